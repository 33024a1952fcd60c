"""A quality classifier: learned vectors of hashed words and character n-grams, averaged per document, with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, materialise, small_batches
from .words import SPACE, is_long, mixed, parts_of, pieces, split, sums

BUCKETS = 1 << 17
SIZES = (3, 4)
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
#: The classifier is fitted on so many labelled documents at most, those whose hashed id comes first.
SAMPLE = 4_000
#: And on so many bytes of their features at most: the driver never holds more, however long documents are.
SAMPLE_BYTES = 96 << 20
THRESHOLD = 0.3


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, for label 1 against label 0
    bias: float


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word: itself and the n-grams of its bytes between marks; and where each word's begin (one more at the end)."""
    size = np.asarray(pc.binary_length(words)).astype(np.int64) + 2
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    ends = np.cumsum(size)
    begins = ends - size
    of = np.repeat(np.arange(len(words)), size)
    power = np.uint64(0x100000001B3)
    # The whole word: its bytes, each with a weight by its place.
    place = mixed((np.arange(len(data)) - begins[of]).astype(np.uint64) + np.uint64(77))
    keys, owners = [np.add.reduceat(mixed(data + np.uint64(1)) * (place | np.uint64(1)), begins)] if len(words) else [np.zeros(0, np.uint64)], [np.arange(len(words))]
    for n in SIZES:
        h = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * power + data[k : k + len(h)]
        whole = np.flatnonzero(np.arange(len(h)) + n <= ends[of[: len(h)]])
        keys.append(h[whole])
        owners.append(of[whole])
    key, owner = mixed(np.concatenate(keys)), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (key[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


def document_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their weights in its average over words."""
    if is_long(texts):
        total, n = np.zeros(BUCKETS), 0
        for part in parts_of(texts[0].as_py(), SPACE):
            words, codes, _ = split(pa.array([part]), lower=False)
            buckets, at = features(words)
            each = np.bincount(codes, minlength=len(words)) / np.maximum(1, np.diff(at))
            total += np.bincount(buckets, np.repeat(each, np.diff(at)), BUCKETS)
            n += len(codes)
        distinct = np.flatnonzero(total)
        yield distinct, total[distinct] / max(1, n)
        return
    words, codes, begins = split(texts, lower=False)
    buckets, at = features(words)
    for d in range(len(texts)):
        kinds, times = np.unique(codes[begins[d] : begins[d + 1]], return_counts=True)
        own = [buckets[at[w] : at[w + 1]] for w in kinds]
        if not own:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        weight = np.repeat(times / times.sum() / np.array([len(x) for x in own]), [len(x) for x in own])
        distinct, where = np.unique(np.concatenate(own), return_inverse=True)
        yield distinct, np.bincount(where, weight)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss, document by document. Without labels the score is a half, with one label near it."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            at, weight, label = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = weight @ vectors[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # A document's average spreads its gradient thinly; it is scaled by the weights' norm, so that long texts teach as much as short ones.
            vectors[at] -= np.outer(weight * (rate / max(weight @ weight, 1e-12)) * min(1.0, 20 * (weight @ weight)), back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled documents that are not held out, at most `sample` of them and SAMPLE_BYTES: a bounded driver table whatever the input."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                at, weight = zip(*document_features(part), strict=True)
                cut = b.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("quality"), pa.array([x.astype(np.int32).tobytes() for x in at], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in weight], pa.binary())],
                    ["doc_id", "quality", "at", "weight"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").cast("int").alias("quality"))
    table = materialise(rows.mapInArrow(run, f"doc_id {kind}, quality int, at binary, weight binary"), "quality-samples")
    # At most `sample` sizes come to the driver, then features within the bound.
    sizes = table.select("doc_id", (F.length("at") + F.length("weight")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept = [r["doc_id"] for r, total in zip(sizes, np.cumsum([r["size"] for r in sizes]), strict=True) if total <= SAMPLE_BYTES]
    got = table.filter(F.col("doc_id").isin(kept)).toArrow().sort_by("doc_id").to_pylist() if kept else []
    discard(table)
    return train([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["weight"], np.float32).astype(float), r["quality"]) for r in got])


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1. The output is linear in the average, so each distinct word needs its weight once."""
    if is_long(texts):
        total = n = 0
        for part in parts_of(texts[0].as_py(), SPACE):
            words, codes, _ = split(pa.array([part]), lower=False)
            total, n = total + _of_words(words, model)[codes].sum(), n + len(codes)
        z = np.array([total / max(1, n)])
    else:
        words, codes, begins = split(texts, lower=False)
        z = sums(_of_words(words, model)[codes], begins) / np.maximum(1, np.diff(begins))
    return 1 / (1 + np.exp(-np.clip(z + model.bias, -50, 50)))


def _of_words(words: pa.Array, model: Model) -> np.ndarray:
    buckets, at = features(words)
    return sums(model.weight[buckets], at) / np.maximum(1, np.diff(at))


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text, ...), learned from labels(doc_id, quality, ...).

    Null and empty texts get the score of the bias alone. Rows are scored alone: repeated
    rows repeat, a null doc_id is held out, an empty table stays empty, other columns don't matter. A long text is cut at
    white space, which changes nothing. Labels other than 0 and 1 are left
    out; of several labels of a document the higher counts, and of several texts the first. Without labels each score is a half.
    """
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                s = score_texts(part, shared.value)
                cut = b.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
