"""Language identification as mixture inference.

Each language is a multinomial over hashed letter trigrams. A document is a mixture of
languages whose proportions are found by expectation-maximisation; which languages take part is
decided by penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .words import NO_LETTER, is_long, letters, parts_of, pieces, sums

BUCKETS = 1 << 16
SMOOTHING = 0.05
#: A language that takes part has at least this share.
LEAST_SHARE = 0.05
ROUNDS = 60
#: Elements of a table of trigrams by languages that are held at a time.
TABLE = 1 << 19


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # a row for each bucket, a column for each language; 256 KB a language


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around letters, how often each counts, and where each text's begin (one more at the end).

    Each letter gives a bucket that counts once, but in a long text, which is cut, each bucket stands once with its count.
    """
    if is_long(texts):
        n = np.zeros(BUCKETS, np.int64)
        for part in parts_of(texts[0].as_py(), NO_LETTER):
            n += np.bincount(_grams(pa.array([part]))[0], minlength=BUCKETS)
        kinds = np.flatnonzero(n)
        return kinds, n[kinds], np.array([0, len(kinds)])
    grams, begins = _grams(texts)
    return grams, np.ones(len(grams), np.int64), begins


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    points, begins = letters(texts)
    p = points.astype(np.uint64)
    at = np.flatnonzero(p)  # never the first or the last: those are 0
    h = p[at - 1] * np.uint64(0x9E3779B97F4A7C15) + p[at] * np.uint64(0xC2B2AE3D27D4EB4F) + p[at + 1] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64), np.append(np.searchsorted(at, begins), len(at))


def fit(docs: DataFrame) -> Model:
    """Counts the trigrams of all rows with a language that are not held out; each task sums its rows before it sends them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for start, part in pieces(b.column("text")):
                grams, times, begins = trigrams(part)
                here = langs[start : start + len(part)]
                names = {x: k for k, x in enumerate(dict.fromkeys(here))}
                of = np.repeat(np.array([names[x] for x in here]), np.diff(begins))
                n = np.bincount(of * BUCKETS + grams, times, minlength=len(names) * BUCKETS).astype(np.int64).reshape(-1, BUCKETS)
                for x, k in names.items():
                    seen[x] = seen[x] + n[k] if x in seen else n[k]
        for x, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})
            if not len(at):  # a language without letters is known all the same
                yield pa.RecordBatch.from_pydict({"lang": pa.array([x], pa.string()), "bucket": pa.array([0], pa.int32()), "n": pa.array([0], pa.int64())})

    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    known = coded.dictionary.to_pylist()
    names = sorted(known)
    column = np.array([names.index(x) for x in known], np.int64)
    table = np.full((BUCKETS, len(names)), SMOOTHING, np.float32)
    if names:  # each pair of a language and a bucket stands once
        table[np.asarray(counts.column("bucket")), column[np.asarray(coded.indices)]] += np.asarray(counts.column("n"))
    return Model(names, np.log(table / table.sum(0, dtype=np.float64)).astype(np.float32))


def mixture(p: np.ndarray, n: np.ndarray, first: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns of p, likelihoods of the distinct trigrams that occur n times) and their log-likelihood.

    Starts from all languages given; as long as leaving one out costs less than its
    penalty of half the logarithm of the document's length, the smallest goes. `first` stays.
    """

    def em(use: np.ndarray) -> tuple[np.ndarray, float]:
        q, share = p[:, use], np.full(len(use), 1 / len(use))
        for _ in range(ROUNDS if len(use) > 1 else 0):
            part = q * share
            part *= (n / part.sum(1))[:, None]
            new = part.sum(0) / n.sum()
            small = np.abs(new - share).max() < 1e-4
            share = new
            if small:
                break
        return share, float(n @ np.log(q @ share))

    use, penalty = np.arange(p.shape[1]), 0.5 * np.log(n.sum())
    share, like = em(use)
    while len(use) > 1:
        drop = min((k for k in range(len(use)) if use[k] != first), key=lambda k: share[k])
        fewer, like_fewer = em(np.delete(use, drop))
        if share[drop] >= LEAST_SHARE and like - penalty > like_fewer:
            break
        use, share, like = np.delete(use, drop), fewer, like_fewer
    out = np.zeros(p.shape[1])
    out[use] = share
    return out, like


def infer(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of languages of each text.

    Most texts have one language, and no mixture is worth its penalty: the likelihood is concave in
    a second language's share, so if it falls at the least share, EM isn't needed.
    """
    grams, times, begins = trigrams(texts)
    n, k = len(texts), len(model.languages)
    size = np.diff(begins)
    if not k:
        return ["und"] * n, np.zeros(n), np.zeros(n, np.int32)
    single, rise = np.zeros((n, k)), np.zeros((n, k))
    # Some texts at a time, so that tables of their trigrams by languages stay small however many languages there are.
    stops = np.unique(np.append(np.searchsorted(begins, np.arange(0, begins[-1], max(1, TABLE // k))), n))
    for low, high in zip(np.append(0, stops[:-1]), stops, strict=True):
        part = slice(begins[low], begins[high])
        log_p = model.log_p[grams[part]].astype(np.float64)
        single[low:high] = sums(log_p * times[part, None], begins[low : high + 1] - begins[low])
        first = np.repeat(single[low:high].argmax(1), size[low:high])
        ratio = np.exp(log_p - log_p[np.arange(len(log_p)), first][:, None]) - 1
        rise[low:high] = sums(times[part, None] * ratio / (1 + LEAST_SHARE * ratio), begins[low : high + 1] - begins[low])
    best = single.argmax(1)
    posterior = 1 / np.exp(single - single.max(1, keepdims=True)).sum(1)
    rise[np.arange(n), best] = 0
    share, many = np.ones(n), np.where(size > 0, 1, 0).astype(np.int32)
    for d in np.flatnonzero((rise > 0).any(1) & (size > 0)):
        use = np.flatnonzero((rise[d] > 0) | (np.arange(k) == best[d]))
        kinds, where = np.unique(grams[begins[d] : begins[d + 1]], return_inverse=True)
        counts = np.bincount(where, times[begins[d] : begins[d + 1]])
        shares, _ = mixture(np.exp(model.log_p[np.ix_(kinds, use)].astype(np.float64)), counts, int(np.flatnonzero(use == best[d])[0]))
        best[d], share[d], many[d] = use[shares.argmax()], shares.max(), (shares > 0).sum()
    return [model.languages[b] if s else "und" for b, s in zip(best, size, strict=True)], np.where(size > 0, share * posterior, 0), many


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_languages for every row of docs(doc_id, text, lang, ...).

    score is the language's share of the text times its posterior against the other
    languages. Null texts and those without a letter are `und` with score 0, as is every text if no row
    has a language to learn from. Ties go to the language first by name; repeated rows repeat; a null
    doc_id is held out; an empty table stays empty. Other columns don't matter. A long text is cut where there
    is no letter, which changes nothing.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                names, score, many = infer(part, shared.value)
                cut = b.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int32())],
                    ["doc_id", "held_out", "lang_pred", "score", "n_languages"],
                )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_languages int")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language scores `least` or more.

    Null texts and those without a letter go; if no row has a language to learn from, all others stay, and so does a null doc_id or a repeated row.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                if model_languages:
                    _, score, many = infer(part, shared.value)
                    stay = (many > 0) & (score >= least)
                else:
                    stay = np.diff(trigrams(part)[2]) > 0
                yield b.slice(start, len(part)).filter(pa.array(stay))

    model_languages = len(model.languages)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
