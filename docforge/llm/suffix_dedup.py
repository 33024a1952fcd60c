"""Removal of repeated 100-byte strings by a sparse suffix array that is merged across tasks.

Suffixes start at anchors: bytes whose 32-byte gram has the least hash of 64 successive ones.
Equal 100-byte strings have an anchor at the same place, so suffixes at anchors, with the bytes
before them, show every repeat. Tasks sort their suffixes into runs and send them front-coded, each without
the prefix it shares with the one before; loser trees merge the runs and never compare a prefix
again that is known to be common. In merged order, strings of any split into
bytes before and after the anchor are equal where both neighbours' common prefixes are long enough.
Suffixes with the same gram meet in one merging task. Where a gram is too frequent for that, as at the edges of a passage that very many
texts have, its suffixes that no run shows to be equal are compared by an aggregation instead, which has no limit: one key for each split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, join_spread, materialise, small_batches, split_by
from .words import mixed

LENGTH, GRAM, WINDOW = 100, 32, 64
#: Bytes before an anchor that a 100-byte string can have.
BEFORE = WINDOW - 1
#: Bits of the filter of grams that occur twice. It is broadcast (8 MB); when it is full, more suffixes are sent and the result is the same.
FILTER_BITS = 26
#: Suffixes of a run, and of one merging task.
RUN, MERGE = 100_000, 150_000
#: Grams that aren't merged are at most so many, and each has more suffixes than a merging task.
MOST_HOT = 1_000_000
#: Suffixes whose splits are hashed at a time.
SPLITS = 4_000
#: Bytes that are hashed at a time; longer texts are cut with overlap.
PIECE = 1 << 20
KEY = LENGTH + 1 + BEFORE + 1
NO_ID = 2**63 - 1

_table = mixed(np.arange(1, 257, dtype=np.uint64))


def _slide(values: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """take over all windows of a width that is a power of two."""
    step = 1
    while step < width:
        values = take(values[:-step], values[step:])
        step *= 2
    return values


def _grams(data: np.ndarray) -> np.ndarray:
    h, step = _table[data], 1
    while step < GRAM:
        h = h[:-step] * (_table[step] | np.uint64(1)) + h[step:]
        step *= 2
    return mixed(h)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of texts: the bytes, where each text's begin (one more at the end), the anchors' places in the bytes, and their hashes.

    A text longer than a piece comes alone.
    """
    batch: list[bytes] = []

    def found() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(batch), np.uint8)
        begins = np.append(0, np.cumsum([len(t) for t in batch]))
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start in range(0, len(data), PIECE):
            # With what windows to either side can reach, so that cuts change nothing.
            low, high = max(0, start - WINDOW), min(len(data), start + PIECE + WINDOW + GRAM)
            if high - low < GRAM + WINDOW:
                continue
            h = _grams(data[low:high])
            least = np.pad(_slide(h, WINDOW, np.minimum), BEFORE)
            at = np.flatnonzero(_slide(least, WINDOW, np.maximum) == h) + low
            at = at[(at >= start) & (at < start + PIECE)]
            places.append(at)
            hashes.append(h[at - low])
        at, h = np.concatenate(places), np.concatenate(hashes)
        whole = at + GRAM <= begins[np.searchsorted(begins, at, "right")]
        return data, begins, at[whole], h[whole]

    size = 0
    for t in texts:
        if batch and size + len(t) > PIECE:
            yield found()
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield found()


def _repeated(docs: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """The filter of grams at anchors that occur at least twice in the table, how many occurrences those have, and the grams that are too frequent to be merged, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, h in anchors(b.column("bytes").to_pylist()):
                kinds, times = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], ["gram", "n"])

    twice = docs.select("bytes").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    twice = materialise(twice, "suffix-grams")
    bit = F.pmod("gram", F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1
    slabs = twice.groupBy(F.bitmap_bucket_number(bit).alias("slab")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"), F.sum("n").alias("n"))
    out, total = np.zeros(1 << FILTER_BITS - 3, np.uint8), 0
    for r in slabs.toLocalIterator():
        start = (r["slab"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bitmap"], np.uint8)
        total += r["n"]
    hot = twice.filter(F.col("n") > max(MERGE, total // MOST_HOT)).select("gram").toArrow().column("gram")
    return out, total, np.sort(np.asarray(hot).astype(np.int64).view(np.uint64))


def contexts(data: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of KEY bytes for each anchor: the 100 bytes from it on, how many there are, the bytes before it from the last to the first, how many."""
    out = np.zeros((len(at), KEY), np.uint8)
    after, before = np.minimum(high - at, LENGTH), np.minimum(at - low, BEFORE)
    steps = np.arange(LENGTH)
    out[:, :LENGTH] = data[np.minimum(at[:, None] + steps, len(data) - 1)] * (steps < after[:, None])
    steps = np.arange(BEFORE)
    out[:, LENGTH + 1 : -1] = data[np.maximum(at[:, None] - 1 - steps, 0)] * (steps < before[:, None])
    out[:, LENGTH], out[:, -1] = after, before
    return out


def reach(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and most bytes before the anchor that a 100-byte string around it can have in its text."""
    return LENGTH - key[:, LENGTH].astype(np.int64), key[:, -1].astype(np.int64)


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; none for the first."""
    out = np.zeros(len(keys), np.int64)
    differ = keys[1:] != keys[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


class LoserTree:
    """Merges sorted runs of front-coded keys. Each run's head carries the length of the prefix it shares with the last key that was put out; between heads only what lies beyond it is compared."""

    def __init__(self, runs: list[tuple[np.ndarray, bytes]]) -> None:
        self.runs = [iter(self._decoded(lcp, tails)) for lcp, tails in runs]
        n = 1
        while n < len(runs):
            n *= 2
        self.n = n
        self.heads = [next(r, None) for r in self.runs] + [None] * (n - len(runs))
        self.shared = [0] * n
        self.losers = [0] * n
        winners = [0] * n + list(range(n))
        for k in range(n - 1, 0, -1):
            winners[k], self.losers[k] = self._play(winners[2 * k], winners[2 * k + 1])
        self.winner = winners[1]

    @staticmethod
    def _decoded(lcp: np.ndarray, tails: bytes) -> Iterator[tuple[bytes, int]]:
        key, at = b"", 0
        for n in lcp.tolist():
            size = KEY - n
            key = key[:n] + tails[at : at + size]
            at += size
            yield key, n

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[0][p:], y[0][p:]
        if s == t:
            first, last = min(a, b), max(a, b)
            self.shared[last] = KEY
            return first, last
        n = p + len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
        win, lose = (a, b) if s < t else (b, a)
        self.shared[lose] = n
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """Run, key and shared length with the key before, in order."""
        while (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield w, head[0], self.shared[w]
            new = self.heads[w] = next(self.runs[w], None)
            self.shared[w] = new[1] if new else 0
            k = (w + self.n) // 2
            while k:
                w, self.losers[k] = self._play(w, self.losers[k])
                k //= 2
            self.winner = w


def packed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def repeats(keys: np.ndarray, lcp: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys in order: which lie in strings that an anchor of lower rank has too, and the least and most bytes before the anchor of such strings.

    For each number of bytes before the anchor, keys have the same string if they are in the same
    class by what comes after, and by what comes before.
    """
    n = len(keys)
    least, most = reach(keys)
    alike = lcp >= LENGTH - BEFORE
    some = np.flatnonzero(alike | np.append(alike[1:], False))
    low, high = np.full(n, BEFORE + 1), np.full(n, -1)
    if len(some):
        before = np.ascontiguousarray(keys[some, LENGTH + 1 : -1])
        by_left = np.argsort(before.view(f"S{BEFORE}").ravel(), kind="stable")
        left_shared = common_prefixes(before[by_left])
        right_shared = _between(lcp, some)
        order = np.argsort(rank[some], kind="stable")
        left = np.empty(len(some), np.int64)
        for d in range(BEFORE + 1):
            fits = (least[some] <= d) & (most[some] >= d)
            right = np.cumsum(right_shared < LENGTH - d)
            left[by_left] = np.cumsum(left_shared < d)
            key = (right * (len(some) + 1) + left)[order]
            there = np.flatnonzero(fits[order])
            first = np.unique(key[there], return_index=True)[1]
            again = np.ones(len(there), bool)
            again[first] = False
            hit = some[order[there[again]]]
            low[hit] = np.minimum(low[hit], d)
            high[hit] = np.maximum(high[hit], d)
    found = high >= 0
    return found, low, high


def _between(lcp: np.ndarray, some: np.ndarray) -> np.ndarray:
    """What each chosen key shares with the chosen one before: the least of the shared lengths from there on."""
    return np.minimum.reduceat(lcp[: some[-1] + 1], np.append(0, some[:-1] + 1))


SPANS = "owner long, mark long, start int, stop int"
RUNS = "part int, n int, lcp binary, tails binary, owner binary, mark binary, place binary, gone binary"


def _runs(docs: DataFrame, bitmap: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """Sorted, front-coded runs of suffixes, one for each merging task, with a share of the spans that the run itself shows to be repeated.

    Suffixes with a hot gram are a run of their own, with -1 as the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    frequent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, grams, owner, mark, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((place, mark, owner))
            order = order[np.argsort(keys.view(f"S{KEY}").ravel()[order], kind="stable")]
            keys, grams, owner, mark, place = keys[order], grams[order], owner[order], mark[order], place[order]
            again = common_prefixes(keys) == KEY
            least, most = reach(keys)
            gone = np.flatnonzero(again & (least <= most))
            spans = np.stack([owner[gone], mark[gone], place[gone] - most[gone], place[gone] - np.maximum(least[gone], 0) + LENGTH], 1)
            stay = np.flatnonzero(~again & (least <= most))
            part = np.where(np.isin(grams, frequent.value), -1, (grams % np.uint64(parts)).astype(np.int64))
            stay = stay[np.argsort(part[stay], kind="stable")]
            cuts = np.append(np.flatnonzero(np.diff(part[stay], prepend=-2)), len(stay))
            rows = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                own = stay[a:b]
                lcp = common_prefixes(keys[own])
                tails = keys[own][np.arange(KEY) >= lcp[:, None]].tobytes()
                own_spans = spans[k * len(spans) // (len(cuts) - 1) : (k + 1) * len(spans) // (len(cuts) - 1)]
                rows.append((int(part[own[0]]), len(own), lcp.astype(np.uint8).tobytes(), packed(tails), owner[own].tobytes(), mark[own].tobytes(), place[own].astype(np.int32).tobytes(), packed(own_spans.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            owners, marks = b.column("owner").to_numpy(), b.column("mark").to_numpy()
            first = 0
            for data, begins, at, h in anchors(b.column("bytes").to_pylist()):
                bit = h & np.uint64((1 << FILTER_BITS) - 1)
                may = shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                at, h = at[may], h[may]
                of = np.searchsorted(begins, at, "right") - 1
                for k in range(0, len(at), 20_000):
                    s, o = at[k : k + 20_000], of[k : k + 20_000]
                    held.append((contexts(data, begins[o], begins[o + 1], s), h[k : k + 20_000], owners[first + o], marks[first + o], s - begins[o]))
                    if sum(len(x[1]) for x in held) >= RUN:
                        yield from flush()
                first += len(begins) - 1
        if held:
            yield from flush()

    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return docs.mapInArrow(run, RUNS)


def _merge(b: pd.DataFrame) -> pd.DataFrame:
    """Spans repeated among the runs of one merging task, and those that came with them."""
    owner, mark, place = (np.concatenate([np.frombuffer(x, t) for x in b[c]]) for c, t in (("owner", np.int64), ("mark", np.int64), ("place", np.int32)))
    at = np.append(0, np.cumsum(b["n"])).astype(np.int64).tolist()
    order, lcp, keys = [], [], bytearray()
    for w, key, shared in LoserTree([(np.frombuffer(x, np.uint8), t) for x, t in zip(b["lcp"], map(unpacked, b["tails"]), strict=True)]):
        order.append(at[w])
        at[w] += 1
        lcp.append(shared)
        keys += key
    owner, mark, place = owner[order], mark[order], place[order].astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((place, mark, owner))] = np.arange(len(order))
    found, low, high = repeats(np.frombuffer(bytes(keys), np.uint8).reshape(-1, KEY), np.array(lcp, np.int64), rank)
    spans = np.concatenate([np.stack([owner[found], mark[found], (place - high)[found], (place - low + LENGTH)[found]], 1), *(np.frombuffer(unpacked(x), np.int64).reshape(-1, 4) for x in b["gone"])])
    return pd.DataFrame({"owner": spans[:, 0], "mark": spans[:, 1], "start": spans[:, 2].astype(np.int32), "stop": spans[:, 3].astype(np.int32)})


def split_keys(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of bytes before the anchor: which keys have a 100-byte string with it, and two hashes of that string."""
    least, most = reach(keys)
    hashes = []
    for seed in (1, 2):
        factor = _table[seed] | np.uint64(1)
        after, before = np.zeros((LENGTH + 1, len(keys)), np.uint64), np.zeros((BEFORE + 1, len(keys)), np.uint64)
        for k in range(LENGTH):
            after[k + 1] = after[k] * factor + _table[keys[:, k]]
        for k in range(BEFORE):
            before[k + 1] = before[k] * factor + _table[keys[:, LENGTH + 1 + k]]
        hashes.append((after, before, factor))
    for d in range(BEFORE + 1):
        fits = np.flatnonzero((least <= d) & (most >= d))
        x, y = (mixed(mixed(after[LENGTH - d][fits] + np.uint64(d)) * factor + before[d][fits]) for after, before, factor in hashes)
        yield fits, x, y


def _compared(hot: DataFrame) -> DataFrame:
    """The spans of suffixes with hot grams: for each split, all but the first of equal strings are repeats; and the spans that came with them."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tails, lcp = unpacked(r["tails"]), np.frombuffer(r["lcp"], np.uint8)
                keys = np.frombuffer(b"".join(k for k, _ in LoserTree._decoded(lcp, tails)), np.uint8).reshape(-1, KEY)
                owner, mark, place = (np.frombuffer(r[c], t) for c, t in (("owner", np.int64), ("mark", np.int64), ("place", np.int32)))
                for at in range(0, len(keys), SPLITS):
                    own = slice(at, at + SPLITS)
                    for d, (fits, x, y) in enumerate(split_keys(keys[own])):
                        if len(fits):
                            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(owner[own][fits]), pa.array(mark[own][fits]), pa.array(place[own][fits]), pa.array(np.full(len(fits), d, np.int32))], ["x", "y", "owner", "mark", "place", "d"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("gone").to_pylist():
                spans = np.frombuffer(unpacked(x), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(spans[:, 2].astype(np.int32)), pa.array(spans[:, 3].astype(np.int32))], ["owner", "mark", "start", "stop"])

    strings = hot.mapInArrow(listed, "x long, y long, owner long, mark long, place int, d int")
    place = F.struct("owner", "mark", "place")
    first = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    first = materialise(first, "suffix-first")
    again = join_spread(strings, first, ["x", "y"], "n", "mark").filter(place > F.col("first"))
    found = again.groupBy("owner", "mark", "place").agg((F.col("place") - F.max("d")).alias("start"), (F.col("place") - F.min("d") + LENGTH).alias("stop"))
    return found.select("owner", "mark", "start", "stop").unionByName(hot.mapInArrow(sent, SPANS))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """owner, mark, start, stop: byte ranges of docs(owner, mark, bytes) whose 100-byte strings start earlier too. Ranges of a text may overlap."""
    bitmap, total, hot = _repeated(docs)
    runs = _runs(docs, bitmap, hot, max(1, -(-total // MERGE)))
    if not len(hot):
        return runs.groupBy("part").applyInPandas(_merge, SPANS)
    runs = materialise(runs, "suffix-runs", compression="none")
    return runs.filter("part >= 0").groupBy("part").applyInPandas(_merge, SPANS).unionByName(_compared(runs.filter("part = -1")))


def _once(docs: DataFrame) -> DataFrame:
    """The distinct rows of docs(owner, mark, bytes); only rows that a bit filter of repeated keys can't clear are shuffled."""
    again = materialise(docs.groupBy("owner", "mark").count().filter("count > 1").select("mark"), "suffix-again")
    may, clear = split_by(docs, "mark", bit_filter(again, "mark"))
    return clear.unionByName(may.distinct())


def _text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs(doc_id, text, ...).

    Each byte in a 100-byte string that also starts earlier, in a document of smaller id or
    earlier in the same one, is removed; strings are judged on the input. Null texts are empty, a null doc_id comes last. Rows
    that repeat both doc_id and text are one document, and come out alike; of rows with an
    id and different texts, one is the earlier. Long texts are hashed in pieces. An empty table gives an empty result; other columns don't matter.
    """
    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("owner"), _text_mark().alias("mark"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    spans = repeated_spans(_once(keyed.select("owner", "mark", "bytes"))).groupBy("owner", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialise(spans, "suffix-spans")
    may, whole = split_by(keyed, "mark", bit_filter(spans, "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("bytes"), b.column("spans"), strict=True):
                t, merged = text.as_py(), []
                for s, e in sorted((x["start"], x["stop"]) for x in spans.as_py() or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                digest, at = hashlib.sha256(), 0
                for s, e in merged:
                    digest.update(t[at:s])
                    at = e
                digest.update(t[at:])
                rows.append((len(t), sum(e - s for s, e in merged), len(merged), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = may.join(spans, ["owner", "mark"], "left").select("doc_id", "bytes", "spans")
    return cut.unionByName(whole.select("doc_id", "bytes", F.lit(None).cast(cut.schema["spans"].dataType).alias("spans"))).select("doc_id", "bytes", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
