"""A similarity join of shingle sets in the metric space of the Jaccard distance.

The space has thousands of dimensions: documents that aren't near copies are at a distance of about 1
from each other and from any few pivots, so regions around document pivots alone separate
nothing. The first pivots therefore are single shingles. A set lies in the
region of its first shingle in a global order, rare shingles first; sets within the radius r share one of
their first n - ceil((1 - r) n) + 1 shingles, and into the regions of those the set is replicated.
Within a region the pivots are documents. All within r of the pivot are linked to it, and so in one component
without being compared. By the triangle inequality, two sets can be linked only if their distances
to the pivot differ by r at most; sets with one of another component in that window
are joined again, with several new pivots: each set lies in the Voronoi region of the nearest one and, as sets within r of each other differ by
2 r at most in how much farther another pivot is, is replicated into those whose pivot is no more than 2 r farther. So
regions are cut until none is left. Before sets are fetched, a small parity sketch
bounds from below in how many elements two sets differ, and pairs too far apart by it are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, discard, join_spread, materialise, small_batches, through, without
from .components import components
from .words import SPACE, hash64, is_long, mixed, parts_of, pieces, split

#: The order has so many buckets of shingles, and levels by how often those repeat that occur twice within so many shingles of a task.
ORDER_BITS = 24
LEVELS = (2, 6, 24, 100)
LOCAL_SHINGLES = 2_000_000
#: Regions are joined in one task up to so many sets and shingles, and block by block beyond.
BLOCK_SETS = 500
BLOCK_SHINGLES = 1_000_000
#: Pivots of the Voronoi regions of a region with more than so many sets; a cut that replicates more than half as many again isn't made.
PIVOTS, WORTH_CUTTING, MOST_REPLICAS = 6, 24, 1.5


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; fewer words make one shingle, no words none."""
    if is_long(texts):
        parts = (split(pa.array([t]), lower=True) for t in parts_of(texts[0].as_py(), SPACE))
        h = np.concatenate([hash64(words)[codes] for words, codes, _ in parts])
        begins = np.array([0, len(h)])
    else:
        words, codes, begins = split(texts, lower=True)
        h = hash64(words)[codes]
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = mixed(rolled)
    for d in range(len(texts)):
        b, e = int(begins[d]), int(begins[d + 1])
        if e - b >= width:
            yield np.unique(rolled[b : e - width + 1])
        elif e > b:
            yield mixed(np.array([(h[b:e] * factors[: e - b]).sum() + np.uint64(e - b)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _order(docs: DataFrame, width: int) -> np.ndarray:
    """How common each bucket of shingles is, on a scale of logarithms. Any table gives right results; a good one keeps regions small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            again = every[1:] == every[:-1]
            # The first of each run of equal shingles that has a second one, and the runs' lengths.
            firsts = np.flatnonzero(again & ~np.append(False, again[:-1]))
            lasts = np.flatnonzero(again & ~np.append(again[1:], False)) + 1
            buckets = (every[firsts] >> np.uint64(64 - ORDER_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array((lasts - firsts + 1).astype(np.int64))], ["bucket", "n"])

        for b in batches:
            for _, part in pieces(b.column("text")):
                held += shingle_sets(part, width)
                if sum(map(len, held)) >= LOCAL_SHINGLES:
                    yield from flush()
        if held:
            yield from flush()

    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    levels = found.select(F.col("bucket") + 1, F.explode(F.expr(f"filter(array({', '.join(map(str, LEVELS))}), t -> n >= t)")).alias("level")).toDF("bit", "level")  # the bitmap functions count from 1
    slabs = levels.groupBy("level", F.bitmap_bucket_number("bit").alias("slab")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in slabs.toLocalIterator():
        start = (r["slab"] - 1) * 32768
        out[start : start + 32768] += np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), bitorder="little")
    return out


def parity(s: np.ndarray) -> bytes:
    """A set's parity sketch: for each of 2**k buckets, more than it has elements, whether it has an odd number there.

    Two sets differ in at least as many elements as their sketches do in bits.
    """
    width = 1 << max(6, len(s).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least; the wider sketch is folded to the narrower."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n > m:
        n //= 2
        x = x >> 8 * n ^ x & (1 << 8 * n) - 1
    while m > n:
        m //= 2
        y = y >> 8 * m ^ y & (1 << 8 * m) - 1
    return (x ^ y).bit_count()


def _keys(docs: DataFrame, order: np.ndarray, percent: int, width: int) -> DataFrame:
    """doc_id, n_shingles, digest and parity sketch of the set, and the shingles whose regions it goes to."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                sizes, digests, sketches, firsts = [], [], [], []
                for s in shingle_sets(part, width):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketches.append(parity(s) if len(s) else None)
                    rank = shared.value[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                    need = len(s) + (-percent * len(s) // 100) + 1 if len(s) else 0
                    firsts.append(np.sort(s[np.lexsort((s, rank))[:need]]).view(np.int64))
                offsets = np.append(0, np.cumsum([len(f) for f in firsts])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, len(part)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))],
                    ["doc_id", "n_shingles", "digest", "parity", "firsts"],
                )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, parity binary, firsts array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("text")):
                found = [s.tobytes() for s in shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, len(part)), pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], ["rep", "digest", "shingles"]
                )

    return docs.mapInArrow(run, f"rep {dict(docs.dtypes)['doc_id']}, digest binary, shingles binary")


def _distances(pairs: DataFrame) -> DataFrame:
    """node, pivot, and the sizes of their sets' intersection and union, for pairs with both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, either = [], []
            for x, y in zip(b.column("shingles"), b.column("pivot_shingles"), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(np.intersect1d(s, t, assume_unique=True))
                both.append(n)
                either.append(len(s) + len(t) - n)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("pivot"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["node", "pivot", "both", "either"])

    return pairs.select("node", "pivot", "shingles", "pivot_shingles").mapInArrow(run, "node long, pivot long, both long, either long")


def _bounds(pairs: DataFrame, percent: int) -> DataFrame:
    """node, pivot, a lower bound of their distance, and whether they may be similar by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.fromiter(map(unlike, b.column("parity").to_pylist(), b.column("pivot_parity").to_pylist()), np.int64, len(b))
            total = b.column("n_shingles").to_numpy() + b.column("pivot_n").to_numpy()
            apart = np.maximum(apart, np.abs(b.column("n_shingles").to_numpy() - b.column("pivot_n").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("pivot"), pa.array(2 * apart / (total + apart)), pa.array((100 + percent) * apart <= (100 - percent) * total)], ["node", "pivot", "away", "may"])

    return pairs.select("node", "pivot", "n_shingles", "pivot_n", "parity", "pivot_parity").mapInArrow(run, "node long, pivot long, away double, may boolean")


def with_partners(size: np.ndarray, sketches: list[bytes], label: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a region may be similar to one that isn't connected to them, by their sketches."""
    least = min(map(len, sketches))
    folded = np.empty((len(size), least), np.uint8)
    for k, x in enumerate(sketches):
        own = np.frombuffer(x, np.uint8)
        while len(own) > least:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        folded[k] = own
    apart = np.zeros((len(size), len(size)), np.float32)
    for at in range(0, least, 128):  # some bits at a time: they take 32 times the room of the sketches
        bits = np.unpackbits(folded[:, at : at + 128], axis=1).astype(np.float32)
        ones = bits.sum(1)
        apart += ones[:, None] + ones - 2 * (bits @ bits.T)
    may = (100 + percent) * np.maximum(apart, np.abs(size[:, None] - size)) <= (100 - percent) * (size[:, None] + size)
    may &= label[:, None] != label
    return may.any(1)


def _to_pivot(pivot: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The distances of sets to a pivot, and which are similar to it."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    both = np.add.reduceat((pivot[at] == flat).astype(np.int64), np.cumsum(size) - size)
    either = size + len(pivot) - both
    return 1 - both / either, 100 * both >= percent * either


def _in_window(away: np.ndarray, of: np.ndarray, radius: float) -> np.ndarray:
    """Which sets have one of another component in the window around their distance to the pivot."""
    order = np.argsort(away, kind="stable")
    there, same = away[order], of[order]
    changes = np.append(0, np.cumsum(same[1:] != same[:-1]))
    low = np.searchsorted(there, there - radius, "left")
    high = np.searchsorted(there, there + radius, "right") - 1
    out = np.zeros(len(away), bool)
    out[order[changes[high] > changes[low]]] = True
    return out


def join_region(nodes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar in a region, where sets of one label are connected already.

    Pivots are compared with all sets of the region and then leave. The others fall into the pivots' Voronoi regions, those
    at a boundary into several; only those stay in whose window of distances to each pivot, as wide as the radius,
    not all sets are connected. Where regions would overlap too much, there is one pivot and no cut.
    """
    links: list[tuple[int, int]] = []
    radius = 1 - percent / 100 + 1e-9
    of = np.unique(label, return_inverse=True)[1]
    todo = [np.arange(len(nodes))]
    while todo:
        here = todo.pop()
        if len(here) < 2 or (of[here] == of[here[0]]).all():
            continue
        pivots = here[np.linspace(0, len(here) - 1, PIVOTS if len(here) > WORTH_CUTTING else 1).astype(int)]
        away = np.empty((len(pivots), len(here)))
        for k, p in enumerate(pivots):
            away[k], near = _to_pivot(sets[p], [sets[x] for x in here], percent)
            # One link for each component that joins the pivot's, not one for each set.
            joined, first = np.unique(of[here[near]], return_index=True)
            links += [(int(nodes[p]), int(nodes[here[near][x]])) for c, x in zip(joined, first, strict=True) if c != of[p]]
            of[np.isin(of, of[here[near]])] = of[p]
        left = ~np.isin(here, pivots)
        here, away = here[left], away[:, left]
        if not len(here):
            continue
        stay = np.all([_in_window(d, of[here], radius) for d in away], 0)
        here, away = here[stay], away[:, stay]
        cells = away <= away.min(0, initial=1) + 2 * radius
        if cells.sum() > MOST_REPLICAS * len(here):
            cells = np.ones((1, len(here)), bool)
        todo += [here[c] for c in cells]
    return links


def _sets_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and shingles for the given nodes: their texts are read and cut into shingles again."""
    involved = materialise(nodes.distinct().join(reps.select("node", "rep", "digest"), "node"), "jaccard-involved")
    texts = through(docs, "doc_id", bit_filter(involved.select(F.col("rep").alias("doc_id")), "doc_id"))
    # A row that repeats its doc_id and set is the same node. The join's partitions serve the aggregate too.
    found = _sets(texts, width).join(involved, ["rep", "digest"]).groupBy("rep", "digest", "node").agg(F.first("shingles").alias("shingles"))
    out = materialise(found.select("node", "shingles"), "jaccard-sets", compression="none")
    discard(involved)
    return out


def _once(members: DataFrame) -> DataFrame:
    """Of regions with the same members one, and none whose members have a single label; members is a written table."""
    same = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sum"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    one = materialise(same.groupBy("n", "low", "high", "sum").agg(F.min("region").alias("region")).select("region", "n"), "jaccard-once")
    return join_spread(members, one, ["region"], "n", "node").drop("n")


def _blocks(members: DataFrame, more: DataFrame) -> DataFrame:
    """members, a written table of regions, with more(node, ...), each region as one block (i = j = 0) or, if it is large, as pairs of blocks of bounded size that meet all others."""
    count = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    counts = materialise(members.groupBy("region").agg(count.alias("blocks"), F.count(F.lit(1)).alias("n")), "jaccard-blocks")
    # Sets and sketches are fetched last: they are sent by node and by block, not by region too.
    dealt = join_spread(members, counts, ["region"], "n", "node").drop("n").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other").join(more, "node")


def _heads(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The first row of each class, as node, of rows(row, digest, ...); both are written tables. Only rows of which a bit filter can't tell that they are first are shuffled with their shingles."""
    repeated = materialise(classes.filter("copies > 1").select("digest", "node", "copies"), "jaccard-repeated")
    copies = through(rows.select("digest", "row"), "digest", bit_filter(repeated, "digest"))
    extra = join_spread(copies, repeated, ["digest"], "copies", "row").filter("row <> node").select("row")
    return without(rows, extra, "row").withColumnRenamed("row", "node")


def linked_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs(doc_id, text, ...).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    `width`-word shingles; component_id is the smallest doc_id that links reach. Null texts and those without
    words have no shingles and link with nothing. A row whose doc_id is null links with nothing and has a
    null component. Equal sets, repeated rows too, are one node; of rows with one id and different texts each has its own set. An empty table gives an empty result;
    other columns don't matter. A long text is cut into words in parts; its set is held whole.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(_keys(docs, _order(docs, width), percent, width).withColumn("row", F.monotonically_increasing_id()), "jaccard-keys")
    able = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is numbered by its first row, whose shingles stay where they were written.
    classes = able.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = materialise(classes, "jaccard-classes")
    heads = _heads(able, reps)
    placed = heads.select("node", "n_shingles", F.explode("firsts").alias("shingle"))
    shared = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")
    shared = materialise(shared, "jaccard-shared")
    # Similar sets differ in size by a factor of 100 / percent at most: each goes into the region of its band of sizes and into the next one's.
    band = F.floor(F.log("n_shingles") / (math.log(100 / percent) + 1e-9))
    banded = through(placed, "shingle", bit_filter(shared, "shingle")).join(shared, "shingle").select("node", "n_shingles", F.explode(F.array(band, band + 1)).alias("band"), "shingle")
    banded = materialise(banded.select("node", "n_shingles", F.xxhash64("shingle", "band").alias("region")), "jaccard-banded")
    regions = banded.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("sum")).filter("n > 1")
    # Near copies share many shingles, and so many regions have the same sets: one of them is joined.
    regions = materialise(regions.groupBy("n", "pivot", "last", "sum").agg(F.min("region").alias("region")).select("region", "n", "pivot"), "jaccard-regions")
    members = materialise(join_spread(through(banded, "region", bit_filter(regions, "region")), regions, ["region"], "n", "node"), "jaccard-members")
    discard(shared, banded)

    sketched = heads.select("node", "n_shingles", "parity")
    pairs = materialise(members.filter("node <> pivot").select("node", "pivot").distinct(), "jaccard-pairs")
    pivots = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).join(sketched.toDF("pivot", "pivot_n", "pivot_parity"), "pivot")
    pivots = materialise(pivots, "jaccard-pivots")
    bounds = materialise(_bounds(join_spread(pairs.join(sketched, "node"), pivots, ["pivot"], "m", "node"), percent), "jaccard-bounds")
    discard(pairs, pivots)
    maybe = bounds.filter("may").select("node", "pivot")
    sets = _sets_of(docs, reps, maybe.select("node").unionByName(maybe.select(F.col("pivot").alias("node"))), width)
    exact = _distances(maybe.join(sets, "node").join(sets.toDF("pivot", "pivot_shingles"), "pivot"))
    exact = exact.select("node", "pivot", F.expr(f"100 * both >= {percent} * either").alias("near"), F.expr("1 - both / either").alias("away"))
    compared = materialise(exact.unionByName(bounds.filter("NOT may").select("node", "pivot", F.lit(False).alias("near"), "away")), "jaccard-compared")
    discard(sets, bounds)

    again = members.filter("n > 2 AND node <> pivot").join(compared, ["node", "pivot"]).select("region", "node", "n_shingles", "near", "away")
    again = materialise(again, "jaccard-again")
    discard(members)
    outside = again.groupBy("region").agg(F.min(F.when(~F.col("near"), F.col("away"))).alias("nearest"), F.count(F.lit(1)).alias("m")).filter("nearest IS NOT NULL")
    outside = materialise(outside, "jaccard-outside")
    # What the pivots have connected needs no other link: regions with a single component are done.
    stars = materialise(components(compared.filter("near").select(F.col("node").alias("u"), F.col("pivot").alias("v"))), "jaccard-stars")
    left = join_spread(again, outside, ["region"], "m", "node").filter(F.expr(f"NOT near OR away >= nearest - {1 - percent / 100} - 1e-9")).select("region", "node", "n_shingles")
    left = materialise(left.join(stars, "node", "left").withColumn("label", F.coalesce("label", "node")), "jaccard-left")
    discard(compared, again, outside)
    left = materialise(_once(left), "jaccard-left-once")

    def pick(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("node")
        return b[with_partners(b["n_shingles"].to_numpy(), list(b["parity"]), b["label"].to_numpy(), percent)][["region", "node", "n_shingles", "label"]]

    picked = _blocks(left, sketched.drop("n_shingles")).groupBy("region", "i", "j").applyInPandas(pick, "region long, node long, n_shingles long, label long")
    picked = materialise(_once(materialise(picked.distinct(), "jaccard-picked")), "jaccard-picked-once")
    dealt = _blocks(picked, _sets_of(docs, reps, picked.select("node"), width))

    def join(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("node").sort_values("node")
        found = join_region(b["node"].to_numpy(), [np.frombuffer(s, np.uint64) for s in b["shingles"]], b["label"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    inner = dealt.groupBy("region", "i", "j").applyInPandas(join, "u long, v long")
    labels = components(stars.toDF("u", "v").unionByName(inner))
    known = reps.select("node", "rep", "digest", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("rep").alias("component"))
    named = materialise(known.join(least, "label").select("digest", "component", "copies"), "jaccard-named")
    linked = join_spread(able.select("doc_id", "n_shingles", "digest"), named, ["digest"], "copies", "doc_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    # A row with an id and no shingles is its own component; one without an id has none.
    return linked.unionByName(rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, but those of documents of which a near copy has a smaller doc_id.

    Rows that share a doc_id go together, null ids, null texts and texts without words stay; an empty table stays empty.
    """
    return without(docs, linked_components(docs, percent, width).filter("doc_id <> component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.doc_id)
SELECT r.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id FROM r JOIN s ON s.doc_id = r.doc_id GROUP BY r.doc_id, s.s
"""
