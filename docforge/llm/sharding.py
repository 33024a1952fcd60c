"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Group sizes keep this many leading bits, so that the driver sees at most a few hundred thousand size classes whatever the input.
SIZE_BITS = 13
#: Rows of one block when places are numbered.
BLOCK_ROWS = 20_000


class Tree:
    """A treap of (remaining capacity, bin), for the tightest bin that still fits: insert, remove and successor in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes below key, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def insert(self, key: tuple) -> None:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % 2**64
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.seed >> 11, None, None]), right)

    def take(self, least: tuple) -> tuple | None:
        """Removes and returns the smallest key from least on."""
        left, right = self._split(self.root, least)
        above, t = [], right
        while t is not None and t[2] is not None:
            above.append(t)
            t = t[2]
        if t is None:
            self.root = left
            return None
        if above:
            above[-1][2] = t[3]
            t[3], top = None, above[0]
        else:
            top = t[3]
        self.root = self._merge(left, top)
        return t[0]


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> tuple[list[list[tuple[int, int]]], int] | None:
    """Packs count items of each size, given by falling size, into bins of a capacity.

    Each item goes to the bin with the least room that still holds it; a run of equal
    items is placed at once, which gives the same packing. Returns for each size its
    runs (bin, count) and the number of bins; None if more than `bins` would be needed.
    """
    tree, used, out = Tree(), 0, []
    for size, count in sizes:
        if size > capacity:
            return None
        runs = []
        while count:
            if (spot := tree.take((size, -1))) is None:
                if bins is not None and used >= bins:
                    return None
                spot, used = (capacity, used), used + 1
            n = min(count, spot[0] // size)
            runs.append((spot[1], n))
            count -= n
            tree.insert((spot[0] - n * size, spot[1]))
        out.append(runs)
    return out, used


def least_capacity(sizes: list[tuple[int, int]], bins: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """The smallest capacity, up to 0.01 %, at which best fit decreasing needs no more than `bins`."""
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // bins), max((s for s, _ in sizes), default=1), 1)
    high = low
    while (found := best_fit(sizes, high, bins)) is None:
        low, high = high + 1, high + max(1, high // 16)
    best = (high, found[0])
    while high - low > low // 10_000:
        mid = (low + high) // 2
        if (found := best_fit(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            best, high = (mid, found[0]), mid
    return best


def pack_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs(doc_id, text, ...).

    The law is `bytes`: groups of equal texts, by falling size, go by best fit into
    shards of the least capacity that suffices. Null texts are one group of 8 bytes a row, whose
    crc32 is that of the empty text. A group larger than an even share can't be whole
    in any near-equal layout; it is cut by a hash of the row into parts of at most an eighth of a share.
    Ties and repeated rows take different slots. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = materialise(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("\x00null")).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    per_text = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    share = max(1, total // n_shards)
    # Fewer than n_shards texts can be larger than a share, so this list is bounded.
    giants = per_text.filter(F.col("bytes") > share).withColumn("parts", F.ceil(F.col("bytes") * 8 / share)).select("digest", "parts")
    cut = rows.join(F.broadcast(giants), "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), "parts"), F.lit(0))).drop("parts")
    groups = cut.groupBy("digest", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    drop = f"greatest(0, length(bin(bytes)) - {SIZE_BITS})"
    groups = materialise(groups.withColumn("class", F.expr(f"shiftleft(shiftright(bytes - 1, {drop}) + 1, {drop})")), "shard-groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(((r["class"], r["n"]) for r in classes.toLocalIterator()), reverse=True)
    _, placed = least_capacity(found, n_shards)
    runs = []
    for (cls, _), at in zip(found, placed, strict=True):
        start, starts, shards = 0, [], []
        for b, n in at:
            starts.append(start)
            shards.append(b)
            start += n
        runs.append((cls, starts, shards))
    plan = docs.sparkSession.createDataFrame(runs, "class long, starts array<long>, shards array<int>")
    n_blocks = max(1, -(-sum(n for _, n in found) // BLOCK_ROWS))
    ranked = _numbered(groups.withColumn("block", F.pmod(F.xxhash64("digest", "part"), F.lit(n_blocks))), "class", ["digest", "part"], "rank")
    where = ranked.join(F.broadcast(plan), "class").select(
        "digest", "part", F.expr("element_at(shards, size(filter(starts, s -> s <= rank)))").alias("shard")
    )
    n_rows = rows.count()
    dealt = cut.join(where, ["digest", "part"]).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n_rows // BLOCK_ROWS)))))
    return _numbered(dealt, "shard", ["row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps: within blocks first, so that a hot key is spread, then the blocks' counts are summed."""
    within = Window.partitionBy(key, "block").orderBy(*order)
    local = df.withColumn("_n", F.row_number().over(within) - 1)
    counts = df.groupBy(key, "block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return local.join(offsets, [key, "block"]).withColumn(name, (F.col("_n") + F.col("_o")).cast("long")).drop("_n", "_o", "block")
