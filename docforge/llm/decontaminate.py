"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A seed is a fixed mask over a few successive tokens that ignores some positions. The
seeds of all benchmark items meet those of all document positions in a hash join; around each
hit, item and document are laid over each other and their equal tokens counted, so
that overlaps with substituted words are found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, materialise, through, without

#: Five tokens count in each mask, at these places.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 7), (0, 2, 3, 5, 6))
SPAN = 8
#: A mask of four for items of fewer than FULL tokens, where the others leave allowed substitutions without a seed: with it none is left.
EXTRA = (0, 2, 5, 7)
FULL = 16
#: Up to so many seeds (20 bytes each) the benchmark's side is broadcast; beyond, both sides are shuffled.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits; null has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _rotated(h: str, at: str, by: int) -> str:
    word = f"get({h}, {at})"
    return f"(shiftleft({word}, {by}) | shiftrightunsigned({word}, {64 - by}))" if by else word


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """A row for each position and mask of the tokens h: place, key; none where the mask reaches beyond the end.

    A key is the exclusive or of the tokens' hashes, each rotated by its rank in the mask: short
    enough that positions, keys and the join's probe stay in one compiled loop, in which h is never copied.
    """
    keys = [" ^ ".join([f"{k * 0x9E3779B97F4A7}L", *(_rotated("h", f"place + {o}", 11 * rank) for rank, o in enumerate(mask))]) for k, mask in enumerate(masks, 1)]
    places = df.select(*keep, "h", F.explode_outer(F.expr("if(size(h) > 0, sequence(0, size(h) - 1), null)")).alias("place"))
    return places.select(*keep, "h", "place", F.explode_outer(F.expr(f"array({', '.join(keys)})")).alias("key")).filter("key IS NOT NULL")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, window: int = 20) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, doc_start, n_equal, n_window, similarity.

    They overlap if in some window of 20 tokens of the item (of all its tokens, if it is
    shorter), laid over the document, at least four fifths of the tokens are equal; items shorter than
    a seed must occur as they are. The masks leave no allowed substitution without a hit in items of up to 20 tokens, which a test enumerates; longer
    ones have windows of 20. Of several places the best is given, then the first. Null
    and empty texts overlap with nothing, as does a null doc_id; repeated rows count once. Clean documents have no row; a benchmark of more than
    BROADCAST_SEEDS seeds is joined by a shuffle, with the same result.
    """
    ids = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    items = materialise(
        benchmark.select("item_id", tokens(F.col("text")).alias("item")).filter("size(item) > 0 AND item_id IS NOT NULL").dropDuplicates(["item_id", "item"]), "benchmark-tokens"
    )
    short = sorted(r[0] for r in items.select(F.size("item").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    exact = [tuple(range(n)) for n in short]
    long_seeds = _seeds(items.filter(F.size("item") >= SPAN).withColumn("h", F.col("item")), list(MASKS), ["item_id", "item"])
    short_seeds = _seeds(items.filter(F.size("item") < SPAN).withColumn("h", F.col("item")), [*MASKS, *exact], ["item_id", "item"]).filter("place = 0")
    masks = [*MASKS, *exact]
    seeds = long_seeds.select("item_id", "item", "place", "key").unionByName(short_seeds.select("item_id", "item", "place", "key"))
    middle = items.filter(F.size("item").between(SPAN, FULL - 1)).withColumn("h", F.col("item"))
    if not middle.isEmpty():
        masks.append(EXTRA)
        extra = _seeds(middle, masks, ["item_id", "item"])
        seeds = seeds.unionByName(extra.select("item_id", "item", "place", "key"))
    seeds = materialise(seeds.select("item_id", F.col("place").alias("item_place"), "key").distinct(), "benchmark-seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    places = _seeds(ids.select("doc_id", tokens(F.col("text")).alias("h")), masks, ["doc_id"])
    start = F.col("place") - F.col("item_place")
    if small:
        hits = places.join(F.broadcast(seeds), "key")
    else:  # only positions that the filter lets through are sent, and without the tokens, which would travel with each
        times = materialise(seeds.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "benchmark-keys")
        hits = through(places.drop("h"), "key", bit_filter(times, "key")).join(seeds, "key")
    hits = hits.withColumn("start", start)
    items_n = items.select("item_id", "item")
    if small:
        # What lies under the item, from the document's first token on at the earliest.
        under = hits.join(F.broadcast(items_n), "item_id").select(
            "doc_id", "item_id", "start", "item", F.expr("slice(h, greatest(start, 0) + 1, size(item) + least(start, 0))").alias("part")
        )
        under = under.distinct()
    else:
        pairs = hits.select("doc_id", "item_id", "start").distinct().join(items_n, "item_id")
        under = pairs.join(ids.select("doc_id", tokens(F.col("text")).alias("h")), "doc_id").select(
            "doc_id", "item_id", "start", "item", F.expr("slice(h, greatest(start, 0) + 1, size(item) + least(start, 0))").alias("part")
        )
    equal = "zip_with(slice(item, 1 - least(start, 0), size(part)), part, (a, b) -> if(a = b, 1, 0))"
    laid = under.withColumn("equal", F.expr(equal)).withColumn("n_window", F.expr(f"least({window}, size(item))"))
    scored = laid.filter("size(equal) >= n_window").withColumn(
        "best",
        F.expr(
            "array_max(transform(sequence(0, size(equal) - n_window), s -> struct(aggregate(slice(equal, s + 1, n_window), 0, (x, y) -> x + y) as n_equal, -(greatest(start, 0) + s) as minus_start)))"
        ),
    )
    need = F.when(F.size("item") < SPAN, F.size("item")).otherwise(F.ceil(F.col("n_window") * similarity))
    return (
        scored.filter(F.col("best.n_equal") >= need)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("best.n_equal") / F.col("n_window")).alias("similarity"), F.col("best.minus_start").alias("minus_start"), F.col("best.n_equal").alias("n_equal"), "n_window")).alias("b"))
        .select("doc_id", "item_id", (-F.col("b.minus_start")).alias("doc_start"), "b.n_equal", "b.n_window", "b.similarity")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that overlap with an item.

    Rows that share a doc_id go together; a row whose id or text is null stays, as does each repeated clean row, and an empty table stays empty.
    """
    return without(docs, contaminated(docs, benchmark))
