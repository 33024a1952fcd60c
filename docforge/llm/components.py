"""Connected components of a table of links, by alternating large and small stars; nothing of it comes to the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of links(u, v) but those that are their component's smallest, which is the label.

    Rounds go on until nothing changes; their number grows with the logarithm of the largest component.
    """
    e = materialise(links.filter("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        new = materialise(_small_star(_large_star(e)), "components")
        discard(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
