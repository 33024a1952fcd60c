"""Exact deduplication as a log-structured merge index, in DataFrame operations alone.

Each input task is a memtable: it turns its rows into (digest, identifier) entries and
flushes them as one sorted run. The runs' filters, a bit for each digest, are merged into one filter of the bits that
more than one entry has: an entry that it clears occurs once and is done. Compaction
merges the others and keeps, for each digest, the row that stays. Digests with more than one
row are hits: a filter finds their rows again, and their bytes
are compared before the index may call them equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, bit_filter, discard, filter_bits, join_spread, materialise, split_by, through

#: The white space that does not count.
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _mark(text: Column) -> Column:
    """A cheap hash of the text as it is, which finds rows again without their digest."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def flush_runs(docs: DataFrame) -> DataFrame:
    """One sorted run for each task: digest, doc_id, mark, row (position, for repeated rows) and minus_points (what decides who stays)."""
    entries = docs.select(
        _digest(F.col("text")).alias("digest"),
        F.col("doc_id"),
        _mark(F.col("text")).alias("mark"),
        F.monotonically_increasing_id().alias("row"),
        (-F.length(F.coalesce("text", F.lit("")))).alias("minus_points"),
    )
    return materialise(entries.sortWithinPartitions("digest"), "dedup-runs")


def merged_filter(runs: DataFrame) -> BitFilter:
    """The bits that entries of several digests or several entries of one have in common, over all runs. Tasks count their bits before they send them."""
    bits = filter_bits(runs)
    spot = F.pmod(F.xxhash64("digest"), F.lit(1 << bits))
    again = runs.select(spot.alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slabs = again.groupBy(F.bitmap_bucket_number("bit").alias("slab")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    return BitFilter(materialise(slabs, "dedup-filter"), bits)


def compact(entries: DataFrame) -> DataFrame:
    """The merged index, a row for each digest: group_size, and the row that stays. Merging is a minimum, so each task combines before it sends."""
    rank = F.struct("minus_points", F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    return entries.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("stays"))


def verify(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests of hits(digest, mark) and how many different byte strings stand behind each; equal texts fold together before they are sent."""
    found = through(docs.select("text", _mark(F.col("text")).alias("mark")), "mark", bit_filter(hits, "mark"))
    texts = through(found.select(_digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes")), "digest", bit_filter(hits, "digest"))
    return texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, mark, digest, keep_id, group_size and kept of every row."""
    runs = flush_runs(docs)
    may, single = split_by(runs, "digest", merged_filter(runs))
    index = materialise(compact(may), "dedup-index")
    several = index.filter("group_size > 1")
    hits = materialise(join_spread(may, index, ["digest"], "group_size", "row"), "dedup-hits")
    checked = several.select("digest", "group_size").join(verify(docs, hits.filter("group_size > 1").select("digest", "mark")), "digest", "left")
    wrong = checked.filter("n_texts IS NULL OR n_texts > 1").limit(1).collect()
    if wrong:
        raise ValueError(f"different texts share the digest {wrong[0]['digest'].hex()}")
    discard(index)
    told = hits.select("doc_id", "mark", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"))
    return told.unionByName(single.select("doc_id", "mark", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...).

    Null texts are empty; the empty text is a text like any other. Of equal texts the one with the
    most code points stays, then the smallest doc_id, a null id last; of rows
    repeated with their id one stays. Texts are hashed whole, however long. An empty table gives an empty result; other columns don't matter.
    Should two texts ever share a SHA-256, the job fails rather than drop either.
    """
    return _judged(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, null as empty, the one that exact_dedup() keeps; of rows that repeat both id and text one.

    Columns of docs may have any names but those that begin with __docforge; an empty table stays empty.
    """
    told = _judged(docs.select("doc_id", "text")).filter("group_size > 1")
    gone = told.groupBy("doc_id", "mark").agg(F.bool_or("kept").alias("__docforge_some"), F.count(F.lit(1)).alias("n")).filter("NOT __docforge_some OR n > 1")
    gone = materialise(gone.select(F.col("doc_id").alias("__docforge_id"), F.col("mark").alias("__docforge_gone"), "__docforge_some"), "dedup-gone")
    marked = docs.withColumn("__docforge_mark", _mark(F.col("text")))
    may, clear = split_by(marked, "__docforge_mark", bit_filter(gone, "__docforge_gone"))
    found = may.join(gone, F.expr("doc_id <=> __docforge_id AND __docforge_mark = __docforge_gone"), "left")
    one = found.filter("__docforge_some").withColumn("__docforge_n", F.row_number().over(Window.partitionBy("doc_id", "__docforge_mark").orderBy(F.length("text"))))
    return clear.select(docs.columns).unionByName(found.filter("__docforge_some IS NULL").select(docs.columns)).unionByName(one.filter("__docforge_n = 1").select(docs.columns))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
