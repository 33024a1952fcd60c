"""What the operators share: tables in the shared folder, byte tests, and reading of inputs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sizes of bit filters: a byte for each key, from 1 to 32 MB.
LEAST_BITS, MOST_BITS = 23, 28
#: Groups of fewer rows are never spread.
SPREAD_ROWS = 256

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has already ended
            return


atexit.register(_forget)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docforge/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.docforge_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more; those left are deleted when the driver ends."""
    for t in tables:
        if _written.pop(t.docforge_path, None):
            _delete(t.sparkSession, t.docforge_path)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 768 << 10) -> None:
    """Arrow batches of at most so many rows and about so many bytes from here on, whose buffers the JVM and the worker both hold; settings for less stay.

    Plans read these settings when they run, so they can't be taken back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < known <= size:
        spark.conf.set(key, f"{size}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class BitFilter:
    """Rows (slab, bitmap) of a filter of 2**bits bits with one hash."""

    slabs: DataFrame
    bits: int


def filter_bits(keys: DataFrame) -> int:
    """8 to 16 bits for each row, as a power of two, within the limits."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))


def bit_filter(keys: DataFrame, column: str) -> BitFilter:
    """A filter over the values of a column, for a table that has been written (it is read twice).

    It has 2**MOST_BITS bits (32 MB) at most, so it may be broadcast;
    when more keys fill it up it lets more through and never loses a key.
    """
    bits = filter_bits(keys)
    bit = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    slabs = (
        keys.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("slab"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    )
    return BitFilter(slabs, bits)


_BIT_IS_SET = """
    pmod(shiftright(cast(conv(hex(substring(__docforge_bitmap, cast(bitmap_bit_position(__docforge_bit) div 8 as int) + 1, 1)), 16, 10) as int),
                    cast(bitmap_bit_position(__docforge_bit) % 8 as int)), 2) = 1
"""


def split_by(df: DataFrame, column: str, known: BitFilter) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose value may be in a bit_filter(), and those whose value is not."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << known.bits))
    spot = df.withColumn("__docforge_bit", bit).withColumn("__docforge_slab", F.bitmap_bucket_number("__docforge_bit"))
    told = spot.join(F.broadcast(known.slabs.withColumnsRenamed({"slab": "__docforge_slab", "bitmap": "__docforge_bitmap"})), "__docforge_slab", "left")
    may = told.select(*df.columns, F.coalesce(F.expr(_BIT_IS_SET), F.lit(False)).alias("__docforge_may"))
    return may.filter("__docforge_may").drop("__docforge_may"), may.filter("NOT __docforge_may").drop("__docforge_may")


def join_spread(rows: DataFrame, facts: DataFrame, on: Sequence[str], size: str, by: str) -> DataFrame:
    """rows joined with facts, a written table with a row for each key and in `size` how many rows the key has.

    Keys with more rows than a quarter of a partition are dealt to several by a hash of `by`, and their
    facts repeated; there are at most four such keys for each partition, so they are broadcast.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total, largest = facts.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    most = max(SPREAD_ROWS, total // (4 * parts))
    if largest <= most:
        return rows.join(facts, list(on))
    hot = F.broadcast(facts.filter(F.col(size) > most).select(*on, F.ceil(F.col(size) / most).cast("int").alias("__docforge_salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("__docforge_salts")), F.lit(0)).cast("int")
    dealt = rows.join(hot, list(on), "left").withColumn("__docforge_salt", salt).drop("__docforge_salts")
    told = facts.join(hot, list(on), "left").withColumn("__docforge_salt", F.explode(F.sequence(F.lit(0), F.coalesce("__docforge_salts", F.lit(1)) - 1))).drop("__docforge_salts")
    return dealt.join(told, [*on, "__docforge_salt"]).drop("__docforge_salt")


def without(docs: DataFrame, gone: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose column is in gone(column); only rows that a bit filter can't clear are shuffled."""
    gone = materialise(gone.select(column).distinct(), "gone")
    may, clear = split_by(docs, column, bit_filter(gone, column))
    return clear.unionByName(may.join(gone, column, "left_anti"))


def through(df: DataFrame, column: str, known: BitFilter) -> DataFrame:
    """The rows of df whose value may be in a bit_filter()."""
    return split_by(df, column, known)[0]


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; DOCFORGE_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("DOCFORGE_TOKENIZERS", "/opt/tokenizers"), name)
