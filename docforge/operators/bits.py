"""Bit vectors, monotone sequences and balanced parentheses as tables of positions.

A vector is rows (keys, pos, bit). Ranks are running sums in two levels: within blocks of positions, so that a long
vector is spread over tasks, and over the blocks' sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import as_of

#: Positions of a block.
BLOCK = 1 << 16


def running(df: DataFrame, keys: Sequence[str], pos: str, amounts: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its amount over all smaller positions of the key."""
    names = list(amounts)
    spot = df.withColumn("_block", F.floor(F.col(pos) / BLOCK))
    within = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    sums = spot.groupBy(*keys, "_block").agg(*(F.sum(amounts[n]).alias(f"_s{k}") for k, n in enumerate(names)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", *(F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(names))))
    local = spot.withColumns({f"_w{k}": F.coalesce(F.sum(amounts[n]).over(within), F.lit(0)) for k, n in enumerate(names)})
    return local.join(offsets, [*keys, "_block"]).select(*df.columns, *((F.col(f"_w{k}") + F.col(f"_o{k}")).cast("long").alias(n) for k, n in enumerate(names)))


def ranks(df: DataFrame, keys: Sequence[str], pos: str, bit: Column) -> DataFrame:
    """df with rank1 and rank0: how many bits are set, and how many are clear, before each position."""
    return running(df, keys, pos, {"rank1": bit.cast("long"), "rank0": (~bit).cast("long")})


def select1(df: DataFrame, keys: Sequence[str], pos: str, bit: Column) -> DataFrame:
    """keys, k and pos: where the k-th set bit is, from 0."""
    return ranks(df.withColumn("_bit", bit), keys, pos, F.col("_bit")).filter("_bit").select(*keys, F.col("rank1").alias("k"), pos)


def select0(df: DataFrame, keys: Sequence[str], pos: str, bit: Column) -> DataFrame:
    """keys, k and pos: where the k-th clear bit is, from 0."""
    return select1(df, keys, pos, ~bit)


def words(df: DataFrame, keys: Sequence[str], pos: str, bit: Column) -> DataFrame:
    """keys, word_idx, word: 64 positions each, the first in the lowest bit."""
    value = F.expr(f"shiftleft(1L, cast({pos} % 64 as int))")
    return df.groupBy(*keys, F.floor(F.col(pos) / 64).alias("word_idx")).agg(F.bit_or(F.when(bit, value).otherwise(F.lit(0))).alias("word"))


def counts(packed: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """keys, len, count_ones and count_zeros of packed words; size is each vector's length."""
    return packed.groupBy(*keys).agg(F.max(size).alias("len"), F.sum(F.bit_count("word")).alias("count_ones")).withColumn("count_zeros", F.col("len") - F.col("count_ones"))


def get_bit(word: str, pos: str) -> Column:
    """The bit at a position of its word."""
    return F.expr(f"bit_get({word}, cast({pos} % 64 as int)) = 1")


def select_in_word(word: str, k: str) -> Column:
    """The place of the k-th set bit of a word, from 0; 64 if it has fewer."""
    return F.expr(f"coalesce(get(filter(sequence(0, 63), i -> bit_get({word}, i) = 1), {k}), 64)")


# Monotone sequences.


def elias_fano(df: DataFrame, key: str, values: str) -> DataFrame:
    """Sorted arrays of non-negative integers as low_bits, low (the lower bits of each) and high (the upper ones, as gaps in unary: places of set bits)."""
    width = F.expr(f"if(size({values}) = 0, 0, greatest(0, cast(floor(log2(greatest(1, element_at({values}, -1) div size({values})))) as int)))")
    coded = df.select(key, F.col(values).alias("_v"), width.alias("low_bits"))
    return coded.select(key, "low_bits", F.expr("transform(_v, x -> x - shiftleft(shiftright(x, low_bits), low_bits))").alias("low"), F.expr("transform(_v, (x, i) -> shiftright(x, low_bits) + i)").alias("high"))


def ef_get(i: str) -> Column:
    """The i-th value of an elias_fano() row; null beyond its end."""
    return F.expr(f"shiftleft(get(high, cast({i} as int)) - {i}, low_bits) + get(low, cast({i} as int))")


def ef_values() -> Column:
    """All values of an elias_fano() row, in order: what a cursor passes."""
    return F.expr("transform(high, (h, i) -> shiftleft(h - i, low_bits) + element_at(low, i + 1))")


def ef_predecessor(x: str) -> Column:
    """The greatest value that isn't above x; null if all are. Only values with the same upper bits are decoded."""
    return F.expr(f"array_max(filter(transform(high, (h, i) -> if(h - i <= shiftright({x}, low_bits), shiftleft(h - i, low_bits) + element_at(low, i + 1), null)), v -> v <= {x}))")


def ef_seek(x: str) -> Column:
    """The index of the first value from x on; the length if there is none."""
    return F.expr(f"size(filter(transform(high, (h, i) -> shiftleft(h - i, low_bits) + element_at(low, i + 1)), v -> v < {x}))")


# Balanced parentheses: rows (keys, pos, open).


def excesses(df: DataFrame, keys: Sequence[str], pos: str = "pos", opens: str = "open") -> DataFrame:
    """df with excess, open less closed parentheses up to and with each position, and level, the depth of the pair that it belongs to, from 1."""
    step = F.when(F.col(opens), 1).otherwise(-1)
    found = running(df, keys, pos, {"_before": step})
    return found.select(*df.columns, (F.col("_before") + step).alias("excess"), (F.col("_before") + F.when(F.col(opens), 1).otherwise(0)).alias("level"))


def tree(df: DataFrame, keys: Sequence[str], pos: str = "pos", opens: str = "open") -> DataFrame:
    """A row for each pair: keys, pos (of the opening), close, depth (0 for a root), parent (its opening's position), subtree_size, first_child and next_sibling; null where there is none.

    Among the positions of one level, openings and closings alternate, so a pair is two neighbours.
    """
    found = excesses(df, keys, pos, opens)
    w = Window.partitionBy(*keys, "level").orderBy(pos)
    after = found.select(*keys, pos, opens, "level", F.lead(pos).over(w).alias("close"), F.lead(pos, 2).over(w).alias("_next"))
    nodes = after.filter(F.col(opens)).select(*keys, pos, "close", (F.col("level") - 1).alias("depth"), ((F.col("close") - F.col(pos) + 1) / 2).cast("long").alias("subtree_size"), "_next")
    # The parent is the last opening one level up before the node.
    up = nodes.select(*keys, (F.col("depth") + 1).alias("_level"), pos)
    with_parent = as_of(nodes.withColumn("_level", F.col("depth")), up, [*keys, "_level"], pos, [pos]).withColumnRenamed(f"right_{pos}", "parent")
    child = F.when(F.col("subtree_size") > 1, F.col(pos) + 1)
    sibling = F.when(F.col("_next") == F.col("close") + 1, F.col("_next"))
    return with_parent.select(*keys, pos, "close", "depth", "parent", "subtree_size", child.alias("first_child"), sibling.alias("next_sibling"))


# Lines and characters.


def line_count(text: str) -> Column:
    return F.expr(f"cast(length({text}) - length(replace({text}, '\\n', '')) + 1 as bigint)")


def to_line_column(text: str, offset: str) -> Column:
    """line and column, from 1, of a character offset from 0; null outside the text."""
    head = f"substring({text}, 1, cast({offset} as int))"
    line = f"length({head}) - length(replace({head}, '\\n', '')) + 1"
    column = f"{offset} + 1 - if(locate('\\n', reverse({head})) = 0, 0, length({head}) - locate('\\n', reverse({head})) + 1)"
    return F.expr(f"if({offset} between 0 and length({text}), named_struct('line', cast({line} as bigint), 'column', cast({column} as bigint)), null)")


def to_offset(text: str, line: str, column: str) -> Column:
    """The character offset of a line and column, from 1; null where the text has no such place."""
    head = f"substring_index({text}, '\\n', cast({line} as int) - 1)"
    start = f"if({line} = 1, 0, length({head}) + 1)"
    width = f"length(get(split({text}, '\\n', -1), cast({line} as int) - 1)) + 1"
    return F.expr(f"if({line} >= 1 and {column} >= 1 and {column} <= {width}, cast({start} + {column} - 1 as bigint), null)")


def sequence_length(first: str) -> Column:
    """The bytes of a UTF-8 sequence by its first byte; 0 for a byte that starts none."""
    return F.expr(f"case when {first} < 128 then 1 when {first} between 194 and 223 then 2 when {first} between 224 and 239 then 3 when {first} between 240 and 244 then 4 else 0 end")


def decode_code_point(data: str) -> Column:
    """The code point of the first character of UTF-8 bytes."""
    return F.expr(f"ascii(substring(decode({data}, 'utf-8'), 1, 1))")


def encode_code_point(point: str) -> Column:
    """The UTF-8 bytes of a code point; null for a surrogate or beyond the last one."""
    tail = lambda shift: f"lpad(hex(128 + (shiftright({point}, {shift}) & 63)), 2, '0')"
    return F.expr(
        f"""unhex(case when {point} between 0 and 127 then lpad(hex({point}), 2, '0')
        when {point} between 128 and 2047 then concat(hex(192 + shiftright({point}, 6)), {tail(0)})
        when {point} between 2048 and 65535 and not {point} between 55296 and 57343 then concat(hex(224 + shiftright({point}, 12)), {tail(6)}, {tail(0)})
        when {point} between 65536 and 1114111 then concat(hex(240 + shiftright({point}, 18)), {tail(12)}, {tail(6)}, {tail(0)}) end)"""
    )
