"""Plain tables of text columns, typed on access, and helpers for parts, samples and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import write_table


def typed(column: str, kind: str) -> Column:
    """A column as another type; null where it cannot be converted."""
    return F.col(column).try_cast(kind)


def insert_column(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    names = df.columns
    return df.withColumn(name, value).select(*names[:at], name, *names[at:])


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def column_index(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def remove_rows(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def replace_cells(df: DataFrame, patch: DataFrame, on: list[str], column: str) -> DataFrame:
    """Cells of ``column`` from ``patch`` where it has the row's key; a null there is a value too."""
    new = patch.select(*on, F.struct(column).alias("__new"))
    joined = df.join(new, on, "left")
    value = F.when(F.col("__new").isNotNull(), F.col(f"__new.{column}")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*df.columns)


def sort_text(df: DataFrame, column: str, *then: str) -> DataFrame:
    return df.orderBy(F.col(column).cast("string"), *then)


def sort_number(df: DataFrame, column: str, *then: str) -> DataFrame:
    """By the column as a number; what is none comes first, as nulls do."""
    return df.orderBy(F.col(column).try_cast("double"), *then)


def split_parts(df: DataFrame, k: int, order: str) -> DataFrame:
    """Add ``part``, 1 to k, in the order of a unique column: sizes differ by one at most, larger parts first.

    Rows are numbered by ranges of ``order``: each range by itself, plus the
    rows of the ranges before it, so no task holds the table.
    """
    numbered = with_row_number(df, order)
    total = df.count()
    small, more = divmod(total, k)
    n = F.col("row") - 1
    edge = more * (small + 1)
    part = F.when(n < edge, F.floor(n / F.lit(small + 1))).otherwise(F.floor((n - edge) / F.lit(max(small, 1))) + more) + 1
    return numbered.withColumn("part", part.cast("int")).drop("row")


def split_sizes(df: DataFrame, size: int, order: str) -> DataFrame:
    """Add ``part``, from 1, with ``size`` rows each but the last."""
    return with_row_number(df, order).withColumn("part", (F.floor((F.col("row") - 1) / size) + 1).cast("int")).drop("row")


def with_row_number(df: DataFrame, order: str) -> DataFrame:
    """Add ``row``, from 1, in the order of a unique column of any kind.

    Rows are dealt by ranges of the column, sorted and numbered within each and
    written; the rows of the ranges before it are added, so no task holds the
    table.
    """
    return number_rows(df.repartitionByRange(order).sortWithinPartitions(order), "row")


def number_rows(df: DataFrame, name: str = "place") -> DataFrame:
    """Add ``name``, from 1, in the order in which the rows of a sorted table stand, one partition after the other.

    Rows are numbered within their partition and written; the rows of the
    partitions before it are added, so no task holds the table.
    """
    kept = write_table(df.withColumn("__m", F.monotonically_increasing_id()), "row-numbers")
    sizes = kept.groupBy(F.shiftright("__m", 33).alias("__b")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__b", before.alias("__before"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.withColumn("__b", F.shiftright("__m", 33)).join(offsets, "__b").withColumn(name, F.col("__before") + place).drop("__b", "__m", "__before")


#: A prime; numbers below it are the hashes of rows.
HASHES = (1 << 31) - 1


def seeded_hash(key: Column, seed: int) -> Column:
    """A whole number below HASHES for a whole number and a seed, the same on every engine with 64-bit integers."""
    x = (F.pmod(key.cast("bigint"), F.lit(HASHES)) * 48_271 + seed % HASHES * 16_807 + 12_345) % HASHES
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * 69_621 + 7) % HASHES
    return (x.bitwiseXOR(F.shiftright(x, 13)) * 39_373 + 11) % HASHES


def sample_rows(df: DataFrame, n: int, key: str, replace: bool = False, seed: int = 1) -> DataFrame:
    """``n`` rows at random by a seed, the same however the table is dealt; all rows where it has fewer and none is replaced.

    ``key`` is a unique column of whole numbers. Without replacement the rows
    with the n smallest hashes of key and seed are taken, equal ones by key:
    histograms of the hash by its upper and lower bits tell below which value
    all are, so only those of one value are sorted. With replacement n draws
    name rows by their number in the order of the key.
    """
    if replace:
        total = df.count()
        draw = F.floor(seeded_hash(F.col("id"), seed) * F.lit(total) / F.lit(HASHES)).cast("bigint") + 1
        return df.sparkSession.range(n if total else 0).select(draw.alias("row")).join(with_row_number(df, key), "row").drop("row")
    rows = df.withColumn("__h", seeded_hash(F.col(key), seed))
    low, left = 0, n
    for bits in (20, 10, 0):
        width = 1 << bits
        own = rows.where((F.col("__h") >= low) & (F.col("__h") < low + 2048 * width))
        parts = sorted((r[0], r[1]) for r in own.groupBy(F.floor((F.col("__h") - low) / width).cast("int").alias("part")).count().collect())  # at most 2,048
        for part, many in parts:
            if many > left:
                low += part * width
                break
            left -= many
        else:
            return rows.drop("__h")
    last = rows.where(F.col("__h") == low).orderBy(key).limit(left)
    return rows.where(F.col("__h") < low).unionByName(last).drop("__h")


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Rows in a random order that a seed and the key repeat."""
    return df.orderBy(seeded_hash(F.col(key), seed), key)


def rank_values(df: DataFrame, key: str, value: str, index: str, descending: bool = False) -> DataFrame:
    """Add ``place`` within ``key`` by value; equal values by index upward, or downward when descending."""
    order = [F.desc(value), F.desc(index)] if descending else [F.asc(value), F.asc(index)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def fields(text: Column, separator: str = "\t") -> Column:
    return F.split(text, "\\Q" + separator + "\\E")


def words(text: Column) -> Column:
    """Fields between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def join_fields(array: Column, places: list[int], separator: str = "\t") -> Column:
    return F.concat_ws(separator, *[F.get(array, F.lit(i)) for i in places])


def zero_padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def fixed_lines(text: Column, width: int) -> Column:
    """A line feed after every ``width`` characters but at the end."""
    return F.rtrim(F.regexp_replace(text, "(.{%d})" % width, "$1\n"), F.lit("\n"))
