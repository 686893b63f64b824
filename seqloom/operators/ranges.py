"""Half-open genome ranges (chrom, start_pos, end_pos): predicates, overlap joins, merging, and genome windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

#: Positions of a bin by which ranges meet; best about the usual length of a range.
BIN = 1 << 10

#: Ranges over this many bins are posted in wide bins instead, so no range makes more than twice as many rows.
MOST_BINS = 64

#: Levels at which ranges meet: short ones, long ones with all of the other side, short ones with long ones.
LEVELS = 3

#: Windows whose sums are carried on in one task.
STRETCH = 1 << 14


def _ends(prefix: str) -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}chrom"), F.col(f"{prefix}start_pos"), F.col(f"{prefix}end_pos")


def overlaps(a: str = "a_", b: str = "b_") -> Column:
    """Whether the ranges of two column prefixes share a position."""
    (ca, sa, ea), (cb, sb, eb) = _ends(a), _ends(b)
    return (ca == cb) & (sa < eb) & (sb < ea)


def within(a: str = "a_", b: str = "b_") -> Column:
    """Whether a lies within b."""
    (ca, sa, ea), (cb, sb, eb) = _ends(a), _ends(b)
    return (ca == cb) & (sa >= sb) & (ea <= eb)


def contains(a: str = "a_", b: str = "b_") -> Column:
    """Whether b lies within a."""
    return within(b, a)


def contains_pos(pos: Column, prefix: str = "") -> Column:
    """Whether a range holds a position: start <= pos < end."""
    start, end = F.col(f"{prefix}start_pos"), F.col(f"{prefix}end_pos")
    return (start <= pos) & (pos < end)


def intersect_ranges(a: str = "a_", b: str = "b_") -> Column:
    """The shared part as a struct (chrom, start_pos, end_pos), null if there is none."""
    (ca, sa, ea), (_, sb, eb) = _ends(a), _ends(b)
    return F.when(overlaps(a, b), F.struct(ca.alias("chrom"), F.greatest(sa, sb).alias("start_pos"), F.least(ea, eb).alias("end_pos")))


def _side(df: DataFrame, prefix: str, bin_size: int, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ranges that are not empty, columns prefixed but for ``chrom``; the short ones; those over MOST_BINS bins, None where there are none."""
    bins = lambda p: F.floor((F.col(f"{p}end_pos") - 1) / bin_size) - F.floor(F.col(f"{p}start_pos") / bin_size)
    any_long = (df if within is None else within).where("start_pos < end_pos").agg(F.max(bins(""))).first()[0] or 0
    any_long = any_long >= MOST_BINS
    is_long = bins(prefix) >= MOST_BINS
    rows = df.select([F.col(c).alias(c if c == "chrom" else f"{prefix}{c}") for c in df.columns]).where(F.col(f"{prefix}start_pos") < F.col(f"{prefix}end_pos"))
    return rows, rows.where(~is_long) if any_long else rows, rows.where(is_long) if any_long else None


def _posted(df: DataFrame, prefix: str, width: int, level: int) -> DataFrame:
    """One row for each bin of ``width`` positions of a range; ``slot`` tells bin and level, ``here`` whether the range starts in the bin."""
    first, last = F.floor(F.col(f"{prefix}start_pos") / width), F.floor((F.col(f"{prefix}end_pos") - 1) / width)
    rows = df.withColumn("slot", F.explode(F.sequence(first, last))).withColumn(f"{prefix}here", F.col("slot") == first)
    return rows.withColumn("slot", F.col("slot") * LEVELS + level)


def _where_any(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows whose slot holds any of the others."""
    return join_sized(rows, others.select("chrom", "slot").distinct(), ["chrom", "slot"], "left_semi")


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """All overlapping pairs of two range sets, each once, with columns prefixed ``a_`` and ``b_``.

    Ranges are posted in the bins they touch and meet by equality of chromosome
    and bin; a pair counts only in the bin of the greater start. Ranges over
    MOST_BINS bins are posted in wide bins only: at level 1 long ranges of a meet
    all of b there, at level 2 short ones of a meet long ones of b, so that two
    short ranges meet in narrow bins alone. A first pass tells whether there are
    long ranges; only where they are do others go to wide bins too. Pairs with
    an empty range do not overlap. Adaptive execution splits crowded bins.
    """
    wide = bin_size * MOST_BINS
    (_, short_a, long_a), (all_b, short_b, long_b) = _side(a, "a_", bin_size), _side(b, "b_", bin_size)
    left, right = _posted(short_a, "a_", bin_size, 0), _posted(short_b, "b_", bin_size, 0)
    if long_a is not None:
        own = _posted(long_a, "a_", wide, 1)
        left, right = left.unionByName(own), right.unionByName(_where_any(_posted(all_b, "b_", wide, 1), own))
    if long_b is not None:
        own = _posted(long_b, "b_", wide, 2)
        left, right = left.unionByName(_where_any(_posted(short_a, "a_", wide, 2), own)), right.unionByName(own)
    meet = (F.col("a_start_pos") < F.col("b_end_pos")) & (F.col("b_start_pos") < F.col("a_end_pos")) & (F.col("a_here") | F.col("b_here"))
    met = left.join(right, ["chrom", "slot"]).where(meet)
    own = [F.col("chrom").alias("a_chrom") if c == "chrom" else F.col(f"a_{c}") for c in a.columns]
    other = [F.col("chrom").alias("b_chrom") if c == "chrom" else F.col(f"b_{c}") for c in b.columns]
    return met.select(*own, *other)


def unheld(ranges: DataFrame, keys: list[str], carry: str | None = None, prefix: str = "") -> DataFrame:
    """Ranges without the positions held by those before them, by start and end, of their group of ``keys``: no two of a group share one.

    The whole range stays as (first, last), prefixed as its columns are.
    ``carry`` names a column with the greatest end of ranges before all those of
    a group.
    """
    start, end = f"{prefix}start_pos", f"{prefix}end_pos"
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(start, F.max(end).over(before), *([carry] if carry else []))
    cut = ranges.select("*", F.col(start).alias(f"{prefix}first"), F.col(end).alias(f"{prefix}last")).where(F.col(start) < F.col(end))
    return cut.withColumn(start, reach).where(F.col(start) < F.col(end))


def ranges_at(ranges: DataFrame, positions: DataFrame, bin_size: int = BIN, within: DataFrame | None = None, once: str | None = None) -> DataFrame:
    """Each position with each range that holds it: the columns of positions, then those of ranges prefixed ``r_``.

    Short ranges are posted in narrow bins, long ones in wide bins. A position
    has one narrow bin, and its wide one where that holds long ranges. Whether
    there are any is looked up in ``within``, if given: ranges that are cheaper
    to read, within which all others lie. Ranges with one value of the column
    ``once`` count once where they overlap, with ends cut: within bins, which
    they are sent to anyway, or before where they meet in two kinds of bins.
    """
    wide = bin_size * MOST_BINS
    at = lambda width, level: positions.withColumn("slot", F.floor(F.col("pos") / width) * LEVELS + level)
    _, short, long = _side(ranges, "r_", bin_size, within)
    if once and long is not None:
        _, short, long = _side(unheld(ranges, ["chrom", once]).select(ranges.columns), "r_", bin_size, within or ranges)
    left, right = at(bin_size, 0), _posted(short, "r_", bin_size, 0)
    if once and long is None:
        right = unheld(right.repartition("chrom", "slot"), ["chrom", "slot", f"r_{once}"], prefix="r_")
    if long is not None:
        own = _posted(long, "r_", wide, 1)
        left, right = left.unionByName(_where_any(at(wide, 1), own)), right.unionByName(own)
    met = left.join(right.drop("r_here"), ["chrom", "slot"]).where(contains_pos(F.col("pos"), "r_"))
    return met.select(*positions.columns, *[F.col("chrom").alias("r_chrom") if c == "chrom" else F.col(f"r_{c}") for c in ranges.columns])


def first_range_at(ranges: DataFrame, positions: DataFrame, stretch: int = BIN) -> DataFrame:
    """For each distinct position the range with the lowest start, then end, that holds it, or nulls.

    Ranges in order leave to those after them only positions that they don't
    hold themselves, so each position meets one range however many hold it.
    Ranges are walked by stretches in which they start, and what those of the
    stretches before reach is carried on.
    """
    rows = ranges.select("chrom", "start_pos", "end_pos").where("start_pos < end_pos").distinct().withColumn("stretch", F.floor(F.col("start_pos") / stretch))
    before = Window.partitionBy("chrom").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.groupBy("chrom", "stretch").agg(F.max("end_pos").alias("carry")).withColumn("carry", F.max("carry").over(before))
    parts = unheld(rows.join(reached, ["chrom", "stretch"]), ["chrom", "stretch"], "carry").select("chrom", "start_pos", "end_pos", "first", "last")
    own = positions.select("chrom", "pos").distinct()
    found = ranges_at(parts, own, within=ranges).select("chrom", "pos", F.col("r_first").alias("start_pos"), F.col("r_last").alias("end_pos"))
    return own.join(found, ["chrom", "pos"], "left")


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping or touching ranges of each group of ``keys``."""
    order = Window.partitionBy(*keys).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start_pos") > reach).cast("int"), F.lit(1))
    marked = df.withColumn("__new", begins).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("__island")


def merge_overlaps(ranges: DataFrame, stretch: int = 1 << 20) -> DataFrame:
    """Non-overlapping ranges with the same positions; ranges that touch are merged, empty ones vanish.

    Ranges are cut at stretches of a chromosome and merged within each; then the
    merged parts that touch a border of their stretch, two of each at most, are
    merged over the chromosome: no window sees all ranges of a chromosome.
    """
    rows = ranges.select("chrom", "start_pos", "end_pos").where("start_pos < end_pos")
    part = F.explode(F.sequence(F.floor(F.col("start_pos") / stretch), F.floor((F.col("end_pos") - 1) / stretch)))
    cut = rows.withColumn("__part", part)
    kind = rows.schema["start_pos"].dataType
    low, high = (F.col("__part") * stretch).cast(kind), ((F.col("__part") + 1) * stretch).cast(kind)
    pieces = cut.select("chrom", "__part", F.greatest("start_pos", low).alias("start_pos"), F.least("end_pos", high).alias("end_pos"))
    merged = _islands(pieces, ["chrom", "__part"])
    at_border = (F.col("start_pos") == low) | (F.col("end_pos") == high)
    across = _islands(merged.where(at_border).drop("__part"), ["chrom"])
    return across.unionByName(merged.where(~at_border).drop("__part"))


def by_chrom(ranges: DataFrame, chrom: int) -> DataFrame:
    return ranges.where(F.col("chrom") == chrom)


def chroms(ranges: DataFrame) -> DataFrame:
    """Each chromosome with the number of its ranges, its lowest start and greatest end."""
    return ranges.groupBy("chrom").agg(F.count("*").alias("n_ranges"), F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"))


def with_size(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("size", F.col("end_pos") - F.col("start_pos"))


def sort_by_size(ranges: DataFrame) -> DataFrame:
    return with_size(ranges).orderBy("size", "chrom", "start_pos", "end_pos")


def sort_by_start(ranges: DataFrame) -> DataFrame:
    return ranges.orderBy("chrom", "start_pos", "end_pos")


def union_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """All ranges of both sets, repeats included."""
    return a.unionByName(b)


def remove_ranges(ranges: DataFrame, gone: DataFrame) -> DataFrame:
    """The ranges that are not, with the same ends, in ``gone``."""
    keys = ["chrom", "start_pos", "end_pos"]
    return ranges.join(gone.select(*keys).distinct(), keys, "left_anti")


def make_windows(chrom_lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Windows from position 1 every ``step`` positions while they start before the end; the last ones are not clipped."""
    starts = F.explode(F.sequence(F.lit(1), F.col("chrom_len") - 1, F.lit(step)))
    rows = chrom_lengths.where("chrom_len > 1").select("chrom", starts.alias("s"))
    return rows.select("chrom", F.col("s").cast("int").alias("win_start"), (F.col("s") + size).cast("int").alias("win_end"))


def _window_values(rows: DataFrame, windows: DataFrame, size: int, step: int, measures: dict[str, Column]) -> DataFrame:
    """Sums of measures over the windows of each row's position: first by cells, then each cell to its windows.

    Where ``step`` divides ``size`` all positions of a step-wide cell are in the
    same windows, so rows are summed by cell before they are copied; a window
    then adds size / step cells. Otherwise rows are copied to their windows.
    """
    sums = {name: F.sum(value) for name, value in measures.items()}
    if size % step == 0:
        cells = rows.withColumn("__k", F.floor((F.col("pos") - 1) / step)).groupBy("chrom", "__k").agg(*[v.alias(n) for n, v in sums.items()])
        first, last = F.greatest(F.lit(0), F.col("__k") - (size // step - 1)), F.col("__k")
        again = {name: F.sum(name) for name in measures}
    else:
        cells = rows
        last = F.floor((F.col("pos") - 1) / step)
        first = F.greatest(F.lit(0), F.floor((F.col("pos") - 1 - size) / step) + 1)
        again = sums
    copied = cells.where(first <= last).withColumn("__w", F.explode(F.sequence(first, last)))
    got = copied.groupBy("chrom", "__w").agg(*[v.alias(n) for n, v in again.items()])
    found = got.withColumn("win_start", (F.col("__w") * step + 1).cast("int")).drop("__w")
    return windows.join(found, ["chrom", "win_start"], "left").select("chrom", "win_start", "win_end", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def window_counts(positions: DataFrame, windows: DataFrame, size: int, step: int) -> DataFrame:
    """Positions in each window; zero where there are none."""
    return _window_values(positions, windows, size, step, {"n": F.lit(1)})


def window_sums(values: DataFrame, windows: DataFrame, size: int, step: int) -> DataFrame:
    """Sum of ``value`` over the positions of each window; zero where there are none."""
    return _window_values(values, windows, size, step, {"total": F.col("value")})


def window_coverage(ranges: DataFrame, windows: DataFrame, size: int, step: int) -> DataFrame:
    """Positions of each window that ranges cover, once for each range.

    With w = 1 at a range's start and -1 at its end, what ranges cover before a
    position x is the sum of w (x - p) over the events p before x; a window
    covers the difference of that at its two ends. Events are summed by the
    first window whose start, or end, lies behind them, so a range makes four
    rows however long it is. Sums run over STRETCH windows at a time, to which
    those of the stretches before are added.
    """
    event = F.explode(F.array(F.struct(F.col("start_pos").cast("bigint").alias("p"), F.lit(1).alias("w")), F.struct(F.col("end_pos").cast("bigint").alias("p"), F.lit(-1).alias("w"))))
    events = ranges.where("start_pos < end_pos").select("chrom", event.alias("e")).select("chrom", "e.p", "e.w")
    behind = lambda p: F.greatest(F.lit(0), F.floor((p - 1) / step) + 1)
    sides = F.explode(F.array(F.struct(behind(F.col("p")).alias("k"), F.lit(-1).alias("side")), F.struct(behind(F.col("p") - size).alias("k"), F.lit(1).alias("side"))))
    rows = events.select("chrom", "p", "w", sides.alias("s")).select("chrom", "p", "w", "s.*")
    names = ["w_start", "p_start", "w_end", "p_end"]
    sums = [F.sum(F.when(F.col("side") == side, F.col("w") * v).otherwise(0)).alias(n) for (side, v), n in zip(((-1, 1), (-1, F.col("p")), (1, 1), (1, F.col("p"))), names, strict=True)]
    cells = rows.groupBy("chrom", "k").agg(*sums).withColumn("at", F.lit(None).cast("struct<win_start:int,win_end:int>"))
    at = F.struct(F.col("win_start").cast("int").alias("win_start"), F.col("win_end").cast("int").alias("win_end")).alias("at")
    asked = windows.select("chrom", F.floor((F.col("win_start") - 1) / step).alias("k"), *[F.lit(0).cast("bigint").alias(n) for n in names], at)
    stretch = F.floor(F.col("k") / STRETCH).alias("stretch")
    rows = cells.unionByName(asked).withColumn("stretch", stretch)
    before = Window.partitionBy("chrom").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("chrom", "stretch").agg(*[F.sum(n).alias(n) for n in names])
    offsets = sums.select("chrom", "stretch", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names])
    upto = Window.partitionBy("chrom", "stretch").orderBy("k", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("chrom", "stretch", "at", *[F.sum(n).over(upto).alias(n) for n in names]).where("at is not null")
    whole = run.join(offsets, ["chrom", "stretch"])
    total = {n: F.col(n) + F.col(f"{n}_before") for n in names}
    covered = F.col("at.win_end") * total["w_end"] - total["p_end"] - (F.col("at.win_start") * total["w_start"] - total["p_start"])
    return whole.select("chrom", "at.win_start", "at.win_end", covered.cast("bigint").alias("covered"))


def as_int(df: DataFrame, column: str) -> DataFrame:
    """A window value as a whole number, cut towards zero."""
    return df.withColumn(column, F.col(column).cast("bigint"))
