"""Windows, ranges and blocks: sliding pages and texts, merged intervals, segments, rates and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions.lineage import cut_lineage


def page_ranges(pages: DataFrame, n_pages: str = "n_pages", size: int = 3, overlap: int = 1) -> DataFrame:
    """start and end of overlapping page ranges; the first that reaches the last page is the last one."""
    step = max(1, size - overlap)
    starts = F.filter(F.sequence(F.lit(1), F.col(n_pages), F.lit(step)), lambda s: (s == 1) | (s - step + size - 1 < F.col(n_pages)))
    return pages.where(F.col(n_pages) >= 1).withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size - 1, F.col(n_pages)))


def text_windows(texts: DataFrame, length: str, budget: int = 15_000, overlap: int = 1_000) -> DataFrame:
    """start and end of overlapping text windows: [0, budget), then a step of budget - overlap; a last one takes the rest.

    After a window that leaves `overlap` characters or fewer, what follows the step is the tail.
    """
    step, n = budget - overlap, F.col(length)
    full = F.when(n <= overlap, F.lit(1)).otherwise(F.ceil((n - overlap) / step)).cast("int")
    d = texts.where(n > 0).withColumn("part", F.explode(F.sequence(F.lit(0), full)))
    start = F.col("part") * step
    return d.withColumn("start", start).withColumn("end", F.when(F.col("part") == full, n).otherwise(F.least(start + budget, n))).where(F.col("start") < F.col("end"))


def merge_intervals(intervals: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of a group that touch or overlap, merged (gaps and islands).  A null start or end comes last: it is no gap."""
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = intervals.withColumn("__new", (before.isNull() | (F.col(start) > before + 1)).cast("int"))
    d = d.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("__island")


def segments(lines: DataFrame, doc: str, line_no: str, boundary: Column) -> DataFrame:
    """Lines with the number of their block: a block begins at each boundary line, and at the first line."""
    w = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.coalesce(boundary, F.lit(False)).cast("int")).over(w))


def options_ahead(lines: DataFrame, doc: str, line_no: str, letter: Column, ahead: int = 8) -> DataFrame:
    """Whether two different option letters at least stand on the next lines."""
    w = Window.partitionBy(doc).orderBy(line_no).rowsBetween(1, ahead)
    return lines.withColumn("has_options_ahead", F.size(F.collect_set(F.nullif(letter, F.lit(""))).over(w)) >= 2)


def chunks(blocks: DataFrame, doc: str, order: str, size: int, text: str) -> DataFrame:
    """Blocks of a document in chunks of a size, their texts joined by blank lines."""
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    d = blocks.withColumn("chunk", F.floor(nth / size).cast("int"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return d.groupBy(doc, "chunk").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(joined, "\n\n").alias("text"))


def neighbours(pages: DataFrame, doc: str, page: str, value: str) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(page)
    return pages.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def rolling_count(events: DataFrame, key: list[str], seconds: str, width: int = 60) -> DataFrame:
    """How many events of a key fall into the window that ends with each event."""
    w = Window.partitionBy(*key).orderBy(seconds).rangeBetween(-(width - 1), 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


def streaks(events: DataFrame, key: str, order: list[str], at: str, gap: int) -> DataFrame:
    """Place of an event in its streak: a streak ends at a gap longer than `gap`."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    d = events.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("streak", F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order))).drop("__new", "__island")


#: Values of one step of a moving average that are held together.
AVERAGE_BLOCK = 4096


def moving_average(events: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.2, block: int = AVERAGE_BLOCK) -> DataFrame:
    """The exponential moving average of a key's values after its last event: old * (1 - alpha) + new * alpha, from the first value on.

    Null values say nothing; a key without values has none.  A stretch of values takes an average a to kept * a + added, and two such
    maps in a row are one: kept2 * kept1, kept2 * added1 + added2.  Rows are dealt by ranges of key and order, so that a
    hot key lies in many partitions, in order; each block of `block` rows there is folded to its map, then the blocks of a key are.
    """
    order_columns = [F.col(c) for c in order]
    known = events.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.struct(*order_columns).alias("__at"), F.col(value).cast("double").alias("__v"))
    dealt = cut_lineage(known.repartitionByRange("__key", "__at").withColumn("__part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at")) - 1
    rows = dealt.withColumn("__block", F.floor(place / block))
    listed = rows.groupBy("__key", "__part", "__block").agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("l"))
    first = F.get("l", F.lit(0))["__v"]
    # the map of a block, as if its first value were the average so far, and that first value
    rest = F.transform(F.slice("l", 2, F.size("l")), lambda x: x["__v"])
    maps = listed.select("__key", "__part", "__block", first.alias("first"), F.aggregate(rest, first, lambda a, x: a * (1 - alpha) + x * alpha).alias("alone"), F.pow(F.lit(1 - alpha), F.size("l") - 1).alias("kept"))
    blocks = maps.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__part", "__block", "first", "alone", "kept"))).alias("b"))
    # after a block: had its first value been the average, `alone`; that average is in truth first + (before - first) * (1 - alpha)
    folded = F.aggregate(F.slice("b", 2, F.size("b")), F.get("b", F.lit(0))["alone"], lambda a, m: m["alone"] + m["kept"] * (1 - alpha) * (a - m["first"]))
    return events.select(F.col(key).alias("__key")).distinct().join(blocks, "__key", "left").select(F.col("__key").alias(key), folded.alias("average"))


def longest_run(numbers: Column) -> Column:
    """Longest run of numbers that each are one more than the one before."""
    seed = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"] + 1, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(numbers, seed, step, lambda acc: acc["best"])
