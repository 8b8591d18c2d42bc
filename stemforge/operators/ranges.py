"""Page ranges that depend on one another: groups that must not be split, and cuts that move with the risk at their end.

Both are folds: each step sees what the steps before it made.  They run as higher-order functions over the ranges, groups and
risky pages of one file, which are as few as its pages; files are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "array<struct<start:int,end:int>>"
#: Reasons for which a cut goes back by a page.
SPLIT_REASONS = ("trailing_question_without_options", "next_page_starts_with_options", "split_options", "continuation_without_marker")
#: Widest range of a single page that takes in its neighbours.
WIDEST = 3


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def merge_by_groups(ranges: DataFrame, groups: DataFrame, file: str = "file_id") -> DataFrame:
    """file, start and end after merging, group by group in order, all ranges that overlap a group (file, ord, start, end).

    A group that overlaps one range alone changes nothing; merged ranges reach from the first start to the last end,
    and later groups see them merged.  Files without groups keep their ranges.  Equal ranges stay as often as they are.
    """
    had = ranges.groupBy(file).agg(F.array_sort(F.collect_list(_range(F.col("start"), F.col("end")))).alias("ranges"))
    asked = groups.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("ord", _range(F.col("start"), F.col("end")).alias("g")))).alias("groups"))

    def fold(now: Column, group: Column) -> Column:
        g = group["g"]
        touches = lambda r: (r["start"] <= g["end"]) & (r["end"] >= g["start"])
        touched, rest = F.filter(now, touches), F.filter(now, lambda r: ~touches(r))
        hull = _range(F.array_min(F.transform(touched, lambda r: r["start"])), F.array_max(F.transform(touched, lambda r: r["end"])))
        return F.when(F.size(touched) > 1, F.concat(rest, F.array(hull))).otherwise(now)

    joined = had.join(asked, file, "left")
    merged = F.when(F.col("groups").isNull(), F.col("ranges")).otherwise(F.aggregate("groups", F.col("ranges"), fold))
    return joined.select(file, F.explode(merged).alias("r")).select(file, "r.start", "r.end")


def cut_ranges(merged: DataFrame, risky: DataFrame, size: int = 3, overlap: int = 1, file: str = "file_id") -> DataFrame:
    """file, start and end of ranges of `size` pages with an overlap; a cut after a page that is `risky` (file, page) goes back by a page.

    Where the next one starts depends on where this one was cut.  A range never gets shorter than a page, and each starts
    at least a page after the one before.
    """
    pages = merged.select(file, "start", "end", F.explode(F.sequence("start", "end")).alias("page"))
    at_risk = pages.join(risky.select(file, "page").distinct().withColumn("risk", F.lit(True)), [file, "page"], "left")
    whole = at_risk.groupBy(file, "start", "end").agg(F.collect_set(F.when(F.col("risk"), F.col("page"))).alias("risky"))
    seed = F.struct(F.col("start").cast("int").alias("next"), F.array().cast(RANGE).alias("out"))

    def step(state: Column, page: Column) -> Column:
        last = F.least(F.col("end"), page + size - 1)
        back = (last < F.col("end")) & (last > page) & F.array_contains("risky", last)
        cut = last - back.cast("int")
        after = F.greatest(page + 1, cut + 1 - overlap)
        following = F.when((after > F.col("end")) | (cut >= F.col("end")), F.lit(0)).otherwise(after)
        taken = F.struct(following.cast("int").alias("next"), F.concat(state["out"], F.array(_range(page, cut))).alias("out"))
        return F.when(state["next"] == page, taken).otherwise(state)

    made = F.aggregate(F.sequence("start", "end"), seed, step, lambda state: state["out"])
    return whole.select(file, F.explode(made).alias("r")).select(file, "r.start", "r.end")


def widen_single_pages(ranges: DataFrame, risks: DataFrame, page_counts: DataFrame, file: str = "file_id") -> DataFrame:
    """Ranges of one page with what the risks (file, page, severity, start, end) before and after it suggest; at most WIDEST pages, each once.

    `page_counts` is file and n_pages.  Ranges of several pages stay.
    """
    risk = risks.where("severity in ('medium', 'high')").select(file, "page", F.col("start").alias("s"), F.col("end").alias("e"))
    after = risk.select(file, F.col("page").alias("start"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    before = risk.select(file, (F.col("page") + 1).alias("start"), F.col("s").alias("s0"), F.col("e").alias("e0"))
    d = ranges.join(after, [file, "start"], "left").join(before, [file, "start"], "left").join(page_counts, file, "left")
    single = (F.col("start") == F.col("end")) & (F.col("s1").isNotNull() | F.col("s0").isNotNull())
    low = F.greatest(F.lit(1), F.least("start", "s1", "s0"))
    high = F.least("n_pages", F.greatest("end", "e1", "e0"))
    wide = high - low + 1 > WIDEST
    kept_low = F.when(wide, F.greatest(F.lit(1), F.col("start") - 1)).otherwise(low)
    kept_high = F.when(wide, F.least(F.col("n_pages"), kept_low + WIDEST - 1)).otherwise(high)
    return d.select(file, F.when(single, kept_low).otherwise(F.col("start")).cast("int").alias("start"), F.when(single, kept_high).otherwise(F.col("end")).cast("int").alias("end")).distinct()
