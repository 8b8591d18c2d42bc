"""Relational operators on record tables: filters, joins, counts, orders, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions import text as T

# --- filters


def list_filter(records: DataFrame, term: str = "", difficulty: str = "all") -> DataFrame:
    """Records whose question holds the term, in any case, of one difficulty or all."""
    out = records.where(F.contains(F.lower("question"), F.lit(term.strip().lower()))) if term.strip() else records
    return out if difficulty == "all" else out.where(F.col("difficulty") == difficulty)


def persistable_files(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce("is_processing", F.lit(False)) & (F.coalesce("content", F.lit("")) != "")).withColumns({"is_processing": F.lit(False), "progress": F.lit(100)})


#: Verbs that begin a task, not an option.
TASK_VERBS = (
    "đặt vấn đề|nhận xét|chẩn đoán|xử trí|xử lý|giải thích|phân tích|trình bày|nêu|liệt kê|mô tả|so sánh|bàn luận|bình luận|đánh giá|"
    "hướng xử trí|hướng điều trị|chỉ định|cho biết|tư vấn|lập kế hoạch|kê đơn|kê toa|viết đơn thuốc|đề xuất|lý giải|biện luận"
)


def essay_like(options: Column) -> Column:
    """Half of two options at least begin with a task."""
    hits = F.size(F.filter(options, lambda o: F.trim(F.coalesce(o, F.lit(""))).rlike(rf"(?iu)^[A-E][\s.:)-]+\s*(?:{TASK_VERBS})")))
    return (F.size(options) >= 2) & (hits >= F.ceil(F.size(options) / 2))


def complete_question(question: Column, options: Column, answer: Column) -> Column:
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return filled(question) & (F.coalesce(F.size(options), F.lit(0)) >= 2) & filled(answer) & ~essay_like(options)


def covered_question(question: Column, options: Column, answer: Column) -> Column:
    q = F.trim(F.coalesce(question, F.lit("")))
    return (F.length(q) >= 8) & ~q.rlike(r"[,;:(\[{–-]$") & (F.coalesce(F.size(options), F.lit(0)) >= 2) & (F.trim(F.coalesce(answer, F.lit(""))) != "")


def first_text(*texts: Column) -> Column:
    """The first of several texts that is not blank, trimmed; the last as it is."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts[:-1]], texts[-1], F.lit(""))


def resume_batches(batches: DataFrame, completed: DataFrame, retry: DataFrame | None = None) -> DataFrame:
    out = batches.join(completed.select("batch_no").distinct(), "batch_no", "left_anti")
    return out if retry is None else out.join(retry.select("batch_no").distinct(), "batch_no", "left_semi")


# --- joins


def question_key(question: Column) -> Column:
    return F.lower(T.squeeze(F.coalesce(question, F.lit(""))))


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("__key", question_key(F.col("question")))


def added(project: DataFrame, current: DataFrame) -> DataFrame:
    return _keyed(current).join(_keyed(project).select("__key").distinct(), "__key", "left_anti").drop("__key")


def removed(project: DataFrame, current: DataFrame) -> DataFrame:
    return added(current, project)


def changed_answers(project: DataFrame, current: DataFrame, order: str = "id") -> DataFrame:
    """id, question and both letters of current records whose answer is another in the project, whose last record of a question counts."""
    letter = T.correct_letter(F.col("options"), F.col("answer"), F.upper(F.trim(F.coalesce("answer", F.lit("")))))
    before = _keyed(project).groupBy("__key").agg(F.max_by(letter, order).alias("previous_answer"))
    now = _keyed(current).select("id", "question", "__key", letter.alias("current_answer"))
    return now.join(before, "__key").where("previous_answer != '' AND current_answer != '' AND previous_answer != current_answer").drop("__key")


def first_interval(points: DataFrame, intervals: DataFrame, number: str, order: str, keep: list[str]) -> DataFrame:
    """For each point the first interval (in `order`) with start <= number <= end.

    A document's intervals are few and short: each is spread over its numbers, so that the range join
    becomes an equi join, whose hot numbers the optimiser can split, without a nested loop.
    """
    first = F.min_by(F.struct(*keep, "start", "end", order), order).alias("hit")
    spread = intervals.withColumn("__n", F.explode(F.sequence("start", "end"))).groupBy("__n").agg(first)
    return points.join(spread, F.col(number) == F.col("__n"), "left").drop("__n").select(*points.columns, *[F.col(f"hit.{c}").alias(c) for c in keep])


def apply_answer_key(records: DataFrame, key: DataFrame, number: str = "number") -> DataFrame:
    """Answers from a key (number, letter; the last one of a number counts) where a record has none."""
    last = key.groupBy("number").agg(F.max_by("letter", "position").alias("__letter"))
    answered = F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.col("__letter"), F.lit(""))
    return records.join(last, F.col(number) == last["number"], "left").withColumn("answer", answered).drop("__letter", last["number"])


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "position") -> DataFrame:
    """One row for each id: the latest version at the first position of the id."""
    rows = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    values = [c for c in existing.columns if c not in ("id", order)]
    newest = F.max_by(F.struct(*values), F.struct("__side", order)).alias("v")
    out = rows.groupBy("id").agg(newest, F.min(F.struct("__side", order)).alias("p"))
    return out.select("id", *[F.col(f"v.{c}").alias(c) for c in values], F.col(f"p.{order}").alias(order))


def append_visible(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records that neither share an id nor an identity with existing ones; the first of equal incoming ones."""
    key = T.identity_key(F.col("question"), F.col("options"), F.col("answer"), F.col("source"))
    new, old = incoming.withColumn("__key", key), existing.withColumn("__key", key)
    new = new.join(old.select("id").distinct(), "id", "left_anti").join(old.select("__key").distinct(), "__key", "left_anti")
    first = F.row_number().over(Window.partitionBy("__key").orderBy("id"))
    return new.withColumn("__nth", first).where("__nth = 1").drop("__key", "__nth")


def coverage(expected: DataFrame, covered: DataFrame, group: str) -> DataFrame:
    """Expected and covered counts and the missing numbers of each group: a division of relations."""
    e = expected.groupBy(group).agg(F.array_sort(F.collect_set("number")).alias("expected"))
    c = covered.groupBy(group).agg(F.array_sort(F.collect_set("number")).alias("covered"))
    d = e.join(c, group, "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<int>")))
    missing = F.array_except("expected", "covered")
    return d.select(group, F.size("expected").alias("n_expected"), F.size(F.array_intersect("expected", "covered")).alias("n_covered"), missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


# --- aggregates


def difficulty_histogram(records: DataFrame, default: str = "Unknown") -> DataFrame:
    return records.groupBy(F.coalesce(F.nullif(F.col("difficulty"), F.lit("")), F.lit(default)).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


def ordered_difficulties(records: DataFrame) -> DataFrame:
    rank = F.when(F.col("difficulty") == "Easy", 0).when(F.col("difficulty") == "Medium", 1).when(F.col("difficulty") == "Hard", 2).otherwise(3)
    return records.select("difficulty").distinct().withColumn("rank", rank).orderBy("rank", "difficulty")


def project_stats(records: DataFrame, duplicates: DataFrame, files: DataFrame) -> DataFrame:
    counts = difficulty_histogram(records).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("question_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("difficulty", "n")))).alias("difficulty_counts"))
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return counts.join(F.broadcast(one(duplicates, "duplicate_count"))).join(F.broadcast(one(files, "file_count")))  # one row each


def failure_summary(failures: DataFrame) -> DataFrame:
    """For each message, in order of its first failure: its distinct labels, joined, and how many failures it has."""
    by_label = failures.groupBy("message", "label").agg(F.min("idx").alias("at"), F.count(F.lit(1)).alias("n"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    return by_label.groupBy("message").agg(F.array_join(labels, ", ").alias("labels"), F.sum("n").alias("failures"), F.min("at").alias("first_idx"))


def merge_risks(risks: DataFrame, group: str) -> DataFrame:
    """The severest risk of a group, its reasons and pages, and the range that covers all suggested ones."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return risks.groupBy(group).agg(
        F.max_by("severity", rank).alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.min("start").alias("start"), F.max("end").alias("end"),
    )


def completed_batches(parts: DataFrame, records: DataFrame) -> DataFrame:
    """Parts whose file and source label already have as many records as the part expects."""
    key = lambda c: question_key(F.col(c))
    have = records.groupBy(F.coalesce("file_id", F.lit("")).alias("file_id"), key("source").alias("source")).agg(F.count(F.lit(1)).alias("have"))
    p = parts.withColumns({"file_id": F.coalesce("file_id", F.lit("")), "source": key("source")}).where("expected > 0")
    return p.join(have, ["file_id", "source"]).where("have >= expected").select("part", "expected", "have")


def recovered(missing: Column, before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), F.least(missing, after - before))


# --- orders


def by_question_number(records: DataFrame, position: str = "position") -> DataFrame:
    return records.withColumn("sort_number", T.sort_number(F.col("question"))).orderBy("sort_number", position)


def merged(existing: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """A sorted list with a batch merged in; the list's records come first among equal numbers."""
    both = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    return both.withColumn("sort_number", T.sort_number(F.col("question"))).orderBy("sort_number", "side", position)


def deferred_last(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.coalesce("failed_before", F.lit(False)), "batch_no")
