"""What becomes of questions after they are found: first of equal blocks, better replacements, scopes, orders and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions.lineage import cut_lineage
from stemforge.operators.markdown import squeezed, trimmed

# Marks of a shared case, tokens that come of bad character recognition, and clinical tokens with digits that do not.
CASE_MARK = r"(?iu)\[\s*(?:tình\s*huống|tinh\s*huong|câu\s*hỏi|cau\s*hoi)\s*\]"
MISREAD = r"(?iU)\b(?:sir|gid|ngot|d6ng|kh6|g8y|teorong|ying|mats|mat\s+batch|ph[ée]di)\b"
MISREAD_WORDS = ["sir", "gid", "ngot", "d6ng", "kh6", "g8y", "teorong", "ying", "mats", "phédi", "phedi"]
WITH_DIGITS = ["spo2", "hba1c", "co2", "o2", "t1", "t2", "t3", "b12"]
ACCENTED = r"(?iu)[ăâêôơưđáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"
UNSORTED = "Chưa phân loại"
LAST_NUMBER = 999_999


def block_fingerprint(block: Column) -> Column:
    """A structured block without its number, in lower case and single spaces."""
    return F.lower(squeezed(F.regexp_replace(block, r"(?i)^<<<MCQ\s+\d+>>>\s*", "")))


def first_blocks(blocks: DataFrame, file: str = "file_id") -> DataFrame:
    """Blocks (file, range, place, block) of overlapping ranges without repeats: of equal ones the first range's first; empty ones go."""
    d = blocks.withColumn("__fp", F.sha2(block_fingerprint(F.col("block")), 256)).where(block_fingerprint(F.col("block")) != "")
    first = F.row_number().over(Window.partitionBy(file, "__fp").orderBy("range", "place"))
    return d.withColumn("__n", first).where("__n = 1").drop("__n", "__fp")


def misread_tokens(text: Column) -> Column:
    """How many tokens are signs of bad character recognition: known ones, and words with digits inside."""
    known = F.regexp_count(text, F.lit(MISREAD))
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\b([\p{L}\p{N}]{3,})\b"), F.lit(1))
    odd = lambda t: t.rlike(r"\p{L}") & t.rlike(r"\p{N}") & ~F.lower(t).isin(*MISREAD_WORDS, *WITH_DIGITS)
    return known + F.size(F.filter(tokens, odd))


def replacement_score(question: Column, options: Column, whole: Column) -> Column:
    """How good a version of a question is; `whole` is its text with the shared case in normal form."""
    filled = F.size(F.filter(F.coalesce(options, F.array()), lambda o: F.coalesce(o, F.lit("")) != ""))
    changed = F.when(whole != trimmed(question), -20).otherwise(0)
    return F.regexp_count(question, F.lit(ACCENTED)) * 2 + filled * 3 - F.regexp_count(question, F.lit(CASE_MARK)) * 18 - misread_tokens(question) * 12 + changed


def replaces(old: Column, new: Column) -> Column:
    """Whether a new version (question, options, whole) takes the place of an old one of the same source.

    A version that drops the shared case does not; one with fewer repeats of it does, and one with fewer
    misread tokens and no fewer accents; else the score must be higher by more than 12.
    """
    old_text, new_text = F.coalesce(old["question"], F.lit("")), F.coalesce(new["question"], F.lit(""))
    marks = lambda t: F.regexp_count(t, F.lit(CASE_MARK))
    accents = lambda t: F.regexp_count(t, F.lit(ACCENTED))
    higher = replacement_score(new_text, new["options"], new["whole"]) > replacement_score(old_text, old["options"], old["whole"]) + 12
    return (
        F.when(old_text == "", True).when((marks(old_text) >= 2) & (marks(new_text) < 2), False).when((marks(old_text) > 2) & (marks(old_text) > marks(new_text)), True)
        .when((misread_tokens(old_text) > misread_tokens(new_text)) & (accents(new_text) >= accents(old_text)), True).otherwise(higher)
    )


def compact(records: DataFrame) -> DataFrame:
    """Records with what de-duplication needs: five options at most, no explanation."""
    options = F.slice(F.coalesce("options", F.array().cast("array<string>")), 1, 5).alias("options")
    kept = [c for c in ("trace", "shared_case") if c in records.columns]
    text = lambda c: F.coalesce(F.col(c) if c in records.columns else F.lit(None), F.lit("")).alias(c)
    return records.select("id", "question", options, "answer", "source", *kept, text("difficulty"), text("depth"))


def _label(c: Column) -> Column:
    return F.lower(squeezed(F.coalesce(c, F.lit(""))))


def in_scope(question: Column, part: Column) -> Column:
    """Whether a question (source, file_id, file_name, start, end) counts for a part (source, mode, and the same): not of another file,
    and of its source, or, where pages are read as images, of its file name and within its pages."""
    other = (trimmed(F.coalesce(part["file_id"], F.lit(""))) != "") & (trimmed(F.coalesce(question["file_id"], F.lit(""))) != "") & (trimmed(part["file_id"]) != trimmed(question["file_id"]))
    same_source = (_label(part["source"]) != "") & (_label(question["source"]) == _label(part["source"]))
    same_pages = (part["mode"] == "pdfVision") & (_label(part["file_name"]) != "") & (_label(question["file_name"]) == _label(part["file_name"])) & (question["start"] >= part["start"]) & (question["end"] <= part["end"])
    return ~other & (same_source | F.coalesce(same_pages, F.lit(False)))


def covered(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """part and question ids in scope.  Parts are looked up by source, and image parts by file name and page: equal keys, no scan of all pairs."""
    p = parts.select(F.col("id").alias("part"), F.struct(*[c for c in parts.columns if c != "id"]).alias("p"))
    q = questions.select(F.col("id").alias("question"), F.struct(*[c for c in questions.columns if c != "id"]).alias("q"))
    by_source = p.withColumn("k", _label(F.col("p.source"))).join(q.withColumn("k", _label(F.col("q.source"))), "k").where("k != ''")
    pages = F.explode(F.sequence("p.start", "p.end"))
    images = p.where("p.mode = 'pdfVision' AND p.start <= p.end").withColumn("k", _label(F.col("p.file_name"))).withColumn("page", pages)
    by_page = images.join(q.withColumn("k", _label(F.col("q.file_name"))).withColumn("page", F.col("q.start")), ["k", "page"]).where("k != ''")
    both = by_source.select("part", "question", "p", "q").unionByName(by_page.select("part", "question", "p", "q"))
    return both.where(in_scope(F.col("q"), F.col("p"))).select("part", "question").distinct()


def final_number(question: Column) -> Column:
    """The number by which results are sorted in the end: of a label anywhere, else at the start; without one the last place."""
    found = [F.nullif(F.regexp_extract(F.coalesce(question, F.lit("")), p, 1), F.lit("")) for p in (r"(?iu)câu\s*(?:số\s*)?(\d+)", r"(?i)question\s*(\d+)", r"^(\d+)\s*[.:)\]]")]
    return F.coalesce(*[x.cast("long") for x in found], F.lit(LAST_NUMBER).cast("long"))


def in_final_order(records: DataFrame, position: str = "position") -> DataFrame:
    """Records sorted by `final_number`, equal ones as they came."""
    return records.withColumn("final_number", final_number(F.col("question"))).orderBy("final_number", position)


def with_places(ordered: DataFrame) -> DataFrame:
    """Sorted rows with their place (from 1): each partition's rows begin behind those of the partitions before it.

    The sorted rows are kept, as places and sizes must come of one run: run twice, a sort may deal its rows over other partitions.
    """
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    d = cut_lineage(ordered.select("*", F.spark_partition_id().alias("__part"), nth.alias("__nth")))
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    placed = d.join(sizes.select("__part", before.alias("__before")), "__part").withColumn("place", F.col("__before") + F.col("__nth") + 1)
    return placed.select(*ordered.columns, "place")


def difficulty_overview(records: DataFrame, collation: str = "vi") -> DataFrame:
    """place, difficulty and n of each difficulty, sorted as Vietnamese readers do (d before đ, accents in their order)."""
    label = trimmed(F.coalesce("difficulty", F.lit("")))
    counts = records.select(F.when(label == "", UNSORTED).otherwise(label).alias("difficulty")).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.collate("difficulty", collation), "difficulty")))  # a row for each label


def difficulty_groups(records: DataFrame, collation: str = "vi_CI_AI") -> DataFrame:
    """n of difficulties that differ by case or accents alone, under the first of their spellings."""
    label = trimmed(F.coalesce("difficulty", F.lit("")))
    named = records.select(F.when(label == "", UNSORTED).otherwise(label).alias("label"))
    return named.groupBy(F.collate("label", collation).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("difficulty")).select("difficulty", "n")


def rotates(cause: Column, tried: Column, available: Column, limit: Column) -> Column:
    """Whether another key is tried: after a soft rate limit two at most, where the provider is busy three to eight, else none."""
    most = F.when(cause == "softRateLimit", F.least(F.lit(2), limit)).when(cause == "serverBusy", F.greatest(F.lit(3), F.least(F.lit(8), limit))).otherwise(0)
    return (available > 0) & (tried < limit) & (tried < most)


#: Longer waits are no advice.
LONGEST_WAIT_MS = 60_000


def retry_after_ms(ms: Column, value: Column, now: Column, most: int = LONGEST_WAIT_MS) -> Column:
    """The wait that headers ask for: retry-after-ms, else retry-after in seconds or as an HTTP date; null if none is sensible."""
    sensible = lambda x: F.when((x > 0) & (x <= most), F.round(x).cast("long"))
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(sensible(ms.try_cast("double")), sensible(value.try_cast("double") * 1000), sensible((F.unix_millis(date) - now).cast("double")))
