"""PDF planning from page texts: quality, marker estimates, boundary risks, ranges and batches.

The input is a table of page texts (file_id, page, text); decoding PDF files is left to a reader
outside, as is OCR.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions import text as T
from stemforge.operators.ranges import SPLIT_REASONS, cut_ranges, widen_single_pages
from stemforge.operators.windows import longest_run, merge_intervals

LEAD = r"(?:^|\n)\s*"
KEYWORD = rf"(?iu){LEAD}(?:câu|cau|question|q)\s*(\d{{1,4}})\s*[:.)-]"
BARE = rf"(?u){LEAD}(\d{{1,3}})\s*[.)-]\s+\p{{Lu}}"
OPTION = rf"(?i){LEAD}(\(?[A-E]\)?\s*[.:)-])"
SAME_LINE = r"(?i)\bA\s*[.:)-].+\bB\s*[.:)-].+\bC\s*[.:)-].+\bD\s*[.:)-]"
#: Words with digits that are no sign of a legacy font.
CLINICAL = ["spo2", "paco2", "pao2", "co2", "o2", "fio2", "hba1c", "t1", "t2", "t3", "t4", "b12", "hco3"]
VOWEL = r"(?iu)[aeiouyàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹ]"


def page_text(text: Column) -> Column:
    """Single spaces, at most one blank line, question markers on lines of their own."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\n])[^\S\n]++((?:Câu|Cau|Question|Q)\s*\d{1,4}\s*[:.)-])", "$1\n$2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def marker_numbers(text: Column) -> Column:
    """Numbers of question markers; bare numbers count only where no keyword stands."""
    number = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda n: n.cast("int"))
    keyword = number(KEYWORD)
    return F.when(F.size(keyword) > 0, keyword).otherwise(number(BARE))


def _estimate(found: Column, distinct: Column, run: Column, options: Column, keywords: Column) -> Column:
    n, markers = F.size(distinct), F.size(found)
    in_sequence = (n <= 1) | (run >= F.greatest(F.lit(2), F.ceil(n * 0.75)))
    optioned = options >= F.least(F.lit(4), F.greatest(F.lit(2), n * 2))
    listing = ~keywords & F.when(n >= 3, (options < 3) | (options / n < 1.5)).otherwise(options == 0)
    confidence = (
        F.when(markers == 0, "none").when(listing, "low").when(markers - n > F.greatest(F.lit(1), F.floor(n / 4)), "low").when(in_sequence & optioned, F.when(n >= 2, "high").otherwise("medium"))
        .when(in_sequence | optioned, "medium").otherwise("low")
    )
    return F.struct(confidence.alias("confidence"), F.when(listing | (markers == 0), 0).otherwise(n).alias("count"), (markers - n).alias("duplicates"), markers.alias("markers"), distinct.alias("numbers"), run.alias("run"))


def marker_estimate(text: Column) -> Column:
    """confidence, count, duplicates, markers, numbers and run of a page's question markers."""
    found = marker_numbers(text)
    distinct = F.array_distinct(found)
    return _estimate(found, distinct, longest_run(distinct), F.regexp_count(text, F.lit(OPTION)), F.regexp_count(text, F.lit(KEYWORD)) > 0)


def scrambled_words(text: Column) -> Column:
    """Words with digits inside that only a legacy font explains."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b([a-zA-Zà-ỹÀ-ỸÀ-ſ]++[1-9]+[a-zA-Zà-ỹÀ-ỸÀ-ſ]*)\b"), F.lit(1))

    def odd(w: Column) -> Column:
        letters = F.regexp_replace(w, "[0-9]", "")
        return ~F.lower(w).isin(*CLINICAL) & (letters != F.upper(letters)) & (F.length(letters) > 1) & w.rlike(VOWEL)

    return F.size(F.filter(found, odd))


def score_pages(pages: DataFrame) -> DataFrame:
    """The pages with their measures and quality: goodText, suspect or scanOrEmpty."""
    d = pages.withColumn("text", page_text(F.col("text")))
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.withColumns({
        "chars": F.length("text"), "strange": T.strange_ratio(F.col("text")), "n_lines": F.size(lines), "n_questions": F.size(marker_numbers(F.col("text"))), "n_options": F.regexp_count("text", F.lit(OPTION)),
        "scrambled": F.contains("text", F.lit("¤")) | (scrambled_words(F.col("text")) >= 3), "__same": F.exists(lines, lambda x: x.rlike(SAME_LINE)),
    })
    mean = F.when(F.col("n_lines") > 0, F.col("chars") / F.col("n_lines")).otherwise(0.0)
    d = d.withColumns({"line_length": mean, "table_risk": F.col("__same") | ((F.col("n_lines") > 40) & (mean < 18))}).drop("__same")
    good = (F.col("chars") >= 450) & (F.col("strange") <= 0.08) & (F.col("n_lines") >= 6) & (F.col("line_length") >= 18) & ((F.col("n_questions") >= 1) | (F.col("n_options") >= 3))
    return d.withColumn("quality", F.when(F.col("chars") < 120, "scanOrEmpty").when(F.col("scrambled") | F.col("table_risk"), "suspect").when(good, "goodText").otherwise("suspect"))


def multi_column_pages(items: DataFrame) -> DataFrame:
    """file_id and page of pages (items: file_id, page, page_width, x, y, width, text) of 20 items at least, blank ones included, with four rows at least that span two columns."""
    blank = F.trim("text") == ""
    w = F.col("page_width")
    sizes = items.groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("items"))
    d = items.where(~blank).withColumn("row", F.floor(F.col("y") / 4 + 0.5) * 4)
    rows = d.groupBy("file_id", "page", "row").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.trim("text"))).alias("chars"), F.min("x").alias("left"), F.max(F.col("x") + F.greatest(F.lit(0.0), F.col("width"))).alias("right"),
        F.max(F.col("x") < w * 0.42).alias("has_left"), F.max(F.col("x") > w * 0.58).alias("has_right"), F.max(w).alias("page_width"),
    )
    risky = (F.col("n") >= 3) & (F.col("chars") >= 20) & F.col("has_left") & F.col("has_right") & (F.col("right") - F.col("left") > F.col("page_width") * 0.48)
    pages = rows.groupBy("file_id", "page").agg(F.count_if(risky).alias("risky")).join(sizes, ["file_id", "page"])
    return pages.where("risky >= 4 AND items >= 20").select("file_id", "page")


def with_columns_risk(pages: DataFrame, two_columns: DataFrame) -> DataFrame:
    """Scored pages with `column_risk`; good text in two columns becomes suspect."""
    d = pages.join(two_columns.select("file_id", "page").distinct().withColumn("column_risk", F.lit(True)), ["file_id", "page"], "left").withColumn("column_risk", F.coalesce("column_risk", F.lit(False)))
    return d.withColumn("quality", F.when(F.col("column_risk") & (F.col("quality") == "goodText"), "suspect").otherwise(F.col("quality")))


# What begins a question, an option, an answer or a shared case at the start of a page's line.
QUESTION_LINE = r"(?iu)^(?:(?:câu|cau|question|q)\s*\d+\s*[:.)-]|(?:\d{1,3}|[IVX]{1,8})\s*[.)-]\s+\S)"
OPTION_LINE = r"(?i)^\(?[A-E]\)?\s*[.:)-]\s*."
ANSWER_LINE = r"(?iu)^(?:đáp\s*án|dap\s*an|answer|correct\s*answer|key)\s*(?:đúng|dung)?\s*[:：.\-]?\s*\(?[A-E]"
SHARED_CASE = r"(?iu)tình\s*huống|tinh\s*huong|dữ\s*kiện|du\s*kien|bệnh\s*cảnh|benh\s*canh|ca\s*bệnh|case|vignette|dùng\s*cho\s*câu|dung\s*cho\s*cau"
HIGH_REASONS = ["trailing_question_without_options", "next_page_starts_with_options", "split_options", "answer_key_on_next_page", "shared_case_crosses_boundary"]


def boundary_risks(pages: DataFrame) -> DataFrame:
    """reasons, severity, page_numbers and the suggested range (start, end) of the boundary after each page, from its lines and its neighbours'.

    `table_risk` and `column_risk` of scored pages count where they are there.  A question is trailing if its line is among the last
    45 % of the page's lines.
    """
    w = Window.partitionBy("file_id").orderBy("page")
    risky = [F.col(c) for c in ("table_risk", "column_risk") if c in pages.columns]
    any_risk = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in risky], F.lit(False))
    # what a page says by itself comes first, step by step: each expression is searched once a page, and neighbours exchange facts, not lines
    d = pages.select("file_id", "page", page_text(F.col("text")).alias("text"), any_risk.alias("risk"))
    d = d.withColumns({"found": marker_numbers(F.col("text")), "keywords": F.regexp_count("text", F.lit(KEYWORD)) > 0, "options": F.regexp_count("text", F.lit(OPTION))})
    split = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.withColumns({"distinct": F.array_distinct("found"), "now": split}).withColumn("run", longest_run(F.col("distinct")))
    places = lambda lines, pattern: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    tail = lambda lines: F.array_join(F.slice(lines, F.greatest(F.size(lines) - 7, F.lit(1)), 8), " ")
    noisy = _estimate(*[F.col(c) for c in ("found", "distinct", "run", "options", "keywords")])["confidence"] == "low"
    d = d.select("file_id", "page", "risk", "now", noisy.alias("noisy"), F.size("now").alias("size"), places(F.col("now"), QUESTION_LINE).alias("asked"), places(F.col("now"), OPTION_LINE).alias("optioned"),
                 F.exists(F.slice("now", 1, 5), lambda x: x.rlike(ANSWER_LINE)).alias("key"), tail(F.col("now")).rlike(SHARED_CASE).alias("shared"))
    d = d.withColumns({"last": F.coalesce(F.array_max("asked"), F.lit(-1)), "first": F.coalesce(F.array_min("asked"), F.lit(-1))})
    same_line = F.exists(F.slice("now", F.greatest(F.col("last") + 1, F.lit(1)), F.size("now") + 1), lambda x: x.rlike(SAME_LINE))
    d = d.withColumn("same_line", same_line).drop("now", "asked")
    ahead = lambda c, default: F.coalesce(F.lead(c).over(w), default)
    d = d.withColumns({
        "page_before": F.lag("page").over(w), "page_after": F.lead("page").over(w), "shared_before": F.coalesce(F.lag("shared").over(w), F.lit(False)), "risk_after": F.lead("risk").over(w), "noisy_after": F.lead("noisy").over(w),
        "next_asked": ahead("first", F.lit(-1)), "next_optioned": ahead("optioned", F.array().cast("array<int>")), "key_next": ahead("key", F.lit(False)), "next_size": ahead("size", F.lit(0)),
    })
    first_option = F.coalesce(F.array_min("next_optioned"), F.lit(-1))
    has_next_question = F.col("next_asked") >= 0
    facts = {
        "options_after": F.when(F.col("last") >= 0, F.size(F.filter("optioned", lambda i: i > F.col("last")))).otherwise(0),
        "trailing": (F.col("last") >= 0) & (F.col("last") >= F.floor(F.col("size") * 0.55)),
        "options_before": F.when(has_next_question, F.size(F.filter("next_optioned", lambda i: i < F.col("next_asked")))).otherwise(F.size("next_optioned")),
        "starts": (first_option >= 0) & (~has_next_question | (first_option < F.col("next_asked"))),
    }
    d = d.withColumns(facts)
    bare = F.col("trailing") & (F.col("options_after") < 2) & ~F.col("same_line")
    shared = F.col("shared") | (F.col("shared_before") & (has_next_question | F.col("starts")))
    continues = (F.col("next_size") > 0) & (F.col("next_asked") != 0) & ~F.col("starts")
    rules = [
        ("trailing_question_without_options", bare),
        ("next_page_starts_with_options", F.col("starts")),
        ("split_options", (F.col("options_after") > 0) & (F.col("options_after") < 4) & (F.col("options_before") > 0)),
        ("answer_key_on_next_page", F.col("key_next") & (F.col("trailing") | (F.col("options_after") > 0))),
        ("shared_case_crosses_boundary", shared),
        ("continuation_without_marker", bare & continues),
        ("table_or_column_split", (F.col("risk") | F.coalesce("risk_after", F.lit(False))) & (F.col("trailing") | F.col("starts") | (F.col("options_before") > 0))),
        ("noisy_duplicate_markers", F.col("noisy") | F.coalesce("noisy_after", F.lit(False))),
    ]
    d = d.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules])))
    previous = shared & F.col("page_before").isNotNull() & (has_next_question | F.col("starts") | continues)
    severity = F.when(F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in HIGH_REASONS])), "high").when(F.size("reasons") > 0, "medium").otherwise("none")
    start = F.when(previous, F.col("page_before")).otherwise(F.col("page"))
    numbers = F.array_compact(F.array(F.when(previous, F.col("page_before")), F.col("page"), F.col("page_after")))
    return d.select("file_id", "page", "reasons", severity.alias("severity"), numbers.alias("page_numbers"), start.alias("start"), F.coalesce("page_after", "page").alias("end"))


def vision_ranges(pages: DataFrame, risks: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """start and end of the page ranges that need vision: pages without good text, merged, cut to a size with an overlap.

    A cut goes back by a page where it would split a question; single pages (size 1) take in the neighbours that their boundaries suggest.
    """
    bad = pages.where("quality != 'goodText'").select("file_id", F.col("page").alias("start"), F.col("page").alias("end"))
    merged = merge_intervals(bad, ["file_id"])
    risky = risks.where(F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in SPLIT_REASONS])))
    cut = cut_ranges(merged, risky, size, overlap)
    if size > 1:
        return cut
    return widen_single_pages(cut, risks, pages.groupBy("file_id").agg(F.max("page").alias("n_pages")))


def case_pages(pages: DataFrame, cases: DataFrame) -> DataFrame:
    """First and last page of the questions of each shared case (file_id, start, end): what must stay in one range.

    Question numbers of a page are rows, cases are spread over their numbers: an equi join.
    """
    numbers = pages.select("file_id", "page", F.explode(F.array_distinct(marker_numbers(page_text(F.col("text"))))).alias("number"))
    spread = cases.where("end - start BETWEEN 0 AND 7").select("file_id", "start", "end", F.explode(F.sequence("start", "end")).alias("number"))
    return numbers.join(spread, ["file_id", "number"]).groupBy("file_id", "start", "end").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).where("last_page - first_page <= 1")
