"""Multiple-choice questions out of Markdown and plain text, as windows over a table of lines.

A document becomes rows (doc, line_no, line).  What a line is by itself (label, option, several options, answer, pair of an
answer key) are Column expressions; what it is by its place are windows over the document's lines:

* a numbered line begins a question only if two letters of options follow within `AHEAD` lines;
* an answer key is an island of lines without other text, from its first header, or line of three pairs, on;
* a question is the running count of beginnings, an option the running count of options, and a line that is nothing else
  continues the option before it, or the question.

Nothing is collected but the lines of one question.  A document is named by one id; null texts have no lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AHEAD = 8
#: Lines of text before the first label that are searched for options.
HEAD = 15
PAIRS_OF_A_KEY = 3
#: What may be left beside the pairs of a line that is a key.
KEY_REST = 15

# Labels, answers and headers as the texts have them.
QUESTION_WORDS = r"câu\s*(?:hỏi|hoi|số|so)?|cau\s*(?:hoi|so)?|bài\s*tập|bai\s*tap|question|case|q(?=\s*\d)"
LABEL = rf"(?iu)^(?:#{{1,6}}\s+)?(?:{QUESTION_WORDS})\s*\d+(?:\s*[:.)-]|(?![\p{{L}}\p{{N}}_]))"
NUMBERED = r"^\[?\d+\]?[\s.:)\-/]+"
OPTION = r"^(?:[-*+]\s+)?(?:\(([A-Ea-e])\)|([A-Ea-e]))\s*[.:)\-]\s*(.*)$"
INLINE = r"(?:^|[;|]|\s+)([✅✓✔]\s*)?\(?([A-Ea-e])\)?\s*[.:)\-]\s*"
ANSWER = r"(?iu)^(?:>\s*)?(?:đáp\s*án(?:\s*đúng)?|dap\s*an(?:\s*dung)?|answer|correct\s*answer)\s*[:：.\-]?\s*\(?([A-E])\)?(?![\p{L}\p{N}_])"
KEY_HEADER = r"(?iu)^(?:đáp\s*án|dap\s*an|bảng\s*đáp\s*án|bang\s*dap\s*an|answer\s*key|answers?|key)(?![\p{L}\p{N}_])"
KEY_PAIR = r"(?iu)(?:^|[\s,;|]+)(?:câu|cau|question|q)?\s*(\d{1,3})\s*(?:[.:)\-]\s*)?([A-E])(?![A-Za-z0-9_])"
EXPLANATION = r"(?iu)^(?:giải\s*thích|giai\s*thich|explanation|lời\s*giải|loi\s*giai|rationale)"
NUMBER_LABELS = (r"(?iu)(?:câu|cau|question|q)\s*(?:số\s*)?(\d{1,3})", r"(\d{1,3})\s*[.:)\-]")
PAIRED_MARKS = (r"\*\*", "__", r"\*", "_", "~~", "`")
TICKS = "✅✓✔"

# private separators of an option's parts
_NEXT, _LETTER, _TEXT = "\x01", "\x02", "\x03"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_marks(c: Column) -> Column:
    """A line without its Markdown: header, paired marks, quote and list signs."""
    inner = reduce(lambda t, mark: F.regexp_replace(t, f"{mark}(.+?){mark}", "$1"), PAIRED_MARKS, F.regexp_replace(c, r"^#{1,6}\s+", ""))
    return trimmed(F.regexp_replace(F.regexp_replace(inner, r"^>\s*", ""), r"^[-*+]\s+", ""))


def _option(letter: Column, text: Column, ticked: Column) -> Column:
    """One option: bold or ticked ones are marked as the answer."""
    bold = F.regexp_extract(text, r"^(\*\*|__)(.+)\1$", 2)
    plain = F.when(bold != "", trimmed(bold)).otherwise(without_marks(text))
    return F.struct(F.upper(letter).alias("letter"), trimmed(F.regexp_replace(plain, f"^[{TICKS}]", "")).alias("text"), (ticked | (bold != "") | plain.rlike(f"^[{TICKS}]")).alias("marked"))


def inline_options(line: Column) -> tuple[Column, Column]:
    """What stands before the first of several options of one line, and the options in the order of the line, in either case of letters."""
    parts = F.split(F.regexp_replace(line, INLINE, f"{_NEXT}$1{_LETTER}$2{_TEXT}"), _NEXT)
    each = F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: _option(F.regexp_extract(p, f"{_LETTER}(.){_TEXT}", 1), trimmed(F.regexp_replace(F.substring_index(p, _TEXT, -1), r"[;|\s]+$", "")), F.length(F.substring_index(p, _LETTER, 1)) > 0),
    )
    found = F.filter(each, lambda o: o["text"] != "")
    return trimmed(F.get(parts, F.lit(0))), F.when((F.size(each) >= 2) & (F.size(found) >= 2), found)


def one_option(line: Column) -> Column:
    """The option of a line that has one, else null."""
    ticked = line.rlike(f"^[{TICKS}]")
    bare = F.regexp_replace(trimmed(F.regexp_replace(line, f"^[{TICKS}]", "")), r"^[-*+]\s+", "")
    letter = F.concat(F.regexp_extract(bare, OPTION, 1), F.regexp_extract(bare, OPTION, 2))
    return F.when(letter != "", _option(letter, trimmed(F.regexp_extract(bare, OPTION, 3)), ticked))


def letter_bits(options: Column) -> Column:
    """Letters as bits, so that windows can count distinct ones."""
    return F.aggregate(options, F.lit(0), lambda bits, o: bits.bitwiseOR(F.pow(F.lit(2), F.ascii(o["letter"]) - 65).cast("int")))


def key_pairs(line: Column) -> Column:
    """(number, letter) pairs of an answer key, in the order of the line."""
    numbers, letters = (F.regexp_extract_all(line, F.lit(KEY_PAIR), F.lit(i)) for i in (1, 2))
    return F.filter(F.transform(F.arrays_zip(numbers.alias("n"), letters.alias("c")), lambda p: F.struct(p["n"].cast("int").alias("number"), F.upper(p["c"]).alias("letter"))), lambda p: p["number"] > 0)


def document_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no (from 0) and line of every line that is not blank."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return docs.select(doc, F.posexplode(lines).alias("line_no", "raw")).select(doc, "line_no", trimmed(F.col("raw")).alias("line"))


def answer_keys(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with `pairs`, and whether they are `in_key`: sections may stand anywhere, with other text before and after.

    A section begins with a header (that is no answer by itself), or with PAIRS_OF_A_KEY pairs or more in a line that is no label, and goes on while lines
    have a pair.  Each stretch of lines without a stop is an island; its key is what comes from its first beginning on.
    """
    rows = lines.withColumn("pairs", key_pairs(F.col("line")))
    n = F.size(F.array_distinct(F.transform("pairs", lambda p: p["number"])))
    begins = (F.col("line") != "") & ((F.col("line").rlike(KEY_HEADER) & ~F.col("line").rlike(ANSWER)) | ((n >= PAIRS_OF_A_KEY) & ~F.col("line").rlike(LABEL)))
    stops = (F.col("line") != "") & ~begins & (n == 0)
    by_doc = Window.partitionBy(doc).orderBy("line_no")
    rows = rows.withColumn("__begins", begins).withColumn("__stops", stops).withColumn("__island", F.count_if("__stops").over(by_doc))
    so_far = Window.partitionBy(doc, "__island").orderBy("line_no")
    inside = F.max("__begins").over(so_far) & ~F.col("__stops") & (F.col("line") != "")
    return rows.withColumn("in_key", inside).drop("__begins", "__stops", "__island")


def key_answers(keyed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, number and letter of all answer keys; the last letter of a number counts."""
    pairs = keyed.where("in_key").select(doc, "line_no", F.posexplode("pairs").alias("pos", "p"))
    return pairs.groupBy(doc, F.col("p.number").alias("number")).agg(F.max_by("p.letter", F.struct("line_no", "pos")).alias("letter"))


def classified(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with what they are: before, options, boundary, and the running question of the document (0 before the first)."""
    rows = answer_keys(lines, doc).withColumn("clean", without_marks(F.col("line")))
    before, several = inline_options(F.col("line"))
    single = one_option(F.col("line"))
    rows = rows.withColumns({"several": several, "single": single}).withColumn("before", F.when(F.col("several").isNotNull(), without_marks(before)))
    options = F.when(F.col("several").isNotNull(), F.col("several")).when(F.col("single").isNotNull(), F.array("single")).otherwise(F.array().cast("array<struct<letter:string,text:string,marked:boolean>>"))
    rows = rows.withColumn("options", F.when(F.col("in_key"), F.slice(options, 1, 0)).otherwise(options)).withColumn("bits", letter_bits(F.col("options")))
    rest = F.length(trimmed(F.regexp_replace("clean", r"(?iu)(?:câu|cau|question|q)?\s*\d+\s*(?:[.:)\-]\s*)?[A-E](?![A-Za-z0-9_])", "")))
    is_key = F.col("in_key") | F.col("clean").rlike(KEY_HEADER) | F.col("clean").rlike(ANSWER) | ((F.size("pairs") > 0) & (rest < KEY_REST))
    by_doc = Window.partitionBy(doc).orderBy("line_no")
    ahead = F.bit_count(F.coalesce(F.bit_or("bits").over(by_doc.rowsBetween(1, AHEAD)), F.lit(0))) >= 2
    label = F.col("clean").rlike(LABEL) | F.col("line").rlike(LABEL)
    rows = rows.withColumn("labelled", (F.col("clean") != "") & ~is_key & (label | (F.col("clean").rlike(NUMBERED) & ahead)))
    whole = Window.partitionBy(doc)
    first = F.coalesce(F.min(F.when(F.col("labelled"), F.col("line_no"))).over(whole), F.lit(HEAD))
    rows = rows.withColumn("__first", first)
    head = F.coalesce(F.bit_or(F.when(F.col("line_no") < F.least("__first", F.lit(HEAD)), F.col("bits")).otherwise(0)).over(whole), F.lit(0))
    rows = rows.withColumn("boundary", F.col("labelled") | ((F.col("line_no") == 0) & (F.col("__first") > 0) & (F.bit_count(head) >= 2)))
    return rows.withColumn("block", F.count_if("boundary").over(by_doc)).drop("__first", "labelled", "several", "single", "bits")


def blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every block from one boundary to the next: doc, block, question, options (letter, text), answer by its own marks, and notes (its lines)."""
    rows = classified(document_lines(docs, doc, text), doc).where("block > 0 and line != '' and not in_key")
    in_block = Window.partitionBy(doc, "block").orderBy("line_no")
    rows = rows.withColumn("so_far", F.coalesce(F.sum(F.size("options")).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    letter = F.upper(F.regexp_extract("clean", ANSWER, 1))
    kind = F.when(F.size("options") > 0, "options").when((letter != "") & (F.col("so_far") >= 2), "answer").when(F.col("so_far") == 0, "question").when(F.col("clean").rlike(EXPLANATION), "skip").otherwise("more")
    line = F.struct("line_no", kind.alias("kind"), "clean", "before", "options", letter.alias("letter"))
    whole = rows.groupBy(doc, "block").agg(F.array_sort(F.collect_list(line)).alias("l"))  # the lines of one question
    texts = F.transform("l", lambda x: F.when(x["kind"] == "question", x["clean"]).when((x["kind"] == "options") & (x["before"] != ""), x["before"]))

    def listed(state: Column, x: Column) -> Column:
        new = F.transform(x["options"], lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text")))
        last = F.element_at(state, -1)
        longer = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.struct(last["letter"].alias("letter"), F.concat(last["text"], F.lit(" "), x["clean"]).alias("text"))))
        return F.when(x["kind"] == "options", F.concat(state, new)).when(x["kind"] == "more", longer).otherwise(state)

    options = F.aggregate("l", F.array().cast("array<struct<letter:string,text:string>>"), listed)
    marked = F.flatten(F.transform("l", lambda x: F.transform(F.filter(x["options"], lambda o: o["marked"]), lambda o: o["letter"])))
    told = F.filter("l", lambda x: x["kind"] == "answer")
    answer = F.when(F.size(marked) > 0, F.element_at(marked, -1)).when(F.size(told) > 0, F.get(told, F.lit(0))["letter"])
    return whole.select(
        doc, "block", squeezed(F.array_join(F.array_compact(texts), " ")).alias("question"), F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), squeezed(o["text"]).alias("text"))).alias("options"),
        answer.alias("answer"), F.transform("l", lambda x: x["clean"]).alias("notes"),
    )


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def markdown_questions(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_options: int = 2) -> DataFrame:
    """doc, ordinal, number, question, options (`A. text`) and answer of every question with enough options; answers by mark, answer line, then key."""
    docs = docs.select(doc, text)
    found = blocks(docs, doc, text).where((F.col("question") != "") & (F.size("options") >= least_options))
    number = F.coalesce(*[F.nullif(F.regexp_extract("question", p, 1), F.lit("")) for p in NUMBER_LABELS]).cast("int")
    found = found.withColumn("number", number)
    keys = key_answers(answer_keys(document_lines(docs, doc, text), doc), doc)
    told = found.join(keys, [doc, "number"], "left")
    ordinal = F.row_number().over(Window.partitionBy(doc).orderBy("block"))
    return told.select(doc, ordinal.alias("ordinal"), "number", "question", F.transform("options", lambda o: F.concat(o["letter"], F.lit(". "), o["text"])).alias("options"), F.coalesce("answer", "letter", F.lit("")).alias("answer"))


def structured_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, count and structured text: marked questions, or, where some beginning has no options, every beginning with its lines as notes."""
    docs = docs.select(doc, text)
    begun = blocks(docs, doc, text)
    asked = markdown_questions(docs, doc, text)
    ticked = F.transform("options", lambda o: F.when(F.substring(o, 1, 1) == F.col("answer"), F.concat(F.lit("✅ "), o)).otherwise(o))
    body = F.concat(F.lit("<<<MCQ "), F.col("ordinal"), F.lit(">>>\nQuestion: "), "question", F.lit("\n"), F.array_join(ticked, "\n"))
    whole = asked.withColumn("body", body).groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "body"))), lambda x: x["body"]).alias("bodies"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("block"))
    rest = F.slice("notes", 2, F.size("notes"))
    marker = F.concat(F.lit("<<<MCQ "), F.col("place"), F.lit(">>>\nQuestion: "), F.get("notes", F.lit(0)), F.when(F.size("notes") > 1, F.concat(F.lit("\nAnswer/Notes:\n"), F.array_join(rest, "\n"))).otherwise(""))
    marked = begun.withColumn("place", place).withColumn("body", marker).groupBy(doc).agg(F.count(F.lit(1)).alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]).alias("markers"))
    both = marked.join(whole, doc, "left").withColumn("fallback", F.col("m") > F.coalesce("n", F.lit(0)))
    count, bodies = F.when(F.col("fallback"), F.col("m")).otherwise(F.col("n")), F.when(F.col("fallback"), F.col("markers")).otherwise(F.col("bodies"))
    return both.select(doc, count.alias("count"), "fallback", F.concat(F.lit("[MARKDOWN_MCQ_COUNT: "), count, F.lit("]\n\n"), F.array_join(bodies, "\n\n")).alias("text"))
