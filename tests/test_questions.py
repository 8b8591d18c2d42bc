"""Question texts by hand-made cases, page risks and ranges against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stemforge.operators import markdown, pdf, ranges
from stemforge.operators.paragraphs import PageQuestions, page_questions, paragraph_questions


def asked(spark, text):
    rows = markdown.markdown_questions(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    return [(r["number"], r["question"], r["options"], r["answer"]) for r in rows]


def test_lower_case_and_unordered_inline_options(spark):
    assert asked(spark, "Câu 1: Pick\na) one b) two c) three d) four") == [(1, "Câu 1: Pick", ["A. one", "B. two", "C. three", "D. four"], "")]
    assert asked(spark, "Câu 2. Pick A. x B. y D. w C. z") == [(2, "Câu 2. Pick", ["A. x", "B. y", "D. w", "C. z"], "")]
    assert asked(spark, "Q3: Pick\n(a): x | (b): y\n✅ C - z") == [(3, "Q3: Pick", ["A. x", "B. y", "C. z"], "C")]


def test_answer_keys_in_the_middle_and_with_text_after_them(spark):
    q = "Câu {0}. Pick\nA. v{0}\nB. w{0}"
    text = "\n".join([q.format(1), q.format(2), "ĐÁP ÁN", "1A 2B", "Notes: more", q.format(3), "1. B, 2. A; 3-C 4 D", "tail text"])
    got = asked(spark, text)
    assert [(n, a) for n, _, _, a in got] == [(1, "B"), (2, "A"), (3, "C")]
    assert got[1][2] == ["A. v2", "B. w2 Notes: more"] and got[2][2] == ["A. v3", "B. w3 tail text"]
    # two pairs are no key by themselves; a labelled line of pairs is none
    assert [x[3] for x in asked(spark, "Câu 1. Pick\nA. v\nB. w\n1A 2B")] == [""]


def test_answers_by_mark_line_and_key(spark):
    body = "Câu 1. Pick\nA. v\n{}\n{}\n\nAnswer key\n1C"
    assert asked(spark, body.format("B. **w**", "Answer: A"))[0][3] == "B"  # marks win
    assert asked(spark, body.format("B. w", "> Đáp án: (A)"))[0][3] == "A"
    assert asked(spark, body.format("B. w", "C. u"))[0][3] == "C"
    assert asked(spark, "Câu 1. Pick\nA. ✅ v\nB. w")[0][2:] == (["A. v", "B. w"], "A")


def test_beginnings(spark):
    head = "Some text\nA. one\nB. two\nCâu 2: Next\nA. x\nB. y"
    assert [x[1] for x in asked(spark, head)] == ["Some text", "Câu 2: Next"]
    assert [x[1] for x in asked(spark, "1. Listed\n2. Also listed\n3. Asked\nA. x\nB. y")] == ["3. Asked"]
    assert asked(spark, "1. Only\n2. a\n3. list") == [] and asked(spark, "") == []
    assert asked(spark, "### **Câu 7**\nPick *this*\n* A. x\n+ B. `y`\nwrapped\nGiải thích: no")[0] == (7, "Câu 7 Pick this", ["A. x", "B. y wrapped"], "")
    assert markdown.markdown_questions(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_structured_text_falls_back_to_markers(spark):
    texts = [(1, "Câu 1. One\nA. x\n✅ B. y"), (2, "Câu 1. One\nA. x\nB. y\nCâu 2. Two\nno options"), (3, "nothing")]
    got = {r["doc_id"]: r for r in markdown.structured_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["text"] == "[MARKDOWN_MCQ_COUNT: 1]\n\n<<<MCQ 1>>>\nQuestion: Câu 1. One\nA. x\n✅ B. y" and not got[1]["fallback"]
    assert got[2]["fallback"] and got[2]["text"] == "[MARKDOWN_MCQ_COUNT: 2]\n\n<<<MCQ 1>>>\nQuestion: Câu 1. One\nAnswer/Notes:\nA. x\nB. y\n\n<<<MCQ 2>>>\nQuestion: Câu 2. Two\nAnswer/Notes:\nno options"
    assert 3 not in got


def paragraphs(spark, *rows):
    d = spark.createDataFrame([("d", i, *([*r, False, None][:3] if isinstance(r, tuple) else (r, False, None))) for i, r in enumerate(rows)], "doc_id string, ord int, text string, marked boolean, level string")
    return [(r["question"], r["options"], r["answer"]) for r in paragraph_questions(d).orderBy("ordinal").collect()]


def test_paragraphs(spark):
    four = ["A. a", "B. b", "C. c", "D. d"]
    assert paragraphs(spark, "Câu 1. One", *four[:3]) == []  # three options are none
    assert paragraphs(spark, "Câu 1. One", "more", *four[:3], ("D. d", True), "Câu 2. Two", *four) == [("Câu 1. One more", four, "D"), ("Câu 2. Two", four, "")]
    # list levels: letters are options, another level after four options begins a question
    got = paragraphs(spark, ("First asked", False, "decimal"), ("a", False, "letter"), ("b", True, "letter"), ("c", False, "letter"), ("d", False, "letter"), ("Second asked", False, "decimal"), *four)
    assert got == [("First asked", four, "B"), ("Second asked", four, "")]
    # all in one paragraph, an answer line, text that goes on, options without a question
    assert paragraphs(spark, *four, "Câu 1: One", "a) a; b) b; c) c; d) d", "Đáp án đúng: C") == [("Câu 1: One", four, "C")]
    assert paragraphs(spark, "Câu 1: One", "A. a", "goes on", None, " ", *four[1:]) == [("Câu 1: One", ["A. a goes on", *four[1:]], "")]
    # five options at most: a sixth begins anew and belongs to no question
    assert paragraphs(spark, "Câu 1: One", *four, "E. e", "A. x") == [("Câu 1: One", [*four, "E. e"], "")]
    assert paragraphs(spark, "Câu 1: One", *four, "Câu 2: Two", *four, "ĐÁP ÁN", "1.B 2.D") == [("Câu 1: One", four, "B"), ("Câu 2: Two", four, "D")]


def test_paragraphs_of_several_documents_do_not_mix(spark):
    rows = [(d, i, t, False, None) for d in "abc" for i, t in enumerate([f"Câu 1. {d}", "A. a", "B. b", "C. c", "D. d"])]
    d = spark.createDataFrame(rows, "doc_id string, ord int, text string, marked boolean, level string").repartition(3)
    assert sorted((r["doc_id"], r["ordinal"], r["question"]) for r in paragraph_questions(d).collect()) == [(x, 1, f"Câu 1. {x}") for x in "abc"]


def pages(spark, text):
    return [(r["question"], r["options"], r["answer"]) for r in page_questions(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()]


def test_page_texts(spark):
    assert pages(spark, "Câu 1: One\nA. a\n(B) b\nwrapped\nDap an: b  Câu 2: Two\nmore\nA. a\nA. again") == [("Câu 1: One", ["A. a", "B. b wrapped"], "B")]
    # a line whose next one is an option begins a question once two options are there; bare numbers need a mark or some length
    assert pages(spark, "Câu 1: One\nA. a\nB. b\nSo what\nA. c\nB. d") == [("Câu 1: One", ["A. a", "B. b"], ""), ("So what", ["A. c", "B. d"], "")]
    assert [q for q, _, _ in pages(spark, "IV. Really?\nA. a\nB. b\n5. short\n6. long enough to be one\nA. c\nB. d")] == ["IV. Really?", "6. long enough to be one"]
    # orphans only where nothing is headed, and from a length on
    assert pages(spark, "An orphan that is long enough, yes\nA. a\nB. b") != [] == pages(spark, "An orphan\nA. a\nB. b")
    assert [q for q, _, _ in pages(spark, "An orphan that is long enough, yes\nA. a\nB. b\nCâu 1: One\nA. a\nB. b")] == ["Câu 1: One"]
    assert pages(spark, None) == [] == pages(spark, "")


def test_page_questions_by_lateral_sql(spark):
    spark.udtf.register("questions_of", PageQuestions)
    spark.createDataFrame([(1, "Câu 1: One\nA. a\nB. b"), (2, "none")], "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, q.question FROM texts, LATERAL questions_of(text) q").collect()
    assert [tuple(r) for r in got] == [(1, "Câu 1: One")]


def brute_risk(previous, now, after):
    """Reasons and range of a boundary, line by line."""
    lines = [[x.strip() for x in (t or "").split("\n") if x.strip()] for t in (previous, now, after)]
    p, c, n = lines
    is_q = lambda x: bool(re.match(r"(?:câu|cau|question|q)\s*\d+\s*[:.)-]", x, re.I) or re.match(r"(?:\d{1,3}|[IVX]{1,8})\s*[.)-]\s+\S", x, re.I))
    is_o = lambda x: bool(re.match(r"\(?[A-E]\)?\s*[.:)-]\s*.", x, re.I))
    is_k = lambda x: bool(re.match(r"(?:đáp\s*án|dap\s*an|answer|correct\s*answer|key)\s*(?:đúng|dung)?\s*[:：.\-]?\s*\(?[A-E]", x, re.I))
    same = lambda x: bool(re.search(r"\bA\s*[.:)-].+\bB\s*[.:)-].+\bC\s*[.:)-].+\bD\s*[.:)-]", x, re.I))
    case = lambda t: bool(re.search(r"tình\s*huống|case|vignette", " ".join(t[-8:]), re.I))
    last = max((i for i, x in enumerate(c) if is_q(x)), default=-1)
    next_q, next_o = next((i for i, x in enumerate(n) if is_q(x)), -1), next((i for i, x in enumerate(n) if is_o(x)), -1)
    before = sum(is_o(x) for x in (n[:next_q] if next_q >= 0 else n))
    starts = next_o >= 0 and (next_q < 0 or next_o < next_q)
    behind = sum(is_o(x) for x in c[last + 1 :]) if last >= 0 else 0
    trailing = last >= 0 and last >= int(len(c) * 0.55)
    bare = trailing and behind < 2 and not any(same(x) for x in c[max(last, 0) :])
    shared = case(c) or (case(p) and (next_q >= 0 or starts))
    goes_on = bool(n) and next_q != 0 and not starts
    reasons = [name for name, hit in [
        ("trailing_question_without_options", bare), ("next_page_starts_with_options", starts), ("split_options", 0 < behind < 4 and before > 0),
        ("answer_key_on_next_page", any(map(is_k, n[:5])) and (trailing or behind > 0)), ("shared_case_crosses_boundary", shared), ("continuation_without_marker", bare and goes_on),
    ] if hit]
    return reasons, shared and previous is not None and (next_q >= 0 or starts or goes_on)


def test_boundary_risks_against_line_by_line_reading(spark):
    r = random.Random(9)
    pool = ["Câu 4: Asked here", "12. Bare and asked", "A. one", "(b) two", "C) three", "D. four", "plain text going on", "Answer: B", "Tình huống cho câu 3", "A. x B. y C. z D. w", "", "case one"]
    files = {f: ["\n".join(r.choice(pool) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(1, 6))] for f in range(120)}
    rows = [(str(f), i + 1, t, False) for f, texts in files.items() for i, t in enumerate(texts)]
    got = {(x["file_id"], x["page"]): x for x in pdf.boundary_risks(spark.createDataFrame(rows, "file_id string, page int, text string, table_risk boolean")).collect()}
    clean = lambda t: None if t is None else re.sub(r"[ \t]+", " ", t)
    for f, texts in files.items():
        for i in range(len(texts)):
            before, after = texts[i - 1] if i else None, texts[i + 1] if i + 1 < len(texts) else None
            reasons, previous = brute_risk(clean(before), clean(texts[i]), clean(after))
            g = got[str(f), i + 1]
            assert [x for x in g["reasons"] if x != "noisy_duplicate_markers"] == reasons, (texts, i)
            assert (g["start"], g["end"]) == (i if previous else i + 1, i + 2 if after is not None else i + 1)
    severities = {g["severity"] for g in got.values()}
    assert severities == {"none", "medium", "high"} or severities == {"none", "high"}


def test_table_and_column_risks(spark):
    rows = [("f", 1, "Câu 1: x\nA. a", False), ("f", 2, "B. b\nC. c", True), ("f", 3, "text", False)]
    d = spark.createDataFrame(rows, "file_id string, page int, text string, table_risk boolean")
    got = {x["page"]: x["reasons"] for x in pdf.boundary_risks(d).collect()}
    assert "table_or_column_split" in got[1] and "table_or_column_split" not in got[3]
    scored = spark.createDataFrame([("f", 1, "goodText"), ("f", 2, "goodText"), ("f", 3, "scanOrEmpty")], "file_id string, page int, quality string")
    two = spark.createDataFrame([("f", 2), ("f", 3)], "file_id string, page int")
    assert [tuple(x) for x in pdf.with_columns_risk(scored, two).select("page", "quality", "column_risk").orderBy("page").collect()] == [(1, "goodText", False), (2, "suspect", True), (3, "scanOrEmpty", True)]


def test_blank_items_count_towards_a_two_column_page(spark):
    items = [("f", 1, 600.0, x, y * 20.0, 90.0, "some words") for y in range(4) for x in (20.0, 120.0, 420.0, 500.0)] + [("f", 1, 600.0, 0.0, 500.0, 1.0, " ")] * 4
    schema = "file_id string, page int, page_width double, x double, y double, width double, text string"
    assert pdf.multi_column_pages(spark.createDataFrame(items, schema)).count() == 1
    assert pdf.multi_column_pages(spark.createDataFrame(items[:-1], schema)).count() == 0


def test_ranges_against_plain_loops(spark):
    r = random.Random(3)
    cuts, groups, risky, whole = [], [], [], []
    want_merged, want_cut = [], []
    for f in range(150):
        n = r.randrange(1, 25)
        now = [(a, min(n, a + 2)) for a in range(1, n + 1, 2)]
        cuts += [(f, a, b) for a, b in now]
        for ord_ in range(r.randrange(0, 6)):
            a = r.randrange(1, n + 1)
            b = a + r.randrange(0, 4)
            groups.append((f, ord_, a, b))
            touched = [x for x in now if x[0] <= b and x[1] >= a]
            if len(touched) > 1:
                now = [x for x in now if x not in touched] + [(min(x[0] for x in touched), max(x[1] for x in touched))]
        want_merged += [(f, a, b) for a, b in now]
        bad = {p for p in range(1, n + 1) if r.random() < 0.4}
        risky += [(f, p) for p in bad]
        whole.append((f, 1, n))
        start = 1
        while start <= n:
            end = min(n, start + 2)
            if end < n and end in bad and end > start:
                end -= 1
            want_cut.append((f, start, end))
            following = max(start + 1, end)
            if following > n or end >= n:
                break
            start = following
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    merged = ranges.merge_by_groups(frame(cuts, "file_id", "start", "end"), frame(groups, "file_id", "ord", "start", "end"))
    assert sorted(tuple(x) for x in merged.collect()) == sorted(want_merged)
    cut = ranges.cut_ranges(frame(whole, "file_id", "start", "end"), frame(risky, "file_id", "page"), 3, 1)
    assert sorted(tuple(x) for x in cut.collect()) == sorted(want_cut)


def test_single_pages_take_in_their_neighbours(spark):
    risks = spark.createDataFrame([("f", 2, "high", 1, 3), ("f", 3, "none", 3, 4), ("f", 5, "medium", 5, 6)], "file_id string, page int, severity string, start int, end int")
    single = spark.createDataFrame([("f", p, p) for p in range(1, 7)] + [("f", 1, 2)], "file_id string, start int, end int")
    counts = spark.createDataFrame([("f", 6)], "file_id string, n_pages int")
    got = sorted((x["start"], x["end"]) for x in ranges.widen_single_pages(single, risks, counts).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (4, 4), (5, 6)]


@pytest.mark.parametrize("size", [1, 3])
def test_vision_ranges_cover_all_bad_pages(spark, size):
    r = random.Random(1)
    rows = [(str(f), p, r.choice(["goodText", "suspect", "suspect"]), r.choice(["Câu 1: x", "A. a\nB. b", "plain"])) for f in range(30) for p in range(1, 10)]
    d = spark.createDataFrame(rows, "file_id string, page int, quality string, text string")
    got = pdf.vision_ranges(d, pdf.boundary_risks(d), size=size).withColumn("p", F.explode(F.sequence("start", "end"))).select("file_id", "p").distinct().collect()
    assert {(f, p) for f, p, q, _ in rows if q != "goodText"} <= {tuple(x) for x in got}


def test_neighbouring_pages_exchange_facts_not_lines(spark):
    """What crosses the exchange of boundary risks are numbers and flags: no text, and no list of lines."""
    d = spark.createDataFrame([("f", 1, "Câu 1: a\nA. b"), ("f", 2, "B. c")], "file_id string, page int, text string")
    plan = pdf.boundary_risks(d)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window [" in line)
    assert "array<string>" not in window and "lag(now" not in window and "lead(now" not in window and "lead(optioned" in window


def test_pages_of_documents_are_cut_in_one_pass(spark):
    from stemforge.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0").collect()}
    d = catalogue._pages(spark, sf)
    assert sorted(tuple(r) for r in d.collect()) == sorted((k, i // 1500 + 1, t[i : i + 1500]) for k, t in texts.items() for i in range(0, len(t), 1500))
    assert "substring" not in d._jdf.queryExecution().optimizedPlan().toString()
