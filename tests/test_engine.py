"""The engine's operators on small inputs of the shapes that question banks have."""

import io
import json
import random
import zipfile

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stemforge.functions import modeljson, similarity
from stemforge.functions import text as T
from stemforge.operators import dedupe, pdf, policy, segments, windows
from stemforge.operators import records as R
from stemforge.plans import catalogue
from stemforge.sources import docx, export
from stemforge.streaming import keys

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in columns.items()])


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_normal_forms(spark):
    n = lambda s: value(spark, T.normalize_field(F.lit(s)))
    assert n("Câu 12: <b>Đau&nbsp;ngực</b> [hình 1] là gì?") == "dau nguc la gi"
    assert n("A. Tăng huyết áp!") == "tang huyet ap"
    assert n("x &#65;&#x42; &bogus; y") == "x ab y"
    assert n(None) == ""
    assert value(spark, T.semantic_field(F.lit("BN có THA, phát biểu nào là đúng"))) == "benh nhan co tang huyet ap dung"


@pytest.mark.parametrize("text,number", [("12. abc", 12), ("Câu hỏi 7: abc", 7), ("abc 3 def", 3), ("abc", 999999), ("", 999999), (None, 999999)])
def test_sort_numbers(spark, text, number):
    assert value(spark, T.sort_number(F.lit(text).cast("string"))) == number


def test_similarity_functions_agree(spark):
    pairs = [("tang huyet ap la gi", "huyet ap tang la gi"), ("mot hai ba", "mot hai ba bon"), ("abc", ""), ("", ""), ("khong co gi", "xyz uvw"), ("aa bb cc", "aa bb dd")]
    d = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in d.select("a", "b", T.levenshtein_ratio(a, b).alias("l"), T.dice(a, b).alias("d"), T.token_sort_ratio(a, b).alias("s"), T.token_set_ratio(a, b).alias("t"), similarity.partial_ratio_udf("a", "b").alias("p")).collect():
        assert r["l"] == pytest.approx(similarity.ratio(r["a"], r["b"]))
        assert r["d"] == pytest.approx(similarity.dice(r["a"], r["b"]))
        assert r["s"] == pytest.approx(similarity.sort_ratio(r["a"], r["b"]))
        assert r["t"] == pytest.approx(similarity.set_ratio(r["a"], r["b"]))
        assert r["p"] == pytest.approx(similarity.partial_ratio(r["a"], r["b"]))


words = st.lists(st.sampled_from("tim phoi gan than mau benh thuoc la khong".split()), max_size=9).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(words, words)
def test_scores_are_symmetric_and_bounded(a, b):
    for f in (similarity.ratio, similarity.sort_ratio, similarity.set_ratio, similarity.dice, similarity.partial_ratio):
        assert 0 <= f(a, b) <= 1 and f(a, a) == 1
        if f is not similarity.partial_ratio:  # of two texts as long the first is the part
            assert f(a, b) == pytest.approx(f(b, a))


OPTIONS = ["A. Tăng huyết áp", "B. Đái tháo đường", "C. Suy tim", "D. Viêm phổi"]


@pytest.fixture(scope="module")
def bank(spark):
    rows = [
        (1, "Câu 1. Nguyên nhân thường gặp nhất của đau ngực cấp ở người lớn tuổi", OPTIONS, "A"),
        (2, "Cau 1) NGUYEN NHAN thuong gap nhat cua dau nguc cap o nguoi lon tuoi?", ["A) Tang huyet ap", "B) Dai thao duong", "C) Suy tim", "D) Viem phoi"], "A"),
        (3, "Câu 2. Nguyên nhân thường gặp nhất của đau ngực cấp ở người lớn tuổi", [OPTIONS[1], OPTIONS[0], OPTIONS[3], OPTIONS[2]], "B"),
        (4, "Câu 3. Nguyên nhân thường gặp nhất của đau ngực cấp ở người lớn tuổi, ngoại trừ", OPTIONS, "A"),
        (5, "Câu 9. Thuốc nào dùng để hạ sốt cho trẻ em dưới hai tuổi", ["A. Một", "B. Hai", "C. Ba", "D. Bốn"], "C"),
        (6, "Câu 1. Nguyên nhân thường gặp nhất của đau ngực cấp ở người lớn tuổi", OPTIONS, "C"),
    ]
    return spark.createDataFrame([(i, q, o, a, i) for i, q, o, a in rows], "id long, question string, options array<string>, answer string, position long")


def test_first_come_first_kept(bank):
    got = {r["id"]: r for r in dedupe.dedupe(bank).collect()}
    assert got[1]["action"] == "new" and got[5]["action"] == "new"
    assert got[2]["action"] == "autoSkip" and got[2]["matched_with"] == 1
    assert got[3]["action"] == "review"
    assert got[4]["action"] == "new"  # the polarity is another
    assert got[6]["action"] == "review" and "answer_conflict" in got[6]["flags"]


def test_answers_of_equal_normal_form_do_not_conflict(spark):
    rows = [(i, f"Câu {i}. Nguyên nhân thường gặp nhất của đau ngực cấp ở người lớn tuổi", OPTIONS, a, i) for i, a in enumerate(["Tăng huyết áp", "<b>tang  huyet ap</b>", None, "Suy tim"], 1)]
    bank = spark.createDataFrame(rows, "id long, question string, options array<string>, answer string, position long")
    got = {r["id"]: r for r in dedupe.dedupe(bank).collect()}
    assert [got[i]["action"] for i in (1, 2, 3, 4)] == ["new", "autoSkip", "autoSkip", "review"]
    assert "answer_conflict" not in (got[2]["flags"] or []) and "answer_conflict" in got[4]["flags"]


def test_rounds_are_the_sequential_run(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (2, 6)]
    rows = spark.range(1, 7).select("id")
    kept = {r["id"] for r in dedupe.resolve(rows, spark.createDataFrame(pairs, "earlier long, later long")).where("kept").collect()}
    expect: set[int] = set()
    for i in range(1, 7):
        if not any(e in expect for e, later in pairs if later == i):
            expect.add(i)
    assert kept == expect


RECORD = {"question": "Câu 4: Tim có mấy buồng?", "options": ["A. 2", "B. 3", "*C. 4", "D. 5"], "explanation": "bốn"}


def test_model_json_shapes():
    good = json.dumps({"questions": [RECORD]})
    assert modeljson.parse(good)["questions"][0]["answer"] == "C" and modeljson.parse(good)["questions"][0]["number"] == 4
    assert len(modeljson.parse(f"Here:\n```json\n{good}\n```")["questions"]) == 1
    assert len(modeljson.parse(good.replace("]}]}", "],},]}"))["questions"]) == 1
    assert len(modeljson.parse(json.dumps([RECORD]))["questions"]) == 1
    two = json.dumps({"questions": [RECORD, RECORD]})
    cut = modeljson.parse(two[:-40], expected=2)
    assert len(cut["questions"]) == 1 and cut["salvaged"] and cut["missing"] == 1
    assert modeljson.parse("no json here")["error"] and modeljson.parse('{"questions": []}')["error"] == "empty"
    assert modeljson.parse('{"questions": []}', allow_empty=True)["error"] is None
    assert modeljson.truncated(two[:-3]) and not modeljson.truncated(two)
    tricky = json.dumps({"questions": [{**RECORD, "question": 'What is "{[" for?'}]})
    assert modeljson.parse(tricky)["questions"][0]["question"].startswith("What")


@pytest.mark.parametrize(
    "options,answer,expect",
    [
        ({"B": "hai", "A": "một", "C": "ba"}, 2, (["A. một", "B. hai", "C. ba"], "B")),
        ("A. một B. hai C. ba", "ba", (["A. một", "B. hai", "C. ba"], "C")),
        ([{"label": "B", "text": "hai"}, {"label": "A", "text": "✓ một"}], None, (["A. một", "B. hai"], "A")),
        (["một", "hai"], {"letter": "b"}, (["A. một", "B. hai"], "B")),
        (["một", "hai"], "khác", (["A. một", "B. hai"], "khác")),
    ],
)
def test_option_and_answer_shapes(options, answer, expect):
    r = modeljson.coerce({"stem": "Hỏi gì?", "choices": options, "correct_answer": answer})
    assert (r["options"], r["answer"]) == expect


def test_essays_and_appended_options():
    assert not modeljson.complete(modeljson.coerce({"question": "Bệnh nhân nam", "options": ["A. Chẩn đoán?", "B. Xử trí?"], "answer": "A"}))
    assert modeljson.coerce({"question": "Chọn câu đúng? A. một B. hai", "options": ["A. một", "B. hai"], "answer": "A"})["question"] == "Chọn câu đúng?"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400))
def test_salvage_never_invents(n):
    whole = json.dumps({"questions": [{**RECORD, "question": f"Question number {i} of all?"} for i in range(3)]})
    for r in modeljson.parse(whole[:n])["questions"]:
        assert r["question"] in {f"Question number {i} of all?" for i in range(3)}


def test_parse_in_spark(spark):
    d = spark.createDataFrame([(1, json.dumps({"questions": [RECORD]})), (2, None)], "batch_no int, text string")
    got = {r["batch_no"]: r for r in modeljson.parse_responses(d).collect()}
    assert got[1]["questions"][0]["options"][2] == "C. 4" and got[2]["error"] is not None
    body = json.dumps({"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}]})
    assert value(spark, modeljson.response_text(F.lit(body))) == "hi" and value(spark, modeljson.response_truncated(F.lit(body)))


MARKDOWN = """# Đề thi
Câu 1: Tim có mấy buồng?
A. Hai
B. **Bốn**
C. Ba
D. Năm
Câu 2: Phổi nào lớn hơn?
A. Trái
B. Phải
Đáp án: B
3. Gan nằm ở đâu? A. Trái B. Phải C. Giữa
## Câu 4
Một câu không có lựa chọn

Đáp án
1. B 2. A 3. B
"""


def test_markdown_questions(spark):
    rows = segments.parse_text(MARKDOWN)
    assert [(r[1], r[4], len(r[3])) for r in rows] == [(1, "B", 4), (2, "B", 2), (3, "B", 3)]
    assert rows[0][2] == "Tim có mấy buồng?" and rows[0][3][1] == "B. Bốn"
    text = segments.structured(rows)
    assert segments.structured_count(text) == 3 and len(segments.structured_blocks(text)) == 3
    assert segments.parse_text(None) == [] and segments.parse_text("") == []
    assert segments.questions(spark.createDataFrame([(1, MARKDOWN), (2, None)], "doc_id long, text string")).count() == 3


def test_shared_cases_and_splits():
    text = "Tình huống dùng cho câu 5-7: Bệnh nhân nam 60 tuổi đau ngực sau xương ức hai giờ.\nCâu 5: Chẩn đoán?\nA. x"
    assert segments.shared_cases(text)[0][:2] == (5, 7)
    long = "\n".join(f"Câu {i}: nội dung câu hỏi số {i} khá dài" for i in range(1, 41))
    parts = segments.split_naturally(long, 3)
    assert "".join(parts) == long and len(parts) == 3 and all(p.lstrip().startswith("Câu") for p in parts)


def test_parts_of_texts_leave_a_task_in_small_batches(spark):
    texts = [None, "", "  \n ", "a", "First sentence here. Second one there.\n\nA paragraph."] * 300
    want = [(i, k, part) for i, t in enumerate(texts) for k, part in enumerate(segments.split_naturally(t or ""))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = list(segments._split_batches(iter([batch])))
    assert len(out) > 1 and max(len(set(b.column("doc_id").to_pylist())) for b in out) <= segments.SPLIT_ROWS
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in segments.natural_parts(d).collect()) == want
    assert segments.natural_parts(d.where("text = '  \n '")).count() == 0


@pytest.mark.parametrize("n,size,overlap", [(n, s, o) for n in (1, 2, 3, 7, 8, 20) for s, o in ((3, 1), (2, 1), (3, 0), (1, 0))])
def test_page_ranges_cover_all(spark, n, size, overlap):
    got = sorted((r["start"], r["end"]) for r in windows.page_ranges(one(spark, n_pages=n), size=size, overlap=overlap).collect())
    expect, start = [], 1
    while start <= n:
        expect.append((start, min(n, start + size - 1)))
        if expect[-1][1] == n:
            break
        start += max(1, size - overlap)
    assert got == expect


def page(*lines):
    return "\n".join(lines)


def test_pdf_pages(spark):
    good = page(*[x for i in range(1, 6) for x in (f"Câu {i}: Nội dung của câu hỏi số {i} đủ dài để đọc", "A. Lựa chọn thứ nhất của câu", "B. Lựa chọn thứ hai của câu", "C. Lựa chọn thứ ba của câu", "D. Lựa chọn thứ tư của câu")])
    rows = [("f", 1, good), ("f", 2, "short"), ("f", 3, good + "\nCâu 6: Bệnh nhân nào sau đây cần mổ"), ("f", 4, "A. Một bệnh nhân\nB. Hai bệnh nhân\n" + good)]
    d = pdf.score_pages(spark.createDataFrame(rows, "file_id string, page int, text string"))
    q = {r["page"]: r["quality"] for r in d.collect()}
    assert q == {1: "goodText", 2: "scanOrEmpty", 3: "goodText", 4: "goodText"}
    risk = {r["page"]: (r["severity"], r["reasons"]) for r in pdf.boundary_risks(d).collect()}
    assert risk[3][0] == "high" and "next_page_starts_with_options" in risk[3][1] and "trailing_question_without_options" in risk[3][1]
    ranges = [(r["start"], r["end"]) for r in pdf.vision_ranges(d, pdf.boundary_risks(d)).collect()]
    assert ranges == [(2, 2)]
    est = value(spark, pdf.marker_estimate(F.lit(good)))
    assert (est["confidence"], est["count"], est["run"]) == ("high", 5, 5)
    assert value(spark, pdf.marker_estimate(F.lit("Câu 1:\nCâu 1:\nCâu 1:\nCâu 7:")))["confidence"] == "low"
    assert value(spark, pdf.marker_estimate(F.lit("plain")))["confidence"] == "none"


def test_docx_paragraphs(spark):
    body = '<w:p><w:r><w:t>Câu 1: Tim có mấy buồng?</w:t></w:r></w:p><w:p><w:r><w:rPr><w:highlight w:val="yellow"/></w:rPr><w:t>A. Bốn</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>Hai</w:t><w:br/><w:t>dòng</w:t></w:r></w:p>'
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {ns}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="upperLetter"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>')
    d = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"nothing"))], "path string, content binary")
    rows = docx.paragraphs(d).orderBy("path", "paragraph").collect()
    assert [(r["text"], r["marked"], r["num_format"]) for r in rows[:4]] == [("Câu 1: Tim có mấy buồng?", False, ""), ("A. Bốn", True, ""), ("Hai", False, "upperLetter"), ("dòng", False, "upperLetter")]
    assert rows[4]["error"]
    made = export.docx_bytes([{"question": "Q & A", "options": ["A. x"], "answer": "A", "difficulty": "Easy"}])
    assert any(p["text"] == "1. Q & A" for p in docx.read(made)[0])


def test_csv_and_html(spark, bank, tmp_path):
    d = bank.withColumn("source", F.lit('a "b"\nc'))
    lines = [r["value"] for r in export.csv_lines(d).orderBy("position").collect()]
    assert len(lines) == 6 and lines[0].endswith(',"A","","a ""b"" c"')
    export.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == 7
    assert export.rich_html("a **b** <c>\n| x | y |\n|---|---|\n| 1 | 2 |") == "a <b>b</b> &lt;c&gt;<br><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>"


def test_policies(spark):
    kind = lambda m, s=0: value(spark, policy.classify_error(F.lit(m), F.lit(s)))
    assert [kind("x", 429), kind("API key not valid", 400), kind("Payload Too Large"), kind("bad", 400), kind("503"), kind("empty"), kind("json"), kind("?")] == ["rateLimit", "auth", "format", "fatal", "serverBusy", "empty", "format", "fatal"]
    assert value(spark, policy.breaker_threshold(F.lit(20))) == 5 and value(spark, policy.normalize_rpm(F.lit("9999"))) == 600


def test_limiter_and_health(spark):
    limiter = keys.Limiter(2)
    assert [limiter.admit(t) for t in (0, 10, 20, 30, 70_000)] == [0, 10, 60_000, 60_010, 120_000]
    h = keys.KeyHealth()
    h.event(0, "ok", 100).event(1, "ok", 200)
    assert h.latency == pytest.approx(120)
    h.event(2, "rateLimit", retry_after_ms=1)
    assert h.status == "cooldown" and h.blocked_until == 45_002 and h.score(10) == float("-inf")
    h.event(3, "auth", permanent=True)
    assert h.status == "authBlocked" and h.blocked_until == keys.FOREVER and h.event(4, "rateLimit").blocked_until == keys.FOREVER
    h.event(5, "ok", 1)  # a success clears every block
    assert h.status == "healthy" and h.blocked_until == 0 and (h.failures, h.rate_strikes, h.auth_strikes) == (2, 1, 1)
    e = spark.createDataFrame([("k", i, t) for i, t in enumerate((0, 10, 20))], "key string, event_id long, at long")
    assert [r["admitted_at"] for r in keys.admissions(e, 2).orderBy("event_id").collect()] == [0, 10, 60_000]
    r = random.Random(4)
    rows = [(k, i, r.randrange(200_000)) for k in ("a", "b", "c") for i in range(150)]
    got = {(x["key"], x["event_id"]): x["admitted_at"] for x in keys.admissions(spark.createDataFrame(rows, "key string, event_id long, at long"), 30).collect()}
    for k in ("a", "b", "c"):
        limiter = keys.Limiter(30)
        for _, i, at in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            assert got[k, i] == limiter.admit(at)


def test_snapshot_operators(spark):
    rows = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (1, "z", 3)], "id long, v string, position long")
    got = {r["id"]: (r["v"], r["position"]) for r in R.upsert(rows.limit(2), rows.where("v = 'z'")).collect()}
    assert got[1] == ("z", 1) and got[2] == ("y", 2)
    merged = windows.merge_intervals(spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", 6, 7), ("b", 1, 9), ("b", 2, 3)], "g string, start int, end int"), ["g"])
    assert sorted((r["g"], r["start"], r["end"]) for r in merged.collect()) == [("a", 1, 4), ("a", 6, 7), ("b", 1, 9)]


def test_streams(spark, tmp_path):
    from stemforge.streaming.records import unique_records, upsert_stream

    source = tmp_path / "in"
    rows = [("2024-01-01 00:00:00", "Câu 1. Tim?", ["A. x"]), ("2024-01-01 00:00:01", "cau 2) TIM", ["A) x"]), ("2024-01-01 00:00:02", "Gan?", ["A. y"])]
    d = spark.createDataFrame(rows, "at string, question string, options array<string>").withColumn("at", F.col("at").cast("timestamp"))
    d.write.parquet(str(source))
    stream = unique_records(spark.readStream.schema(d.schema).parquet(str(source)))
    upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "events", "documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    d = catalogue.QUERIES[name](spark, SF)
    got = con.execute(catalogue.ORACLES[name])
    names = sorted(c[0] for c in got.description)
    assert sorted(d.columns) == names
    place = [[c[0] for c in got.description].index(n) for n in names]
    show = lambda x: repr(round(x, 8)) if isinstance(x, float) else str(x)
    assert sorted([show(r[n]) for n in names] for r in d.collect()) == sorted([show(r[i]) for i in place] for r in got.fetchall())


def test_benchmark_containment_of_passages_of_all_lengths(spark, tmp_path):
    """Ends of a passage may lie within words; short passages and other spaces count as well."""
    from stemforge.plans.catalogue import QUERIES

    texts = ["one two three four five six seven eight nine", "xone two threey", "none  two\tthree", "a", "", None, "b a c", "one two three four five six seven eigh"]
    passages = ["a", "two", "one two", "one two three", "two three four", "ne two three four five six seven eigh", "one  two", "absent words here", "none  two\tthree", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["documents"] for r in QUERIES["benchmark_containment"](spark, str(tmp_path)).collect()}
    brute = {i: sum(p in t for t in texts if t is not None) for i, p in enumerate(passages) if p is not None}
    assert got == {i: n for i, n in brute.items() if n}
