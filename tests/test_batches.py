from pyspark.sql import functions as F

from stemforge.operators import batches as B


def test_sizes():
    assert B.question_batch(15_000, 10) == 10 and B.structured_batch(15_000, 10) == 5 and B.question_batch(2_000, 10) == 1
    assert B.text_budget(10_000) == 15_000 and B.text_budget(10**6) == 22_000 and B.vision_pages(9) == 4


def test_text_parts_overlap_and_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(2600))
    d = spark.createDataFrame([("f", "a.txt", text), ("g", "b.txt", "short"), ("h", "c.txt", "")], "file_id string, name string, text string")
    rows = B.text_parts(d, budget=1000, overlap=100).orderBy("file_id", "part").collect()
    f = [r for r in rows if r["file_id"] == "f"]
    assert f[0]["text"] == text[:1000] and f[1]["text"] == text[900:1900] and f[-1]["text"].endswith(text[-10:]) and f[-1]["source_label"] == "a.txt | Phần cuối"
    assert [(r["source_label"], r["text"]) for r in rows if r["file_id"] == "g"][0] == ("b.txt", "short")


def test_coverage_and_recovery(spark):
    verifier = F.struct(F.lit(0).alias("expected"), F.lit("none").alias("confidence"), F.lit(False).alias("tail_complete"), F.lit(False).alias("missing_likely"), F.array().cast("array<int>").alias("numbers"))
    sure = F.struct(F.lit(2).alias("expected"), F.lit("high").alias("confidence"), F.lit(True).alias("tail_complete"), F.lit(False).alias("missing_likely"), F.array(F.lit(1), F.lit(2)).alias("numbers"))
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")

    def status(mode, covered, numbers, expected, confidence, wanted, v):
        return spark.range(1).select(B.coverage_status(F.lit(mode), F.lit(covered), numbers, F.lit(expected), F.lit(confidence), wanted, v)).first()[0]

    assert status("text", 0, ints(), 0, "none", ints(), verifier) == "notApplicable"
    assert status("pdfVision", 2, ints(1, 2), 2, "high", ints(1, 2), verifier) == "complete"
    assert status("pdfVision", 2, ints(1, 3), 2, "high", ints(1, 2), verifier) == "missing"
    assert status("pdfVision", 2, ints(1, 2), 0, "none", ints(), sure) == "complete"
    assert status("pdfVision", 1, ints(1), 0, "none", ints(), sure) == "missing"
    assert status("pdfVision", 1, ints(1), 0, "none", ints(), verifier) == "unverified"
    blocks = [f"<<<MCQ {i}>>>\nQuestion: Câu {i}: nội dung số {w}" for i, w in enumerate("một hai ba bốn".split(), 1)]
    assert B.unrecovered_blocks(blocks, ["Câu 1: một", "Câu 3: ba"]) == [[blocks[1], blocks[3]]]
    assert B.unrecovered_blocks(blocks, ["khác hẳn xyz"]) == [blocks[:2], blocks[2:]]


def test_cases_and_delays():
    stem = "Bệnh nhân nam 60 tuổi đau ngực sau xương ức hai giờ kèm vã mồ hôi"
    once = B.with_case("Chẩn đoán phù hợp?", stem)
    assert stem in once and B.with_case(once, stem) == once
    assert B.retry_delay_ms({"error": {"details": [{"retryDelay": "12.5s"}]}}) == 12_500
    assert B.retry_delay_ms('429 {"retryDelay": {"seconds": 3, "nanos": 5e8}}') == 3_500
    assert B.retry_delay_ms("please retry in 250 ms") == 250 and B.retry_delay_ms("retry after 2 minutes") == 120_000 and B.retry_delay_ms("no") is None


def test_sessions_and_settings(spark):
    s = spark.createDataFrame([("a", "running", "x")], "id string, status string, files_fingerprint string")
    assert B.resumable(s, "x").first()["status"] == "interrupted" and not B.resumable(s, "y").count()
    merged = B.merge_session(s, spark.createDataFrame([(None, "paused", 3)], "id string, status string, done int")).first()
    assert (merged["id"], merged["status"], merged["done"]) == ("a", "paused", 3)
    assert B.normalize_settings({"provider": "other", "rpm_limit": "900"})["rpm_limit"] == 600
    f = spark.createDataFrame([("b", "2", None), ("a", "1", None)], "name string, content_hash string, content string")
    assert B.files_hash(f).first()[0] == B.files_hash(f.orderBy("name")).first()[0]


def test_review_helpers(spark):
    from stemforge.operators import review as V

    schema = "id long, question string, options array<string>, answer string, position long"
    options = ["A. Tăng huyết áp", "B. Đái tháo đường", "C. Suy tim", "D. Viêm phổi"]
    project = spark.createDataFrame([(1, "Câu 1. Nguyên nhân thường gặp nhất của đau ngực cấp là bệnh nào", options, "A", 1)], schema)
    current = spark.createDataFrame([(7, "Cau 5: NGUYEN NHAN thuong gap nhat cua dau nguc cap la benh nao?", options, "A", 1), (8, "Thuốc hạ sốt cho trẻ em", ["A. x", "B. y"], "A", 2)], schema)
    found, skipped = V.likely_duplicates(project, current)
    assert not skipped and [(r["id"], r["matched_with"]) for r in found.collect()] == [("7", "1")]
    assert V.likely_duplicates(project, current, pair_limit=1) == (None, True)
    assert [r["id"] for r in V.changed_rows(current, current.where("id = 7"), "id", ["question", "answer"]).collect()] == [8]
    review = spark.createDataFrame([(9, 7, "replace", "neu", ["A. z"], "A", 3), (10, 8, "skip", "s", ["A. z"], "A", 4), (11, 8, "restore", "r", ["A. z"], "A", 5)], "id long, matched_id long, choice string, question string, options array<string>, answer string, position long")
    got = {r["id"]: r["question"] for r in V.resolve_duplicates(current, review).collect()}
    assert got == {7: "neu", 8: "Thuốc hạ sốt cho trẻ em", 11: "r"}
    files = spark.createDataFrame([("f1", "a.pdf", 1), ("f2", "b.pdf", 2)], "id string, name string, position int")
    traced = spark.createDataFrame([(1, "b.pdf"), (2, "none")], "id int, trace_file string")
    assert {r["id"]: r["file"] for r in V.source_file(traced, files).collect()} == {1: "f2", 2: "f1"}
    stems = spark.createDataFrame([(1, "Benh nhan nam", 0), (1, "Bệnh nhân nam 60 tuổi", 1)], "k int, stem string, position int")
    assert V.best_stem(stems, "k").first()["stem"].startswith("Bệnh")
