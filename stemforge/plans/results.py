"""Queries over results: equal blocks, replacements, final order, overviews, waits and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.operators import results
from stemforge.plans.registry import query
from stemforge.plans.synth import table


@query(
    """WITH b AS (SELECT l_orderkey AS file_id, l_linenumber // 2 AS range, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'part ' || l_partkey % 4 || ' of ' || l_quantity::INT % 2 END AS body FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id, body ORDER BY range, place) AS n FROM b WHERE body <> '') SELECT file_id, CAST(range AS BIGINT) AS range, CAST(place AS INT) AS place, body FROM r WHERE n = 1"""
)
def first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that overlapping ranges repeat, with other numbers, cases and spaces."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    body = F.concat(F.when(F.col("l_partkey") % 2 == 0, "PART  ").otherwise("Part "), (F.col("l_partkey") % 4).cast("string"), F.lit("\n of "), (F.col("l_quantity").cast("int") % 2).cast("string"))
    block = F.concat(F.lit("<<<MCQ "), F.col("l_linenumber").cast("string"), F.lit(">>>\n"), F.when(F.col("l_partkey") % 9 == 0, "  ").otherwise(body))
    blocks = d.select(F.col("l_orderkey").alias("file_id"), F.floor(F.col("l_linenumber") / 2).alias("range"), place.alias("place"), block.alias("block"))
    return results.first_blocks(blocks).select("file_id", "range", "place", results.block_fingerprint(F.col("block")).alias("body"))


#: Versions of a question by the number of its part: with shared cases, misread tokens and accents, or without.
VERSIONS = ["Câu hỏi về thuốc", "[Tình huống] a [Câu hỏi] b", "[tinh huong] a [câu hỏi] b [ cau hoi ] c", "cau hoi ve thu0c va kh6 d6ng", "spo2 sir HbA1c co2 t1", "Bệnh nhân được điều trị", "x1y2 plain", ""]
_ACCENTED = "[ăâêôơưđáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"


def _measures(x: str, options: str) -> str:
    marks = rf"len(regexp_extract_all(lower({x}), '\[\s*(?:tình\s*huống|tinh\s*huong|câu\s*hỏi|cau\s*hoi)\s*\]'))"
    known = rf"len(regexp_extract_all(lower({x}), '\b(?:sir|gid|ngot|d6ng|kh6|g8y|teorong|ying|mats)\b'))"
    odd = f"len(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '\\p{{N}}') AND NOT list_contains(['d6ng', 'kh6', 'g8y', 'spo2', 'hba1c', 'co2', 'b12'], t)))"
    accents = f"len(regexp_extract_all(lower({x}), '{_ACCENTED}'))"
    return f"{{'marks': {marks}, 'bad': {known} + {odd}, 'accents': {accents}, 'score': {accents} * 2 + {options} * 3 - {marks} * 18 - ({known} + {odd}) * 12}}"


@query(
    f"""WITH v AS (SELECT {VERSIONS!r} AS l), q AS (SELECT p_partkey AS id, list_extract(l, CAST(p_partkey % 8 + 1 AS INT)) AS old, list_extract(l, CAST(p_partkey // 8 % 8 + 1 AS INT)) AS new, 2 + p_size % 3 AS n FROM part, v),
    m AS (SELECT id, old, {_measures("old", "4")} AS o, {_measures("new", "n")} AS w FROM q)
    SELECT id, CASE WHEN old = '' THEN true WHEN o.marks >= 2 AND w.marks < 2 THEN false WHEN o.marks > 2 AND o.marks > w.marks THEN true WHEN o.bad > w.bad AND w.accents >= o.accents THEN true ELSE w.score > o.score + 12 END AS replaces FROM m"""
)
def replacement_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(v) for v in VERSIONS]), (i + 1).cast("int"))
    version = lambda text, n: F.struct(text.alias("question"), F.concat(F.array_repeat(F.lit("A. x"), n), F.array(F.lit(""))).alias("options"), F.trim(text).alias("whole"))
    old, new = version(pick(k % 8), F.lit(4)), version(pick(F.floor(k / 8) % 8), (2 + F.col("p_size") % 3).cast("int"))
    return p.select(k.alias("id"), results.replaces(old, new).alias("replaces"))


@query(
    """WITH q AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Câu số ' || p_size || ': ' || p_name WHEN 1 THEN 'see question ' || p_size WHEN 2 THEN p_size || ') ' || p_name WHEN 3 THEN p_name || ' ' || p_size || '.' ELSE NULL END AS question, p_size AS n FROM part)
    SELECT id, CAST(CASE WHEN id % 5 < 3 THEN n ELSE 999999 END AS BIGINT) AS final_number, row_number() OVER (ORDER BY CASE WHEN id % 5 < 3 THEN n ELSE 999999 END, id) AS place FROM q"""
)
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    question = (
        F.when(k % 5 == 0, F.concat(F.lit("Câu số "), n, F.lit(": "), name)).when(k % 5 == 1, F.concat(F.lit("see question "), n)).when(k % 5 == 2, F.concat(n, F.lit(") "), name)).when(k % 5 == 3, F.concat(name, F.lit(" "), n, F.lit(".")))
    )
    ordered = results.in_final_order(p.select(k.alias("id"), question.alias("question"), k.alias("position")))
    return results.with_places(ordered).select("id", "final_number", "place")


#: Labels in the order of Vietnamese readers.
LABELS = ["Bình thường", "Chưa phân loại", "Dễ", "Đơn giản", "khó", "Khó", "Nâng cao", "Trung bình", "Ứng dụng", "Vận dụng"]


@query(
    f"""WITH l AS (SELECT {LABELS!r} AS l), d AS (SELECT list_extract(l, CAST(p_size % 10 + 1 AS INT)) AS difficulty FROM part, l), c AS (SELECT difficulty, count(*) AS n FROM d GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY list_position(l, difficulty)) AS INT) AS place, difficulty, n FROM c, l"""
)
def difficulty_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by a string collation: d before đ, u before ư, small before capital letters."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_size") % 10 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select(F.when(label == "Chưa phân loại", F.lit("  ")).otherwise(F.concat(F.lit(" "), label)).alias("difficulty"))
    return results.difficulty_overview(d).select("place", "difficulty", "n")


@query(
    f"""WITH l AS (SELECT {LABELS!r} AS l), d AS (SELECT list_extract(l, CAST(p_size % 10 + 1 AS INT)) AS x FROM part, l) SELECT min(x) AS difficulty, count(*) AS n FROM d GROUP BY lower(strip_accents(x))"""
)
def difficulty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_size") % 10 + 1).cast("int"))
    return results.difficulty_groups(table(spark, sf_dir, "part").select(label.alias("difficulty")))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 5000 AS VARCHAR) WHEN 1 THEN 'x' END AS ms,
      CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) WHEN 1 THEN 'Mon, 01 Jan 2024 00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':30 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN '-5' END AS v, event_id % 60 AS m FROM events)
    SELECT event_id, CAST(CASE WHEN event_id % 6 = 0 AND event_id % 5000 > 0 THEN event_id % 5000 WHEN event_id % 5 = 0 AND event_id % 90 BETWEEN 1 AND 60 THEN event_id % 90 * 1000 WHEN event_id % 5 = 1 AND m = 10 THEN 30000 END AS BIGINT) AS wait_ms,
      event_id % 4 > 0 AND event_id % 7 < event_id % 10 AND event_id % 7 < CASE event_id % 3 WHEN 0 THEN least(2, event_id % 10) WHEN 1 THEN greatest(3, least(8, event_id % 10)) ELSE 0 END AS rotates FROM e"""
)
def waits_and_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits by headers (as of ten past midnight), and whether another key is tried."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    ms = F.when(n % 6 == 0, (n % 5000).cast("string")).when(n % 6 == 1, "x")
    date = F.concat(F.lit("Mon, 01 Jan 2024 00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":30 GMT"))
    value = F.when(n % 5 == 0, (n % 90).cast("string")).when(n % 5 == 1, date).when(n % 5 == 2, "soon").when(n % 5 == 3, "-5")
    cause = F.when(n % 3 == 0, "softRateLimit").when(n % 3 == 1, "serverBusy").otherwise("format")
    now = F.lit(1_704_067_800_000)
    return e.select("event_id", results.retry_after_ms(ms, value, now).alias("wait_ms"), results.rotates(cause, n % 7, n % 4, n % 10).alias("rotates"))
