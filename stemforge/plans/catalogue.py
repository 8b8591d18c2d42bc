"""Every query of the engine by name, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemforge.functions import html, text as T
from stemforge.functions.lineage import cut_lineage
from stemforge.operators import policy, records as R, windows as W
from stemforge.operators.pairs import scored_pairs
from stemforge.plans import questions as _questions, results as _results  # noqa: F401  they register their queries
from stemforge.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from stemforge.plans.synth import FAILURES, RECORDS, document_records, failures, records, table

# DuckDB pieces.  Its regular expressions have no look-around, and fold accents by a function.
NORMAL = r"""
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(replace(replace(strip_accents(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\[[^\]]*?\]', ' ', 'g')), 'đ', 'd'), 'Đ', 'd')),
  '(?:^|\s)(?:cau|question|bai)\s*(?:so\s*)?\d+\s*[.:)\]-]?\s*', ' ', 'g'),
  '^\s*(?:\(?[a-e]\)?|[0-9]{{1,2}})\s*[.:)\]-]\s*', ''),
  '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def normal(x: str) -> str:
    return NORMAL.format(x=x)


def lev(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END)"


# --- normal forms and fingerprints


@query(f"SELECT doc_id, {normal('text')} AS normal FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_field(F.col("text")).alias("normal"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.normalize_field(F.col("text")), 256).alias("fp"))


FINGERPRINTS = f"fp AS (SELECT doc_id, source, sha256({normal('text')}) AS fp FROM documents)"


@query(f"WITH {FINGERPRINTS} SELECT fp, min(doc_id) AS doc_id, count(*) AS copies FROM fp GROUP BY fp")
def fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins exact de-duplication as one aggregate: no task holds a group of copies."""
    return _fingerprints(spark, sf_dir).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"WITH {FINGERPRINTS}, f AS (SELECT fp, min(doc_id) AS first FROM fp GROUP BY fp) SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id <> first) AS surplus FROM fp JOIN f USING (fp) GROUP BY source")
def duplicate_groups_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fingerprints(spark, sf_dir)
    firsts = d.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.lit(1).alias("first"))
    joined = d.select("doc_id", "source").join(firsts, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("first").isNull()).alias("surplus"))


@query(rf"WITH {RECORDS} SELECT id, {normal('question')} || '|' || array_to_string(list_transform(options, lambda o: {normal('o')}), '|') || '|' AS fingerprint FROM records")
def record_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", T.fingerprint(F.col("question"), F.col("options")).alias("fingerprint"))


@query(rf"WITH {RECORDS} SELECT id, lower(trim(question)) || chr(1) || array_to_string(list_transform(options, lambda o: lower(trim(regexp_replace(o, '\s+', ' ', 'g')))), chr(1)) || chr(1) || lower(answer) || chr(1) || lower(source) AS identity FROM records")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", T.identity_key(F.col("question"), F.col("options"), F.col("answer"), F.col("source")).alias("identity"))


def _phrases(x: str) -> str:
    for k, v in T.ABBREVIATIONS.items():
        x = rf"regexp_replace({x}, '\b{k}\b', '{v}', 'g')"
    for p in T.STOP_PHRASES:
        x = rf"regexp_replace({x}, '\b{p}\b', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_phrases(normal('text'))} AS semantic FROM documents")
def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.semantic_field(F.col("text")).alias("semantic"))


# --- filters, counts, orders


@query(f"WITH {RECORDS} SELECT id, question, difficulty FROM records WHERE contains(lower(question), 'ar') AND difficulty = 'Hard'")
def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_filter(records(spark, sf_dir), " AR ", "Hard").select("id", "question", "difficulty")


@query(f"WITH {RECORDS} SELECT CASE WHEN difficulty = '' THEN 'Unknown' ELSE difficulty END AS difficulty, count(*) AS n FROM records GROUP BY 1")
def difficulty_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.difficulty_histogram(records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT DISTINCT difficulty, CASE difficulty WHEN 'Easy' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Hard' THEN 2 ELSE 3 END AS rank FROM records")
def ordered_difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_difficulties(records(spark, sf_dir))


@query("SELECT p_partkey AS id, p_size % 3 <> 0 AND p_size % 5 > 1 AND p_size % 2 = 0 AS complete FROM part")
def complete_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of records that lack a question, options or an answer by rule."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    options = F.slice(F.array(*[F.concat(F.lit(f"{c}. "), "p_type") for c in "ABCD"]), 1, F.coalesce(s % 5, F.lit(0)))
    done = R.complete_question(F.when(s % 3 != 0, F.col("p_name")).otherwise(" "), options, F.when(s % 2 == 0, "A"))
    return p.select(F.col("p_partkey").alias("id"), done.alias("complete"))


@query(f"WITH {RECORDS} SELECT id, question, CAST(id AS INT) AS sort_number, row_number() OVER (ORDER BY id) AS place FROM records")
def question_number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = records(spark, sf_dir).withColumn("sort_number", T.sort_number(F.col("question")))
    # places from counts by number: no window over the whole table
    sizes = d.groupBy(F.floor(F.col("sort_number") / 1000).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.g") < F.col("a.g"), "left").groupBy("a.g").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # 1,000 groups: sort numbers end at 999,999
    d = d.withColumn("g", F.floor(F.col("sort_number") / 1000)).join(before, "g")
    place = F.col("before") + F.row_number().over(Window.partitionBy("g").orderBy("sort_number", "id"))
    return d.select("id", "question", "sort_number", place.alias("place"))


@query(f"WITH {RECORDS} SELECT source, difficulty, count(*) AS n FROM records GROUP BY ROLLUP (source, difficulty)")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: counts by source and difficulty, with subtotals."""
    return records(spark, sf_dir).rollup("source", "difficulty").agg(F.count(F.lit(1)).alias("n"))


# --- snapshots and projects


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A saved project and the current records: they overlap, and every seventh answer has changed."""
    r = records(spark, sf_dir)
    return r.where("id % 5 != 0"), r.where("id % 3 != 0").withColumn("answer", F.when(F.col("id") % 7 == 0, "A").otherwise(F.col("answer")))


HALVES = f"{RECORDS}, project AS (SELECT * FROM records WHERE id % 5 <> 0), current AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'A' ELSE answer END AS answer) FROM records WHERE id % 3 <> 0)"


@query(f"WITH {HALVES} SELECT id, question, source FROM current WHERE lower(question) NOT IN (SELECT lower(question) FROM project)")
def project_diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.added(*_halves(spark, sf_dir)).select("id", "question", "source")


@query(f"WITH {HALVES} SELECT id, question, source FROM project WHERE lower(question) NOT IN (SELECT lower(question) FROM current)")
def project_diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.removed(*_halves(spark, sf_dir)).select("id", "question", "source")


@query(f"WITH {HALVES} SELECT c.id, c.question, p.answer AS previous_answer, c.answer AS current_answer FROM current c JOIN project p USING (question) WHERE p.answer <> c.answer")
def project_diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changed_answers(*_halves(spark, sf_dir)).select("id", "question", "previous_answer", "current_answer")


@query(
    """WITH r AS (SELECT o_custkey AS id, o_orderstatus AS status, o_orderkey AS position, 0 AS side FROM orders WHERE o_orderkey % 3 <> 0
      UNION ALL SELECT o_custkey, lower(o_orderstatus), o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 1)
    SELECT CAST(id AS BIGINT) AS id, arg_max(status, side * 1000000000000 + position) AS status, arg_min(position, side * 1000000000000 + position) AS position FROM r GROUP BY id"""
)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customers: some rows arrive in both sides, some in one; arriving versions win."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), key.alias("position"))
    incoming = o.where("position % 3 = 0 OR position % 4 = 1").withColumn("status", F.lower("status"))
    return R.upsert(o.where("position % 3 != 0"), incoming)


@query(f"WITH {HALVES} SELECT id, question FROM current WHERE id NOT IN (SELECT id FROM project)")
def append_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    project, current = _halves(spark, sf_dir)
    return R.append_visible(project, current).select("id", "question")


@query(
    """SELECT l_orderkey AS order_key, CAST(max(l_linenumber) + l_orderkey % 2 AS INT) AS n_expected, CAST(count(DISTINCT l_linenumber) AS INT) AS n_covered, max(l_linenumber) + l_orderkey % 2 = count(DISTINCT l_linenumber) AS complete,
    array_to_string(list_sort(list_filter(range(1, CAST(max(l_linenumber) + l_orderkey % 2 + 1 AS BIGINT)), lambda i: NOT list_contains(list(l_linenumber), i))), ',') AS missing FROM lineitem GROUP BY l_orderkey"""
)
def coverage_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other order expects one line more than it has."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("number"))
    expected = li.groupBy("order_key").agg(F.max("number").alias("m")).select("order_key", F.explode(F.sequence(F.lit(1), (F.col("m") + F.col("order_key") % 2).cast("int"))).alias("number"))
    return R.coverage(expected, li, "order_key").select("order_key", "n_expected", "n_covered", "complete", F.array_join("missing", ",").alias("missing"))


@query(
    f"WITH {RECORDS}, have AS (SELECT lower(source) AS source, count(*) AS have FROM records GROUP BY 1), parts AS (SELECT DISTINCT p_brand AS part, lower(p_brand) AS source, 40 AS expected FROM part) SELECT part, expected, have FROM parts JOIN have USING (source) WHERE have >= expected"
)
def completed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("file_id", F.lit(""))
    parts = r.select(F.col("source").alias("part"), "source", "file_id").distinct().withColumn("expected", F.lit(40))
    return R.completed_batches(parts, r)


# --- similarity


def _name_pairs(spark: SparkSession, sf_dir: str, forms: dict[str, Column], score: Callable[[dict[str, Column], dict[str, Column]], Column]) -> DataFrame:
    """Scores of all pairs of different parts of one type and size: blocking by equal keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return scored_pairs(p, "p_partkey", ["p_type", "p_size"], "name", forms, lambda x, y: F.round(score(x, y), 9))


NAME_PAIRS = "pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name || ' ' || a.p_type AS x, b.p_name || ' ' || b.p_type AS y FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"
TOKENS = f"toks AS (SELECT a, b, list_filter(string_split({normal('x')}, ' '), lambda t: length(t) > 1) AS u, list_filter(string_split({normal('y')}, ' '), lambda t: length(t) > 1) AS v FROM pairs)"


@query(f"WITH {NAME_PAIRS} SELECT a, b, round({lev('x', 'y')}, 9) AS score FROM pairs")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir, {"x": F.col("name")}, lambda a, b: T.levenshtein_ratio(a["x"], b["x"]))


@query(
    f"""WITH {NAME_PAIRS}, g AS (SELECT a, b, x, y, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS u, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS v FROM pairs)
    SELECT a, b, round(CASE WHEN x = y THEN 1.0 ELSE 2.0 * len(list_intersect(u, v)) / (len(u) + len(v)) END, 9) AS score FROM g"""
)
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir, {"x": F.col("name")}, lambda a, b: T.dice(a["x"], b["x"]))


@query(f"WITH {NAME_PAIRS}, {TOKENS}, s AS (SELECT a, b, array_to_string(list_sort(u), ' ') AS p, array_to_string(list_sort(v), ' ') AS q FROM toks) SELECT a, b, round({lev('p', 'q')}, 9) AS score FROM s")
def token_sort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir, {"u": T.tokens(F.col("name"))}, lambda a, b: T.sort_ratio_of(a["u"], b["u"]))


@query(
    f"""WITH {NAME_PAIRS}, {TOKENS}, d AS (SELECT a, b, list_distinct(u) AS u, list_distinct(v) AS v FROM toks),
    s AS (SELECT a, b, len(u) AS nu, len(v) AS nv, len(list_intersect(u, v)) AS nc, array_to_string(list_sort(list_intersect(u, v)), ' ') AS c, array_to_string(list_sort(u), ' ') AS p, array_to_string(list_sort(v), ' ') AS q FROM d)
    SELECT a, b, round(CASE WHEN nc = 0 THEN 0.0 WHEN nc = nu OR nc = nv THEN 1.0 ELSE greatest({lev('p', 'q')}, {lev('c', 'p')}, {lev('c', 'q')}) END, 9) AS score FROM s"""
)
def token_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir, {"u": F.array_distinct(T.tokens(F.col("name")))}, lambda a, b: T.set_ratio_of(a["u"], b["u"]))


@query(f"WITH {RECORDS}, b AS (SELECT source, CAST(length({normal('question')}) // 40 AS INT) AS band, count(*) AS n FROM records GROUP BY ALL) SELECT x.source, sum(x.n * y.n) AS candidates FROM b x JOIN b y ON x.source = y.source AND abs(x.band - y.band) <= 2 GROUP BY x.source")
def blocked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the length bands leave to compare, from counts of the bands alone."""
    bands = records(spark, sf_dir).groupBy("source", F.floor(F.length(T.normalize_field(F.col("question"))) / 40).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    near = bands.select("source", F.explode(F.array(*[F.col("band") + k for k in range(-2, 3)])).alias("band"), F.col("n").alias("m"))
    return bands.join(near, ["source", "band"]).groupBy("source").agg(F.sum(F.col("n") * F.col("m")).alias("candidates"))


def _profile_sql(x: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{name}'" for name, p in rules) + f" ELSE '{other}' END"


INTENTS = [("contraindication", T.CONTRAINDICATION), ("exception", T.EXCEPTION), ("false", T.FALSE_CHOICE), ("negative", T.NEGATIVE)]


@query(f"WITH n AS (SELECT doc_id, {normal('text')} AS x FROM documents) SELECT doc_id, {_profile_sql('x', INTENTS, 'none')} AS marker FROM n")
def intent_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.intent_marker(T.normalize_field(F.col("text"))).alias("marker"))


@query(f"WITH n AS (SELECT item_id, {_phrases(normal('text'))} AS x FROM benchmark) SELECT item_id, {_profile_sql('x', T.OBJECTIVES, 'normal')} AS objective FROM n")
def objective_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.objective(T.semantic_field(F.col("text"))).alias("objective"))


@query("SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text: candidates share a window of its inner words, then the whole text is looked for.

    The words between a passage's first and last one (up to six) are whole words of a document that
    holds it.  Their hash is one key, so that the join is on equal keys.  Passages of one or two words
    have no inner word: that small set is looked for in each document.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), F.split(F.trim("text"), r"\s+").alias("w")).where("passage IS NOT NULL")
    b = b.select("item_id", "passage", F.least(F.size("w") - 2, F.lit(6)).alias("n"), "w")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sizes = [r["n"] for r in b.where("n > 0").select("n").distinct().collect()]  # six at most
    heads = b.where("n > 0").select("item_id", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("head"))
    w = d.select("doc_id", F.split("text", r"\s+").alias("w"))
    window = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))
    windows = F.array_distinct(F.concat(F.array().cast("array<long>"), *[F.coalesce(window(n), F.array().cast("array<long>")) for n in sizes]))
    met = w.select("doc_id", F.explode(windows).alias("head")).join(heads, "head").select("doc_id", "item_id").distinct().join(b.select("item_id", "passage"), "item_id")
    short = d.join(b.where("n < 1").select("item_id", "passage"), F.contains("text", F.col("passage"))).select("item_id")
    held = met.join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id")
    return held.unionByName(short).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


# --- windows, ranges and blocks


@query(
    """WITH p AS (SELECT doc_id, CAST(n_chars // 1500 + 1 AS INT) AS n_pages FROM documents), s AS (SELECT doc_id, n_pages, unnest(range(1, n_pages + 1, 2)) AS st FROM p)
    SELECT doc_id, n_pages, CAST(st AS INT) AS "start", CAST(least(st + 2, n_pages) AS INT) AS "end" FROM s WHERE st = 1 OR st < n_pages"""
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_ranges(table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("n_chars") / 1500) + 1).cast("int").alias("n_pages")))


@query(
    """WITH RECURSIVE t(doc_id, n, part, st, done) AS (
      SELECT doc_id, CAST(length(text) AS BIGINT), 0, CAST(0 AS BIGINT), false FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, n, part + 1, st + 4000, st + 4000 >= n - 1000 FROM t WHERE NOT done AND st + 4000 < n)
    SELECT doc_id, part, st AS "start", CASE WHEN done THEN n ELSE least(st + 5000, n) END AS "end" FROM t WHERE st < n"""
)
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return W.text_windows(d, "n", budget=5000, overlap=1000).select("doc_id", "part", F.col("start").cast("long"), F.col("end").cast("long"))


@query(
    """WITH i AS (SELECT l_orderkey AS k, CAST(l_partkey % 50 AS BIGINT) AS s, CAST(l_partkey % 50 + floor(l_quantity / 4) AS BIGINT) AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT k AS order_key, min(s) AS "start", max(e) AS "end", count(*) AS merged FROM g GROUP BY k, g"""
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 50
    return W.merge_intervals(li.select(F.col("l_orderkey").alias("order_key"), start.cast("long").alias("start"), (start + F.floor(F.col("l_quantity") / 4)).cast("long").alias("end")), ["order_key"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"WITH {LINES}, s AS (SELECT doc_id, line_no, sum(CASE WHEN regexp_matches(line, '^[AT]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, CAST(min(line_no) AS INT) AS first_line FROM s GROUP BY ALL")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.segments(_lines(spark, sf_dir), "doc_id", "line_no", F.col("line").rlike("^[AT]"))
    return d.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, count(DISTINCT nullif(regexp_extract(line, '^[A-E]'), '')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) >= 2 AS has_options_ahead FROM lines")
def options_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.options_ahead(_lines(spark, sf_dir), "doc_id", "line_no", F.regexp_extract("line", "^[A-E]", 0)).select("doc_id", "line_no", "has_options_ahead")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no // 5 AS INT) AS chunk, count(*) AS n_blocks, string_agg(line, chr(10) || chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, line_no // 5")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.chunks(_lines(spark, sf_dir), "doc_id", "line_no", 5, "line")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, length(lag(line) OVER w) AS before, length(lead(line) OVER w) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.neighbours(_lines(spark, sf_dir), "doc_id", "line_no", "line")
    return d.select("doc_id", "line_no", F.length("previous").cast("long").alias("before"), F.length("next").cast("long").alias("after"))


USUAL = r"""[\p{L}\p{N}.,;:!?()\[\]{}''"%+\-=/<>°–—_`~^&|#@*$✓✔☑✅]"""


@query(
    rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents),
    m AS (SELECT doc_id, length(t) AS chars, len(list_filter(string_split_regex(t, '\n+'), lambda l: trim(l) <> '')) AS n_lines, regexp_replace(t, '\s', '', 'g') AS c FROM p)
    SELECT doc_id, chars, CAST(n_lines AS INT) AS n_lines, round(CASE WHEN c = '' THEN 1.0 ELSE length(regexp_replace(c, '{USUAL}', '', 'g')) / CAST(length(c) AS DOUBLE) END, 9) AS strange,
           CASE WHEN chars < 120 THEN 'scanOrEmpty' WHEN n_lines > 40 AND chars / CAST(n_lines AS DOUBLE) < 18 THEN 'table' ELSE 'text' END AS kind FROM m"""
)
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\n{3,}", "\n\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "").alias("t"))
    d = d.select("doc_id", "t", F.length("t").cast("long").alias("chars"), F.size(F.filter(F.split("t", r"\n+"), lambda x: F.trim(x) != "")).alias("n_lines"))
    kind = F.when(F.col("chars") < 120, "scanOrEmpty").when((F.col("n_lines") > 40) & (F.col("chars") / F.col("n_lines") < 18), "table").otherwise("text")
    return d.select("doc_id", "chars", "n_lines", F.round(T.strange_ratio(F.col("t")), 9).alias("strange"), kind.alias("kind"))


@query(
    """WITH n AS (SELECT DISTINCT l_orderkey AS k, l_linenumber + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS x FROM lineitem),
    g AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM n), c AS (SELECT k, g, count(*) AS run FROM g GROUP BY k, g) SELECT k AS order_key, CAST(max(run) AS INT) AS longest FROM c GROUP BY k"""
)
def marker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of question numbers that follow each other, by a fold over the sorted numbers."""
    number = F.col("l_linenumber") + F.when(F.col("l_linenumber") > 3, 1).otherwise(0)
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_set(number)).alias("n"))
    return d.select("order_key", W.longest_run(F.col("n")).cast("int").alias("longest"))


@query("SELECT p_partkey AS id, 'case ' || min(c.o_orderkey) AS stem FROM part LEFT JOIN (SELECT o_orderkey, CAST(o_orderkey % 40 AS INT) AS s, CAST(o_orderkey % 40 + 2 AS INT) AS e FROM orders) c ON p_size BETWEEN c.s AND c.e GROUP BY p_partkey")
def range_join_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    start = (F.col("o_orderkey") % 40).cast("int")
    c = table(spark, sf_dir, "orders").select(F.concat(F.lit("case "), F.col("o_orderkey").cast("string")).alias("stem"), start.alias("start"), (start + 2).alias("end"), F.col("o_orderkey").alias("pos"))
    return R.first_interval(p, c, "p_size", "pos", ["stem"]).select("id", "stem")


@query(
    "WITH key AS (SELECT CAST(o_custkey AS BIGINT) AS number, arg_max(substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1), o_orderkey) AS letter FROM orders GROUP BY o_custkey) SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'E' ELSE coalesce(letter, '') END AS answer FROM customer LEFT JOIN key ON c_custkey = number"
)
def answer_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("qn"), F.when(F.col("c_custkey") % 4 == 0, "E").otherwise("  ").alias("answer"))
    key = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), F.substring(F.lit("ABCDE"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1)).alias("letter"), F.col("o_orderkey").alias("position"))
    return R.apply_answer_key(c, key, "qn").select("id", "answer")


# --- pages


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.to_text(F.col("html")).alias("text"))


#: Links that a page gets by its number, and what of them is safe.
LINKS = [('<a href="javascript:go()" id="k">x</a>', '<a id="k">x</a>'), ("<img alt=y src='data:text/html;base64,AA=='>", "<img alt=y>"), ('<a href=" JavaScript:go(1)">x</a>', "<a>x</a>"), ('<a href="https://x.org/javascript:1">x</a>', '<a href="https://x.org/javascript:1">x</a>'), ("<a xlink:href=javascript:go>x</a><img src=data:image/png;base64,AA>", "<a>x</a><img src=data:image/png;base64,AA>")]


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|iframe|object|embed|link|meta)\b[^>]*>(.*?</(script|style|iframe|object|embed)\s*>)?', '', 'g'), '(?i)\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g')
    || list_extract("""
    + "[" + ", ".join("'" + safe.replace("'", "''") + "'" for _, safe in LINKS) + "], CAST(page_id % 5 + 1 AS INT)) AS html FROM pages"
)
def html_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.element_at(F.array(*[F.lit(x) for x, _ in LINKS]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", html.sanitize(F.concat("html", link)).alias("html"))


# --- policies and events


KIND_SQL = "CASE event_id % 9 WHEN 0 THEN 'rateLimit' WHEN 1 THEN 'rateLimit' WHEN 2 THEN 'serverBusy' WHEN 3 THEN 'format' WHEN 4 THEN 'empty' WHEN 5 THEN 'auth' WHEN 6 THEN 'format' WHEN 7 THEN 'auth' ELSE 'fatal' END"


def _signs(signs: list[str]) -> str:
    return "(" + " OR ".join(f"contains(m, '{s}')" for s in signs) + ")"


CLASSIFIED = f"""kinds AS (SELECT *, CASE WHEN {_signs(policy.INVALID_KEY)} OR contains(m, 'invalid_grant') OR (contains(m, 'token') AND {_signs(['expired', 'hết hạn'])}) THEN 'auth'
  WHEN {_signs(policy.TOO_LARGE)} OR status = 413 THEN 'format' WHEN {_signs(policy.NO_CHANNEL)} THEN 'fatal' WHEN status = 400 OR contains(m, 'invalid_argument') THEN 'fatal'
  WHEN status = 429 OR {_signs(policy.RATE_LIMIT)} THEN 'rateLimit' WHEN status IN (401, 403) OR regexp_matches(m, '\\b(?:401|403)\\b') OR {_signs(policy.NO_ACCESS)} THEN 'auth'
  WHEN status IN (503, 504) OR {_signs(policy.BUSY)} THEN 'serverBusy' WHEN {_signs(policy.EMPTY)} THEN 'empty' WHEN {_signs(policy.MALFORMED)} THEN 'format' ELSE 'fatal' END AS kind
  FROM (SELECT *, lower(message) AS m FROM failures))"""


@query(f"WITH {FAILURES}, {CLASSIFIED} SELECT event_id, kind FROM kinds")
def retry_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures(spark, sf_dir).select("event_id", policy.classify_error(F.col("message"), F.col("status")).alias("kind"))


@query(
    f"""WITH {FAILURES}, {CLASSIFIED}, c AS (SELECT *, CASE WHEN kind = 'auth' THEN 'auth' WHEN status = 413 OR {_signs(policy.TOO_LARGE)} THEN 'requestTooLarge'
      WHEN kind = 'rateLimit' THEN CASE WHEN NOT {_signs(policy.TRANSIENT)} AND {_signs(policy.HARD_QUOTA)} AND delay_hint <= 0 THEN 'hardQuota' ELSE 'softRateLimit' END ELSE kind END AS cause FROM kinds)
    SELECT event_id, cause, CASE WHEN cause IN ('auth', 'hardQuota', 'fatal') THEN 'fail' WHEN cause = 'requestTooLarge' THEN 'split' WHEN cause = 'softRateLimit' THEN 'retry'
      WHEN attempts >= 2 THEN 'split' ELSE 'retry' END AS action FROM c"""
)
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause, action = policy.retry_decision(F.col("message"), F.col("status"), F.col("attempts"), F.col("delay_hint"))
    return failures(spark, sf_dir).select("event_id", cause.alias("cause"), action.alias("action"))


@query("SELECT event_id, CAST(least(45000.0, 3500.0 * pow(2.0, event_id % 6)) * 0.5 AS DOUBLE) AS delay_ms FROM events")
def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = policy.backoff_ms(F.lit("serverBusy"), (F.col("event_id") % 6 + 1), F.lit(0), F.lit(False), F.lit(0.5))
    return e.select("event_id", ms.alias("delay_ms"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("sec"))
    return W.rolling_count(e, ["user_id"], "sec").select("event_id", "in_window")


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events),
    n AS (SELECT *, CASE WHEN s - lag(s) OVER w > 86400 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS g FROM n)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY s, event_id) AS streak FROM g"""
)
def pressure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("sec"))
    return W.streaks(e, "user_id", ["sec", "event_id"], "sec", 86_400).select("event_id", F.col("streak").cast("long").alias("streak"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r(user_id, i, a) AS (SELECT user_id, i, value FROM e WHERE i = 1 UNION ALL SELECT r.user_id, e.i, r.a * 0.8 + e.value * 0.2 FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1)
    SELECT user_id, round(arg_max(a, i), 6) AS average FROM r GROUP BY user_id"""
)
def latency_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving_average(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value").select("user_id", F.round("average", 6).alias("average"))


@query(
    f"""WITH {FAILURES}, l AS (SELECT message, event_type AS label, min(event_id) AS first_at, count(*) AS n FROM failures GROUP BY ALL)
    SELECT message, string_agg(label, ', ' ORDER BY first_at, label) AS labels, CAST(sum(n) AS BIGINT) AS failures, min(first_at) AS first_idx FROM l GROUP BY message"""
)
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failure_summary(failures(spark, sf_dir).select("message", F.col("event_type").alias("label"), F.col("event_id").alias("idx")))


@query("SELECT user_id, count(*) AS slow FROM events WHERE value >= 50 AND event_type LIKE 'c%' GROUP BY user_id HAVING count(*) >= 3")
def slow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("value") >= 50) & F.col("event_type").startswith("c"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("slow")).where("slow >= 3")


# --- export


@query(
    f"""WITH {RECORDS} SELECT id, '"' || replace(regexp_replace(question, '^Cau \\d+\\. ', ''), '"', '""') || '"' AS question, '"' || replace(p_brand, '"', '""') || '"' AS a,
    '"' || substr('ABCD', CAST(id % 4 + 1 AS INT), 1) || '"' AS correct FROM records JOIN part ON p_partkey = id"""
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.sources.export import quoted

    r = records(spark, sf_dir)
    letter = T.correct_letter(F.col("options"), F.col("answer"), F.coalesce("answer", F.lit("A")))
    question = F.regexp_replace("question", r"^Cau \d+\. ", "")
    return r.select("id", quoted(question).alias("question"), quoted(T.clean_option(F.get("options", F.lit(0)))).alias("a"), quoted(letter).alias("correct"))


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(ceil(length(text) / 3.6) AS BIGINT) AS tokens FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), T.text_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(x) > 220 THEN trim(substr(x, 1, 220)) || '...' ELSE x END AS snippet FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\[[^\\]\\n]{0,180}\\]\\s*', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM documents)")
def source_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '_') AS name FROM pages")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.download_name(F.col("url")).alias("name"))


# --- operators that SQL does not express: rows only, held against unit tests


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made of records, ten in each; every third answer breaks off."""
    r = records(spark, sf_dir).withColumn("batch_no", F.floor(F.col("id") / 10).cast("int"))
    one = F.to_json(F.struct("question", "options", F.col("answer").alias("correctAnswer"), "difficulty"))
    d = r.groupBy("batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("j")))), lambda x: x["j"]), ",").alias("body"))
    whole = F.concat(F.lit('{"questions":['), "body", F.lit("]}"))
    return d.select("batch_no", F.when(F.col("batch_no") % 3 == 0, F.expr("substring(concat('{\"questions\":[', body, ']}'), 1, length(body) - 50)")).otherwise(whole).alias("text"))


@query("WITH n AS (SELECT CAST(p_partkey // 10 AS INT) AS batch_no, count(*) AS n FROM part GROUP BY 1) SELECT batch_no, CAST(CASE WHEN batch_no % 3 = 0 THEN n - 1 ELSE n END AS BIGINT) AS questions, batch_no % 3 = 0 AND n > 1 AS salvaged FROM n")
def salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.functions.modeljson import parse_responses

    d = parse_responses(_responses(spark, sf_dir))
    return d.select("batch_no", F.size("questions").cast("long").alias("questions"), "salvaged")


@query("SELECT CAST(p_partkey // 10 AS INT) AS doc_id, count(*) AS questions, count(*) AS answered FROM part GROUP BY 1")
def parse_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.markdown import markdown_questions

    r = records(spark, sf_dir).withColumn("doc_id", F.floor(F.col("id") / 10).cast("int"))
    block = F.concat("question", F.lit("\n"), F.array_join("options", "\n"), F.lit("\nAnswer: "), "answer")
    d = r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    return markdown_questions(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("answer") != "").alias("answered"))


@query()
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.dedupe import dedupe

    return dedupe(document_records(spark, sf_dir)).select("id", "action", "matched_with", F.round("composite", 9).alias("composite"))


@query()
def partial_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.functions.similarity import partial_ratio_udf

    return _name_pairs(spark, sf_dir, {"x": T.normalize_field(F.col("name"))}, lambda a, b: partial_ratio_udf(a["x"], b["x"]))


@query()
def split_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.segments import natural_parts

    return natural_parts(table(spark, sf_dir, "documents"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of 1,500 characters."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    # cut in one pass: a page for itself would be looked for from the text's start, with a copy of the whole text
    cut = d.select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,1500}"), F.lit(0))).alias("nth", "text"))
    return cut.select("file_id", (F.col("nth") + 1).alias("page"), "text")


@query()
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.pdf import score_pages

    return score_pages(_pages(spark, sf_dir)).select("file_id", "page", "chars", "n_lines", "n_questions", "n_options", "table_risk", "quality")


@query()
def pdf_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.pdf import boundary_risks, score_pages, vision_ranges

    # both steps read the scored pages: they are scored once
    pages = cut_lineage(score_pages(_pages(spark, sf_dir)).select("file_id", "page", "text", "table_risk", "quality"))
    return vision_ranges(pages, boundary_risks(pages))


@query()
def marker_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemforge.operators.pdf import marker_estimate as estimate

    d = records(spark, sf_dir).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "question"))), lambda x: x["question"]), "\n").alias("text"))
    return d.select("source", estimate(F.col("text")).alias("e")).select("source", "e.confidence", "e.count", "e.duplicates", "e.markers", "e.run")


@query(
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 100000000 AS "at" FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", event_id) - 1 AS n FROM e)
    SELECT event_id, key, "at", CAST(max("at" - n // 30 * 60000) OVER (PARTITION BY key, n % 30 ORDER BY n) + n // 30 * 60000 AS BIGINT) AS admitted_at FROM n"""
)
def request_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 s of the table count as one ms, so that a user's requests come faster than 30 a minute and wait."""
    from stemforge.streaming.keys import admissions

    at = F.floor(F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 100_000)
    return admissions(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", at.alias("at")))


@query()
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: sessions of events in batch, by the function that streams use."""
    from stemforge.streaming.records import sessions

    return sessions(table(spark, sf_dir, "events"), gap="1 day").select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
