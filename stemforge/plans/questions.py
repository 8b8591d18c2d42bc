"""Queries over question texts, page ranges and key events.

Their texts are written from the plain tables in the odd ways that question banks have; the SQL does not parse them, it says
from the same tables what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemforge.operators import markdown, ranges
from stemforge.operators.paragraphs import page_questions as pages_to_questions
from stemforge.operators.paragraphs import paragraph_questions as paragraphs_to_questions
from stemforge.plans.registry import query
from stemforge.plans.synth import table

#: Ten parts are a document; a part's place there is its number, and its format.
ITEMS = """
items AS (
  SELECT p_partkey // 10 AS doc, CAST(p_partkey % 10 + 1 AS INT) AS i, p_name AS name, p_brand AS o1, p_type AS o2, 'Size ' || p_size AS o3, 'Part ' || p_name AS o4,
         substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS key, CAST(p_partkey % 10 % 6 AS INT) AS format
  FROM part)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        F.floor(k / 10).alias("doc"), (k % 10 + 1).cast("int").alias("i"), F.col("p_name").alias("name"), F.col("p_brand").alias("o1"), F.col("p_type").alias("o2"), F.concat(F.lit("Size "), "p_size").alias("o3"),
        F.concat(F.lit("Part "), "p_name").alias("o4"), F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1)).alias("key"), (k % 10 % 6).cast("int").alias("format"),
    )


def _text(*parts: str) -> Column:
    """Column names in braces of a format string's pieces."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc and text: six formats, and an answer key with a note after it behind the fifth question."""
    f = F.col("format")
    block = (
        F.when(f == 0, _text("Câu ", "{i}", ": ", "{name}", "\nA. ", "{o1}", "\nB. ", "{o2}", "\nC. ", "{o3}", "\nD. ", "{o4}", "\nĐáp án: ", "{key}"))
        .when(f == 1, _text("## Question ", "{i}", "\n", "{name}", "\na) ", "{o1}", " b) ", "{o2}", " c) ", "{o3}", " d) ", "{o4}"))
        .when(f == 2, _text("{i}", ". ", "{name}", "\n- A. ", "{o1}", "\n- B. ", "{o2}", "\n✅ C. ", "{o3}", "\n- D. ", "{o4}"))
        .when(f == 3, _text("Câu ", "{i}", ". ", "{name}", " A. ", "{o1}", " C. ", "{o3}", " B. ", "{o2}", " D. ", "{o4}"))
        .when(f == 4, _text("**Bài tập ", "{i}", "**: ", "{name}", "\nwritten on\nA: ", "{o1}", "\nB - **", "{o2}", "**\nC: ", "{o3}", "\nand more\nD: ", "{o4}", "\nExplanation: none"))
        .otherwise(_text("Q ", "{i}", ") ", "{name}", "\n(A) ", "{o1}", "; (B) ", "{o2}", "; (C) ", "{o3}", "; (D) ", "{o4}", "\n> Answer: (D)"))
    )
    d = _items(spark, sf_dir).select("doc", "i", block.alias("block"), F.concat(F.col("i").cast("string"), "key").alias("pair"))
    listed = d.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "block", "pair"))).alias("l"))  # ten rows
    blocks, pairs = F.transform("l", lambda x: x["block"]), F.transform("l", lambda x: x["pair"])
    key = F.concat(F.lit("\nBẢNG ĐÁP ÁN\n"), F.array_join(F.slice(pairs, 1, 5), " "), F.lit("\n\n"), F.array_join(F.slice(pairs, 6, 5), ", "), F.lit("\nNotes: end of part one"))
    return listed.select("doc", F.array_join(F.flatten(F.array(F.slice(blocks, 1, 5), F.array(key), F.slice(blocks, 6, 5))), "\n\n").alias("text"))


EXPECTED = f"""
WITH {ITEMS},
q AS (
  SELECT doc, i, format, key,
         CASE format WHEN 0 THEN 'Câu ' || i || ': ' || name WHEN 1 THEN 'Question ' || i || ' ' || name WHEN 2 THEN i || '. ' || name WHEN 3 THEN 'Câu ' || i || '. ' || name
                     WHEN 4 THEN 'Bài tập ' || i || ': ' || name || ' written on' ELSE 'Q ' || i || ') ' || name END AS question,
         CASE format WHEN 3 THEN ['A. ' || o1, 'C. ' || o3, 'B. ' || o2, 'D. ' || o4]
                     WHEN 4 THEN ['A. ' || o1, 'B. ' || o2, 'C. ' || o3 || ' and more', 'D. ' || o4]
                     ELSE ['A. ' || o1, 'B. ' || o2, 'C. ' || o3, 'D. ' || o4] END AS options,
         CASE format WHEN 2 THEN 'C' WHEN 4 THEN 'B' WHEN 5 THEN 'D' ELSE key END AS answer
  FROM items),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) AS ordinal, count(*) OVER (PARTITION BY doc) AS n FROM q)"""


@query(f"{EXPECTED} SELECT doc, CAST(ordinal AS INT) AS ordinal, i AS number, question, array_to_string(options, ' | ') || CASE WHEN ordinal = least(n, 5) THEN ' Notes: end of part one' ELSE '' END AS options, answer FROM n")
def markdown_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of irregular texts, whole rows."""
    found = markdown.markdown_questions(_documents(spark, sf_dir), doc="doc")
    return found.select("doc", "ordinal", "number", "question", F.array_join("options", " | ").alias("options"), "answer")


@query(f"WITH {ITEMS} SELECT doc, i AS number, key AS letter FROM items")
def answer_key_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of keys that stand in the middle of their documents."""
    return markdown.key_answers(markdown.answer_keys(markdown.document_lines(_documents(spark, sf_dir), "doc"), "doc"), "doc")


@query(
    f"""{EXPECTED}, b AS (SELECT doc, string_agg('<<<MCQ ' || ordinal || '>>>' || chr(10) || 'Question: ' || question || chr(10) ||
      array_to_string(list_transform(options, lambda o: CASE WHEN substr(o, 1, 1) = answer THEN '✅ ' ELSE '' END || o || CASE WHEN ordinal = least(n, 5) AND o[1] = 'D' THEN ' Notes: end of part one' ELSE '' END), chr(10)), chr(10) || chr(10) ORDER BY ordinal) AS body, count(*) AS c FROM n GROUP BY doc)
    SELECT doc, c AS count, false AS fallback, '[MARKDOWN_MCQ_COUNT: ' || c || ']' || chr(10) || chr(10) || body AS text FROM b"""
)
def markdown_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.structured_texts(_documents(spark, sf_dir), doc="doc")


@query(
    f"""WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) AS ordinal FROM items)
    SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(ordinal AS INT) AS ordinal, i AS number, 'Câu ' || i || '. ' || name AS question,
           CASE WHEN format % 3 = 2 THEN 'A. ' || o1 || ' | B. ' || o2 || ' | C. ' || o3 || ' | D. ' || o4 ELSE 'A. ' || o1 || ' | B. ' || o2 || ' continued | C. ' || o3 || ' | D. ' || o4 END AS options,
           CASE WHEN format % 3 = 1 THEN 'D' ELSE key END AS answer FROM n"""
)
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with labels, with list levels, and with all options in one; answers by highlight and by a key at the end."""
    items = _items(spark, sf_dir)
    f = F.col("format") % 3
    row = lambda k, text, marked=F.lit(False), level=F.lit(None).cast("string"): F.struct(F.lit(k).alias("k"), text.alias("text"), marked.alias("marked"), level.alias("level"))
    head = row(0, _text("Câu ", "{i}", ". ", "{name}"))
    labelled = F.array(head, row(1, _text("A. ", "{o1}")), row(2, _text("b) ", "{o2}")), row(3, F.lit("continued")), row(4, _text("C: ", "{o3}")), row(5, _text("D. ", "{o4}")))
    levels = F.array(head, row(1, F.col("o1"), level=F.lit("letter")), row(2, F.concat("o2", F.lit(" continued")), level=F.lit("letter")), row(3, F.lit("   ")), row(4, F.col("o3"), level=F.lit("letter")), row(5, F.col("o4"), F.lit(True), F.lit("letter")))
    inline = F.array(head, row(1, _text("A. ", "{o1}", "; B. ", "{o2}", "; C. ", "{o3}", "; D. ", "{o4}")))
    body = items.select("doc", "i", F.explode(F.when(f == 0, labelled).when(f == 1, levels).otherwise(inline)).alias("p")).select("doc", (F.col("i") * 10 + F.col("p.k")).alias("ord"), "p.text", "p.marked", "p.level")
    pairs = items.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda x: F.concat(x["i"].cast("string"), F.lit("-"), x["key"])), "; ").alias("pairs"))
    keys = pairs.select("doc", F.explode(F.array(row(500, F.lit("Đáp án")), row(501, F.col("pairs")))).alias("p")).select("doc", F.col("p.k").alias("ord"), "p.text", "p.marked", "p.level")
    found = paragraphs_to_questions(body.unionByName(keys).withColumnRenamed("doc", "doc_id"))
    return found.select("doc_id", "ordinal", "number", "question", F.array_join("options", " | ").alias("options"), "answer")


@query(
    f"""WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) AS ordinal FROM items WHERE doc % 3 <> 1)
    SELECT doc, CAST(ordinal AS INT) AS ordinal, CASE WHEN i % 2 = 0 THEN 'Câu ' || i || ': ' ELSE i || '. Which one of these is it, ' END || name AS question, 'A. ' || o1 || ' | B. ' || o2 || ' run on' AS options, key AS answer FROM n
    UNION ALL SELECT doc, 1, 'No heading, but long enough ' || name, 'A. ' || o1 || ' | B. ' || o2, '' FROM items WHERE i = 1 AND doc % 3 = 1"""
)
def page_text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts: bare numbers and labels, run-on headings, text before the first heading, and texts without any heading."""
    items = _items(spark, sf_dir)
    head = F.when(F.col("i") % 2 == 0, _text("Câu ", "{i}", ": ", "{name}")).otherwise(_text("{i}", ". Which one of these is it, ", "{name}"))
    block = F.concat(head, _text("\nA. ", "{o1}", "\n(B) ", "{o2}", "\nrun on\nĐáp án: ", "{key}"))
    headed = items.where("doc % 3 <> 1").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]).alias("l"))
    headed = headed.select("doc", F.concat(F.lit("A header that is long enough to be one\nA. no\nB. heading\n"), F.array_join("l", "\n")).alias("text"))
    bare = items.where("i = 1 AND doc % 3 = 1").select("doc", _text("No heading, but\nlong enough ", "{name}", "\nA. ", "{o1}", "\nB. ", "{o2}").alias("text"))
    return pages_to_questions(headed.unionByName(bare), doc="doc").select("doc", "ordinal", "question", F.array_join("options", " | ").alias("options"), "answer")


# --- ranges of pages

#: An order is a file of as many pages as its key says; its groups of pages come from its line items.
FILES = """
f AS (SELECT o_orderkey AS file_id, CAST(5 + o_orderkey % 40 AS INT) AS n FROM orders),
g AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ord, CAST(1 + (l_partkey * 7 + l_linenumber * 3) % (5 + l_orderkey % 40) AS INT) AS s, CAST(l_partkey % 4 AS INT) AS w FROM lineitem),
r AS (SELECT file_id, n, CAST(1 + 2 * k AS INT) AS a, CAST(least(n, 3 + 2 * k) AS INT) AS b FROM f, range(25) t(k) WHERE k = 0 OR 1 + 2 * (k - 1) + 2 < n)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (5 + F.col("o_orderkey") % 40).cast("int").alias("n_pages"))
    from stemforge.operators.windows import page_ranges

    cut = page_ranges(f).select("file_id", "start", "end")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    start = (1 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % (5 + F.col("l_orderkey") % 40)).cast("int")
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), place.alias("ord"), start.alias("start"), (start + F.col("l_partkey") % 4).cast("int").alias("end"))
    return f, cut, groups


@query(
    f"""WITH RECURSIVE {FILES},
    s(file_id, step, l) AS (
      SELECT file_id, CAST(0 AS BIGINT), list({{'a': a, 'b': b}} ORDER BY a, b) FROM r GROUP BY file_id
      UNION ALL
      SELECT s.file_id, g.ord, CASE WHEN len(list_filter(s.l, lambda x: x.a <= g.s + g.w AND x.b >= g.s)) > 1
             THEN list_append(list_filter(s.l, lambda x: NOT (x.a <= g.s + g.w AND x.b >= g.s)),
                              {{'a': list_min(list_transform(list_filter(s.l, lambda x: x.a <= g.s + g.w AND x.b >= g.s), lambda x: x.a)), 'b': list_max(list_transform(list_filter(s.l, lambda x: x.a <= g.s + g.w AND x.b >= g.s), lambda x: x.b))}})
             ELSE s.l END
      FROM s JOIN g ON g.file_id = s.file_id AND g.ord = s.step + 1),
    last AS (SELECT file_id, arg_max(l, step) AS l FROM s GROUP BY file_id), u AS (SELECT file_id, unnest(l) AS x FROM last)
    SELECT file_id, x.a AS "start", x.b AS "end" FROM u"""
)
def merge_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping page ranges merged by groups of pages, each group seeing what those before it merged."""
    _, cut, groups = _files(spark, sf_dir)
    return ranges.merge_by_groups(cut, groups)


@query(
    f"""WITH RECURSIVE {FILES},
    risky AS (SELECT DISTINCT file_id, s AS page FROM g),
    c(file_id, n, a, b) AS (
      SELECT file_id, n, 1, CAST(least(n, 4) - CASE WHEN least(n, 4) < n AND (file_id, least(n, 4)) IN (SELECT (file_id, page) FROM risky) THEN 1 ELSE 0 END AS INT) FROM f
      UNION ALL
      SELECT file_id, n, a, CAST(e - CASE WHEN e < n AND e > a AND EXISTS (SELECT 1 FROM risky k WHERE k.file_id = x.file_id AND k.page = x.e) THEN 1 ELSE 0 END AS INT)
      FROM (SELECT file_id, n, CAST(greatest(a + 1, b) AS INT) AS a, CAST(least(n, greatest(a + 1, b) + 3) AS INT) AS e FROM c WHERE greatest(a + 1, b) <= n AND b < n) x)
    SELECT file_id, a AS "start", b AS "end" FROM c"""
)
def cut_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of four pages, one overlapping, over whole files; a cut at a risky page goes back by a page, and so does what follows."""
    files, _, groups = _files(spark, sf_dir)
    whole = files.select("file_id", F.lit(1).alias("start"), F.col("n_pages").alias("end"))
    return ranges.cut_ranges(whole, groups.select("file_id", F.col("start").alias("page")), size=4, overlap=1)


# --- key health

KINDS = "['ok', 'ok', 'ok', 'rateLimit', 'ok', 'quota', 'auth', 'serverBusy', 'suspect', 'format', 'ok']"
BOUNDS = {"rateLimit": "greatest(45000, least(300000, coalesce(retry, 180000)))", "suspect": "greatest(30000, least(120000, coalesce(retry, 30000)))"}


@query(
    f"""WITH RECURSIVE e AS (
      SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) // 100000 AS "at", list_extract({KINDS}, CAST(event_id * 7 % 11 + 1 AS INT)) AS kind, value AS ms,
             CASE WHEN event_id % 3 = 0 THEN event_id % 7 * 60000 END AS retry, event_id % 500 = 6 AS permanent FROM events),
    c AS (
      SELECT *, count(*) FILTER (WHERE kind IN ('ok', 'format')) OVER w AS epoch, count(*) FILTER (WHERE kind = 'quota') OVER w AS quotas, count(*) FILTER (WHERE kind = 'auth') OVER w AS auths,
             sum(CASE WHEN kind = 'ok' THEN -1 WHEN kind IN ('format', 'serverBusy') THEN 0 ELSE 1 END) OVER w AS walk, sum(CASE kind WHEN 'ok' THEN -1 WHEN 'rateLimit' THEN 1 ELSE 0 END) OVER w AS rates,
             sum(CASE kind WHEN 'ok' THEN -1 WHEN 'suspect' THEN 1 ELSE 0 END) OVER w AS suspects, row_number() OVER w AS n, max("at") FILTER (WHERE kind <> 'serverBusy') OVER (PARTITION BY key) AS touched
      FROM e WINDOW w AS (PARTITION BY key ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (
      SELECT *, CASE kind WHEN 'rateLimit' THEN "at" + {BOUNDS["rateLimit"]} WHEN 'suspect' THEN "at" + {BOUNDS["suspect"]}
                          WHEN 'quota' THEN "at" + greatest(1800000, least(21600000, coalesce(retry, CAST(1800000 * power(2, least(quotas - 1, 10)) AS BIGINT))))
                          WHEN 'auth' THEN CASE WHEN permanent THEN 4611686018427387904 ELSE "at" + greatest(900000, least(3600000, coalesce(retry, 900000 * auths))) END END AS until,
             CASE kind WHEN 'rateLimit' THEN 'cooldown' WHEN 'quota' THEN 'quotaBlocked' WHEN 'auth' THEN 'authBlocked' WHEN 'suspect' THEN 'suspect' END AS status FROM c),
    x AS (SELECT key, epoch, max(until) AS until, arg_max(status, n) FILTER (WHERE status IS NOT NULL) AS status FROM b GROUP BY key, epoch),
    y AS (SELECT key, coalesce(arg_max(until, epoch) FILTER (WHERE epoch = m), 0) AS until, coalesce(max(status) FILTER (WHERE epoch = m), 'healthy') AS status FROM (SELECT *, max(epoch) OVER (PARTITION BY key) AS m FROM x) GROUP BY key),
    p AS (SELECT key, "at", event_id, CASE WHEN "at" - lag("at") OVER (PARTITION BY key ORDER BY "at", event_id) <= 45000 THEN 0 ELSE 1 END AS new FROM e WHERE kind IN ('rateLimit', 'quota', 'serverBusy')),
    i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY "at", event_id) AS island FROM p),
    q AS (SELECT key, max(island) AS island, max("at") AS pressed FROM i GROUP BY key), run AS (SELECT q.key, q.pressed, count(*) AS run FROM q JOIN i ON i.key = q.key AND i.island = q.island GROUP BY 1, 2),
    o AS (SELECT key, ms, row_number() OVER (PARTITION BY key ORDER BY "at", event_id) AS k FROM e WHERE kind = 'ok'),
    a(key, k, v) AS (SELECT key, k, ms FROM o WHERE k = 1 UNION ALL SELECT a.key, o.k, a.v * 0.8 + o.ms * 0.2 FROM a JOIN o ON o.key = a.key AND o.k = a.k + 1),
    l AS (SELECT key, arg_max(v, k) AS v FROM a GROUP BY key)
    SELECT b.key, any_value(y.status) AS status, CAST(any_value(y.until) AS BIGINT) AS blocked_until, count(*) FILTER (WHERE kind = 'ok') AS successes, CAST(arg_max(walk, n) - least(0, min(walk)) AS BIGINT) AS failures,
           count(*) FILTER (WHERE kind = 'format') AS format_errors, CAST(arg_max(rates, n) - least(0, min(rates)) AS BIGINT) AS rate_strikes, count(*) FILTER (WHERE kind = 'quota') AS quota_strikes, count(*) FILTER (WHERE kind = 'auth') AS auth_strikes,
           CAST(arg_max(suspects, n) - least(0, min(suspects)) AS BIGINT) AS suspect_strikes,
           CAST(CASE WHEN any_value(run.run) IS NULL OR max("at") FILTER (WHERE kind = 'ok') - any_value(run.pressed) > 60000 THEN 0 ELSE any_value(run.run) END AS BIGINT) AS pressure,
           max("at") FILTER (WHERE kind = 'ok') AS last_success, max("at") FILTER (WHERE kind NOT IN ('ok', 'format', 'serverBusy')) AS last_failure,
           least(100, count(*) FILTER (WHERE kind = 'ok' AND touched - "at" <= 60000)) AS recent, round(any_value(l.v), 6) AS latency
    FROM b JOIN y ON y.key = b.key LEFT JOIN run ON run.key = b.key LEFT JOIN l ON l.key = b.key GROUP BY b.key"""
)
def key_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the state of every user as a key; a tenth of a second of the table counts as one ms."""
    from stemforge.streaming.keys import key_health as health

    return health(key_events(spark, sf_dir)).withColumn("latency", F.round("latency", 6))


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    kinds = ["ok", "ok", "ok", "rateLimit", "ok", "quota", "auth", "serverBusy", "suspect", "format", "ok"]
    at = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 100_000)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (n * 7 % 11 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", at.alias("at"), kind.alias("kind"), F.col("value").alias("latency_ms"), F.when(n % 3 == 0, n % 7 * 60000).alias("retry_after_ms"), (n % 500 == 6).alias("permanent"))
