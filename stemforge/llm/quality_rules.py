"""Quality rules: word and repetition statistics of a text, and the frequency of its lines across documents.

DataFrame functions only.  A line, normalised (lower case, one space between words), is boilerplate of
a host if more of the host's documents hold it than `least_documents` and than `share` of them all.
Boilerplate lines are removed, and a document is rejected if too little is left of it.

A first count, of rows by host and line, leaves the few lines that may be above the limits; only where
these stand is kept, in one small table, for the exact count of documents and for the removal.

Words are runs without space and 0x09-0x0D.  Null texts have no words; a null host is a host of its
own.  Rows that share an id have statistics each of their own, but count as one document, whose lines
are judged together.  Extra columns are ignored; an empty table gives an empty result.
Windows and lines are compared by 64-bit hashes (within a text, and two of them across documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import materialize
from stemforge.llm.components import salted_join

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5

LEAST_DOCUMENTS = 100
SHARE = 0.1
#: A document whose lines are removed must keep so many words, and such a share of them.
LEAST_WORDS_LEFT = 10
LEAST_SHARE_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def normal_line(line: Column) -> Column:
    return F.lower(F.array_join(words_of(line), " "))


def line_hash(line: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), normal_line(line))


def statistics(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row: one scan, no shuffle."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    d = docs.select(F.col(id_column), text.alias("text"), words_of(text).alias("w"))
    d = d.withColumn("n", F.size("w"))
    window = lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])
    hashes = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        id_column,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    # only texts with a repeated window sort theirs: equal ones meet, and their places are sorted again
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    at = lambda i: F.get(F.col("s"), i)["h"]
    again = F.filter("s", lambda x, k: (x["h"] == at(k + 1)) | ((k > 0) & (x["h"] == at(k - 1))))
    d = d.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def normal_lines(text: Column) -> Column:
    """normal_line() of every line of a text, by one call for its white space."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")), "\n"), F.trim)


def host_of(host_column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_column).cast("string")), F.lit(""))


def host_sizes(docs: DataFrame, id_column: str, host_column: str) -> DataFrame:
    """host and its number of documents (a null id is one)."""
    return docs.select(host_of(host_column).alias("host"), F.col(id_column).alias("id")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))


def likely_lines(docs: DataFrame, sizes: DataFrame, text_column: str, host_column: str, least_documents: int, share: float) -> DataFrame:
    """host and hash of the lines that more rows than the limits hold: at most 1/share for each host and line of a document, on average."""
    lines = docs.select(host_of(host_column).alias("host"), F.explode(F.array_distinct(normal_lines(F.col(text_column)))).alias("x")).where("x != ''")
    often = lines.groupBy("host", F.xxhash64(F.lit(0), "x").alias("h0")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least_documents)
    return often.join(sizes, "host").where(F.col("rows") > F.col("size") * share).select("host", "h0")


def held_lines(docs: DataFrame, keys: list[str], wanted: DataFrame, text_column: str, host_column: str) -> DataFrame:
    """keys, host, two hashes, how often and with how many words a row holds each line of `wanted` (host, h0)."""
    lines = docs.select(*keys, host_of(host_column).alias("host"), F.explode(normal_lines(F.col(text_column))).alias("x")).where("x != ''")
    # hashes and counts, not texts, go through the join
    lines = lines.select(*keys, "host", F.xxhash64(F.lit(0), "x").alias("h0"), F.xxhash64(F.lit(1), "x").alias("h1"), F.size(F.split("x", " ")).alias("n"))
    held = salted_join(lines, wanted, ["host", "h0"], F.hash(*keys))
    return held.groupBy(*keys, "host", "h0", "h1").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("words"))


def boilerplate(docs: DataFrame, keys: list[str], id_column: str, text_column: str, host_column: str, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """held_lines() of the lines that more documents than the limits hold."""
    sizes = materialize(host_sizes(docs, id_column, host_column))
    held = materialize(held_lines(docs, keys, likely_lines(docs, sizes, text_column, host_column, least_documents, share), text_column, host_column))
    often = held.select(id_column, "host", "h0", "h1").distinct().groupBy("host", "h0", "h1").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > least_documents)
    common = often.join(sizes, "host").where(F.col("documents") > F.col("size") * share).select("host", "h0", "h1")
    return salted_join(held, common, ["host", "h0", "h1"], F.hash(*keys))


def _rejections(removed: Column) -> tuple[Column, Column]:
    """Whether the base rules fail, and whether too little is left, by n_words, n_repeat_words and the removed words."""
    left = F.greatest(F.col("n_words") - removed, F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return failed, (removed > 0) & ((left < LEAST_WORDS_LEFT) | (left < LEAST_SHARE_LEFT * F.col("n_words")))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", least_documents: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """id, the statistics, base_failed, kept, removed_words and removed_lines (hashes) of every row."""
    held = boilerplate(docs, [id_column], id_column, text_column, host_column, least_documents, share)
    hit = held.groupBy(id_column).agg(F.sum("words").alias("removed_words"), F.collect_set("h0").alias("removed_lines"))
    base = statistics(docs, id_column, text_column)
    d = base.join(hit, id_column, "left")
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    failed, depleted = _rejections(removed)
    return d.select(
        id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), removed.alias("removed_words"), "removed_lines"
    )


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", **limits) -> DataFrame:
    """The kept rows with their columns as they were, without their boilerplate lines; other texts stay byte for byte.

    What is boilerplate is counted by id, but each row stays or goes by its own text, with a null or repeated id too.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    own = docs.withColumn("__row", F.md5(F.concat_ws("\x01", named(id_column), named(host_column), F.col(text_column)).cast("binary")))
    held = boilerplate(own, [id_column, "__row"], id_column, text_column, host_column, **limits)
    hit = held.groupBy("__row").agg(F.sum("words").alias("words"), F.collect_set("h0").alias("__removed"))
    base = statistics(own, "__row", text_column).groupBy("__row").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"), F.max("n_repeat_words").alias("n_repeat_words"))
    # the words of equal rows were added up
    d = base.join(hit, "__row", "left").withColumn("removed_words", F.coalesce(F.col("words") / F.col("copies"), F.lit(0)))
    failed, depleted = _rejections(F.col("removed_words"))
    d = own.join(d.where(~failed & ~depleted).select("__row", "__removed"), "__row")
    rest = F.filter(F.split(text_column, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("__removed"), line_hash(x, 0))))
    text = F.when(F.col("__removed").isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text_column))
    return d.withColumn(text_column, text).select(*docs.columns)


#: DuckDB SQL for the rows of the query on `documents`.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, host, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
nl AS (SELECT doc_id, host, lower(array_to_string(w, ' ')) AS x, sum(len(w)) AS words FROM ln GROUP BY ALL),
common AS (
  SELECT host, x FROM (SELECT host, x, count(*) AS documents FROM nl GROUP BY host, x)
  JOIN (SELECT host, count(DISTINCT doc_id) AS size FROM d GROUP BY host) USING (host)
  WHERE documents > 100 AND documents > size * 0.1),
hit AS (SELECT doc_id, sum(words) AS n FROM nl JOIN common USING (host, x) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(hit.n, 0) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN hit USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.3 * n_words)) AS kept,
       CAST(removed_words AS BIGINT) AS removed_words
FROM base
"""
