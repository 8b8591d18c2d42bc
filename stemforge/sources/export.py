"""Sinks: CSV text, HTML for flash cards, a DOCX study sheet, keyed tables."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions import text as T

CSV_HEADER = "Question,A,B,C,D,E,CorrectAnswer,ExplanationHTML,Source"


def quoted(text: Column) -> Column:
    """A CSV value: always quoted, quotes doubled, line ends as spaces."""
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", " "), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(records: DataFrame) -> DataFrame:
    """position and one CSV line for each record; the default answer is A."""
    letter = T.correct_letter(F.col("options"), F.col("answer"), F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce("answer", F.lit("")), "(?i)^[A-E]", 0)), F.lit("")), F.nullif(F.col("answer"), F.lit("")), F.lit("A")))
    options = [quoted(T.clean_option(F.get("options", F.lit(i)))) for i in range(5)]
    explanation = F.col("explanation") if "explanation" in records.columns else F.lit("")
    return records.select("position", F.concat_ws(",", quoted(T.strip_platform_noise(F.coalesce("question", F.lit("")))), *options, quoted(letter), quoted(explanation), quoted(F.col("source"))).alias("value"))


def write_csv(records: DataFrame, path: str) -> None:
    """Sorted CSV part files; the first line of all is the header, after a byte-order mark."""
    spark = records.sparkSession
    header = spark.createDataFrame([(-1, "﻿" + CSV_HEADER)], "position long, value string")
    csv_lines(records).unionByName(header).orderBy("position").select("value").write.mode("overwrite").text(path)


def write_keyed(existing: DataFrame | None, incoming: DataFrame, path: str, key: str = "id") -> None:
    """Replaces rows by key: what is not in the batch stays, the batch is added.  `path` must not be read by `existing`."""
    out = incoming if existing is None else existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
    out.write.mode("overwrite").parquet(path)


def rich_html(text: str | None) -> str:
    """Card HTML: escaped text with pipe tables, quotes, bold, italics and line breaks."""
    out: list[str] = []
    rows: list[list[str]] = []

    def inline(s: str) -> str:
        s = escape(s, quote=False)
        s = re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", s)
        return re.sub(r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"<i>\1</i>", s)

    def flush() -> None:
        if rows:
            body = "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in rows)
            out.append(f"<table>{body}</table>")
            rows.clear()

    for line in (text or "").split("\n"):
        s = line.strip()
        if s.startswith("|") and s.endswith("|") and len(s) > 1:
            cells = [c.strip() for c in s[1:-1].split("|")]
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                rows.append(cells)
            continue
        flush()
        out.append(f"<blockquote>{inline(s[1:].strip())}</blockquote>" if s.startswith(">") else inline(line))
    flush()
    return "<br>".join(out)


_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx_bytes(records: list[dict], title: str = "Study sheet", per_page: int = 12) -> bytes:
    """A study sheet: an overview by difficulty, then each record with its answer, with a page break after so many.

    The records of one sheet are on the driver: a sheet is for people to read.
    """
    p = lambda s, bold=False: f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(s)}</w:t></w:r></w:p>'
    counts: dict[str, int] = {}
    for r in records:
        counts[r.get("difficulty") or "Unknown"] = counts.get(r.get("difficulty") or "Unknown", 0) + 1
    body = [p(title, True), p(f"Questions: {len(records)}"), *[p(f"{k}: {counts[k]}") for k in sorted(counts)]]
    for i, r in enumerate(records):
        if i and i % per_page == 0:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        body += [p(f"{i + 1}. {r.get('question') or ''}", True), *[p(o) for o in r.get("options") or []], p(f"Answer: {r.get('answer') or '?'}"), p(f"Source: {r.get('source') or ''}")]
    document = f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", document)
    return out.getvalue()
