"""DOCX source: paragraphs with answer marks, numbering and images, read with the standard library.

`paragraphs` turns a table of files (binaryFile) into one row for each paragraph.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Reds that mark an answer, fills that mark none, image types.
REDS = {"FF0000", "C00000", "E60000", "ED1C24", "FF3333"}
NO_FILL = {"auto", "ffffff", "none", "clear"}
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
MOST_BYTES = 50 * 1024 * 1024


def _value(node, name: str) -> str:
    child = node.find(f"{W}{name}") if node is not None else None
    return child.get(f"{W}val", "") if child is not None else ""


def marked(properties) -> bool:
    """Whether run properties mark an answer: highlight, a red colour or a fill."""
    if properties is None:
        return False
    shade = properties.find(f"{W}shd")
    fill = shade.get(f"{W}fill", "").lower() if shade is not None else ""
    return _value(properties, "highlight") not in ("", "none") or _value(properties, "color").upper() in REDS or (fill != "" and fill not in NO_FILL)


def numbering_formats(xml: bytes | None) -> dict[tuple[str, str], str]:
    """(numId, level) to number format: numbers refer to abstract definitions."""
    if not xml:
        return {}
    root = ElementTree.fromstring(xml)
    levels = {a.get(f"{W}abstractNumId"): {x.get(f"{W}ilvl"): _value(x, "numFmt") for x in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
    return {(n.get(f"{W}numId"), level): fmt for n in root.findall(f"{W}num") for level, fmt in levels.get(_value(n, "abstractNumId"), {}).items()}


def style_numbers(xml: bytes | None) -> dict[str, tuple[str, str]]:
    if not xml:
        return {}
    out = {}
    for style in ElementTree.fromstring(xml).findall(f"{W}style"):
        found = style.find(f"{W}pPr/{W}numPr")
        if found is not None:
            out[style.get(f"{W}styleId")] = (_value(found, "numId"), _value(found, "ilvl") or "0")
    return out


def read(data: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs (text, marked, style, num_format) and images (name, type, occurrence) in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = lambda name: z.read(name) if name in z.namelist() else None
        document, numbers, styles, rels = (part(f"word/{n}") for n in ("document.xml", "numbering.xml", "styles.xml", "_rels/document.xml.rels"))
    if document is None:
        return [], []
    formats, inherited = numbering_formats(numbers), style_numbers(styles)
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in ElementTree.fromstring(rels)} if rels else {}
    paragraphs, images, seen = [], [], {}
    for p in ElementTree.fromstring(document).iter(f"{W}p"):
        style = _value(p.find(f"{W}pPr"), "pStyle")
        own = p.find(f"{W}pPr/{W}numPr")
        num = (_value(own, "numId"), _value(own, "ilvl") or "0") if own is not None else inherited.get(style)
        lines, hits = [""], [False]
        for run in p.iter(f"{W}r"):
            hit = marked(run.find(f"{W}rPr"))
            for node in run.iter():
                if node.tag == f"{W}t":
                    lines[-1] += node.text or ""
                    hits[-1] |= hit and bool((node.text or "").strip())
                elif node.tag == f"{W}tab":
                    lines[-1] += " "
                elif node.tag == f"{W}br":
                    lines.append("")
                    hits.append(False)
                elif node.tag == f"{A}blip" and (target := targets.get(node.get(f"{R}embed"))):
                    kind = IMAGES.get(posixpath.splitext(target)[1].lower())
                    seen[target] = seen.get(target, 0) + 1
                    images.append({"name": target + (f"#{seen[target]}" if seen[target] > 1 else ""), "type": kind, "supported": kind is not None})
        for text, hit in zip(lines, hits, strict=True):
            if text.strip():
                paragraphs.append({"text": " ".join(text.split()), "marked": hit, "style": style, "num_format": formats.get(num, "") if num else ""})
    return paragraphs, images


def letter_options(paragraphs: list[dict]) -> list[str]:
    """Lines with the letters that numbering gives written out, and marks of answers as ticks."""
    out, run = [], 0
    for p in paragraphs:
        lettered = p["num_format"] in ("upperLetter", "lowerLetter")
        run = run + 1 if lettered else 0
        text = f"{'ABCDE'[run - 1]}. {p['text']}" if 0 < run <= 5 else p["text"]
        out.append(f"✓ {text}" if p["marked"] else text)
    return out


PARAGRAPHS = "path string, paragraph int, text string, marked boolean, style string, num_format string, error string"


def paragraphs(files: DataFrame) -> DataFrame:
    """A row for each paragraph of the DOCX files (path, content); a file that can't be read gives one row with an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows += [{"path": path, "paragraph": i, **p, "error": None} for i, p in enumerate(read(data.as_py())[0])]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows.append({"path": path, "paragraph": -1, "text": None, "marked": None, "style": None, "num_format": None, "error": str(e)})
            names = ["path", "paragraph", "text", "marked", "style", "num_format", "error"]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(each, PARAGRAPHS)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder up to 50 MiB, with their kind; of one name the first by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)
    name = F.element_at(F.split("path", "/"), -1)
    end = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(end == "pdf", "pdf").when(end == "docx", "docx").when(end.isin("png", "jpg", "jpeg", "webp"), "image").when(end.isin("md", "markdown"), "markdown").when(end == "csv", "csv").otherwise("text")
    named = files.withColumns({"name": name, "kind": kind})
    first = named.groupBy("name").agg(F.min("path").alias("path"))  # without contents
    return named.join(first.select("path"), "path", "left_semi")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    return spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def routing(images: Column, native: Column, answered: Column, structured: Column, chars: Column) -> Column:
    """How a DOCX is handled: hybrid, native, structuredFallback, textFallback or visionRecommended."""
    return F.when(images > 0, "hybrid").when((native >= 4) & (answered >= 1), "native").when(structured >= 4, "structuredFallback").when(chars >= 300, "textFallback").otherwise("visionRecommended")
