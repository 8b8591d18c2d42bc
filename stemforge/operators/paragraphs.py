"""Questions out of DOCX paragraphs and PDF text lines: state machines as table functions.

Whether a paragraph ends a question depends on how many options that question has so far, and these on where it began; no
window says so.  Each machine is a Python table function that holds one open question.

* `ParagraphQuestions` reads a table of paragraphs, one document after the other in order:
  `paragraphs.asTable().partitionBy("doc_id").orderBy("ord")`, or `TABLE (paragraphs) PARTITION BY doc_id ORDER BY ord`.
  At least four options; list levels count as options and as ends.
* `PageQuestions` reads one text a call, by LATERAL.  At least two letters; text before the first heading counts only where
  nothing has a heading.

Null texts are empty; paragraphs without text count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from stemforge.operators.markdown import NUMBER_LABELS, answer_keys, key_answers

# How headings, options and answers are written.
HEADING = re.compile(r"(?:câu|cau|question|q)\s*\d+\s*[:.)-]", re.I)
BARE_HEADING = re.compile(r"(?:\d{1,3}|[IVX]{1,8})\s*[.)-]\s+\S", re.I)
OPTION = re.compile(r"\(?([A-E])\)?\s*[.:)-]\s*(.+)", re.I | re.S)
ANSWER = re.compile(r"(?:đáp\s*án|dap\s*an|answer|correct\s*answer|key)\s*(?:đúng|dung)?\s*[:：.\-]?\s*\(?([A-E])\b", re.I)
INLINE = re.compile(r"(?:^|[;|]|\s)\s*\(?([A-E])\)?\s*[.:)-]\s*", re.I)
TICKS = re.compile(r"^(?:[✓✔☑✅*•●■]\s*)+")
RUN_ON = re.compile(r"(?<=\S)[^\S\n]+(?=(?:Câu|Cau|Question|Q)\s*\d{1,4}\s*[:.)-])")

LETTERS = "ABCDE"
LEAST_PARAGRAPH_OPTIONS = 4
LEAST_PAGE_LETTERS = 2
#: A bare number begins a question only with a question mark or this many characters.
BARE_LENGTH = 18
#: Text without a heading is a question only from this length on.
ORPHAN_LENGTH = 30

PARAGRAPH_SCHEMA = "doc_id string, ordinal int, question string, options array<string>, answer string"
PAGE_SCHEMA = "ordinal int, headed boolean, question string, options array<string>, answer string"


def squeezed(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def options_in(text: str) -> list[tuple[str, str]]:
    """Two or more options of one paragraph, as (letter, text)."""
    marks = list(INLINE.finditer(text))
    if len(marks) < 2:
        return []
    ends = [m.start() for m in marks[1:]] + [len(text)]
    found = [(m[1].upper(), TICKS.sub("", text[m.end() : end].strip(" ;|\t\n"))) for m, end in zip(marks, ends, strict=True)]
    return [x for x in found if x[1]]


class _Open:
    """The open question: its lines, options as [letter, text, marked], and how it was headed."""

    def __init__(self, lines: list[str] | None = None, headed: bool = False) -> None:
        self.lines = lines or []
        self.options: list[list] = []
        self.headed = headed
        self.answer = ""

    def continued(self, text: str, marked: bool = False) -> None:
        if self.options:
            last = self.options[-1]
            last[1] = f"{last[1]} {text}"
            last[2] = last[2] or marked
        else:
            self.lines.append(text)

    def listed(self) -> list[str]:
        return [f"{letter}. {squeezed([text])}" for letter, text, _ in self.options]


@udtf(returnType=PARAGRAPH_SCHEMA)
class ParagraphQuestions:
    """Rows doc_id, ord, text, marked (boolean) and level (`letter`, another list level, or null) to questions."""

    def __init__(self) -> None:
        self.open = _Open()
        self.doc = None
        self.ordinal = 0

    def _closed(self) -> Iterator[tuple]:
        q, self.open = self.open, _Open()
        text = squeezed(q.lines)
        if text and len(q.options) >= LEAST_PARAGRAPH_OPTIONS:
            self.ordinal += 1
            marked = next((letter for letter, _, marked in q.options if marked), "")
            yield self.doc, self.ordinal, text, q.listed(), marked

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc = row["doc_id"]
        text = squeezed([row["text"] or ""])
        if not text:
            return
        marked, level = bool(row["marked"]), row["level"]
        one = OPTION.fullmatch(TICKS.sub("", text))
        several = options_in(text)
        n = len(self.open.options)
        if HEADING.match(text) or (not one and level is not None and n >= LEAST_PARAGRAPH_OPTIONS):
            yield from self._closed()
            self.open.lines.append(text)
        elif len(several) >= 2:
            if self.open.lines:
                if n + len(several) > len(LETTERS):
                    yield from self._closed()
                room = len(LETTERS) - len(self.open.options)
                self.open.options += [[letter, t, marked] for letter, t in several[:room]]
        elif n >= 2 and (told := ANSWER.match(text)):
            for option in self.open.options:
                option[2] = option[2] or option[0] == told[1].upper()
        elif one or (level == "letter" and self.open.lines and n < len(LETTERS)):
            if n >= len(LETTERS):
                yield from self._closed()
            if self.open.lines:
                self.open.options.append([one[1].upper(), TICKS.sub("", one[2]), marked or bool(TICKS.match(text))] if one else [LETTERS[n], text, marked])
        else:
            if n >= LEAST_PARAGRAPH_OPTIONS:
                yield from self._closed()
            self.open.continued(text, marked)

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


@udtf(returnType=PAGE_SCHEMA)
class PageQuestions:
    """The questions of one text, headed or not."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = [x for raw in RUN_ON.sub("\n", text or "").split("\n") if (x := " ".join(raw.split()))]
        now: _Open | None = None
        ordinal = 0
        for i, line in enumerate([*lines, None]):
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if line is None or self._begins(now, line, after):
                if now and now.lines and len({o[0] for o in now.options}) >= LEAST_PAGE_LETTERS:
                    ordinal += 1
                    yield ordinal, now.headed, squeezed(now.lines), now.listed(), now.answer
                now = _Open([line], headed=True) if line else None
                continue
            one, told = OPTION.fullmatch(line), ANSWER.match(line)
            if now is None:
                now = _Open([line], headed=self._bare(line))
            elif one:
                now.options.append([one[1].upper(), one[2], False])
            elif told and len(now.options) >= 2:
                now.answer = told[1].upper()
            else:
                now.continued(line)

    @staticmethod
    def _bare(line: str) -> bool:
        return bool(BARE_HEADING.match(line)) and ("?" in line or len(line) >= BARE_LENGTH)

    def _begins(self, now: _Open | None, line: str, after: str) -> bool:
        if HEADING.match(line):
            return True
        if now is None or OPTION.fullmatch(line):
            return False
        if len(now.options) >= 2:
            return bool(OPTION.fullmatch(after)) or self._bare(line)
        return not now.options and not now.headed and self._bare(line)


def paragraph_questions(paragraphs: DataFrame) -> DataFrame:
    """doc_id, ordinal, question, options and answer (by mark, else by a key anywhere in the document) from rows doc_id, ord, text, marked, level."""
    rows = paragraphs.select(F.col("doc_id").cast("string").alias("doc_id"), "ord", "text", "marked", "level")
    found = ParagraphQuestions(rows.asTable().partitionBy("doc_id").orderBy("ord"))
    lines = rows.select("doc_id", F.col("ord").alias("line_no"), F.trim(F.coalesce("text", F.lit(""))).alias("line"))
    keys = key_answers(answer_keys(lines))
    number = F.coalesce(*[F.nullif(F.regexp_extract("question", p, 1), F.lit("")) for p in NUMBER_LABELS]).cast("int")
    told = found.withColumn("number", number).join(keys, ["doc_id", "number"], "left")
    return told.select("doc_id", "ordinal", "number", "question", "options", F.coalesce(F.nullif(F.col("answer"), F.lit("")), "letter", F.lit("")).alias("answer"))


def page_questions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, ordinal, question, options and answer of every question of a text; those without a heading only where none has one, from ORPHAN_LENGTH on."""
    rows = docs.select(doc, F.col(text).alias("__text"))
    found = rows.lateralJoin(PageQuestions(F.col("__text").outer())).drop("__text")
    headed = F.max("headed").over(Window.partitionBy(doc))
    kept = found.withColumn("__any", headed).where(F.col("headed") | (~F.col("__any") & (F.length("question") >= ORPHAN_LENGTH)))
    ordinal = F.row_number().over(Window.partitionBy(doc).orderBy("ordinal"))
    return kept.withColumn("ordinal", ordinal).select(doc, "ordinal", "question", "options", "answer")
