"""Question blocks out of text: Markdown and plain text, PDF pages, shared cases, natural splits.

Line rules are small functions; documents are parsed one at a time in Arrow batches, as a document's
lines are few and their order decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.functions.types import BLOCKS, CASES

#: Documents whose parts leave a task together.
SPLIT_ROWS = 256

LABEL = re.compile(r"(?:#{1,6}\s+)?(?:c[âa]u\s*(?:h[ỏo]i|s[ốo])?|b[àa]i\s*t[ậa]p|question|case|q(?=\s*\d))\s*(\d+)\s*(?:[:.)-]|\b|$)", re.I)
NUMBERED = re.compile(r"\[?(\d{1,3})\]?\s*[.:)\-/]\s*(?=\S)")
OPTION = re.compile(r"(?:[-*+]\s+)?([✅✓✔]\s*)?(?:\(([A-Ea-e])\)|([A-Ea-e]))\s*[.:)-]\s*(.*)")
INLINE = re.compile(r"(?:^|\s)([✅✓✔*]\s*)?\(?([A-E])[.)]\s*")
ANSWER = re.compile(r"(?:>\s*)?(?:đáp\s*án(?:\s*đúng)?|dap\s*an(?:\s*dung)?|answer|correct\s*answer|key)\s*[:：.\-]?\s*\(?([A-Ea-e])\)?(?:\b|$)", re.I)
KEY_HEAD = re.compile(r"(?:bảng\s*)?(?:đáp\s*án|bang\s*dap\s*an|dap\s*an)\b|answer\s*key|answers?\b|key\b", re.I)
KEY_PAIR = re.compile(r"(?:^|[\s,;|]+)(?:c[âa]u|question|q)?\s*(\d{1,3})\s*[.:)\-]?\s*([A-Ea-e])(?=\b|$)", re.I)
CASE = re.compile(r"(?:t[ìi]nh\s*hu[ốo]ng(?:\s*l[âa]m\s*s[àa]ng)?|d[ữu]\s*ki[ệe]n|b[ệe]nh\s*c[ảa]nh|(?:clinical\s+)?vignette|case|item\s*set)[^\n\d]{0,60}?(?:c[âa]u|questions?|items?|q)\s*(\d{1,4})\s*(?:-|–|—|đến|den|tới|toi|to|through|và|va|and|&)\s*(?:c[âa]u\s*)?(\d{1,4})\s*[:.)-]*", re.I)


def plain(line: str) -> str:
    """A line without Markdown marks; whole-line bold keeps its text."""
    s = re.sub(r"^\s*(?:#{1,6}\s+|>\s+)", "", line).strip()
    return re.sub(r"(\*\*|__)(.+?)\1", r"\2", s).strip()


@dataclass
class Block:
    number: int | None
    question: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    answer: str = ""

    def row(self, ordinal: int) -> tuple:
        letters = sorted(self.options)
        return ordinal, self.number, " ".join(" ".join(self.question).split()), [f"{c}. {self.options[c]}" for c in letters], self.answer


def option_of(line: str) -> tuple[str, str, bool] | None:
    """Letter, text and mark of an option line."""
    m = OPTION.match(line.strip()) or OPTION.match(plain(line))
    if not m or not m[4].strip():
        return None
    text = m[4].strip()
    bold = bool(re.fullmatch(r"(\*\*|__).+\1", text)) or bool(re.match(r"[-*+]?\s*\*\*[A-Ea-e][.)]", line.strip()))
    return (m[2] or m[3]).upper(), re.sub(r"^[✅✓✔]\s*|\s*[✅✓✔]$", "", plain(text)), bool(m[1]) or bold or text[0] in "✅✓✔" or text[-1] in "✅✓✔"


def inline_options(line: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """What stands before the first of several options on one line, and the options, letters in order from A."""
    marks = list(INLINE.finditer(line))
    letters = [m[2] for m in marks]
    if len(marks) < 2 or letters != list("ABCDE"[: len(marks)]):
        return line, []
    ends = [m.start() for m in marks[1:]] + [len(line)]
    return line[: marks[0].start()].strip(), [(m[2], line[m.end() : e].strip(" ;|\t"), bool(m[1])) for m, e in zip(marks, ends, strict=True)]


def key_pairs(line: str) -> dict[int, str]:
    """Numbers and letters of an answer key; the last letter of a number counts."""
    return {int(n): c.upper() for n, c in KEY_PAIR.findall(line)}


def is_key_line(line: str) -> bool:
    if ANSWER.match(line):
        return True
    pairs = key_pairs(line)
    return bool(pairs) and len(KEY_PAIR.sub("", line).strip(" ,;|")) < 15 and not re.search(r"[^\W\d_]{3,}", KEY_PAIR.sub("", line))


def options_follow(lines: list[str], start: int, ahead: int = 8) -> bool:
    seen: set[str] = set()
    for line in lines[start : start + ahead]:
        one = option_of(line)
        seen |= {one[0]} if one else {x[0] for x in inline_options(line)[1]}
        if len(seen) >= 2:
            return True
    return False


def is_boundary(lines: list[str], i: int) -> bool:
    line = plain(lines[i])
    if not line or is_key_line(line) or option_of(line):
        return False
    if LABEL.match(line) or LABEL.match(lines[i].strip()):
        return True
    return bool(NUMBERED.match(line)) and (options_follow(lines, i + 1) or bool(inline_options(line)[1]))


def trailing_key(lines: list[str]) -> tuple[dict[int, str], int]:
    """The answer key at the end, and the line where it begins."""
    found: dict[int, str] = {}
    start = len(lines)
    for i in range(len(lines) - 1, -1, -1):
        line = plain(lines[i])
        if not line:
            continue
        pairs = key_pairs(line)
        if pairs and is_key_line(line) and not ANSWER.match(line):
            found, start = {**pairs, **found}, i
        elif KEY_HEAD.match(line) and (found or pairs) and not ANSWER.match(line):
            return {**pairs, **found}, i
        else:
            break
    return found, start


def parse_text(text: str | None, least_options: int = 2) -> list[tuple]:
    """(ordinal, number, question, options, answer) of every question with enough options.

    Without a label on the first line the text before the first boundary is a question as well.
    """
    lines = (text or "").replace("\r\n", "\n").split("\n")
    key, end = trailing_key(lines)
    lines = lines[:end]
    blocks: list[Block] = []
    for i, raw in enumerate(lines):
        line = plain(raw)
        if not line:
            continue
        if is_boundary(lines, i) or not blocks:
            m = LABEL.match(line) or NUMBERED.match(line)
            blocks.append(Block(int(m[1]) if m else None))
            line = line[m.end() :].strip(" :.)-") if m else line
        b = blocks[-1]
        if (m := ANSWER.match(line)) and b.options:
            b.answer = m[1].upper()
            continue
        one = option_of(raw) if not (m and not line) else None
        before, several = inline_options(line)
        if several and not (one and len(several) < 2):
            if before:
                b.question.append(before)
            found = several
        elif one:
            found = [one]
        else:
            if b.options and line:
                last = max(b.options)
                b.options[last] = f"{b.options[last]} {line}"
            elif line:
                b.question.append(line)
            continue
        for letter, value, marked in found:
            b.options.setdefault(letter, value)
            if marked and not b.answer:
                b.answer = letter
    out = []
    for b in blocks:
        if len(b.options) >= least_options and b.question:
            b.answer = b.answer or key.get(b.number or -1, "") or key.get(len(out) + 1 if b.number is None else -1, "")
            out.append(b.row(len(out) + 1))
    return out


def structured(rows: list[tuple], kind: str = "MARKDOWN") -> str:
    """A batch text: a header with the count, then marked blocks."""
    body = [f"<<<MCQ {o}>>>\nQuestion: {q}\n" + "\n".join(options) + (f"\nAnswer: {a}" if a else "") for o, _, q, options, a in rows]
    return f"[{kind}_MCQ_COUNT: {len(rows)}]\n\n" + "\n\n".join(body) if rows else ""


def structured_count(text: str | None) -> int:
    m = re.match(r"\[(?:DOCX_NATIVE|PDF_TEXT|MARKDOWN)_(?:BATCH|MCQ)_COUNT:\s*(\d+)\]", text or "", re.I)
    return int(m[1]) if m else 0


def structured_blocks(text: str | None) -> list[str]:
    return [b.strip() for b in re.split(r"(?=<<<MCQ\s+\d+>>>)", text or "") if b.strip().startswith("<<<MCQ")]


def shared_cases(text: str | None) -> list[tuple[int, int, str]]:
    """start, end and stem of the cases that several questions share: from a header with their range to the first question."""
    out = []
    for m in CASE.finditer(text or ""):
        start, end = int(m[1]), int(m[2])
        rest = (text or "")[m.end() :]
        stop = re.search(r"(?:^|\n)\s*(?:c[âa]u|question|q)\s*\d+\s*[:.)-]", rest, re.I)
        stem = " ".join(rest[: stop.start() if stop else len(rest)].split())
        if start <= end and len(stem) >= 30:
            out.append((start, end, stem))
    return out


def split_naturally(text: str, parts: int = 2, least: int = 1) -> list[str]:
    """A text in parts of about equal length, cut at the nearest question, paragraph, line or sentence, never inside a shared case."""
    if parts < 2 or len(text) < 2 * least:
        return [text]
    protected = [(m.start(), m.end() + 400) for m in CASE.finditer(text)]
    tiers = [r"\n(?=\s*(?:c[âa]u|question|q)\s*\d+)", r"\n\s*(?=\d{1,3}[.)]\s)", r"\n\s*\n", r"\n", r"(?<=[.!?])\s", r"\s"]
    cuts, size = [0], len(text) / parts
    for k in range(1, parts):
        goal = round(k * size)
        best = goal
        for tier in tiers:
            places = [m.end() for m in re.finditer(tier, text, re.I) if abs(m.end() - goal) <= size / 3 and not any(a < m.end() < b for a, b in protected)]
            if places:
                best = min(places, key=lambda p: abs(p - goal))
                break
        cuts.append(max(best, cuts[-1]))
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


@F.pandas_udf(BLOCKS)
def blocks_udf(text: pd.Series) -> pd.Series:
    names = ("ordinal", "number", "question", "options", "answer")
    return pd.Series([[dict(zip(names, r, strict=True)) for r in parse_text(t)] for t in text])


@F.pandas_udf(CASES)
def cases_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "end", "stem"), r, strict=True)) for r in shared_cases(t)] for t in text])


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SPLIT_ROWS):
            ids, texts = batch.slice(start, SPLIT_ROWS).columns
            found = [(i, k, part) for i, text in enumerate(texts) for k, part in enumerate(split_naturally(text.as_py() or ""))]
            rows, places, parts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(parts, pa.string())], [batch.schema.names[0], "part", "text"])


def natural_parts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, part (from 0) and text of the parts of each document's text (null: empty); a task holds one batch of texts and the parts of SPLIT_ROWS of them."""
    schema = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, part int, text string"
    return docs.select(doc, text).mapInArrow(_split_batches, schema)


def questions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each question of a document."""
    return docs.select(doc, F.explode(blocks_udf(text)).alias("b")).select(doc, "b.*")
