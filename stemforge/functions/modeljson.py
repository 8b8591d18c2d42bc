"""Question records out of raw model text: finding, repairing and reading JSON, with aliases and defaults.

One scanner knows strings and brackets; extraction, repair, salvage and the truncation test all
stand on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.types import PARSED

LETTERS = "ABCDE"
MARK = re.compile(r"^[\s✓✔☑✅*•●■]+")
#: Names under which models give a field.
ALIASES = {
    "question": ["question", "stem", "prompt", "questionText", "text"],
    "options": ["options", "choices", "answers", "answerOptions"],
    "answer": ["correctAnswer", "answer", "correct_answer", "correctOption", "correct", "correctChoice"],
    "explanation": ["explanation", "rationale", "reason", "reasoning", "explain"],
    "number": ["questionNumber", "questionNo", "number", "no", "index"],
    "option_text": ["text", "content", "value", "option", "answer", "labelText"],
    "option_letter": ["letter", "key", "label", "id"],
    "answer_value": ["letter", "answer", "correctAnswer", "correct_answer", "value", "text"],
}


class ModelFormatError(ValueError):
    """The text holds no JSON that can be read or salvaged."""


def scan(text: str, start: int = 0) -> Iterator[tuple[int, str, list[str]]]:
    """(place, character, open brackets after it) of every bracket, comma and string end outside strings; the list of brackets goes on changing."""
    stack: list[str] = []
    quoted = escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
                yield i, '"', stack
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            yield i, c, stack
        elif c in "}]":
            if stack and stack[-1] == c:
                stack.pop()
            yield i, c, stack
            if not stack:
                return
        elif c == ",":
            yield i, c, stack


def balanced_end(text: str, start: int) -> int | None:
    """Place after the value that begins with a bracket at `start`; None if it does not end."""
    return next((i + 1 for i, c, stack in scan(text, start) if c in "}]" and not stack), None)


def close(text: str) -> str:
    """A value that breaks off, cut after its last whole element and closed."""
    best: int | None = None
    for i, c, stack in scan(text):
        if c in "}][{":
            best = i + 1
        elif c == "," and stack:
            best = i
    if best is None:
        return text
    stack = []
    for _, _, stack in scan(text[:best]):  # noqa: B007  the brackets that are open there
        pass
    return text[:best].rstrip().rstrip(",") + "".join(reversed(stack))


def tidy(text: str) -> str:
    """Commas before closing brackets, outside strings, removed."""
    drop: set[int] = set()
    last: tuple[int, str] | None = None
    for i, c, _ in scan(text):
        if c in "}]" and last and last[1] == "," and not text[last[0] + 1 : i].strip():
            drop.add(last[0])
        last = (i, c)
    return "".join(c for i, c in enumerate(text) if i not in drop) if drop else text


#: Objects nested deeper are no records.
DEEPEST = 40


class Span:
    """A whole object of a text: its places, how deep it is nested, and the whole objects in it."""

    __slots__ = ("start", "end", "height", "inner")

    def __init__(self, start: int) -> None:
        self.start, self.end, self.height, self.inner = start, -1, 1, []


def spans(text: str, start: int = 0, quoted: bool = False) -> list[Span]:
    """The outermost whole objects from `start` on, in one pass that keeps the places of open brackets.

    `quoted` says whether the first character lies in a string; after an odd quote the two readings change places.
    """
    found: list[Span] = []
    stack: list[tuple[str, Span | None, list[Span]]] = []
    escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            span = Span(i) if c == "{" else None
            stack.append(("}" if c == "{" else "]", span, span.inner if span else []))
        elif c in "}]" and stack and stack[-1][0] == c:
            _, span, inner = stack.pop()
            if span:
                span.end, span.height = i + 1, 1 + max((x.height for x in inner), default=0)
            (stack[-1][2] if stack else found).extend([span] if span else inner)
    for _, _, inner in stack:  # brackets that never close hold whole objects all the same
        found += inner
    return sorted(found, key=lambda x: x.start)


def extract(text: str) -> str:
    """The JSON value of a model's answer: what a code fence holds, else from the first bracket to its end, closed if it breaks off."""
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text or "", re.S | re.I)
    body = fence[1] if fence and re.search(r"[\[{]", fence[1]) else text or ""
    start = re.search(r"[\[{]", body)
    if not start:
        return body.strip()
    end = balanced_end(body, start.start())
    return body[start.start() : end] if end else close(body[start.start() :])


def truncated(text: str) -> bool:
    """Whether the list of questions does not end."""
    m = re.search(r'"questions"\s*:\s*\[', text or "")
    start = m.end() - 1 if m else (text or "").find("[")
    return start >= 0 and balanced_end(text, start) is None


def _read(text: str) -> Any:
    try:
        return json.loads(tidy(text))
    except (ValueError, RecursionError):
        return None


def salvage(text: str) -> list[dict]:
    """All whole objects inside the list of questions (or the text) that can be read and are complete.

    Objects are found in one pass for each reading of the quotes; one that cannot be read gives way to those inside it.
    """
    text = text or ""
    m = re.search(r'"questions"\s*:\s*\[', text)
    at = m.end() if m else 0
    taken: list[tuple[int, int, Any]] = []
    for quoted in (False, True):
        open_ = spans(text, at, quoted)[::-1]
        while open_:
            span = open_.pop()
            value = _read(text[span.start : span.end]) if span.height <= DEEPEST else None
            if isinstance(value, dict) and not isinstance(value.get("questions"), list):
                taken.append((span.start, span.end, value))
            else:
                open_ += span.inner[::-1]
    out, end = [], -1
    for start, stop, value in sorted(taken, key=lambda x: x[:2]):
        if start < end:
            continue
        end = stop
        record = coerce(value)
        if complete(record):
            out.append(record)
    return out


def alias(source: Any, name: str) -> Any:
    return next((source[k] for k in ALIASES[name] if source.get(k) is not None), None) if isinstance(source, dict) else None


def _labelled(letter: str, value: Any) -> str:
    text = " ".join(MARK.sub("", "" if value is None else str(value)).split())
    return text if not text or re.match(r"[A-Ea-e][\s.:)-]", text) else f"{letter}. {text}"


def _letter_of(option: Any) -> str | None:
    m = re.match(r"[A-Ea-e]", str(alias(option, "option_letter") or "").strip()) if isinstance(option, dict) else None
    if m:
        return m[0].upper()
    m = re.match(r"([A-Ea-e])[\s.:)-]", MARK.sub("", str(_text_of(option) or "").strip()))
    return m[1].upper() if m else None


def _text_of(option: Any) -> Any:
    if not isinstance(option, dict):
        return option
    found = alias(option, "option_text")
    return option if found is None else found


def read_options(value: Any) -> tuple[list[str], str | None]:
    """Labelled options in the order of their letters, and the letter of a marked one."""
    if isinstance(value, str):
        marks = list(re.finditer(r"(?:^|[\n\r;|]|\s)\s*([✓✔☑✅*•●■]?)\s*\(?([A-Ea-e])\)?[\s.:)-]+", value.strip()))
        if len(marks) < 2:
            return [], None
        text = value.strip()
        ends = [m.start() for m in marks[1:]] + [len(text)]
        found = [(m[2].upper(), _labelled(m[2].upper(), text[m.end() : e].strip(" ;|")), bool(m[1])) for m, e in zip(marks, ends, strict=True)]
    elif isinstance(value, dict):
        rank = lambda k: (LETTERS.find(k.strip().upper()) if k.strip().upper() in LETTERS and k.strip() else 99, k)
        items = sorted(((k, v) for k, v in value.items() if v is not None and str(v).strip()), key=lambda kv: rank(kv[0]))
        letter = lambda k, i: k.strip().upper() if len(k.strip()) == 1 and k.strip().upper() in LETTERS else LETTERS[i] if i < 5 else str(i + 1)
        found = [(letter(k, i), _labelled(letter(k, i), v), bool(MARK.match(str(v)))) for i, (k, v) in enumerate(items)]
    elif isinstance(value, list):
        items = [(_letter_of(o), o) for o in value]
        if sum(x is not None for x, _ in items) >= 2:
            items.sort(key=lambda x: LETTERS.index(x[0]) if x[0] else 99)
        found = []
        for i, (x, o) in enumerate(items):
            label = x or (LETTERS[i] if i < 5 else str(i + 1))
            found.append((label if x else None, _labelled(label, _text_of(o)), bool(MARK.match(str(_text_of(o) or "")))))
    else:
        return [], None
    return [t for _, t, _ in found if t], next((x for x, _, marked in found if marked), None)


def read_answer(value: Any, options: list[str]) -> str:
    """A letter where the answer names an option (numbers count from one first), else its text."""
    value = value[0] if isinstance(value, list) and value else value
    if isinstance(value, dict):
        value = alias(value, "answer_value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        i = int(value) - 1 if 1 <= value <= len(options) else int(value)
        if 0 <= i < min(len(options), 5):
            return LETTERS[i]
    text = "" if value is None or isinstance(value, list) else str(value).strip()
    if m := re.match(r"([A-Ea-e])(?:$|[\s.:)-])", text):
        return m[1].upper()
    bare = lambda s: " ".join(re.sub(r"^[A-Ea-e][\s.:)-]+", "", s).split()).lower()
    return next((LETTERS[i] for i, o in enumerate(options[:5]) if text and bare(o) == bare(text)), text)


def without_options(question: str, options: list[str]) -> str:
    """The question without options that were appended to it in order."""
    bare = [re.sub(r"^[A-Ea-e][.\-)]?\s*", "", o).strip() for o in options]
    if len(bare) < 2 or not all(bare):
        return question
    at, first = 0, -1
    for o in bare:
        at = question.find(o, at)
        if at < 0:
            return question
        first = at if first < 0 else first
        at += len(o)
    if len(question) - at > 50:
        return question
    head = re.sub(r"(?:^|\s)[A-Ea-e][.\-)]\s*$", "", question[:first]).strip()
    return head if len(head) > 3 else question


_PREFIX = re.compile(r"^[\s*_\[(<]*(?:c[âa]u(?:\s*(?:h[ỏo]i|s[ốo]|th[ứu]))?|question(?:\s*no\.?)?|q|case|b[àa]i(?:\s*t[ậa]p)?)\s*(\d{1,4})(?:\.\d+)?[a-z]?\s*[:.)\-–—]?\s*", re.I)


def coerce(value: Any) -> dict:
    """A record from a model's object: aliases resolved, labels set, defaults filled in."""
    value = value if isinstance(value, dict) else {}
    question = str(alias(value, "question") or "").strip()
    m = _PREFIX.match(question)
    try:
        number = int(float(alias(value, "number")))
    except (TypeError, ValueError, OverflowError):
        number = int(m[1]) if m else None
    options, marked = read_options(alias(value, "options"))
    stem = question[m.end() :].strip() or question if m else question
    explanation = alias(value, "explanation")
    parts = explanation if isinstance(explanation, dict) else {"core": explanation if isinstance(explanation, str) else ""}
    text = lambda name, default="": value[name] if isinstance(value.get(name), str) else default
    return {
        "question": without_options(stem, options), "options": options, "answer": marked or read_answer(alias(value, "answer"), options), "number": number if number and number > 0 else None,
        "explanation": {k: parts.get(k) if isinstance(parts.get(k), str) else "" for k in ("core", "evidence", "analysis", "warning")},
        "source": text("source"), "difficulty": text("difficulty", "Medium"), "depth": text("depthAnalysis"),
    }


_TASKS = None


def complete(record: dict) -> bool:
    global _TASKS
    if _TASKS is None:
        from stemforge.operators.records import TASK_VERBS

        _TASKS = re.compile(rf"[A-E][\s.:)-]+\s*(?:{TASK_VERBS})", re.I)
    options = record["options"]
    tasks = sum(bool(_TASKS.match(o.strip())) for o in options)
    return bool(record["question"].strip() and len(options) >= 2 and record["answer"].strip() and tasks < (len(options) + 1) // 2)


def parse(text: str | None, expected: int = 0, allow_empty: bool = False) -> dict:
    """questions, salvaged, missing and error of a model's answer."""
    text = text or ""
    out: dict[str, Any] = {"questions": [], "salvaged": False, "missing": 0, "error": None}
    try:
        value = json.loads(tidy(extract(text)))
        found = value.get("questions") if isinstance(value, dict) else value
        out["questions"] = [r for r in map(coerce, found) if complete(r)] if isinstance(found, list) else []
    except ValueError:
        out["questions"] = salvage(text)
        out["salvaged"] = bool(out["questions"])
        if not out["questions"]:
            out["error"] = "format"
    if truncated(text) and out["questions"]:
        out["salvaged"] = True
    if not out["questions"] and not out["error"] and not allow_empty:
        out["error"] = "empty"
    out["missing"] = max(0, expected - len(out["questions"]))
    return out


@F.pandas_udf(PARSED)
def parse_udf(text: pd.Series, expected: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t, int(e or 0)) for t, e in zip(text, expected.fillna(0), strict=True)], columns=["questions", "salvaged", "missing", "error"])


def parse_responses(responses: DataFrame, text: str = "text", expected: Column | None = None) -> DataFrame:
    """The responses with questions, salvaged, missing and error."""
    return responses.withColumn("__p", parse_udf(text, expected if expected is not None else F.lit(0))).select(*responses.columns, "__p.*")


def response_text(body: Column) -> Column:
    """The text of a provider's response body, whichever shape it has."""
    paths = ["$.choices[0].message.content", "$.output_text", "$.output[0].content[0].text", "$.content[0].text", "$.candidates[0].content.parts[0].text", "$.text"]
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def response_truncated(body: Column) -> Column:
    reason = F.lower(F.coalesce(*[F.get_json_object(body, p) for p in ("$.choices[0].finish_reason", "$.incomplete_details.reason", "$.stop_reason", "$.candidates[0].finishReason")], F.lit("")))
    return reason.isin("length", "max_tokens", "max_output_tokens")
