"""Batches from plan to result: parts, sizes, coverage, recovery, shared cases, sessions and caches."""

from __future__ import annotations

import json
import re
import unicodedata
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions import text as T
from stemforge.operators.windows import text_windows

#: Fixed values of the planner.
QUESTION_CAP = 5
TOKENS_PER_QUESTION = 1100
CACHE_TTL_MS = 2 * 60 * 60 * 1000
CACHE_LEAST_TOKENS = 2000
MOST_RETRY_DELAY_MS = 60_000


# --- sizes


def question_batch(output_budget: int, most: int, adaptive: bool = True, runtime_cap: int | None = None) -> int:
    """Questions of a batch by a model's output budget."""
    if not adaptive:
        return QUESTION_CAP
    budget = max(1, output_budget // -(-TOKENS_PER_QUESTION * 115 // 100))
    return max(1, min(runtime_cap or most, most, budget))


def structured_batch(output_budget: int, most: int, adaptive: bool = True) -> int:
    return min(question_batch(output_budget, most, adaptive), QUESTION_CAP)


def text_budget(input_limit: int, adaptive: bool = True) -> int:
    return max(15_000, min(22_000, int(input_limit * 0.08 * 3.6))) if adaptive else 15_000


def vision_pages(wanted: int, adaptive: bool = True) -> int:
    return max(2, min(4, wanted)) if adaptive else 2


# --- parts


def text_parts(files: DataFrame, budget: int = 15_000, overlap: int = 1_000) -> DataFrame:
    """Parts of plain texts (file_id, name, text): overlapping windows with a label each; a short text is one part under its name."""
    d = files.select("file_id", "name", "text", F.length("text").alias("__n"))
    w = text_windows(d, "__n", budget, overlap)
    final = F.max("part").over(Window.partitionBy("file_id")) == F.col("part")
    w = w.withColumn("__last", final & (F.col("part") > 0))
    label = F.when(F.col("__n") <= budget, F.col("name")).otherwise(T.source_label(F.col("name"), F.concat(F.lit("Phần "), F.when(F.col("__last"), F.lit("cuối")).otherwise((F.col("part") + 1).cast("string")))))
    return w.select("file_id", (F.col("part") + 1).alias("part"), label.alias("source_label"), F.expr("substring(text, start + 1, end - start)").alias("text"), F.lit("text").alias("mode"))


def trusted_source(records: DataFrame, parts: DataFrame) -> DataFrame:
    """Records (part, ...) with their part's label as source and its trace: file, label, number, snippet."""
    label = F.coalesce(F.nullif(F.trim("source_label"), F.lit("")), F.lit("Nguồn không xác định"))
    p = parts.select("part", label.alias("__label"), "file_id", "mode")
    number = F.when(F.col("number") > 0, F.col("number"))
    trace = F.struct(F.col("file_id").alias("file_id"), F.col("__label").alias("source_label"), F.col("mode").alias("mode"), number.alias("question_number"), T.snippet(F.col("question")).alias("snippet"))
    return records.join(p, "part", "left").withColumn("source", F.col("__label")).withColumn("trace", trace).drop("__label", "file_id", "mode")


# --- coverage and recovery


def coverage_status(mode: Column, covered: Column, numbers: Column, expected: Column, confidence: Column, expected_numbers: Column, verifier: Column) -> Column:
    """complete, missing, unverified or notApplicable for a vision part.

    Local evidence of medium confidence or better decides; else a verifier (expected, confidence,
    tail_complete, missing_likely, numbers) does.
    """
    lacks = lambda wanted: F.size(F.array_except(F.coalesce(wanted, F.array().cast("array<int>")), numbers)) > 0
    local = (F.coalesce(expected, F.lit(0)) > 0) & confidence.isin("medium", "high", "exact")
    seen = F.coalesce(verifier["expected"], F.lit(0))
    short = (covered < seen) | lacks(verifier["numbers"])
    sure = (verifier["confidence"] == "high") & F.coalesce(verifier["tail_complete"], F.lit(False)) & ~F.coalesce(verifier["missing_likely"], F.lit(False)) & ~short
    checked = F.when(sure, "complete").when(F.coalesce(verifier["missing_likely"], F.lit(False)) | short, "missing").otherwise("unverified")
    return F.when(mode != "pdfVision", "notApplicable").when(local, F.when((covered >= expected) & ~lacks(expected_numbers), "complete").otherwise("missing")).when(seen > 0, checked).otherwise("unverified")


def recovery_policy(main_only: Column, structured: Column, mode: Column, confidence: Column, options: Column, suspect: Column) -> Column:
    """evidence, requests and allow_empty for what a part may still cost."""
    strong, medium = structured, (mode == "pdfVision") & (confidence.isin("medium", "high") | ((options >= 3) & ~suspect))
    evidence = F.when(main_only, "weak").when(strong, "strong").when(medium, "medium").otherwise("weak")
    return F.struct(evidence.alias("evidence"), F.when(evidence == "strong", 3).when(evidence == "medium", 1).otherwise(0).alias("requests"), (evidence == "weak").alias("allow_empty"))


def recovery_words(text: str | None) -> set[str]:
    s = unicodedata.normalize("NFD", text or "")
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    s = re.sub(r"^(?:cau|question|q)?\s*\d+\s*[:.)-]?\s*", "", s)
    return {w for w in re.sub(r"[^a-z0-9\s]", " ", s).split() if len(w) > 2}


def overlap(a: str | None, b: str | None) -> float:
    x, y = recovery_words(a), recovery_words(b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def leading_number(text: str | None) -> int | None:
    m = re.match(r"\s*(?:c[âa]u|question|q)?\s*(\d{1,4})\s*[:.)-]?", text or "", re.I)
    return int(m[1]) if m else None


def unrecovered_blocks(blocks: list[str], salvaged: list[str], size: int = 2, least: float = 0.55) -> list[list[str]]:
    """Blocks that no salvaged question came from, in chunks: each question takes its best free block.

    With too few matches all blocks are asked for again, or those after as many as were salvaged if these
    are half of all.
    """
    if len(blocks) < 2 or not salvaged:
        return []
    heads = [re.sub(r"^question\s*:\s*", "", next((x for x in b.split("\n") if re.match(r"\s*question\s*:", x, re.I)), b).strip(), flags=re.I) for b in blocks]
    taken: set[int] = set()
    for q in salvaged:
        number = leading_number(q)
        scored = [(max(float(number is not None and number == leading_number(h)), overlap(q, h)), -i) for i, h in enumerate(heads) if i not in taken]
        best = max(scored, default=(0.0, 0))
        if best[0] >= least:
            taken.add(-best[1])
    if len(taken) < max(1, int(len(salvaged) * 0.6)):
        left = blocks[len(salvaged) :] if -(-len(blocks) // 2) <= len(salvaged) < len(blocks) else blocks
    else:
        left = [b for i, b in enumerate(blocks) if i not in taken]
    return [left[i : i + size] for i in range(0, len(left), size)]


# --- shared cases


def has_stem(question: str, stem: str) -> bool:
    """Whether a question already tells its case: by the stem's first 80 characters, or by most of its words."""
    flat = lambda s: " ".join(sorted(recovery_words(s)))
    if " ".join(stem.split())[:80].lower() in " ".join(question.split()).lower():
        return True
    share = overlap(question, stem)
    return share >= (0.70 if len(flat(question)) < len(flat(stem)) else 0.52) and len(recovery_words(question)) > 8


def with_case(question: str, stem: str) -> str:
    """The question under its case; wrappers that are there already are not doubled."""
    bare = re.sub(r"^\s*\[TÌNH HUỐNG\].*?\[CÂU HỎI\]\s*", "", question, flags=re.S | re.I).strip()
    return bare if has_stem(bare, stem) else f"[TÌNH HUỐNG] {stem}\n[CÂU HỎI] {bare}"


# --- errors


def retry_delay_ms(error: Any) -> int | None:
    """The delay that an error asks for: a field of its structure, else words of its message."""

    def amount(v: Any) -> int | None:
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0:
            return round(v * 1000)
        if isinstance(v, str) and (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*(ms|milliseconds?|s|sec(?:onds?)?|m|minutes?)?", v.strip(), re.I)):
            unit = (m[2] or "s").lower()
            scale = 1 if unit == "ms" or unit.startswith("milli") else 60_000 if unit.startswith("m") else 1000
            return round(float(m[1]) * scale) or None
        if isinstance(v, dict):
            ms = float(v.get("seconds") or v.get("sec") or 0) * 1000 + float(v.get("nanos") or v.get("nanoseconds") or 0) / 1e6
            return round(ms) or None
        return None

    def find(v: Any, depth: int = 0) -> int | None:
        if depth > 6:
            return None
        children = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, child in children:
            if str(k).lower() in ("retrydelay", "retry_delay", "retryafter", "retry_after") and (ms := amount(child)):
                return ms
            if ms := find(child, depth + 1):
                return ms
        return None

    text = error if isinstance(error, str) else str(error.get("message") or "") if isinstance(error, dict) else ""
    structure = error
    if isinstance(error, str) and "{" in error:
        try:
            structure = json.loads(error[error.index("{") : error.rindex("}") + 1])
        except ValueError:
            structure = None
    if ms := find(structure):
        return ms
    m = re.search(r"retry(?:ing)?(?:_delay|delay)?(?:\s+(?:in|after)\s+|[\"'\s:=]+)(\d+(?:\.\d+)?)\s*(ms|milliseconds?|s|sec(?:onds?)?|m|minutes?)\b", text, re.I)
    return amount(m[1] + m[2]) if m else None


# --- sessions, settings and caches


def merge_session(current: DataFrame | None, change: DataFrame) -> DataFrame:
    """The one row of a session with the fields that a change has set."""
    if current is None:
        return change
    c, p = current.alias("c"), change.alias("p")
    names = [*current.columns, *[n for n in change.columns if n not in current.columns]]
    pick = lambda n: F.coalesce(*[F.col(f"{t}.{n}") for t, d in (("p", change), ("c", current)) if n in d.columns]).alias(n)
    return c.join(F.broadcast(p), F.lit(True), "left").select(*[pick(n) for n in names])  # one row each


def resumable(sessions: DataFrame, fingerprint: str) -> DataFrame:
    """Sessions of these files that can go on; what ran is interrupted."""
    kept = sessions.where((F.col("files_fingerprint") == fingerprint) & F.col("status").isin("running", "paused", "interrupted"))
    return kept.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def live_cache(entries: DataFrame, now_ms: int) -> DataFrame:
    return entries.where(F.col("expires_at") > now_ms)


def cacheable(text: Column, failures: Column) -> Column:
    """Texts worth caching: of so many estimated tokens, until creation has failed twice."""
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) >= CACHE_LEAST_TOKENS) & (failures < 2)


def files_hash(files: DataFrame) -> DataFrame:
    """One hash over names and content hashes, in the order of the names."""
    pair = F.struct("name", F.concat_ws(":", "name", F.coalesce("content_hash", "content")).alias("x"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["x"]), "|"), 256).alias("files_fingerprint"))


#: Defaults of settings.
DEFAULTS: dict[str, Any] = {"provider": "google", "concurrency_limit": 1, "adaptive_batching": True, "batching_mode": "safe", "skip_analysis": True, "project_library": True, "main_batch_only_rescue": False, "vision_pages": 2, "auto_group_cases": True, "rpm_limiter": True, "rpm_limit": 30}


def normalize_settings(settings: dict[str, Any]) -> dict[str, Any]:
    """Stored settings with defaults for what is missing, known providers only, and a rate limit from 1 to 600."""
    out = {**DEFAULTS, **{k: v for k, v in settings.items() if v is not None}}
    if out["provider"] not in ("google", "shopaikey", "openrouter"):
        out["provider"] = DEFAULTS["provider"]
    try:
        out["rpm_limit"] = min(600, max(1, round(float(out["rpm_limit"]))))
    except (TypeError, ValueError):
        out["rpm_limit"] = DEFAULTS["rpm_limit"]
    return out
