"""Text functions as Column expressions: normal forms, keys, question numbers, cleaning and scores.

All stay inside the JVM.  Accents are folded by a translation table that is built from the Unicode
decompositions of the Latin blocks, as Spark has no normalisation function.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x01"
LETTERS = "ABCDE"

#: The named entities that stand for a character; any other becomes a space.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

#: Abbreviations and their long forms, in the order of their expansion.
ABBREVIATIONS = {
    "bn": "benh nhan",
    "tha": "tang huyet ap",
    "dtd": "dai thao duong",
    "gpb": "giai phau benh",
    "ux": "u xo",
    "ct": "cat lop vi tinh",
    "cx": "co tu cung",
    "mri": "cong huong tu",
    "vq": "vong kinh",
    "stis": "benh lay truyen qua duong tinh duc",
}

#: Phrases without weight, in the order of their removal.
STOP_PHRASES = [
    "nao sau day la",
    "nao sau day",
    "sau day",
    "hay chon",
    "chon phat bieu",
    "phat bieu nao",
    "trieu chung nao",
    "dau hieu nao",
    "cau hoi nao",
    "cau hoi",
    "phat bieu",
    "cau nao",
    "cau",
    "la",
    "ve",
]


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters; combining marks come last and vanish in translate()."""
    source, target = ["đ", "Đ"], ["d", "d"]
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
                source.append(chr(code))
                target.append(parts[0])
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


def fold_accents(text: Column) -> Column:
    return F.translate(text, *accent_table())


def squeeze(text: Column) -> Column:
    """Single spaces for runs of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _decoded(text: Column, matches: str, prefix: str, code) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(matches), F.lit(1)))
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, F.concat(F.lit(prefix), m, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(code(m)), 4, "0")), "UTF-16BE")))


def decode_entities(text: Column) -> Column:
    """Numeric entities of the basic plane and the named ones; other names become a space."""
    out = _decoded(text, "&#([0-9]{1,5});", "&#", lambda m: m.cast("long"))
    out = _decoded(out, "&#x([0-9A-Fa-f]{1,4});", "&#x", lambda m: F.conv(m, 16, 10).cast("long"))
    for name, char in ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", char)
    out = F.regexp_replace(out, "(?i)&(?!amp;)[a-z]+;", " ")
    return F.regexp_replace(out, "(?i)&amp;", "&")


def normalize_field(text: Column) -> Column:
    """The comparison form of a question or option: no markup, brackets, accents, labels or punctuation, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(decode_entities(F.coalesce(text, F.lit(""))), "<[^>]*>", " "), r"\[[^\]]*?\]", " ")
    low = F.lower(fold_accents(plain))
    low = F.regexp_replace(low, r"(?:^|\s)(?:cau|question|bai)\s*(?:so\s*)?\d+\s*[.:)\]-]?\s*", " ")
    low = F.regexp_replace(low, r"^\s*(?:\(?[a-e]\)?|[0-9]{1,2})\s*[.:)\]-]\s*", "")
    return squeeze(F.regexp_replace(low, r"(?U)[^\p{L}\p{N}\s]", " "))


def semantic_field(text: Column) -> Column:
    """The normal form with abbreviations written out and phrases without weight removed, each in order."""
    out = reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), normalize_field(text))
    return squeeze(reduce(lambda c, phrase: F.regexp_replace(c, rf"\b{phrase}\b", " "), STOP_PHRASES, out))


def tokens(text: Column) -> Column:
    """Tokens of two characters at least of the normal form."""
    return F.filter(F.split(normalize_field(text), " "), lambda t: F.length(t) > 1)


def five_options(options: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(F.get(options, i), F.lit("")))


def fingerprint(question: Column, options: Column) -> Column:
    return F.array_join(F.concat(F.array(normalize_field(question)), F.transform(five_options(options), normalize_field)), "|")


def options_fingerprint(options: Column) -> Column:
    return F.array_join(F.transform(five_options(options), normalize_field), "|")


def identity_key(question: Column, options: Column, answer: Column, source: Column) -> Column:
    """What makes two visible records the same: text in lower case and single spaces, joined by a control character."""
    low = lambda c: F.lower(squeeze(F.coalesce(c, F.lit(""))))
    return F.array_join(F.concat(F.array(low(question)), F.transform(F.coalesce(options, F.array()), low), F.array(low(answer), low(source))), SEPARATOR)


def normalize_answer(answer: Column) -> Column:
    letter = F.lower(F.regexp_extract(F.trim(F.coalesce(answer, F.lit(""))), "(?i)^[A-E]", 0))
    return F.when(letter != "", letter).otherwise(normalize_field(answer))


def answers_conflict(a: Column, b: Column) -> Column:
    x, y = normalize_answer(a), normalize_answer(b)
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (x != "") & (y != "") & (x != y)


# --- similarity


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice over trigram sets; edit distance where a side has none."""
    x, y = trigrams(a), trigrams(b)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 3) | (F.length(b) < 3), levenshtein_ratio(a, b)).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def _joined(array: Column) -> Column:
    return F.array_join(F.array_sort(array), " ")


def _guarded(x: Column, y: Column, ratio: Column) -> Column:
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(none, F.when(F.size(x) == F.size(y), 1.0).otherwise(0.0)).otherwise(ratio)


def sort_ratio_of(x: Column, y: Column) -> Column:
    """Token-sort ratio of two token arrays, best made once for each record."""
    return _guarded(x, y, levenshtein_ratio(_joined(x), _joined(y)))


def set_ratio_of(x: Column, y: Column) -> Column:
    """Token-set ratio of two arrays of distinct tokens."""
    common = F.array_intersect(x, y)
    within = (F.size(common) == F.size(x)) | (F.size(common) == F.size(y))
    c, p, q = _joined(common), _joined(x), _joined(y)
    best = F.greatest(levenshtein_ratio(p, q), levenshtein_ratio(c, p), levenshtein_ratio(c, q))
    return _guarded(x, y, F.when(F.size(common) == 0, 0.0).when(within, 1.0).otherwise(best))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return sort_ratio_of(tokens(a), tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    return set_ratio_of(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def token_ratio(a: Column, b: Column) -> Column:
    return F.greatest(token_sort_ratio(a, b), token_set_ratio(a, b))


# --- profiles

#: Patterns on the normal form.
EXCEPTION = r"\bngoai\s+tru\b|\bexcept\b|\bleast\s+likely\b|\bit\s+co\s+kha\s+nang\b"
CONTRAINDICATION = r"\bchong\s+chi\s+dinh\b|\bkhong\s+nen\b|\bkhong\s+duoc\b|\bkhong\s+duoc\s+dung\b|\bcan\s+tranh\b|\btranh\s+dung\b"
FALSE_CHOICE = r"\bkhong\s+(?:dung|chinh\s+xac|phu\s+hop|phai|thuoc|bao\s+gom|goi\s+y)\b|\bnot\s+(?:true|correct|appropriate|indicated|likely)\b|\bsai\b"
NEGATIVE = r"\bkhong\b|\bnot\b|\bnone\b|\bwithout\b"
#: Objectives in the order of their tests.
OBJECTIVES = [
    ("contraindication", r"\bchong\s+chi\s+dinh\b|\bkhong\s+nen\b|\bcontraindicat\b|\bavoid\b"),
    ("treatment", r"\bxu\s+tri\b|\bdieu\s+tri\b|\bthuoc\b|\bcan\s+lam\s+gi\b|\btreatment\b|\bmanagement\b|\bmanage\b|\bfirst\s+line\b"),
    ("investigation", r"\bxet\s+nghiem\b|\bcan\s+lam\s+sang\b|\bsieu\s+am\b|\bct\b|\bmri\b|\btest\b|\binvestigation\b|\bimaging\b"),
    ("complication", r"\bbien\s+chung\b|\bcomplication\b|\bcomplicate\b"),
    ("prognosis", r"\btien\s+luong\b|\bprognosis\b|\brisk\b|\byeu\s+to\s+nguy\s+co\b"),
    ("mechanism", r"\bco\s+che\b|\bnguyen\s+nhan\b|\bpathophysiology\b|\bmechanism\b|\bcause\b"),
    ("diagnosis", r"\bchan\s+doan\b|\bdiagnosis\b|\bdiagnose\b|\bbenh\s+nao\b"),
]


def intent_marker(normal: Column) -> Column:
    """Marker of a normalised question's intent: contraindication, exception, false, negative or none."""
    return (
        F.when(normal.rlike(CONTRAINDICATION), "contraindication").when(normal.rlike(EXCEPTION), "exception").when(normal.rlike(FALSE_CHOICE), "false").when(normal.rlike(NEGATIVE), "negative").otherwise("none")
    )


def intent_key(marker: Column) -> Column:
    return F.when(marker.isin("exception", "false"), "falseChoice").when(marker == "none", "normal").otherwise(marker)


def objective(semantic: Column) -> Column:
    out = F.lit("normal")
    for name, pattern in reversed(OBJECTIVES):
        out = F.when(semantic.rlike(pattern), name).otherwise(out)
    return out


# --- question numbers: several extractors that are not interchangeable


def _number(text: Column, pattern: str) -> Column:
    return F.expr("null").cast("int") if text is None else F.regexp_extract(text, pattern, 1).try_cast("int")


def dedupe_number(text: Column) -> Column:
    return F.coalesce(_number(text, r"(?iu)câu\s*(?:số\s*)?(\d+)"), _number(text, r"(?iu)question\s*(\d+)"), _number(text, r"^(\d+)\s*[.:)\]]"))


def sort_number(text: Column) -> Column:
    """A leading number, else the one after a question word, else the first; 999999 without any."""
    lead = _number(text, r"^\s*[\s*_\[\(<]*(\d+)\s*[.:)\-–—−]")
    word = _number(text, r"(?iu)(?:câu|question|bài|case)\s*(?:hỏi|số|thứ|no\.?)?\s*(\d+)")
    return F.coalesce(lead, word, _number(text, r"(\d+)"), F.lit(999999))


def leading_number(text: Column) -> Column:
    return _number(text, r"(?iu)^\s*(?:câu|cau|question|q)?\s*(\d{1,4})\s*[:.)-]?")


# --- cleaning and labels

#: Lines that learning platforms add.
PLATFORM_NOISE = [
    r"not\s+yet\s+answered",
    r"chưa\s+trả\s+lời",
    r"marked\s+out\s+of\s*\d+(?:[.,]\d+)?",
    r"đạt\s+điểm(?:\s+số)?\s*\d+(?:[.,]\d+)?",
    r"được\s+cho\s+điểm\s*\d+(?:[.,]\d+)?",
    r"flag\s+question",
    r"đánh\s+dấu\s+câu\s+hỏi",
    r"edit\s+question",
    r"chỉnh\s+sửa\s+câu\s+hỏi",
]


def strip_platform_noise(text: Column) -> Column:
    noise = "(?iu)" + "|".join(PLATFORM_NOISE)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, noise, "")))
    return F.trim(F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"[|\-*•●■\s]", "") != ""), "\n"))


def clean_option(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[A-Ea-e]\s*[:.)]\s*", ""))


def strip_control(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+\n", "\n"), r"\n{3,}", "\n\n"))


def match_text(text: Column) -> Column:
    """The form in which an option is held against the answer."""
    out = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^(\(?[A-Za-z0-9]{1,2}[.\s)\-:]+)\s*", "")
    return squeeze(F.regexp_replace(F.lower(out), r"[.,;:]+$", ""))


def option_is_correct(option: Column, answer: Column, index: Column) -> Column:
    letter = F.substring(F.lit(LETTERS.lower()), index + 1, F.lit(1))
    raw = F.lower(F.trim(answer))
    only = F.regexp_replace(raw, "[^a-z]", "")
    return (F.coalesce(answer, F.lit("")) != "") & ((match_text(option) == match_text(answer)) | (only == letter) | ((F.substring(raw, 1, 1) == letter) & raw.rlike(r"^[a-e](?:$|[.)\-:\s])")))


def correct_index(options: Column, answer: Column) -> Column:
    """Place (from 0) of the first option that the answer names; -1 without one."""
    hits = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, i: option_is_correct(o, answer, i))
    return (F.array_position(hits, True) - 1).cast("int")


def correct_letter(options: Column, answer: Column, default: Column) -> Column:
    i = correct_index(options, answer)
    return F.when(i >= 0, F.chr(i + 65)).otherwise(default)


def source_label(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != ""), " | ")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("Trang "), start)).otherwise(F.concat(F.lit("Trang "), start, F.lit("-"), end))


def snippet(text: Column, size: int = 220) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]\n]{0,180}\]\s*", " "), r"(?i)<<<MCQ\s+\d+>>>", " ")
    out = squeeze(out)
    return F.when(F.length(out) > size, F.concat(F.trim(F.substring(out, 1, size)), F.lit("..."))).otherwise(out)


def download_name(name: Column, default: str = "export") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", default).otherwise(out)


def strange_ratio(text: Column) -> Column:
    """Share of characters that are no letters, digits or usual punctuation; 1 for a blank text."""
    compact = F.regexp_replace(text, r"(?U)\s++", "")  # whole runs at once
    usual = r"""[\p{L}\p{N}.,;:!?()\[\]{}'"%+\-=/<>°–—_`~^&|#@*$✓✔☑✅]++"""
    return F.when(compact == "", 1.0).otherwise(F.length(F.regexp_replace(compact, usual, "")) / F.length(compact))


def text_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.6).cast("long")


def output_tokens(questions: Column) -> Column:
    return F.ceil(F.greatest(questions, F.lit(1)) * 1100 * F.lit(1.15)).cast("long")
