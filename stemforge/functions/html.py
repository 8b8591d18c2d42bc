"""HTML as text expressions: what is unsafe goes, and what is left as plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go with all they hold, or alone where they hold nothing.
DROPPED = r"(?is)<(script|style|iframe|object|embed|link|meta)\b[^>]*>(.*?</(script|style|iframe|object|embed)\s*>)?"
HANDLERS = r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
#: Attributes whose value runs code, or is a page of its own.
UNSAFE_VALUE = r"""(?i)\s[\w:.-]+\s*=\s*("\s*(javascript:|data:text/html)[^"]*"|'\s*(javascript:|data:text/html)[^']*'|(javascript:|data:text/html)[^\s>]*)"""


def sanitize(html: Column) -> Column:
    """HTML without scripts, styles, frames, plug-ins, handlers, and values that begin with javascript: or data:text/html."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, ""), HANDLERS, ""), UNSAFE_VALUE, "")


def to_text(html: Column) -> Column:
    """Text without tags, scripts and styles, in single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
