"""Secret scan: plain patterns, and probabilistic automata inferred from labelled credentials.

The automata come from ALERGIA: a prefix tree of the whole labelled strings is built, its states are
visited in breadth-first order and merged where the Hoeffding bound finds their ends and next
symbols (and those of all successors) compatible.  Characters are symbols of their own as long as
a format's strings often start with them, and fall into classes after that.  A candidate's score is
its log likelihood per symbol, its end included, under the best credential automaton less that
under the automaton of ordinary strings.

Every run of 16 or more credential characters is a candidate and is scored whole, unless base spans
cover it; one that only overlaps base spans may be added beside them.

Null texts are empty texts.  Repeated rows are scanned each on its own, extra columns ignored,
and an empty table gives an empty result.  Spans are in code points with exclusive ends.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import map_rows

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "grammar")

#: `[0-9a-f]{16,}` has the matches of HEX that are long enough, as a run starts where it is longest; it is quicker to search.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: `=` stands at the end only, as padding: what it assigns is a candidate of its own.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
#: Labelled rows of a table that a grammar is fitted on.
LABELLED_ROWS = 20_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, kinds as places in KINDS, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def symbol(c: str) -> str:
    """Symbols of the automata behind the frequent starts: digits and letters fall into classes, punctuation stands for itself."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "f":
        return "f"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "F"
    return "Z" if "G" <= c <= "Z" else c


#: Characters of each class; all of a class are equally likely.
CLASS_SIZES = {"0": 10, "f": 6, "z": 20, "F": 6, "Z": 20}


@dataclass
class _Node:
    ends: int = 0
    through: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    next: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton with smoothed transitions."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05, start_share: float = 0.1) -> None:
        """Starts that at least `start_share` of the strings have are kept literally."""
        self.alpha = alpha
        strings = list(strings)
        self.starts = self._frequent_starts(strings, max(2.0, start_share * len(strings)))
        nodes = [_Node()]
        for s in strings:
            at = 0
            nodes[0].through += 1
            for c in self.symbols(s):
                nodes[at].counts[c] = nodes[at].counts.get(c, 0) + 1
                if c not in nodes[at].next:
                    nodes[at].next[c] = len(nodes)
                    nodes.append(_Node())
                at = nodes[at].next[c]
                nodes[at].through += 1
            nodes[at].ends += 1
        self.nodes = nodes
        self._merge()
        self._table()

    @staticmethod
    def _frequent_starts(strings: list[str], least: float) -> set[str]:
        found: set[str] = set()
        level, n = strings, 0
        while level:
            n += 1
            counts = Counter(s[:n] for s in level if len(s) >= n)
            often = {x for x, k in counts.items() if k >= least}
            found |= often
            level = [s for s in level if s[:n] in often]
        return found

    def symbols(self, text: str) -> list[str]:
        n = 0
        while n < len(text) and text[: n + 1] in self.starts:
            n += 1
        # a literal is no class, also where both are one character
        return ["=" + c for c in text[:n]] + [symbol(c) for c in text[n:]]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            x, y = self.nodes[a], self.nodes[b]
            if self._differ(x.ends, x.through, y.ends, y.through):
                return False
            for c in {*x.counts, *y.counts}:
                if self._differ(x.counts.get(c, 0), x.through, y.counts.get(c, 0), y.through):
                    return False
                if c in x.next and c in y.next:
                    todo.append((x.next[c], y.next[c]))
        return True

    def _fold(self, into: int, node: int) -> None:
        """Adds the counts of a state and of the subtree below it, which is a tree still, to another state and its successors."""
        todo = [(into, node)]
        while todo:
            a, b = todo.pop()
            x, y = self.nodes[a], self.nodes[b]
            x.ends += y.ends
            x.through += y.through
            for c, n in y.counts.items():
                x.counts[c] = x.counts.get(c, 0) + n
            for c, t in y.next.items():
                if c in x.next:
                    todo.append((x.next[c], t))
                else:
                    x.next[c] = t

    def _merge(self) -> None:
        kept = [0]
        done = {0}
        edge = deque((0, c) for c in sorted(self.nodes[0].next))
        while edge:
            parent, c = edge.popleft()
            node = self.nodes[parent].next[c]
            if node in done:
                continue
            for other in kept:
                if self._compatible(other, node):
                    self.nodes[parent].next[c] = other
                    self._fold(other, node)
                    break
            else:
                kept.append(node)
                done.add(node)
                other = node
            # folding may hang new subtrees below any kept state
            edge.extend((s, d) for s in kept for d in sorted(self.nodes[s].next) if self.nodes[s].next[d] not in done and (s, d) not in edge)
        self.states = kept

    def _table(self) -> None:
        self.score: dict[tuple[int, str], tuple[float, int]] = {}
        self.miss: dict[int, float] = {}
        self.end: dict[int, float] = {}
        for s in self.states:
            n = self.nodes[s]
            total = sum(n.counts.values()) + n.ends + 1.0
            self.miss[s] = math.log(1.0 / total / 12)
            self.end[s] = math.log(n.ends / total) if n.ends else self.miss[s]
            for c, k in n.counts.items():
                self.score[s, c] = (math.log(k / total), n.next.get(c, 0))

    def log_likelihood(self, text: str) -> float:
        """Per symbol, with the end as one."""
        at, total = 0, 0.0
        for c in self.symbols(text):
            total -= math.log(CLASS_SIZES.get(c, 1))
            if (hit := self.score.get((at, c))) is None:
                total, at = total + self.miss[at], 0
            else:
                total, at = total + hit[0], hit[1]
        return (total + self.end[at]) / (len(text) + 1)


@dataclass
class SecretGrammar:
    formats: dict[str, Automaton]
    ordinary: Automaton
    margin: float = 0.9

    @classmethod
    def fit(cls, labelled: Iterable[tuple[str, str]], margin: float = 0.9) -> SecretGrammar:
        """labelled: (format, string); the format `ordinary` holds strings that are no credentials."""
        by: dict[str, list[str]] = {}
        for kind, s in labelled:
            by.setdefault(kind, []).append(s)
        ordinary = Automaton(by.pop("ordinary", []))
        return cls({k: Automaton(v) for k, v in sorted(by.items())}, ordinary, margin)

    def score(self, candidate: str) -> float:
        return max((a.log_likelihood(candidate) for a in self.formats.values()), default=-math.inf) - self.ordinary.log_likelihood(candidate)


def fit_grammar(labelled: DataFrame, format_column: str = "format", string_column: str = "string", margin: float = 0.9, rows: int = LABELLED_ROWS) -> SecretGrammar:
    """A grammar from a labelled table, of at most `rows` whole strings in the order of their hashes; rows with a null or an empty string are left out."""
    named = labelled.select(F.col(format_column).alias("f"), F.col(string_column).alias("s")).where("f IS NOT NULL AND s != ''")
    chosen = named.orderBy(F.xxhash64("f", "s"), "f", "s").limit(rows).collect()
    return SecretGrammar.fit(((r["f"], r["s"]) for r in chosen), margin)


def labelled_credentials(per_format: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled strings drawn from publicly documented credential formats, and ordinary strings of like length."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    upper, word, url_safe = string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"
    syllables = ["an", "be", "con", "der", "en", "for", "ge", "in", "la", "ment", "no", "on", "per", "re", "st", "tion", "un", "ver"]
    name = lambda n: "".join(r.choice(syllables) for _ in range(n))
    out = []
    for _ in range(per_format):
        out += [
            ("access_key", "AKIA" + pick(upper, 16)),
            ("forge_token", r.choice(["ghp_", "gho_", "ghs_"]) + pick(word, 36)),
            ("chat_token", r.choice(["xoxb-", "xoxp-"]) + pick(string.digits, 12) + "-" + pick(word, 24)),
            ("payment_key", r.choice(["sk_live_", "sk_test_"]) + pick(word, 24)),
            ("hex_digest", pick("0123456789abcdef", r.choice([32, 40, 64]))),
            ("web_token", "eyJ" + pick(url_safe, 30) + "." + "eyJ" + pick(url_safe, 40) + "." + pick(url_safe, 43)),
            ("base64_key", pick(word + "+/", 40)),
            ("ordinary", name(r.randint(4, 14))),
            ("ordinary", name(r.randint(4, 14)).capitalize() + r.choice(["", ".", "..."])),
            ("ordinary", name(r.randint(4, 14)).upper()),
            ("ordinary", r.choice("-_").join(name(r.randint(1, 3)).upper() for _ in range(r.randint(3, 6)))),
            ("ordinary", "".join(name(r.randint(1, 3)).capitalize() for _ in range(r.randint(3, 6)))),
            ("ordinary", "-".join(name(r.randint(1, 3)) for _ in range(r.randint(3, 6)))),
            ("ordinary", "_".join(name(r.randint(1, 3)) for _ in range(r.randint(3, 6)))),
            ("ordinary", "www." + name(3) + "." + r.choice(["com", "org", "net"]) + "/" + "/".join(name(2) for _ in range(3)) + r.choice(["", ".html", f"/{r.randint(1, 999)}"])),
            ("ordinary", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"),
            ("ordinary", ".".join(str(r.randint(0, 255)) for _ in range(4)) + f"/{r.randint(8, 30)}"),
            ("ordinary", pick(string.digits, r.randint(16, 20))),
            ("ordinary", r.choice("-=_.+") * r.randint(16, 60)),
        ]
    return out


@lru_cache(maxsize=4)
def default_grammar(per_format: int = 300, seed: int = 7) -> SecretGrammar:
    return SecretGrammar.fit(labelled_credentials(per_format, seed))


def scan(text: str | None, grammar: SecretGrammar | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the candidates that the grammar finds and base spans do not cover."""
    text = text or ""
    grammar = grammar or default_grammar()
    base = base_spans(text)
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    added = []
    for m in _CANDIDATE.finditer(text):
        value = m.group().rstrip(".-_") if m.group()[-1] in ".-_" else m.group()
        start, end = m.start(), m.start() + len(value)
        at = bisect_right(covered, start, key=lambda x: x[0]) - 1
        if len(value) < 16 or (at >= 0 and end <= covered[at][1]):
            continue
        if grammar.score(value) >= grammar.margin:
            added.append((start, 3, end))
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", grammar: SecretGrammar | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_grammar, base_sha256 and spans of every document: one scan, no shuffle."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        digests, joined = [], []
        for text in batch.column(text_column):
            base, spans = scan(text.as_py(), grammar)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in spans))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(spans))
        return pa.record_batch(
            [batch.column(id_column), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
            names=[id_column, "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"],
        )

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs.select(id_column, text_column), each, f"{id_column} {kind}, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_column: str = "text", grammar: SecretGrammar | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every found span replaced by a mark; null texts stay null."""
    names = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value in batch.column(text_column):
            text = value.as_py()
            if text:
                out, at = [], 0
                for s, _, e in scan(text, grammar)[1]:
                    if s >= at:
                        out += [text[at:s], mark]
                    at = max(at, e)
                text = "".join(out) + text[at:]
            texts.append(text)
        return pa.record_batch([pa.array(texts, pa.string()) if n == text_column else batch.column(n) for n in names], names=names)

    return map_rows(docs, each, docs.schema)
