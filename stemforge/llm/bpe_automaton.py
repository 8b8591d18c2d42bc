"""BPE encoding by a deterministic tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that byte-pair encoding makes.  It
starts as one universal state over the base symbols; every merge (u, v), in rank order, is a
gadget: with q the state that all u-arcs enter, u-arcs are redirected to a copy of q without its
v-arc, and every state with a u-arc gets a uv-arc to the old target of v.  All arcs of one label
enter one state, so a state is named by the label that enters it, and the merge ranks say when a
state was split off and when an arc came or went.  `arc` answers from these gadgets whether a state
has an arc; answers are kept in a table, so that only the part of the automaton that texts visit is
ever laid out (the whole one has some 10^9 arcs).

Encoding follows the arcs that spell a pre-split word, the longest first; as exactly one path spells
the whole word, the first that is found is the encoding.  Decoding emits arc labels.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stemforge.llm.common import map_rows

#: Unicode White_Space, which is what \s means to the vocabulary's normaliser and splitter.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space to str.split() that is none above.
_ODD = regex.compile("[\x1c-\x1f]")
_RUNS = regex.compile(f"[^{_WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


#: Keys, beside the characters, of a tree's node: the label that ends there inside a word, and at a word's end.
_INNER, _LAST = 0, 1


class TokenizationAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = "") -> None:
        self.vocabulary = vocabulary
        self.word_end = word_end
        ids = vocabulary
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(merges, 1):
            self.rank[ids[u], ids[v]] = rank
            made = ids[u + v]
            if made in self.born:
                raise ValueError(f"two merges make {u + v!r}: the gadgets need one")
            self.born[made] = rank
            self.parts[made] = (ids[u], ids[v])
        self._tree: dict = {}
        for token, label in ids.items():
            ends = word_end != "" and token.endswith(word_end)
            symbols = token[: len(token) - len(word_end)] if ends else token
            if label not in self.parts and len(symbols) != 1:
                continue  # no base symbol, and no merge makes it
            node = self._tree
            for c in symbols:
                node = node.setdefault(c, {})
            node[_LAST if ends else _INNER] = label
        self._arcs: dict[tuple[int, int], bool] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether the finished automaton has an arc with this label from the state that labels `state` enter."""
        hit = self._arcs.get((state, label))
        if hit is None:
            if len(self._arcs) > 2_000_000:
                self._arcs.clear()
            hit = self._arcs[state, label] = self._arc(state, label, len(self.rank) + 2)
        return hit

    def _arc(self, state: int, label: int, before: int) -> bool:
        """The same when the merges of rank below `before` have been applied."""
        cut = self.rank.get((state, label))
        if cut is not None and cut < before:
            return False
        came, split = self.born.get(label, 0), self.born.get(state, 0)
        if came >= before:
            return False
        if came and came >= split:  # the gadget of the label found an arc of its first half here, or did not
            first = self.parts[label][0]
            now = self.rank.get((state, first))
            if came > split and now is not None and now == came:
                return False  # u = v: the copy has lost that very arc
            return self._arc(state, first, came)
        if split:  # the state is what its second half led to when its own merge came
            return self._arc(self.parts[state][1], label, split)
        return True

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, written in the vocabulary's characters and without the word-end mark."""
        n = len(word)
        if not n:
            return []
        arcs, arc, tree = self._arcs, self.arc, self._tree
        last = _LAST if self.word_end else _INNER
        path: list[int] = []
        ends: list[int] = []
        at, state = 0, -1
        open_arcs: list[tuple[int, list[tuple[int, int]]]] = []  # the states on the path, with the arcs not yet followed
        dead: set[tuple[int, int]] = set()
        while True:
            node, j, found = tree, at, []
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if (label := node.get(last if j == n else _INNER)) is not None:
                    found.append((j, label))
            open_arcs.append((state, found))
            while True:
                state, found = open_arcs[-1]
                while found:  # the longest first, which is mostly right
                    at, label = found.pop()
                    if (state < 0 or arcs.get((state, label)) or (state, label) not in arcs and arc(state, label)) and (at, label) not in dead:
                        break
                else:
                    open_arcs.pop()
                    if not open_arcs:
                        raise ValueError(f"no path for {word!r}")
                    dead.add((ends.pop(), path.pop()))
                    continue
                path.append(label)
                ends.append(at)
                break
            if at == n:
                return path
            state = label


class WordEncoder:
    """A vocabulary file: normalises, splits, and encodes words through the automaton, which it keeps in a bounded table."""

    def __init__(self, path: str, words_kept: int = 250_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.labels = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: t for t, i in self.special.items()})
        self.automaton = TokenizationAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self._split = regex.compile(split.replace(r"\s", _WHITE))
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self._symbols = byte_symbols()
        self.words_kept = words_kept
        self._words: dict[str, tuple[str, str, int]] = {}
        self._runs: dict[str, tuple[str, str, int]] = {}
        self._older: dict[str, tuple[str, str, int]] = {}  # the table before, from which what is met again moves on
        self._numbers = {i: str(i) for i in self.labels}

    def _word(self, word: str) -> tuple[str, str, int]:
        if (hit := self._words.get(word)) is None:
            symbols = word if word.isascii() and word.isprintable() else "".join([self._symbols[b] for b in word.encode("utf-8", "surrogatepass")])
            ids = self.automaton.encode(symbols)
            hit = (" ".join([self._numbers[i] for i in ids]), " ".join([self.labels[i] for i in ids]), len(ids))
            if len(self._words) >= self.words_kept:
                self._words.clear()
            self._words[word] = hit
        return hit

    def _run(self, run: str) -> tuple[str, str, int]:
        """A run without white space: ids, labels and their number.  Every such run has a word."""
        text = run
        if not run.isascii():
            text = unicodedata.normalize("NFC", run)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = run.lower()
        if text.isalpha():  # letters only, as in the splitter's first class
            return self._word(text)
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            a, b = self._word(text[:-1]), self._word(text[-1])
            return (f"{a[0]} {b[0]}", f"{a[1]} {b[1]}", a[2] + b[2])
        found = [self._word(w) for w in self._split.findall(text)]
        return (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found]))

    def _plain(self, text: str) -> list[tuple[str, str, int]]:
        runs = _RUNS.findall(text) if _ODD.search(text) else text.split()
        out = list(map(self._runs.get, runs))
        if None in out:
            known = self._runs
            for i, hit in enumerate(out):
                if hit is None:
                    run = runs[i]
                    if (hit := known.get(run) or self._older.get(run)) is None:
                        hit = self._run(run)
                    if len(known) >= self.words_kept:
                        self._older, self._runs = known, {}
                        known = self._runs
                    out[i] = known[run] = hit
        return out

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """Ids and labels of a whole text, each joined by a space, and their number."""
        text = text or ""
        found, at = [], 0
        for m in self._special.finditer(text) if "<|" in text else ():
            found += self._plain(text[at : m.start()])
            i = self.special[m.group()]
            found.append((str(i), self.labels[i], 1))
            at = m.end()
        found += self._plain(text[at:] if at else text)
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space, as this vocabulary names no decoder."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    made = WordEncoder(path)
    gc.collect()
    gc.freeze()  # the vocabulary stays for good: the collector need not walk it again
    return made


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 (and ids, decoded as strings) of every whole text: one scan, no shuffle.

    Null texts are empty texts and have no tokens.  Repeated rows are encoded each on its own, extra
    columns ignored, an empty table gives an empty result.  `path` must exist on every executor.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids, decoded, counts = [], [], []
        for text in batch.column(text_column):
            i, d, n = e.encode(text.as_py())
            ids.append(i if with_text else hashlib.sha256(i.encode()).hexdigest())
            decoded.append(d if with_text else hashlib.sha256(d.encode()).hexdigest())
            counts.append(n)
        return pa.record_batch([batch.column(id_column), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_column, *names])

    names = ["n_tokens", "ids", "decoded"] if with_text else ["n_tokens", "ids_sha256", "decoded_sha256"]
    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs.select(id_column, text_column), each, f"{id_column} {kind}, {names[0]} long, {names[1]} string, {names[2]} string")
