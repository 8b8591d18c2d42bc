"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its character n-grams (2 to 4 letters, word bounds included), hashed to a
fixed number of rows of an embedding table; their mean goes through a linear softmax.  Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  A part of the
sample is held back to fit a temperature, so that scores are probabilities, and the score below
which a prediction is rejected.

Null texts and texts without a letter are `und` with score 0.  Repeated rows are judged each on its
own, extra columns ignored; without any labelled row everything is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import hash_share, map_rows

#: Bound of the labelled sample on the driver, in rows; their texts are whole.
SAMPLE_ROWS = 2_500
BUCKETS = 1 << 15
WIDTH = 12
SIZES = (2, 3, 4)
#: Code points of a text that one vectorised step holds.
STEP = 500_000

UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where there is none."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _ngrams(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams of letters and single spaces; `codes` begins and ends with a space."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    c = codes[keep].astype(np.uint32) * np.uint32(0x9E3779B1)
    out = []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _steps(text: str):
    """Codes of a whole text in overlapping steps, so that long texts need no more memory."""
    for i in range(0, len(text), STEP):
        codes = _codes(text[max(0, i - max(SIZES) + 1) : i + STEP])
        yield np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]) if len(text) <= STEP else codes


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # embeddings times softmax weights: one row of logits for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], epochs: int = 12, rate: float = 8.0, segment: int = 400, seed: int = 1) -> LanguageModel:
        languages = sorted(set(langs))
        rng = np.random.default_rng(seed)
        if not languages:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
        rows, labels = [], []
        for text, lang in zip(texts, langs, strict=True):
            for i in range(0, len(text), segment):
                if len(part := text[i : i + segment]) >= 20 or not i:
                    g = _ngrams(np.concatenate([[np.uint32(32)], _codes(part), [np.uint32(32)]]))
                    if len(g):
                        rows.append(g.astype(np.uint16))
                        labels.append(languages.index(lang))
        y = np.array(labels)
        order = rng.permutation(len(y))
        back = order[: len(y) // 10]
        order = order[len(y) // 10 :]
        k = len(languages)
        emb = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
        w = np.zeros((WIDTH, k), np.float32)
        bias = np.zeros(k, np.float32)
        batch = 48
        steps = min(500, max(200, epochs * len(order) // batch))
        for step in range(steps):
            lr = rate * (1 - step / steps)
            pick = order[rng.integers(0, len(order), batch)] if len(order) else back
            counts = np.stack([np.bincount(rows[i], minlength=BUCKETS) / len(rows[i]) for i in pick]).astype(np.float32)
            used = np.flatnonzero(counts.any(0))
            counts = counts[:, used]
            x = counts @ emb[used]
            p = _softmax(x @ w + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back_x = p @ w.T
            w -= lr * (x.T @ p)
            bias -= 0.1 * lr * p.sum(0)
            emb[used] -= lr * (counts.T @ back_x)
        model = cls(languages, emb @ w, bias.astype(np.float64))
        logits = np.stack([model.table[rows[i]].mean(0) + bias for i in back]) if len(back) else np.zeros((0, k))
        model._calibrate(logits.astype(np.float64), y[back])
        return model

    def _calibrate(self, logits: np.ndarray, y: np.ndarray, accuracy: float = 0.99) -> None:
        """Temperature of least log loss, and the least score from which held-back predictions reach the accuracy."""
        if not len(y):
            return
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / self.temperature)
        score, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-score)
        good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= accuracy
        self.reject_below = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        total, n, letters = np.zeros(len(self.languages)), 0, False
        for codes in _steps(text):
            letters = letters or bool((codes != 32).any())
            g = _ngrams(codes)
            total += np.bincount(g, minlength=BUCKETS) @ self.table if len(g) > BUCKETS // 8 else self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        if not letters:
            return UNDETERMINED, 0.0
        p = _softmax(((total / max(n, 1) + self.bias) / self.temperature)[None])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_language_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on about `sample_rows` labelled rows, as many of each language as there are, chosen by a hash of the id."""
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_column).count().collect()}  # one row for each language
    quota = sample_rows / max(1, len(counts))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col(lang_column) == lang) & hash_share(id_column, quota / n))
    got = known.where(chosen).select(id_column, F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).toPandas()
    got = got.sort_values([id_column, "text"], kind="stable")
    return LanguageModel.fit(list(got["text"]), list(got["lang"]))


def identify_language(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected of every whole text: one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the data

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        said = [m.predict(t.as_py()) for t in batch.column(text_column)]
        return pa.record_batch(
            [batch.column(id_column), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[1] < m.reject_below or x[0] == UNDETERMINED for x in said], pa.bool_())],
            names=[id_column, "lang_pred", "score", "rejected"],
        )

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs.select(id_column, text_column), each, f"{id_column} {kind}, lang_pred string, score double, rejected boolean")
