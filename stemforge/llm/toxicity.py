"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary text, predict each letter of a word (and its
end) from up to five symbols before it, the word's start included.  The longest contexts have counts
of each class; both classes back off to the same lower orders, one symbol shorter each time, made of
continuation counts over the grams of both.  A rare expression is so judged by the parts that it
shares with known ones, and what no class has seen weighs only by how open its context is.  All
labelled texts are counted whole, and the tables of all orders are made by Spark; no count is
dropped.  A toxic text is a mixture: few of its words come from the toxic model and the rest from
the ordinary one, so that the many words that tell nothing hardly count.  A text's score is a logistic function of the difference of the two log likelihoods, per
word, fitted on a bounded sample of labelled rows that give no counts.

The difference of a text is a sum over its words, so a task keeps those of the words that it met.
Models of up to MODEL_GRAMS grams are broadcast; with larger ones the distinct words are scored
by joins and joined back.

Null and empty texts, and texts without letters, have a difference of 0.  Several labels of an id
count as their largest.  Repeated rows are counted and scored each on its own, extra columns ignored;
without labelled rows of both classes all score 0, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import hash_share, map_rows, materialize

#: Bound of the labelled rows of each class that the calibration is fitted on, and their greatest share.
SAMPLE_ROWS, SAMPLE_SHARE = 2_500, 0.2
CONTEXT = 5
DISCOUNT = 0.75
#: Share of a toxic text's words that come from the toxic model; the others come from the ordinary one.
TOXIC_WORDS = 0.01
#: Grams up to which the model is broadcast: some 100 bytes each in a worker.
MODEL_GRAMS = 1_000_000
#: Labelled ids (of 16 bytes) up to which their table is broadcast to the documents.
BROADCAST_IDS = 2_000_000
WORDS_KEPT = 200_000
#: Characters of a text that are taken at once.
STEP = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a whole text, lower-cased, in parts that are cut between words."""
    text, start = text or "", 0
    while start < len(text):
        end = start + STEP
        while end < len(text) and _WORD.match(text[end]):
            end += 1
        yield _WORD.findall(text[start:end].lower())
        start = end


def grams(word: str) -> Iterator[tuple[str, str]]:
    """Context and symbol of each letter and of the end; a space marks start and end."""
    padded = f" {word} "
    for i in range(1, len(padded)):
        yield padded[max(0, i - CONTEXT) : i], padded[i]


def gram_counts(texts: DataFrame) -> DataFrame:
    """context, symbol and counts in ordinary (n0) and toxic (n1) texts, of columns `text` and `toxic`."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[Counter] = [Counter(), Counter()]
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            for part in words_of(text.as_py()):
                found[toxic].update(part)
        made: dict[tuple[str, str], list[int]] = {}
        for y in (0, 1):
            for word, n in found[y].items():
                for g in grams(word):
                    made.setdefault(g, [0, 0])[y] += n
        columns = [pa.array([g[0] for g in made], pa.string()), pa.array([g[1] for g in made], pa.string()), *(pa.array([n[y] for n in made.values()], pa.int64()) for y in (0, 1))]
        return pa.record_batch(columns, names=["context", "symbol", "n0", "n1"])

    made = map_rows(texts.select("text", "toxic"), each, "context string, symbol string, n0 long, n1 long")
    return made.groupBy("context", "symbol").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shorter() -> Column:
    """The context without its first symbol."""
    return F.expr("substring(context, 2)")


def shared_orders(top: DataFrame) -> list[DataFrame]:
    """context, symbol and probability p of the shared orders of 0 to CONTEXT - 1 symbols, by continuation counts.

    A symbol's count after a context is the number of different symbols before them; contexts at a word's start have none.
    """
    size = F.length("context")
    longer, counted = top.where(size == CONTEXT).select("context", "symbol"), []
    for k in range(CONTEXT - 1, -1, -1):
        now = materialize(longer.groupBy(shorter().alias("context"), "symbol").agg(F.count(F.lit(1)).alias("c")))
        counted.append(now)
        longer = now.select("context", "symbol").unionByName(top.where(size == k).select("context", "symbol"))
    out: list[DataFrame] = []
    for now in reversed(counted):
        totals = now.groupBy("context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = now.join(totals, "context")
        if out:
            rows = rows.withColumn("from", shorter()).join(out[-1].select(F.col("context").alias("from"), "symbol", F.col("p").alias("lower")), ["from", "symbol"])
        else:
            rows = rows.withColumn("lower", 1 / F.col("kinds"))
        p = (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")
        out.append(materialize(rows.select("context", "symbol", p.alias("p"))))
    return out


def log_ratios(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Toxic less ordinary log probability of each gram (context, symbol, ratio), and of any symbol that was not seen after a context (context, ratio).

    Counts of the larger class are scaled to the total of the smaller one, so that either must see an
    expression as often, for its share, before the shared orders give way.
    """
    orders = [o.withColumn("k", F.lit(k)) for k, o in enumerate(shared_orders(top))]
    shared = orders[0]
    for o in orders[1:]:
        shared = shared.unionByName(o)
    whole = top.agg(F.sum("n0"), F.sum("n1")).first()
    least = float(min(whole))
    top = top.withColumns({f"n{y}": F.col(f"n{y}") * F.lit(least / whole[y]) for y in (0, 1)})
    cut = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    sums = top.groupBy("context").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), cut("n0").alias("k0"), cut("n1").alias("k1"))
    back = [F.when(F.col(f"t{y}") > 0, F.col(f"k{y}") / F.col(f"t{y}")).otherwise(1.0) for y in (0, 1)]
    contexts = materialize(sums.select("context", "t0", "t1", back[0].alias("b0"), back[1].alias("b1")))
    lower = shared.select(F.col("context").alias("from"), "symbol", "k", "p")
    rows = top.join(contexts, "context").withColumns({"from": shorter(), "k": F.length("context") - 1}).join(lower, ["from", "symbol", "k"])
    p = [F.greatest(F.col(f"n{y}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"t{y}"), F.lit(1e-9)) + F.col(f"b{y}") * F.col("p") for y in (0, 1)]
    return rows.select("context", "symbol", F.log(p[1] / p[0]).alias("ratio")), contexts.select("context", F.log(F.col("b1") / F.col("b0")).alias("ratio"))


@dataclass
class Ratios:
    """The tables of log_ratios() in a worker."""

    seen: dict[str, float]
    unseen: dict[str, float]
    words: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"seen": self.seen, "unseen": self.unseen, "words": {}}

    def of(self, word: str) -> float:
        total = 0.0
        for context, symbol in grams(word):
            ratio = self.seen.get(context + symbol)
            total += self.unseen.get(context, 0.0) if ratio is None else ratio
        return math.log1p(TOXIC_WORDS * math.expm1(min(total, 500.0)))

    def difference(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in words_of(text):
            n += len(part)
            for word in part:
                if (known := self.words.get(word)) is None:
                    known = self.of(word)
                    if len(self.words) >= WORDS_KEPT:
                        self.words.clear()
                    self.words[word] = known
                total += known
        return total / max(n, 1)


@dataclass
class ToxicityModel:
    seen: DataFrame | None = None
    unseen: DataFrame | None = None
    slope: float = 0.0
    offset: float = -20.0
    held: Ratios | None = None  # what is broadcast, if it is small enough

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of one variable by Newton steps, with a little ridge."""
        scale = float(np.std(x)) or 1.0
        z = np.stack([x / scale, np.ones(len(x))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + 1e-2 * w
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
        self.slope, self.offset = float(w[0] / scale), float(w[1])


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS, model_grams: int = MODEL_GRAMS) -> ToxicityModel:
    """Counts all labelled texts but those of the calibration: about `sample_rows` of each class, chosen by a hash of the id."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg((F.max(label_column) > 0).cast("int").alias("toxic"))
    known = materialize(known)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return ToxicityModel()
    share = {y: min(SAMPLE_SHARE, sample_rows / n) for y, n in sizes.items()}
    marked = known.withColumn("held", hash_share(id_column, share[0]) & (F.col("toxic") == 0) | hash_share(id_column, share[1]) & (F.col("toxic") == 1))
    texts = docs.select(id_column, F.col(text_column).alias("text")).join(F.broadcast(marked) if sum(sizes.values()) <= BROADCAST_IDS else marked, id_column)
    top = materialize(gram_counts(texts.where("NOT held")))
    if not all(top.agg(F.sum("n0"), F.sum("n1")).first()):
        return ToxicityModel()
    seen, unseen = (materialize(t) for t in log_ratios(top))
    model = ToxicityModel(seen, unseen)
    if seen.count() <= model_grams:
        s, u = seen.select(F.concat("context", "symbol").alias("g"), "ratio").toArrow(), unseen.toArrow()  # model_grams rows at most
        model.held = Ratios(dict(zip(s["g"].to_pylist(), s["ratio"].to_pylist(), strict=True)), dict(zip(u["context"].to_pylist(), u["ratio"].to_pylist(), strict=True)))
    got = differences(texts.where("held"), model, ["toxic"], "text").toArrow()  # about 2 * sample_rows numbers
    x, y = got["difference"].to_numpy(), got["toxic"].to_numpy()
    order = np.lexsort((x, y))
    x, y = x[order], y[order].astype(float)
    if 0 < y.sum() < len(y):
        prior, now = sizes[1] / sum(sizes.values()), y.mean()
        model.calibrate(x, y, np.where(y > 0, prior / now, (1 - prior) / (1 - now)))
    return model


def differences(docs: DataFrame, model: ToxicityModel, keep: list[str], text_column: str) -> DataFrame:
    """The columns `keep` and the difference of every whole text."""
    if model.seen is None:
        return docs.select(*keep, F.lit(0.0).alias("difference"))
    if model.held is None:
        return _joined_differences(docs, model, keep, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model.held)  # MODEL_GRAMS at most

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = [shared.value.difference(t.as_py()) for t in batch.column(text_column)]
        return pa.record_batch([*(batch.column(c) for c in keep), pa.array(d, pa.float64())], names=[*keep, "difference"])

    kinds = dict(docs.dtypes)
    return map_rows(docs.select(*dict.fromkeys([*keep, text_column])), each, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", difference double")


def _joined_differences(docs: DataFrame, model: ToxicityModel, keep: list[str], text_column: str) -> DataFrame:
    """The same with models of any size: distinct words meet the tables, and are joined back."""
    rows = materialize(docs.select(*keep, F.monotonically_increasing_id().alias("__row"), F.col(text_column).alias("__text")))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, words, n = [], [], []
        for row, text in zip(batch.column("__row").to_pylist(), batch.column("__text"), strict=True):
            found: Counter = Counter()
            for part in words_of(text.as_py()):
                found.update(part)
            at += [row] * len(found)
            words += found.keys()
            n += found.values()
        return pa.record_batch([pa.array(at, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["__row", "word", "n"])

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(w, c, s) for w in batch.column("word").to_pylist() for c, s in grams(w)]
        return pa.record_batch([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["word", "context", "symbol"])

    held = materialize(map_rows(rows.select("__row", "__text"), count, "__row long, word string, n long"))
    spelt = map_rows(held.select("word").distinct(), spell, "word string, context string, symbol string")
    ratio = F.coalesce("ratio", "open", F.lit(0.0))
    scored = spelt.join(model.seen, ["context", "symbol"], "left").join(model.unseen.withColumnRenamed("ratio", "open"), "context", "left").groupBy("word").agg(F.log1p(TOXIC_WORDS * F.expm1(F.least(F.sum(ratio), F.lit(500.0)))).alias("r"))
    sums = held.join(scored, "word").groupBy("__row").agg((F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("difference"))
    return rows.drop("__text").join(sums, "__row", "left").select(*keep, F.coalesce("difference", F.lit(0.0)).alias("difference"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted and difference of every whole text: one scan, no shuffle, if the model can be broadcast."""
    d = differences(docs, model, [id_column], text_column)
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), model.slope * F.col("difference") + model.offset))
    score = 1 / (1 + F.exp(-z))
    return d.select(id_column, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "difference")
