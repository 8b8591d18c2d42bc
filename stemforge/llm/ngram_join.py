"""N-gram Jaccard self-join by prefixes of adaptive length with several matches.

A document's set are its distinct five-word shingles (A-Z lower-cased; the whole sequence if it is
shorter).  Documents link when 100 * intersection >= 75 * union.

1. Equal sets are one class, named by 128 bits and represented by its smallest id.
2. Groups of near copies are joined early: of the representatives that share a MinHash band each is
   compared with the smallest and with the one that shares its bands with most others (in a group of
   edited copies that with the fewest edits), and union-find labels what is linked.
3. All other links are found by prefixes.  Shingles have one order: rare ones by hash, then frequent
   ones by frequency.  If two sets link, their first n - ceil(0.75 n) + l shingles share l at least,
   for every l.  Each document picks its l, a power of two, by the estimated cost: the postings in
   the prefix, and verifying the candidates that l matches leave.  The sizes of a pair say what it
   must share, o = ceil((|a| + |b|) * 75 / 175), so it meets within the first |a| - o + l and
   |b| - o + l shingles, l being the smaller of the two.  It is verified if it shares l there, and if
   these and what follows the last of them in either set can make o.  Pairs within one label of step 2
   need no check, as they are in one component already: of each shingle's documents those with its
   most common label stand on one side of the join only.
4. Verified links join the labels to components.

Nothing is capped or sampled: frequencies steer the order and l only, any order finds all links.
Shingles are compared by 64-bit hashes.

Null texts and texts without words have an empty set, which links with nothing.  Rows that repeat an
id are joined each by its own text.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import map_rows, materialize, mix, shingle_hashes, slices, word_hashes
from stemforge.llm.components import components, salted_join

WIDTH = 5
PER_CENT = 75
BANDS, BAND_HASHES = 4, 2
#: Shingles so frequent in one batch are counted over all of them; the most frequent are ordered last.
BATCH_FREQUENT = 8
FREQUENT_KEPT = 100_000
#: Verifying what a shared posting makes a candidate costs as much as reading this share of its set in postings: both
#: sets travel, but the bounds of the pair leave few candidates to verify.
VERIFY_SHARE = 0.03
#: How often a shingle that is not known as frequent is expected in other sets.
ELSEWHERE = 0.3
#: Bits of a need that hold the logarithm of the matches.
NEED_BITS = 5
#: Parts of a set that places are told by; up to so many shingles they are exact.
PLACE_PARTS = 2048
#: Prefix shingles that one task sorts.
RANGE_POSTINGS = 1_500_000
#: Ids up to which a list is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000

_SEEDS = mix(np.arange(1, BANDS * BAND_HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def shingle_sets(batch: pa.RecordBatch, text_column: str, width: int = WIDTH) -> list[np.ndarray]:
    words, begins = word_hashes(batch.column(text_column).to_pylist())
    return [shingle_hashes(words[begins[i] : begins[i + 1]], width) for i in range(batch.num_rows)]


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def band_hashes(shingles: np.ndarray) -> list[int]:
    least = [(shingles * s).min() for s in _SEEDS]
    out = []
    for k in range(BANDS):
        h = np.uint64(k + 1)
        for x in least[k * BAND_HASHES : (k + 1) * BAND_HASHES]:
            h = mix(np.array([h ^ x]))[0]
        out.append(int(h.view(np.int64)))
    return out


def least_overlap(n: int, per_cent: int = PER_CENT) -> int:
    """A set of n shingles shares so many with any that it links to."""
    return -(-per_cent * n // 100)


def pair_overlap(a, b, per_cent: int = PER_CENT):
    """Two sets of a and b shingles (Columns) share so many at least if they link."""
    return F.ceil((a + b) * F.lit(per_cent) / F.lit(100 + per_cent) - F.lit(1e-9)).cast("long")


def sketch(docs: DataFrame, id_column: str, text_column: str, width: int = WIDTH) -> DataFrame:
    """id, n, set key and bands of every row; beside the first rows of batches the batch's frequent shingles with their counts."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch, text_column, width)
        keys = [set_key(s) if len(s) else (0, 0) for s in sets]
        bands = [band_hashes(s) if len(s) else None for s in sets]
        distinct = {k: s for k, s in zip(keys, sets, strict=True)}
        token, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
        often = count >= BATCH_FREQUENT
        none = [None] * (len(sets) - 1)
        return pa.record_batch(
            [
                batch.column(id_column), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array([token[often].view(np.int64), *none], pa.list_(pa.int64())), pa.array([count[often], *none], pa.list_(pa.int64())),
            ],
            names=["id", "n", "k0", "k1", "bands", "often", "counts"],
        )

    d = docs.select(F.col(id_column).cast("long").alias(id_column), text_column)
    return map_rows(d, each, "id long, n long, k0 long, k1 long, bands array<long>, often array<long>, counts array<long>")


def frequent_shingles(sketches: DataFrame, kept: int = FREQUENT_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their counts: `kept` at most."""
    rows = sketches.where("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "counts")).alias("x"))
    top = rows.groupBy(F.col("x.often").alias("token")).agg(F.sum("x.counts").alias("n")).orderBy(F.desc("n"), "token").limit(kept).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def choose_prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, per_cent: int = PER_CENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set, which of it is frequent, and how many matches it requires."""
    n = len(shingles)
    df = np.ones(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        hit = frequent[at] == shingles
        df[hit] = counts[at[hit]]
    order = np.argsort(df, kind="stable")  # ties stay in the order of their hashes
    must = least_overlap(n, per_cent)
    base = n - must
    matches, best = 1, math.inf
    read = np.cumsum(df[order] + ELSEWHERE)
    k = 1
    while k <= must:
        p = base + k
        cost = read[p - 1] + VERIFY_SHARE * n * (read[p - 1] - p) / k
        if cost < best:
            best, matches = cost, k
        k *= 2
    prefix = order[: base + matches]
    return shingles[prefix], df[prefix] > 1, matches


def postings(docs: DataFrame, id_column: str, text_column: str, frequent, ranges: int, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """Packed prefixes: range, shingles, set keys and needs; frequent shingles lie in ranges of their own, spread by set.

    A need holds a shingle's place, as the part of its set that stands before it, and the logarithm of the matches.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT_KEPT at most

    def each(batches):
        f, c = shared.value
        for whole in batches:
            for batch in slices(whole):
                tokens, keys, needs, where = [], [], [], []
                for s in shingle_sets(batch, text_column, width):
                    if len(s):
                        prefix, often, matches = choose_prefix(s, f, c, per_cent)
                        k0 = set_key(s)[0]
                        tokens.append(prefix)
                        keys.append(np.full(len(prefix), k0, np.int64))
                        needs.append((np.arange(len(prefix), dtype=np.int64) * PLACE_PARTS // len(s) << NEED_BITS) | (matches.bit_length() - 1))
                        where.append(np.where(often, ranges + k0 % ranges, (prefix % np.uint64(ranges)).astype(np.int64)))
                if not tokens:
                    continue
                t, k, m, w = (np.concatenate(x) for x in (tokens, keys, needs, where))
                order = np.argsort(w, kind="stable")
                t, k, m, w = t[order], k[order], m[order].astype(np.uint16), w[order]
                cut = np.flatnonzero(np.diff(w)) + 1
                starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(w)]])
                yield pa.record_batch(
                    [pa.array(w[starts].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (t, k, m))],
                    names=["range", "tokens", "keys", "needs"],
                )

    return docs.select(id_column, text_column).mapInArrow(each, "range int, tokens binary, keys binary, needs binary")


def shared_postings(packed: DataFrame, ranges: int) -> DataFrame:
    """token, k0 and need of the prefix shingles that two sets at least have; all frequent ones."""

    def group(table: pa.Table) -> pa.Table:
        t, k, m = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]) for name, kind in (("tokens", np.int64), ("keys", np.int64), ("needs", np.uint16)))
        order = np.lexsort((k, t))
        t, k, m = t[order], k[order], m[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])  # copies of a set count once
        t, k, m = t[new], k[new], m[new]
        if table.column("range")[0].as_py() < ranges:
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), bool)
            keep[1:] |= same
            keep[:-1] |= same
            t, k, m = t[keep], k[keep], m[keep]
        return pa.table({"token": t, "k0": k, "need": m.astype(np.int32)})

    return packed.groupBy("range").applyInArrow(group, "token long, k0 long, need int")


def prefix_pairs(shared: DataFrame, nodes: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Pairs a, b of representatives of different labels that may link, by the prefix shingles that they share."""
    columns = ("rep", "label", "n", "matches", "place")
    rows = shared.join(nodes.select("k0", "rep", "label", "n"), "k0").select("token", "rep", "label", "n", "need")
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
    rows = materialize(salted_join(rows, mixed, ["token"], F.col("rep")))
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    main = by_label.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    # the least place that rounds to its part, so that bounds by it never say too little
    place = F.ceil(F.shiftright("need", NEED_BITS) * F.col("n") / F.lit(PLACE_PARTS)).cast("long")
    matches = F.expr(f"shiftleft(1, need & {(1 << NEED_BITS) - 1})")
    rows = salted_join(rows, main, ["token"], F.col("rep")).select("token", "rep", "label", "n", matches.alias("matches"), place.alias("place"), (F.col("label") != F.col("main")).alias("minor"))
    rows = materialize(rows)
    a, b = (rows.select("token", *[F.col(c).alias(c + s) for c in (*columns, "minor")]) for s in ("_a", "_b"))
    must, need = pair_overlap(F.col("n_a"), F.col("n_b"), per_cent), F.least("matches_a", "matches_b")
    once = ~F.col("minor_b") | (F.col("rep_a") < F.col("rep_b"))
    near = (F.col("place_a") + must < F.col("n_a") + need) & (F.col("place_b") + must < F.col("n_b") + need)
    met = a.where("minor_a").join(b, "token").where(once & (F.col("label_a") != F.col("label_b")) & near)
    found = met.groupBy("rep_a", "rep_b", "n_a", "n_b", "matches_a", "matches_b").agg(F.count(F.lit(1)).alias("met"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b"))
    reach = F.col("met") + F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    return found.where((F.col("met") >= need) & (reach >= must)).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def verified(docs: DataFrame, pairs: DataFrame, id_column: str, text_column: str, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """The pairs a, b of ids that link, by exact intersection of their whole sets."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = ids.count() <= BROADCAST_ROWS
    wanted = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(F.broadcast(ids) if few else ids, "id")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(batch, "text", width)], pa.binary())], names=["id", "s"])

    sets = materialize(map_rows(wanted, pack, "id long, s binary"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            keep.append(common > 0 and 100 * common >= per_cent * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(both.select("a", "b", "sa", "sb"), check, "a long, b long")


def near_pairs(reps: DataFrame) -> DataFrame:
    """Pairs a, b of representatives: the members of each band with its smallest and its best connected one."""
    rows = reps.select("rep", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = materialize(salted_join(rows, sizes, ["band"], F.col("rep")))
    rows = rows.join(rows.groupBy("rep").agg(F.sum("m").alias("met")), "rep")
    ends = rows.groupBy("band").agg(F.min("rep").alias("low"), F.max_by("rep", F.struct("met", "rep")).alias("centre"))
    met = salted_join(rows.select("rep", "band"), ends, ["band"], F.col("rep")).select("rep", F.explode(F.array("low", "centre")).alias("b")).where("rep != b")
    return met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def join_ngrams(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    sketches = materialize(sketch(docs, id_column, text_column, width))
    full = sketches.where("n > 0")
    classes = full.groupBy("k0", "k1").agg(F.min("id").alias("rep"))
    reps = materialize(full.join(classes, ["k0", "k1"]).where("id = rep").select("k0", "k1", "rep", "n", "bands").dropDuplicates(["k0", "k1"]))

    near = materialize(near_pairs(reps))
    early = materialize(components(verified(docs, near, id_column, text_column, width, per_cent)))
    nodes = materialize(reps.join(early.withColumnRenamed("node", "rep"), "rep", "left").select("k0", "k1", "rep", "n", F.coalesce("component", "rep").alias("label")))

    # all others: prefixes
    total = nodes.agg(F.sum("n")).first()[0] or 0
    ranges = max(8, math.ceil(total / 2 / RANGE_POSTINGS))  # prefixes are about half of the sets
    packed = postings(docs, id_column, text_column, frequent_shingles(sketches), ranges, width, per_cent)
    pairs = materialize(prefix_pairs(shared_postings(packed, ranges), nodes, per_cent))
    late = verified(docs, pairs, id_column, text_column, width, per_cent)
    label = nodes.select("rep", "label")
    late = reduce(lambda d, c: d.join(label.select(F.col("rep").alias(c), F.col("label").alias("l" + c)), c), ("a", "b"), late)
    last = components(late.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    final = nodes.join(last.withColumnRenamed("node", "label"), "label", "left").select("k0", "k1", F.coalesce("component", "label").alias("component_id"))
    out = salted_join(sketches.select("id", "n", "k0", "k1"), final, ["k0", "k1"], F.col("id"), "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """One row of each component, that with its smallest id (null ids last); what links with nothing stays.

    Rows are told apart by id and text: of rows that repeat both one stays, of rows that repeat an id only
    those that link are one component.  Rows with neither id nor words all stay.
    """
    rows = docs.withColumn("__row", F.xxhash64(F.col(id_column).isNull(), id_column, text_column))
    joined = join_ngrams(rows, "__row", text_column, **how).dropDuplicates(["__row"])
    order = F.struct(F.col(id_column).isNull(), id_column, "__row")
    known = rows.select(id_column, "__row").join(joined, "__row")
    kept = known.groupBy("component_id").agg(F.min_by("__row", order).alias("__row"), F.max("n_shingles").alias("__n"))
    alone = F.when(F.col(id_column).isNull() & (F.col("__n") == 0), F.monotonically_increasing_id())
    d = rows.join(kept.select("__row", "__n"), "__row").withColumn("__alone", alone)
    return d.dropDuplicates([id_column, "__row", "__alone"]).select(*docs.columns)
