"""Fuzzy line de-duplication by MinHash, with DataFrame functions only.

A line with a word is normalised (lower case, one space between words).  Its character shingles are
the 16 characters from each word's start on (fewer at the line's end); runs of over 8 characters
without a space start further ones, so that shingles cover every line whole.  Equal normal lines are
one class.

1. The signature of a class is a one-permutation MinHash: the least hashed shingle of each of ten
   bins, in five bands of two bins.  A first pass compares the classes of a band with the one that
   shares its bands with most others and with the least one, and union-find labels what is linked.
2. Bands whose other classes still have several labels go through an exact prefix join.  Of these
   classes' sets, what only one label has comes first, then what few classes have; pairs of different
   labels whose prefixes in this order meet, and whose sets differ in no more bits of their parities than
   two similar ones may, are compared.  So all classes that share a band, and are
   similar, end in one component.
3. Pairs of either step are verified by the exact Jaccard similarity of their shingle sets; union-find
   joins what is linked, and of each component only the first line (by document id, then by line
   number) stays.

Bands miss a pair of similarity 0.8 with a chance of 0.006, one of 0.9 with one of 0.00002.
Nothing is capped or sampled.  Shingles are compared by 64-bit hashes; lines are named by 64-bit hashes in
pairs, and by 128 bits and their first place elsewhere.

Null texts have no lines; lines without a word are never touched.  Rows that repeat an id are one
document: the same place in both is the same line, and stays or goes in both.  Extra columns are
carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import materialize
from stemforge.llm.components import components, salted_join
from stemforge.llm.quality_rules import WORD

#: Each match is up to 8 characters of a word with the spaces after it (a single one in scripts without spaces); its shingle looks ahead from its start.
SHINGLE = r"(?=(.{1,16}))(?:[!-~¡-ɏ]{1,8}|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^ ]{1,8}) ?"
BANDS = 5
#: Lower bounds of the bins, two for each band.
BOUNDS = [-(2**63) + i * (2**64 // (2 * BANDS)) for i in range(2 * BANDS)]
SIMILARITY = 0.8
#: A shingle is hot that makes up more than one of so many shingles.
HOT_TOKENS = 1000
#: Places are document id times this, plus the line's number.
PLACES = 10_000_000_000
#: Numbers of 64 bits, a power of two, that tell sets apart before they are compared.
PARITIES = 4
#: Ids up to which a list is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(normal: Column) -> Column:
    """64-bit hashes of the shingles, again where they repeat."""
    return F.transform(F.regexp_extract_all(normal, F.lit(SHINGLE), F.lit(1)), lambda x: F.xxhash64(x))


def shingle_set(normal: Column) -> Column:
    """Distinct 64-bit hashes of the shingles."""
    return F.array_distinct(shingle_hashes(normal))


def bands(shingles: Column) -> list[Column]:
    """A hash for each band of two bins, from hashes of shingles; null where both bins are empty.

    Bins are equal parts of the range of hashes.  Sorted among the bins' lower bounds, a bin's least
    hash stands right after its bound: no function of Python's or of single elements is called.
    """
    marks = F.sort_array(F.concat(shingles, F.array(*[F.lit(b) for b in BOUNDS])))
    after = lambda b: F.get(F.col("__marks"), F.array_position("__marks", F.lit(b)).cast("int"))
    out = []
    for k in range(BANDS):
        low, middle = BOUNDS[2 * k], BOUNDS[2 * k + 1]
        beyond = BOUNDS[2 * k + 2] if k + 1 < BANDS else None
        one, two = after(low), after(middle)
        empty = (one == middle) & (two.isNull() if beyond is None else two == beyond)
        out.append(F.when(~F.coalesce(empty, F.lit(False)), F.xxhash64(F.lit(k), one, two)))
    return [marks, *out]


def least_shared(n: Column, similarity: float) -> Column:
    """A set of n shingles shares so many with any that it links to."""
    return F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int")


def _lines(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    place = F.col("id").cast("decimal(38,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("no")
    return lines.select(place.cast("decimal(38,0)").alias("place"), "line")


def raw_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """place and text of every line."""
    return _lines(docs, id_column, F.col(text_column))


def normal_form(line: Column) -> Column:
    """The same as normal_line(), for lines that mostly need no change."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")))


def places(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """place and normal form of every line with a word; texts are normalised before they are split, which takes one call for each."""
    # most texts hold single spaces only, which plain searches tell sooner than a pattern
    odd = reduce(or_, [F.contains(text_column, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    spaced = F.when(odd, F.regexp_replace(text_column, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(F.col(text_column))
    return _lines(docs, id_column, F.lower(spaced)).select("place", F.trim("line").alias("x")).where("x != ''")


def keyed_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """place, two hashes of the normal form (k0, k1) and band hashes of every line with a word."""
    lines = places(docs, id_column, text_column)
    signed = lines.select("place", F.xxhash64(F.lit(0), "x").alias("k0"), F.xxhash64(F.lit(1), "x").alias("k1"), shingle_hashes(F.col("x")).alias("__s"))
    marks, *hashes = bands(F.col("__s"))
    return signed.select("place", "k0", "k1", marks.alias("__marks")).select("place", "k0", "k1", *[h.alias(f"b{k}") for k, h in enumerate(hashes)])


def line_classes(keyed: DataFrame) -> DataFrame:
    """k0, k1, first place, number of lines and band hashes of every class of equal lines."""
    return keyed.groupBy("k0", "k1").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(f"b{k}").alias(f"b{k}") for k in range(BANDS)])


def band_members(classes: DataFrame) -> DataFrame:
    """band, class name (k0), number of classes of the band (m) and its least one (low), of bands with two classes or more."""
    rows = classes.select("k0", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("band")).where("band IS NOT NULL")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("k0").alias("low")).where("m > 1")
    return salted_join(rows, shared, ["band"], F.col("k0")).select("band", "k0", "m", "low")


def centred(members: DataFrame) -> DataFrame:
    """band, k0, low and the class of the band that shares its bands with most others (centre); of edited copies that is one with few edits."""
    met = members.groupBy("k0").agg(F.sum("m").alias("met"))
    centres = members.join(met, "k0").groupBy("band").agg(F.max_by("k0", F.struct("met", "k0")).alias("centre"))
    return salted_join(members, centres, ["band"], F.col("k0")).select("band", "k0", "low", "centre")


def candidates(members: DataFrame) -> DataFrame:
    """Pairs a, b of class names that share a band with its centre or its least class."""
    met = members.select("k0", F.explode(F.array("low", "centre")).alias("b")).where("k0 != b")
    return met.select(F.least("k0", "b").alias("a"), F.greatest("k0", "b").alias("b")).distinct()


def crowded(members: DataFrame, labels: DataFrame) -> DataFrame:
    """k0 of the classes of bands in which classes that were not compared have different labels."""
    labelled = members.where("k0 != low AND k0 != centre").select("band", "k0").join(labels, "k0")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("band")
    return salted_join(labelled, mixed, ["band"], F.col("k0")).select("k0").distinct()


def relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """k0 and label, with the component of each label that links to another."""
    to = moved.select(F.col("node").alias("label"), "component")
    return labels.join(to, "label", "left").select("k0", F.coalesce("component", "label").alias("label"))


def whole_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The columns of `wanted` (k0, place and others) and the shingles s of each class in it; again for repeated rows."""
    few = wanted.count() <= BROADCAST_ROWS
    lines = raw_lines(docs, id_column, text_column).join(F.broadcast(wanted) if few else wanted, "place").withColumn("x", normal_form(F.col("line")))
    # rows that repeat an id may hold other lines at the place; an equation would become a key of the join, and normalise every line
    return lines.where(F.xxhash64(F.lit(0), "x").bitwiseXOR(F.col("k0")) == 0).select(*wanted.columns, shingle_set(F.col("x")).alias("s"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of different labels, of the pairs a, b of class names whose sets have the similarity."""
    one = sets.select(F.col("k0").alias("a"), F.col("label").alias("la"), F.col("s").alias("sa"))
    two = sets.select(F.col("k0").alias("b"), F.col("label").alias("lb"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(one, "a").join(two, "b").where((F.col("la") != F.col("lb")) & (shared >= similarity * (F.size("sa") + F.size("sb") - shared)))
    return both.select(F.col("la").alias("a"), F.col("lb").alias("b"))


def member_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """k0, place and shingles s of every class that shares a band."""
    wanted = materialize(classes.select("k0", F.col("first").alias("place")).join(members.select("k0").distinct(), "k0"))
    sets = materialize(whole_sets(docs, wanted, id_column, text_column))
    # only rows that repeat an id make a set again
    return materialize(sets.dropDuplicates(["k0"])) if sets.count() > wanted.count() else sets


def parities() -> list[Column]:
    """PARITIES numbers that hold, for each of their bits, whether an odd count of the shingles s falls on it.

    Each shingle that only one of two sets has turns one bit over, so the bits in which the sets differ are at most so many.
    """
    part = "aggregate(s, 0L, (p, x) -> IF(shiftright(x, 6) & {last} = {k}, p ^ shiftleft(1L, CAST(x & 63L AS INT)), p))"
    return [F.expr(part.format(last=PARITIES - 1, k=k)).alias(f"p{k}") for k in range(PARITIES)]


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of class names of different labels that may link: their prefixes meet, rarest shingles first, and their parities allow it."""
    rows = sets.select("k0", "label", F.size("s").alias("size"), F.explode("s").alias("token"))
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_label.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("m").alias("df"), F.max_by("label", F.struct("m", "label")).alias("main")).where("low != high")
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    mixed = materialize(mixed.select("token", "df", "main", (F.col("df") * HOT_TOKENS > total).alias("hot")))
    # only hot shingles are salted: HOT_TOKENS at most, as the frequencies add up to the total
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k0"), F.lit(8))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(mixed.where("hot").select("token", "hot")), "token", "left").withColumn("salt", salt).drop("hot")
    copies = mixed.select("token", "df", "main", F.explode(F.expr("IF(hot, sequence(0L, 7L), array(0L))")).alias("salt"))
    # shingles of one label come first in the order, so that they take up the start of each prefix
    known = dealt.join(copies, ["token", "salt"]).groupBy("k0", "label", "size").agg(F.sort_array(F.collect_set(F.struct("df", "token", "main"))).alias("t"))
    spare = F.size("t") - least_shared(F.col("size"), similarity)
    prefix = known.where(spare >= 0).select("k0", "label", "size", (F.col("size") - F.size("t")).alias("alone"), F.posexplode(F.slice("t", 1, spare + 1)).alias("at", "t"))
    odd = [f"p{k}" for k in range(PARITIES)]
    kept = prefix.select("k0", "label", "size", (F.col("alone") + F.col("at")).alias("place"), "t.token", (F.col("label") != F.col("t.main")).alias("minor"))
    kept = materialize(kept.join(sets.select("k0", *parities()), "k0"))
    a, b = (kept.select("token", *[F.col(c).alias(c + x) for c in ("k0", "label", "size", "place", "minor", *odd)]) for x in ("_a", "_b"))
    # the sizes of a pair say what it must share, and so where its first common shingle may stand at the latest
    must = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    near = (F.col("place_a") + must <= F.col("size_a")) & (F.col("place_b") + must <= F.col("size_b"))
    once = ~F.col("minor_b") | (F.col("k0_a") < F.col("k0_b"))
    unlike = reduce(add, [F.bit_count(F.col(p + "_a").bitwiseXOR(F.col(p + "_b"))) for p in odd])
    close = unlike + 2 * must <= F.col("size_a") + F.col("size_b")
    met = a.where("minor_a").join(b, "token").where(once & (F.col("label_a") != F.col("label_b")) & near & close)
    return met.select(F.least("k0_a", "k0_b").alias("a"), F.greatest("k0_a", "k0_b").alias("b")).distinct()


def linked_labels(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node and component of every label that one of the pairs of classes links to another."""
    return materialize(components(similar(materialize(pairs), sets, similarity)))


def class_labels(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """k0 and label (the least first place of its component) of every class in `sets` (k0, place, s)."""
    sets = sets.select("k0", F.col("place").alias("label"), "s")
    labels = sets.select("k0", "label")
    members = materialize(centred(members))
    labels = materialize(relabelled(labels, linked_labels(candidates(members), sets, similarity)))
    left = crowded(members, labels)
    sets = materialize(sets.select("k0", "s").join(labels, "k0").join(left, "k0"))
    return materialize(relabelled(labels, linked_labels(prefix_pairs(sets, similarity), sets, similarity)))


def surplus_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """place, and the place of the line that stays for it, of every line that goes (again for repeated rows)."""
    # each step keeps what later ones read, so that wide tables leave the disks
    keyed = materialize(keyed_lines(docs, id_column, text_column))
    classes = materialize(line_classes(keyed))
    keyed = materialize(keyed.select("place", "k0", "k1"))
    members = materialize(band_members(classes))
    classes = materialize(classes.select("k0", "k1", "first", "n"))
    labels = class_labels(members, member_sets(docs, classes, members, id_column, text_column), similarity)
    labelled = classes.join(labels, "k0", "left")
    labelled = labelled.select("k0", "k1", F.coalesce("label", "first").alias("stays"), "n", "first").where((F.col("n") > 1) | (F.col("stays") != F.col("first")))
    return salted_join(keyed.select("place", "k0", "k1"), labelled.select("k0", "k1", "stays"), ["k0", "k1"], F.col("place")).where("place != stays").select("place", "stays")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id and the sorted numbers (from 0) of the lines that go, for documents that lose any."""
    gone = surplus_lines(docs, id_column, text_column, similarity)
    scale = F.lit(PLACES).cast("decimal(11,0)")
    number = F.pmod("place", scale)
    return gone.select(((F.col("place") - number) / scale).cast("long").alias(id_column), number.cast("int").alias("no")).groupBy(id_column).agg(F.sort_array(F.collect_set("no")).alias("removed"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with their columns, without surplus lines; documents left without a word go."""
    gone = removals(docs, id_column, text_column, similarity).withColumnRenamed("removed", "__removed")
    d = docs.join(gone, id_column, "left")
    rest = F.array_join(F.filter(F.split(text_column, "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    d = d.withColumn(text_column, F.when(F.col("__removed").isNotNull(), rest).otherwise(F.col(text_column)))
    return d.where(F.col("__removed").isNull() | F.col(text_column).rlike(WORD)).select(*docs.columns)


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, n_lines (with a word), n_removed and removed (their numbers) of every document."""
    gone = removals(docs, id_column, text_column, similarity)
    lines = F.regexp_count(F.coalesce(text_column, F.lit("")), F.lit(WORD + r"[^\n]*"))
    d = docs.select(id_column, lines.cast("long").alias("n_lines")).join(gone, id_column, "left")
    return d.select(id_column, "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
