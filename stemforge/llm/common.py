"""What the operators of this subpackage share: reading, cutting lineage, Arrow batches and word hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step holds; longer texts are cut at white space.
SLICE_BYTES = 2_000_000
CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="stemforge-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder, so that a lost executor costs no recomputation of it."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    # a checkpoint keeps its plan's constraints, and over several of them these multiply beyond the driver's memory
    conf = df.sparkSession.conf
    before = conf.get(CONSTRAINTS, "true")
    conf.set(CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(CONSTRAINTS, before)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files and checkpoints of plans that are gone leave the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> str:
    """The path of a new Parquet table in that folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    release(df.sparkSession)
    df.write.parquet(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder, for rows with texts and for steps that repeat.

    A checkpoint also keeps its plan's size estimate, and joins multiply these: repeated over rounds the
    estimate takes millions of digits.  A table has the size of its files.
    """
    return df.sparkSession.read.parquet(written(df))


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of `written` that nothing reads any more."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                if (out := fn(small)) is not None:
                    yield out

    return df.mapInArrow(each, schema)


def slices(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, one row at least, so that results are handed on in small pieces."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def hash_share(column: str, share: float):
    """Rows whose hashed id falls into a share of the hash range: the same rows in every run and at every partitioning."""
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1_000_000)) < F.lit(int(min(1.0, share) * 1_000_000))


def pack_ints(values: np.ndarray) -> bytes:
    """Integers, compressed with the bytes of one place together: small ones take little room."""
    return zstandard.compress(values.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpack_ints(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > SLICE_BYTES:
        end = start + SLICE_BYTES
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in the bytes."""
    b = np.frombuffer(data, np.uint8)
    inside = ~_IS_SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(b)))
    at = np.arange(starts[0], len(b)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    values = (b[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers[at]
    values[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's words begin (and the end).

    Words are maximal runs without space and 0x09-0x0D; `lower` folds A-Z only.  Null texts have no words.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    group: list[bytes] = []
    members: list[int] = []

    def flush() -> None:
        if not group:
            return
        data = b"\n".join(group)
        hashes, starts = _hash_slice(data)
        ends = np.cumsum([len(x) + 1 for x in group])
        where = np.searchsorted(ends, starts, side="right")
        np.add.at(counts, np.asarray(members)[where] + 1, 1)
        found.append(hashes)
        group.clear()
        members.clear()

    held = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if lower:
            data = data.lower()
        for piece in _pieces(data):
            if held + len(piece) > SLICE_BYTES:
                flush()
                held = 0
            group.append(piece)
            members.append(i)
            held += len(piece) + 1
    flush()
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text; fewer words than `width` make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(width, n)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        h = (h ^ words[k : n - size + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))
