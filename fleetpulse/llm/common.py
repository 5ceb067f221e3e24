"""What several operators share: words, hashes, tables on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or the checkpoint folder of the context.

    Only a local master, where driver and executors are one process, gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fp-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go when it ends: its result is kept elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: a lost executor costs a reread.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}-{name}"
    with tidied(spark):
        df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for t in tables:
        files, place = _file_system(t.sparkSession, t.settled_at)
        files.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def learn_row(doc_id: Column, parts: int, held_out: int) -> Column:
    """True where crc32 of the id as text leaves another remainder than `held_out`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held_out, F.lit(False))


def told_apart(df: DataFrame, key: Column, mark: Column) -> Column:
    """`key`, changed where rows of different `mark` share one, so that equal keys mean equal marks.

    With 64-bit hashes for both, rows are told apart by 128 bits and carry 64. One aggregate of two numbers a
    row finds the shared keys; of n different rows about n^2 / 2^65 reach the driver (none below billions).
    """
    out, seed = key, 0
    while True:
        of = df.select(out.alias("key"), mark.alias("mark")).groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
        shared = [r["key"] for r in of.filter("low != high").select("key").collect()]
        if not shared:
            return out
        seed += 1
        out = F.when(out.isin(shared), F.xxhash64(F.lit(seed), key, mark)).otherwise(out)


# odd multipliers of the rolling hashes over bytes and over words
_BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_SPAN = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


class Powers:
    """Powers of an odd base modulo 2^64, longer on demand."""

    def __init__(self, base: int):
        self.base, self.up = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            steps = np.full(max(n, 1 << 12), self.base, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
        return self.up[:n]


_byte_powers = Powers(_BYTE_BASE)
_byte_inverses = Powers(pow(_BYTE_BASE, -1, 1 << 64))
_word_powers = Powers(WORD_BASE)


def word_bounds(raw: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a UTF-8 text; `between` marks the bytes that separate words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    outside = np.empty(len(raw) + 2, bool)
    outside[0] = outside[-1] = True
    np.take(between, raw, out=outside[1:-1])
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes.

    Polynomial sums over the bytes come from running sums, a stretch of words at a time.
    """
    out = (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        part = raw[starts[i] : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _byte_powers(len(part)), out=sums[1:])
        at = starts[i:j] - starts[i]
        out[i:j] += (sums[ends[i:j] - starts[i]] - sums[at]) * _byte_inverses(len(part))[at]
        i = j
    return mixed(out)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every `k` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = _word_powers(k)
    seed = np.uint64(seed)
    words = mixed(words ^ seed) if seed else words
    total = words[:n].copy()
    for i in range(1, k):
        total += words[i : i + n] * power[i]
    return mixed(total + seed)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


class Bitmap:
    """A set of hashes (Bloom filter) that may hold more than was put in, never less.

    Tasks use it to leave out rows that cannot matter before a shuffle; the exact test follows
    the shuffle. It has PER_HASH bits for each counted hash, between 2^BITS and 2^MOST bits (4 to 32 MB).
    Beyond some 30 million hashes it fills up, and more rows go through the exact test.
    """

    BITS, MOST, PER_HASH, PROBES = 25, 28, 12, 4

    @staticmethod
    def bits_for(count: int) -> int:
        return min(max((Bitmap.PER_HASH * count - 1).bit_length(), Bitmap.BITS), Bitmap.MOST)

    @staticmethod
    def of(hashes: Column | str, df: DataFrame) -> np.ndarray:
        """Words of the bitmap over a column of 64-bit hashes of a settled table: at most 2^(MOST - 6) rows reach the driver."""
        bits = Bitmap.bits_for(df.count())
        mask, h = F.lit((1 << bits) - 1), F.col("__h")
        first, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask).bitwiseOR(F.lit(1))
        probes = F.explode(F.array(*[(first + i * step).bitwiseAND(mask) for i in range(Bitmap.PROBES)]))
        hashes = F.col(hashes) if isinstance(hashes, str) else hashes
        bit = F.expr("shiftleft(1L, cast((__bit & 63) as int))")
        rows = (
            df.select(hashes.cast("long").alias("__h"))
            .select(probes.alias("__bit"))
            .groupBy(F.shiftright("__bit", 6).alias("word"))
            .agg(F.bit_or(bit).alias("bits"))
        )
        with tidied(df.sparkSession):
            rows = rows.toArrow()
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return out

    @staticmethod
    def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(64 * len(bitmap) - 1)
        hashes = hashes.astype(np.uint64, copy=False)
        first, step = hashes & mask, ((hashes >> np.uint64(32)) & mask) | np.uint64(1)
        found = np.ones(len(hashes), bool)
        for i in range(Bitmap.PROBES):
            at = (first + np.uint64(i) * step) & mask
            found &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, UTF-8 bytes) of every non-empty text of a batch, without copies."""
    col = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    for i in range(len(col)):
        if offsets[i + 1] > offsets[i] and (not col.null_count or col[i].is_valid):
            yield i, data[offsets[i] : offsets[i + 1]]


class Rows:
    """Columns gathered piece by piece and given out as record batches of a bounded size."""

    def __init__(self, names: Sequence[str], limit: int = 1 << 17):
        self.names, self.limit, self.parts, self.count = list(names), limit, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.count += len(columns[0])

    def full(self) -> bool:
        return self.count >= self.limit

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.count = [], 0
            yield pa.record_batch([long_array(c) for c in cols], names=self.names)
