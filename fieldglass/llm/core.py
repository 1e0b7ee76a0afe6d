"""Helpers shared by the training-data operators.

Word rule used throughout: ASCII capitals are lower-cased, words are maximal
runs of characters other than space, tab, line feed, vertical tab, form feed
and carriage return.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Regex of one run of separators.
GAP = r"[\x20\x09-\x0D]+"

_own_scratch: str | None = None


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session gets a temporary folder; on a cluster
    executors would write to their own disks, so there it is an error.
    """
    global _own_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="fieldglass-")
        atexit.register(shutil.rmtree, _own_scratch, ignore_errors=True)
    return _own_scratch


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken)


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """(key, _slices): keys with more rows than a fair share of the n rows, and into how many slices they are dealt; None if there are none.

    There are under 2,000 of them, so they may be broadcast.  They are looked
    for first, so that plans without them stay small on the driver.
    """
    most = max(256, n // 2_000)
    if n <= most:
        return None
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_slices"))
    hot = materialize(hot, "hot")
    if not hot.isEmpty():
        return hot
    discard(hot)
    return None


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key); rows of a hot key are dealt into slices by column ``spread``, and its table row is copied to each."""
    if hot is None:
        return rows.join(table, key)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_slice", F.pmod(F.xxhash64(spread), slices).cast("int")).drop("_slices")
    right = table.join(F.broadcast(hot), key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return left.join(right, [key, "_slice"]).drop("_slice")


#: Bits of a bitmap of keys for each key, at least; bits of the largest one (32 MB); bits in a row of it.
KEY_BITS, MOST_BITS, ROW_BITS = 16, 1 << 28, 1 << 15


def with_possible(rows: DataFrame, key: str, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where ``key`` (long) is surely not in ``wanted``, a table of one long column and about n rows.

    Only a bitmap of the hashes of the keys goes to the tasks, so wide rows
    need not be shuffled to find the few of them that a join keeps.  Some
    others are marked too (up to one in ``KEY_BITS``, more beyond the largest
    bitmap): the join itself decides.  A null key is not wanted.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (KEY_BITS * max(1, n) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("possible")), F.lit(bits))
    (column,) = wanted.columns
    spots = wanted.where(F.col(column).isNotNull()).select(place(column).alias("_at"))
    bitmap = spots.groupBy(F.shiftright("_at", 15).alias("_row")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(ROW_BITS - 1))).alias("_bits"))
    at = F.col("_at").bitwiseAND(F.lit(ROW_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    marked = rows.withColumn("_at", place(key)).withColumn("_row", F.shiftright("_at", 15)).join(F.broadcast(bitmap), "_row", "left")
    return marked.select(*rows.columns, F.coalesce(F.col(key).isNotNull() & set_, F.lit(False)).alias(name))


def possible(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """The rows that :func:`with_possible` cannot rule out."""
    return with_possible(rows, key, wanted, n, "_possible").where("_possible").drop("_possible")


def lowest_hashed(rows: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """The k of n rows whose ``key`` hashes lowest.

    A threshold first leaves about 2 k rows, so few reach the driver however
    many tasks there are; the order then takes exactly k.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    few = rows if n <= 2 * k else rows.where(at < int((1 << 30) * 2 * k / n) + 1)
    return few.orderBy(at, key).limit(k)


def keep_memory() -> None:
    """Let this process keep the memory of arrays of a few MB for the next ones.

    The C library raises its limits by the largest block that was freed; below
    them, numpy's temporary arrays come back without new pages.
    """
    np.empty(31 << 20, dtype=np.uint8)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast ``value`` with its code; tasks read it with :func:`shared`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> object:
    return cloudpickle.loads(value.value)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    gap = np.zeros(256, dtype=bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    with np.errstate(over="ignore"):
        mix = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return lower, gap, mix


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text, computed on whole byte arrays.

    A word's hash is its bytes' polynomial modulo 2^64, brought to its own
    first byte by the inverse power, then mixed with its length.  The tables of
    powers grow to the longest text seen and are reused.
    """

    BASE = 0x5851F42D4C957F2D | 1

    def __init__(self) -> None:
        self.lower, self.gap, self.mix = _tables()
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            step = np.ones(n, dtype=np.uint64)
            step[1:] = self.BASE
            back = np.ones(n, dtype=np.uint64)
            back[1:] = self.inverse
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.words(text)[3]

    def words(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the text with capitals lowered, where words start and end, and their hashes."""
        raw = self.lower[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        gap = np.ones(len(raw) + 2, dtype=bool)
        gap[1:-1] = self.gap[raw]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return raw, starts, ends, np.empty(0, dtype=np.uint64)
        self._grow(len(raw) + 1)
        with np.errstate(over="ignore"):
            value = self.mix[raw] * self.up[: len(raw)]
            value[gap[1:-1]] = 0
            total = np.add.reduceat(value, starts) * self.down[starts]
            return raw, starts, ends, mix64(total + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words give one hash of the whole, none give none."""
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9DDFEA08EB382D69) + words[i : i + len(out)]
            out ^= out >> np.uint64(29)
    return mix64(out)
