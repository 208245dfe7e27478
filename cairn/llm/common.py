"""Shared parts of the text operators: staging tables, document batches and rolling word hashes.

Staging tables live in the folder that the session names in ``spark.checkpoint.dir``, which the driver
and all executors can reach.  Writing a table there cuts the lineage: a lost executor costs the running
stage, never the finished ones.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}

U64 = np.uint64
#: Odd multiplier of the rolling word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors; a temporary one only in plain local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _LOCAL["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; its path is kept in ``staged_path``."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def committed(df: DataFrame, folder: str) -> DataFrame:
    """Write df as the manifest of a folder of files: whole under a temporary name beside them, then renamed.

    A folder without `manifest` is unfinished, and files that its manifest does not list are leftovers.
    """
    spark = df.sparkSession
    path = f"{folder}/_manifest-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{folder}/manifest"))
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"cannot commit the manifest of {folder}")
    return spark.read.schema(df.schema).parquet(f"{folder}/manifest")


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads, and let Spark drop finished shuffle files."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop finished shuffle files, which stay on disk until the driver collects its garbage; a few times a query at most."""
    spark._jvm.System.gc()


def file_system(uri: str):
    """(pyarrow file system, path in it) for a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most this many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


# ---------------------------------------------------------------- sums in an order


def scanned(rows: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """rows with their number in an order that tells them apart, and for each of sums its sum over the rows before.

    Rows are dealt by ranges of the order; only the totals of the ranges meet.
    """
    parts = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    totals = parts.groupBy("part").agg(F.expr("count(*) AS number"), *(F.expr(f"sum({c}) AS {c}") for c in sums))
    ranges = "OVER (PARTITION BY 0 ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"  # one row for each partition
    totals = totals.selectExpr("part", *(f"coalesce(sum({c}) {ranges}, 0L) AS all_{c}" for c in ["number", *sums]))
    here = f"OVER (PARTITION BY part ORDER BY {', '.join(order)}"
    own = [f"row_number() {here}) - 1 AS number", *(f"coalesce(sum({c}) {here} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS {c}_before" for c in sums)]
    placed = parts.selectExpr("*", *own).join(F.broadcast(totals), "part")
    return placed.selectExpr(*rows.columns, "number + all_number AS number", *(f"{c}_before + all_{c} AS {c}_before" for c in sums))


# ---------------------------------------------------------------- ranges of ids

#: Ranges at most: their bounds (33 bytes each) are a literal of every task.
MOST_RANGES = 1 << 16


def range_key(number, tie):
    """A string that sorts as (number, nulls first, tie), for two long columns."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(number.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), digits(number))), digits(tie))


def range_bounds(slim: DataFrame, range_bytes: int, most: int = MOST_RANGES) -> list[str]:
    """The keys at which ranges of range_bytes begin, from slim (key string, bytes long); the first range has none.

    Exact quantiles of the running sum of bytes, so that neither outlying ids nor the partitioning of slim matter.
    Where that would give more than `most` ranges, they get larger.  Rows of one key stay together.
    """
    rows, total = slim.agg(F.count("*"), F.sum("bytes")).first()
    if not total or total <= range_bytes:
        return []
    parts = staged(slim.repartitionByRange(max(8, rows >> 20), "key").withColumn("part", F.spark_partition_id()), "range-parts")
    sums = parts.groupBy("part").agg(F.sum("bytes").alias("own"))  # one row for each partition
    sums = staged(sums.select("part", (F.sum("own").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("own")).alias("before")), "range-sums")
    here = F.sum("bytes").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    per = max(range_bytes, -(-total // most))
    placed = parts.select("key", "part", here.alias("here")).join(F.broadcast(sums), "part").select("key", F.floor((F.col("here") + F.col("before")) / per).alias("range"))
    bounds = sorted({r["key"] for r in placed.groupBy("range").agg(F.min("key").alias("key")).where("range > 0").collect()})  # `most` rows at most
    unstage(parts, sums)
    return bounds


def range_of(key, bounds: list[str]):
    """Number of the range of a key, by binary search in the bounds."""
    if not bounds:
        return F.lit(0)
    every = F.split(F.lit(",".join(bounds)), ",")  # folded to one literal
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(every, at + step - 1) <= key, at + step).otherwise(at))


# ---------------------------------------------------------------- document batches


def document_groups(batches: Iterable[pa.RecordBatch], column: int = 1, most_bytes: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of Arrow batches whose texts have about most_bytes in all (or are one text), with the texts as UTF-8."""
    for batch in batches:
        texts = batch.column(column)
        texts = (texts if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


class WordHashes(dict):
    """64-bit hash of a word; remembers the most recent words, at most `most` of them."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list[bytes | None], seen: WordHashes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts in one array, and where each text begins in it.

    bytes.split() parts at exactly these six ASCII characters and bytes.lower() changes A-Z only.
    """
    words: list[bytes] = []
    at = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += t.lower().split() if lower else t.split()
        at[i + 1] = len(words)
    return np.fromiter(map(seen.__getitem__, words), U64, len(words)), at


# ---------------------------------------------------------------- rolling hashes


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finalizer."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for base in (BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        have = _POWERS[0] = (both[0], both[1])
    return have


class Rolling:
    """Hash of any run of words: sums of word hash times BASE**i modulo 2**64, moved to position 0."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * self.up[: len(words)], dtype=U64, out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Mixed hash of each run of `size` words."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


#: Bytes of words that are hashed together, and 64-bit numbers of the bytes, A-Z as a-z.
_HASHED_BYTES = 1 << 18
_LETTERS = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(U64))
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def lower_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes of lower-cased texts, with other hashes: rolling ones over the bytes of all words at once, so that rare words cost no more than others."""
    data = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACES[data].view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    at = np.searchsorted(starts, np.cumsum([0, *(len(t or b"") + 1 for t in texts)]))
    out, i = np.zeros(len(starts), U64), 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + _HASHED_BYTES, "right"))
        if j > i:
            out[i:j] = Rolling(_LETTERS[data[lo : ends[j - 1]]]).spans(starts[i:j] - lo, ends[i:j] - lo)
        else:  # one very long word
            j = i + 1
            out[i] = xxhash.xxh3_64_intdigest(data[lo : ends[i]].tobytes().lower())
        i = j
    return out, at


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(node, component) for all ends of the edges; component is the smallest node that can be reached.

    Each round hooks every node's root to the smallest root among its neighbours and then jumps
    pointers (root of root), so that a path of n nodes needs O(log n) rounds.  Rounds are staged
    tables; the driver only learns how many nodes still changed.  Joins read staged tables on both
    sides, so adaptive execution may split a node that has most of the edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = staged(pairs.union(pairs.select("v", "u")).distinct(), f"{name}-edges")
    label = staged(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")), f"{name}-labels")
    while True:
        # the smallest root in each node's neighbourhood is proposed to the node and to its root
        near = pairs.join(label.select(F.col("u").alias("v"), F.col("root").alias("other")), "v").select("u", "other")
        told = label.join(near.groupBy("u").agg(F.min("other").alias("least")), "u").select("u", "root", F.least("root", "least").alias("least"))
        told = staged(told, f"{name}-told")
        hooks = told.where("least < root").groupBy("root").agg(F.min("least").alias("hook"))
        hooked = staged(told.select("u", F.col("least")).join(hooks.select(F.col("root").alias("u"), "hook"), "u", "left").select("u", F.least("least", F.coalesce("hook", "least")).alias("parent")), f"{name}-hooked")
        up = hooked.select(F.col("u").alias("parent"), F.col("parent").alias("grand"))
        after = staged(hooked.join(up, "parent").select("u", F.col("grand").alias("root")), f"{name}-labels")
        changed = not after.join(label.withColumnRenamed("root", "before"), "u").where("root <> before").isEmpty()
        unstage(told, hooked, label)
        label = after
        if not changed:
            unstage(pairs)
            return label.select(F.col("u").alias("node"), F.col("root").alias("component"))
