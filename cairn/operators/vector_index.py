"""An inverted file of vectors: every vector in the list of its nearest centre, searched in the lists nearest to a query.

Centres are fitted on a bounded sample, as is the number of lists to look into for a recall; every vector is indexed.  Vectors lie in packed blocks of a Parquet table,
sorted by list, each with the number of its list, so that a search reads blocks, not rows.  Scores are exact cosines; what may be missing are neighbours in lists
that a query does not look into.  With as many probes as lists the result is that of an exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import ship
from cairn.operators.retrieval import DIGITS, best_of_pairs, block_rows, unit
from cairn.sources.store import Store, Table, kept_rows

#: Vectors of the sample that centres are fitted on, and steps of fitting.
SAMPLE, STEPS = 100_000, 12
#: Lists for each root of the number of vectors, and lists at most: their centres are a literal of every task.
LISTS_PER_ROOT, MOST_LISTS = 2.0, 16_384
_BLOCKS = "lists array<int>, ids array<string>, matrix binary"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def centres(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centres by the cosine; a centre without vectors takes one that is far from its own."""
    random = np.random.default_rng(seed)
    x = _unit(np.asarray(sample, np.float64))
    lists = min(lists, len(x))
    c = x[random.choice(len(x), lists, replace=False)]
    for _ in range(STEPS):
        best, score = _nearest_centres(x, c, 1)
        best, score = best[:, 0], score[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        sums[empty] = x[np.argsort(score, kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def _nearest_centres(x: np.ndarray, c: np.ndarray, n: int, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n centres with the largest cosines for each row, best first, and the cosines."""
    out, scores = np.zeros((len(x), n), np.int64), np.zeros((len(x), n))
    for lo in range(0, len(x), rows):
        s = x[lo : lo + rows] @ c.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
        own = np.take_along_axis(s, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        out[lo : lo + rows], scores[lo : lo + rows] = np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)
    return out, scores


def probes_for(sample: np.ndarray, c: np.ndarray, recall: float, near: int = 10, queries: int = 256) -> int:
    """How many lists a query looks into to meet that share of its nearest vectors, from vectors of the sample asked against all of it.

    Neighbours in a sample are farther than among all vectors, so this is on the safe side.
    """
    x = _unit(np.asarray(sample, np.float64))
    asked = x[np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)]
    lists = _nearest_centres(x, c, 1)[0][:, 0]
    best = _nearest_centres(asked, x, min(near + 1, len(x)))[0]  # with the query itself
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, lists[best], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def _assigned(fitted: np.ndarray):
    """A function from rows (id, v, and what follows) to (list, id, v as bytes of a unit vector, and what follows)."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(1))
                more = batch.columns[2:]
                yield pa.RecordBatch.from_arrays([pa.array(_nearest_centres(x, fitted, 1)[0][:, 0], pa.int32()), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), *more], ["list", "id", "v", "more"][: 3 + len(more)])

    return assign


class VectorIndex:
    """An index of vectors (key, embedding) in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder, {"lists": Table(())})
        ship(spark)

    def build(self, vectors: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, recall: float = 0.97, seed: int = 0) -> VectorIndex:
        """Index all vectors; null ones are left out, ones of length 0 are in some list.

        The sample has that many vectors at most.  recall is what the number of lists for a query is fitted to.
        """
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = rows.count()
        lists = lists or int(min(MOST_LISTS, max(1, LISTS_PER_ROOT * n**0.5)))
        some = rows if n <= sample else rows.sample(min(1.0, 1.2 * sample / n), seed).limit(sample)
        taken = np.array([r["v"] for r in some.collect()], np.float64) if n else np.zeros((0, 1))  # the bounded sample
        fitted = centres(taken, lists, seed) if len(taken) else taken
        probes = probes_for(taken, fitted, recall) if len(taken) else 0
        lists = len(fitted)

        def pack(batches):
            held: list = [[], [], []]

            def block():
                names = np.array(held[1])
                order = np.argsort(names, kind="stable")
                return pa.RecordBatch.from_pydict({"lists": pa.array([np.array(held[0])[order]], pa.list_(pa.int32())), "ids": pa.array([names[order].tolist()], pa.list_(pa.string())), "matrix": pa.array([b"".join(held[2][i] for i in order)], pa.binary())})

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for own, x in zip(held, row, strict=True):
                        own.append(x)
                    if len(held[1]) >= size:
                        yield block()
                        held = [[], [], []]
            if held[1]:
                yield block()

        size = block_rows(fitted.shape[1] if lists else 1)
        if lists:
            placed = rows.mapInArrow(_assigned(fitted), "list int, id string, v binary")
            # by list and id, so that a list with a third of all vectors lies in many partitions
            packed = placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(pack, _BLOCKS)
        else:
            packed = self.spark.createDataFrame([], _BLOCKS)
        self.store.commit({"lists": packed}, facts={"centres": fitted.tolist(), "vectors": n, "probes": probes})
        return self

    def nearest(self, queries: DataFrame, vectors: DataFrame | None, k: int, key: str = "id", vector: str = "embedding", digits: int | None = None, own_k: str | None = None, probes: int | None = None, floor: float = -2.0) -> DataFrame:
        """(query, id, score, nth) as retrieval.nearest, from the lists whose centres are nearest to each query.

        probes is the number of lists that a query looks into, by default that fitted to the recall.  vectors is not read: the index has
        them.  Queries of one list lie together in blocks, and a block meets those of the index that have a list which one of its
        queries looks into; no vector is sent once for each list.
        """
        record = self.store.record()
        fitted = np.array(record.facts["centres"])
        lists = self.store.read("lists", record.number)
        if not len(fitted):
            return self.spark.createDataFrame([], "query string, id string, score double, nth int")
        probes, digits = min(len(fitted), probes or record.facts["probes"]), DIGITS if digits is None else digits
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(own_k).cast("int") if own_k else F.lit(0)).alias("more"))
        placed = asked.mapInArrow(_assigned(fitted), "list int, id string, v binary, more int").repartitionByRange("list", "id").sortWithinPartitions("list", "id")
        size = block_rows(fitted.shape[1])

        def probe(batches):
            nr = TaskContext.get().partitionId() << 32
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    q = b"".join(part.column(2).to_pylist())
                    bits = np.zeros((part.num_rows, len(fitted)), bool)
                    np.put_along_axis(bits, _nearest_centres(np.frombuffer(q).reshape(part.num_rows, -1), fitted, probes)[0], True, 1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "nr": pa.array([nr]),
                            "q_ids": pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                            "more": pa.array([part.column(3).to_pylist()], pa.list_(pa.int32())),
                            "q": pa.array([q], pa.binary()),
                            "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
                            "probed": pa.array([np.flatnonzero(bits.any(axis=0))], pa.list_(pa.int32())),
                        }
                    )
                    nr += 1

        one = kept_rows(placed.mapInArrow(probe, "nr long, q_ids array<string>, more array<int>, q binary, bits binary, probed array<int>"), "query-blocks")
        pairs = one.crossJoin(lists).where(F.arrays_overlap("probed", "lists"))  # of blocks
        found = pairs.select("nr", "q_ids", "more", "q", "ids", "matrix", "bits", "lists").mapInArrow(best_of_pairs(k, digits, floor, lists=True), "query string, id string, score double")
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
        if own_k:
            limits = one.select(F.explode(F.arrays_zip("q_ids", "more")).alias("x")).select(F.col("x.q_ids").alias("query"), F.col("x.more").alias("more"))
            return found.join(limits, "query").where(F.col("nth") <= k + F.col("more")).drop("more")
        return found.where(F.col("nth") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query, id) that were found."""
    n = exact.count()
    return exact.join(found.select("query", "id"), ["query", "id"], "left_semi").count() / n if n else 1.0
