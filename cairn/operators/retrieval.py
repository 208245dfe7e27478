"""Vector and BM25 retrieval, score fusion and what follows it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn import ship
from cairn.functions import text as X
from cairn.operators import facets
from cairn.sources.store import kept_rows

#: Vectors of a block, and bytes of its matrix, at most; rows of queries that are multiplied at once.
BLOCK, BLOCK_BYTES, ROWS = 2048, 2 << 20, 64
#: Digits of the cosines that are ranked, so that equal vectors are level wherever they lie.
DIGITS = 12
#: Blocks of queries that are sent to all tasks, at most, and blocks whose best a task holds.
FEW_BLOCKS, HELD_BLOCKS = 8, 64
_FOUND = "query string, id string, score double"


def unit(vectors: pa.Array) -> np.ndarray:
    """A list array of vectors of one length as rows of length 1; those of length 0 stay."""
    sizes = pc.list_value_length(vectors)
    if len(vectors) and pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors of different lengths")
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def block_rows(dimension: int, most: int = BLOCK) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * max(dimension, 1))))


def _packed(rows: DataFrame, key: str, vector: str, block: int, more: str | None = None) -> DataFrame:
    """(nr, ids, matrix): vectors of unit length in the order of their ids, so many to a row; with a column of numbers beside the ids if asked for."""

    def pack(batches):
        nr = TaskContext.get().partitionId() << 32
        for batch in batches:
            whole = unit(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            size = block_rows(whole.shape[1], block)
            for lo in range(0, len(whole), size):
                part = batch.slice(lo, size)
                order = pc.sort_indices(part.column(0))
                columns = {"nr": pa.array([nr]), "ids": pa.array([part.column(0).take(order).to_pylist()], pa.list_(pa.string())), "matrix": pa.array([whole[lo : lo + size][order.to_numpy()].tobytes()], pa.binary())}
                if more:
                    columns["more"] = pa.array([part.column(2).take(order).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
                nr += 1

    ship(rows.sparkSession)
    whole = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(more)] if more else []))
    return whole.mapInArrow(pack, "nr long, ids array<string>, matrix binary" + (", more array<int>" if more else ""))


def _nth(groups: np.ndarray) -> np.ndarray:
    """Places of the elements in their runs of equal ones."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


class _Best:
    """The best of each query of a block among the blocks of vectors that a task has met.

    Products in single precision say which pairs may be among the best; the cosines of these are in double precision.
    """

    def __init__(self, q_ids: list[str], most: np.ndarray, q: np.ndarray, floor: float):
        self.q_ids, self.most, self.q, self.single = q_ids, most, q, q.astype(np.float32)
        self.bar = np.full(len(q_ids), floor)
        self.parts, self.n, self.fresh = [], 0, True

    def add(self, ids: list[str], m: np.ndarray, digits: int, searched: np.ndarray | None = None) -> None:
        """ids are in order; searched says which queries look at which vectors."""
        names, single = np.array(ids), np.ascontiguousarray(m.astype(np.float32).T)
        error = 1.2e-7 * (m.shape[1] + 4)  # of a product in single precision, at most
        for lo in range(0, len(self.q), ROWS):
            s = self.single[lo : lo + ROWS] @ single
            if searched is not None:
                s[~searched[lo : lo + ROWS]] = -np.inf
            most, bar = self.most[lo : lo + ROWS], self.bar[lo : lo + ROWS]  # bar is a part of the array that stays
            if self.fresh and most.max() < len(ids):
                np.maximum(bar, np.partition(s, len(ids) - most.max(), axis=1)[:, len(ids) - most.max()] - error, out=bar)
            limit = np.maximum(bar, -2.0) - error - 10.0**-digits
            i, j = np.divmod(np.flatnonzero(s >= limit[:, None].astype(np.float32)), len(ids))
            if not len(i):
                continue
            score = np.round(np.einsum("ij,ij->i", self.q[i + lo], m[j]), digits)
            if (np.bincount(i, minlength=len(most)) > 4 * most).any():  # many are level, and the first by id do
                order = np.lexsort((j, -score, i))
                order = order[_nth(i[order]) < most[i[order]]]
                i, j, score = i[order], j[order], score[order]
            self.parts.append((i + lo, score, names[j]))
            self.n += len(i)
        self.fresh = False
        if self.n > 2 * self.most.sum():
            self.cut()

    def cut(self) -> None:
        """Keep the best, ties by id, and set the bar of the queries that have all they ask for."""
        if not self.parts:
            return
        i, score, names = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((names, -score, i))
        i, score, names = i[order], score[order], names[order]
        nth = _nth(i)
        last = nth == self.most[i] - 1
        self.bar[i[last]] = np.maximum(self.bar[i[last]], score[last])
        keep = nth < self.most[i]
        self.parts, self.n = [(i[keep], score[keep], names[keep])], int(keep.sum())

    def rows(self) -> pa.RecordBatch:
        self.cut()
        i, score, names = self.parts[0] if self.parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, "U1"))
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids, pa.string()).take(pa.array(i)), pa.array(names.tolist(), pa.string()), pa.array(score)], ["query", "id", "score"])


def best_of_pairs(k: int, digits: int, floor: float, lists: bool = False):
    """A function from pairs of blocks (nr, q_ids, more, q, ids, matrix) to (query, id, score): the best that a task has for each query.

    What leaves a task is in proportion to its queries, not to the pairs.  With lists there are two more columns: the lists that each
    query looks into, as bits, and the list of each vector.
    """

    def run(batches):
        held: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                nr, q_ids, more, q, ids, matrix, *both = (c[row].as_py() for c in batch.columns)
                if nr not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield held.pop(next(iter(held))).rows()
                    held[nr] = _Best(q_ids, k + np.array(more), np.frombuffer(q).reshape(len(q_ids), -1), floor)
                searched = None
                if lists:
                    bits = np.frombuffer(both[0], np.uint8).reshape(len(q_ids), -1)
                    searched = np.unpackbits(bits, axis=1)[:, np.array(both[1])].astype(bool)
                held[nr].add(ids, np.frombuffer(matrix).reshape(len(ids), -1), digits, searched)
        for own in held.values():
            yield own.rows()

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", block: int = BLOCK, digits: int | None = None, own_k: str | None = None, floor: float = -2.0) -> DataFrame:
    """(query, id, score, nth): the k vectors with the largest cosine for each query, ties by id; exact.

    A stated set of queries meets all vectors in blocks: pairs of blocks are multiplied, and only the best of each task leave
    it.  A few blocks of queries are sent to all tasks; more of them meet the vectors' blocks, written once, partition by partition,
    without a shuffle.  A vector of length 0 has a cosine of 0.  digits rounds the scores before they are ranked, by default to
    DIGITS; own_k is a column of queries that is added to k, so that a query asks for as many as it needs itself.  Scores
    under floor may be left out; this changes no place of the others.
    """
    digits = DIGITS if digits is None else digits
    asked = queries.withColumn("_more", F.col(own_k).cast("int") if own_k else F.lit(0))
    one = kept_rows(_packed(asked, key, vector, block, "_more").withColumnsRenamed({"ids": "q_ids", "matrix": "q"}), "query-blocks")
    two = _packed(vectors, key, vector, block).drop("nr")
    few = one.count() <= FEW_BLOCKS
    pairs = F.broadcast(one).crossJoin(two) if few else one.crossJoin(kept_rows(two, "blocks"))  # of blocks; or FEW_BLOCKS * BLOCK_BYTES at most
    found = pairs.select("nr", "q_ids", "more", "q", "ids", "matrix").mapInArrow(best_of_pairs(k, digits, floor), _FOUND)
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    if own_k:
        limits = one.select(F.explode(F.arrays_zip("q_ids", "more")).alias("x")).select(F.col("x.q_ids").alias("query"), F.col("x.more").alias("_more"))
        return found.join(limits, "query").where(F.col("nth") <= k + F.col("_more")).drop("_more")
    return found.where(F.col("nth") <= k)


def similar_documents(nodes: DataFrame, k: int, threshold: float, anchors: DataFrame | None = None, digits: int | None = None, near=nearest) -> DataFrame:
    """(a, b, score): for each document the k most similar of those whose url is larger.

    nodes has (node_id, ref_doc_id, embedding).  Each node of a document asks for k + (number of own nodes) nodes; then
    own nodes, scores under the threshold and smaller urls are dropped, and the best node counts.  near is the search for the
    nearest nodes: exact by default, or that of an index.  Nodes are written once, so that no embedding is made twice.
    """
    nodes = kept_rows(nodes.select("node_id", "ref_doc_id", "embedding"), "nodes")
    asked = nodes if anchors is None else nodes.join(anchors.select(F.col("url").alias("ref_doc_id")), "ref_doc_id", "left_semi")
    own = asked.groupBy("ref_doc_id").agg(F.count("*").alias("n_own"))
    found = near(asked.join(own, "ref_doc_id"), nodes, k, "node_id", own_k="n_own", digits=digits, floor=threshold)
    names = nodes.select(F.col("node_id").cast("string").alias("node_id"), F.col("ref_doc_id").alias("doc"))
    found = found.join(names.withColumnsRenamed({"node_id": "query", "doc": "a"}), "query").join(names.withColumnsRenamed({"node_id": "id", "doc": "b"}), "id")
    found = found.where((F.col("score") >= threshold) & (F.col("b") > F.col("a")))
    best = found.groupBy("a", "b").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return best.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 25, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, id, score, nth) of the k best documents (id, text) for each query (query, text), without an index.

    The texts are read twice: for the lengths, and for the words that are asked for.  See bm25_index for texts that are
    searched more than once.
    """
    words = docs.select("id", X.tokens(F.col("text")).alias("w")).select("id", F.size("w").alias("length"), "w")
    size = words.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    terms = queries.select("query", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    asked = words.select("id", "length", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = asked.join(df, "term").crossJoin(F.broadcast(size)).select("term", "id", score.alias("s"))  # size is one row
    sums = scored.join(terms, "term").groupBy("query", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return ranked(sums).where(F.col("nth") <= k)


def ranked(scores: DataFrame) -> DataFrame:
    """scores (query, id, score) with the place nth in the query, the best first, ties by id."""
    return scores.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))


def normalized(scores: DataFrame, mode: str = "relative_score") -> DataFrame:
    """scores (query, retriever, id, score) plus norm: position between minimum and maximum of the query and retriever, or between
    the mean less and plus three deviations.  Equal bounds give 1 if the maximum is above 0, else 0."""
    w = Window.partitionBy("query", "retriever")
    if mode == "relative_score":
        low, high = F.min("score").over(w), F.max("score").over(w)
    elif mode == "dist_based_score":
        mean, spread = F.avg("score").over(w), F.stddev_pop("score").over(w)
        low, high = mean - 3 * spread, mean + 3 * spread
    else:
        raise ValueError(f"no such mode: {mode}")
    rows = scores.withColumn("low", low).withColumn("high", high)
    norm = F.when(F.col("high") == F.col("low"), F.when(F.col("high") > 0, 1.0).otherwise(0.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return rows.withColumn("norm", norm).drop("low", "high")


def fused(scores: DataFrame, weights: dict[str, float], k: int = 40, mode: str = "relative_score") -> DataFrame:
    """(query, id, score, nth): weighted sums of normalised scores, the k best of each query."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("retriever"))
    sums = normalized(scores, mode).groupBy("query", "id").agg(F.round(F.sum(F.col("norm") * weight), 9).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return sums.withColumn("nth", nth).where(F.col("nth") <= k)


def folded(results: DataFrame) -> DataFrame:
    """Results (query, id, parent, score) in which chunks whose parent was found too add their score to it and go."""
    parents = results.select("query", F.col("id").alias("parent"), F.lit(True).alias("found"))
    rows = results.join(parents, ["query", "parent"], "left").withColumn("child", F.coalesce("found", F.lit(False)) & (F.col("parent") != F.col("id")))
    to = F.when(F.col("child"), F.col("parent")).otherwise(F.col("id"))
    return rows.groupBy("query", to.alias("id")).agg(F.round(F.sum("score"), 9).alias("score"), F.max(F.when(~F.col("child"), F.col("parent"))).alias("parent"))


def with_parents(results: DataFrame) -> DataFrame:
    """(query, id, parent, score) of the results (query, id, parent, score) whose parent was found too, with both scores added."""
    parents = results.select("query", F.col("id").alias("parent"), F.col("score").alias("parent_score"))
    rows = results.where("id <> parent").join(parents, ["query", "parent"])
    return rows.select("query", "id", "parent", (F.col("score") + F.col("parent_score")).alias("score"))


def reranked(results: DataFrame, cutoff: float = 0.2, k: int = 30, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Results of at least the cutoff, the best first and k of each query; scorer may replace the scores that order them."""
    kept = results.where(F.col("score") >= cutoff)
    kept = scorer(kept) if scorer else kept
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= k)


def search(vector_scores: DataFrame, bm25_scores: DataFrame, catalogue: DataFrame, *, weights: tuple[float, float] = (0.6, 0.4), mode: str = "relative_score", fused_k: int = 40, cutoff: float = 0.2, k: int = 30, scorer=None) -> DataFrame:
    """Fusion, folding, cutoff, ranking and catalogue records; results that the catalogue lacks drop out.

    Scores have (query, id, parent, score).
    """
    both = vector_scores.withColumn("retriever", F.lit("vector")).unionByName(bm25_scores.withColumn("retriever", F.lit("bm25")))
    parents = both.select("id", "parent").distinct()
    found = fused(both.select("query", "retriever", "id", "score"), {"vector": weights[0], "bm25": weights[1]}, fused_k, mode)
    ranked = reranked(folded(found.join(parents, "id").select("query", "id", "parent", "score")), cutoff, k, scorer)
    return ranked.join(catalogue, ranked["parent"] == catalogue["url"]).drop("parent")


def filtered_search(index, queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, datasets: DataFrame, selected: dict[str, list[str]], *, vector_k: int = 25, bm25_k: int = 25, **options) -> tuple[DataFrame, DataFrame]:
    """(results, facets) of a search among the datasets that have every selected value.

    The filter narrows what both retrievers may find before they take their best, so that a filter that few datasets pass still
    gives full lists, and scores are normalised among what may be shown.  index is a Bm25Index of the datasets' urls;
    query_vectors (id, embedding) and vectors (id, embedding) have the queries' names and the datasets' urls.  facets (query,
    facet, value, n) are those of the results, for which the selected values are live or not.
    """
    allowed = facets.filtered(datasets, selected).select(F.col("url").alias("id"))
    words = index.top_k(queries, bm25_k, within=allowed if facets.any_selected(selected) else None)
    near = nearest(query_vectors, vectors.join(allowed, "id", "left_semi"), vector_k).withColumn("score", F.round("score", 9))
    whole = lambda found: found.select("query", "id", F.col("id").alias("parent"), "score")
    results = search(whole(near), whole(words), datasets, **options)
    return results, facets.facet_counts(results, ["query"])


def hashed_embedding(column, size: int = 64):
    """Deterministic stand-in for an embedding model: signed counts of hashed tokens."""
    parts = F.transform(X.tokens(column), lambda t: F.xxhash64(t))
    zero = F.array_repeat(F.lit(0.0), size)
    add = lambda acc, h: F.transform(acc, lambda v, i: v + F.when(i == F.pmod(h, F.lit(size)), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.aggregate(parts, zero, add)
