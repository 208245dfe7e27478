"""Models behind callables: embeddings, cross-encoders and completions in Arrow batches, with answers kept in a table.

A factory makes the model once in each Python worker, so that weights are loaded as often as there are workers.  Every
operator here leaves it to Spark which task runs where: rows are batched inside tasks, and what must not be asked twice is in
a table that is read before asking.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as CallTimeout

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import ship

#: Texts to vectors, one for each; pairs of texts to scores; a prompt to a text.
Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Complete = Callable[[str], str]

_MODELS: dict[str, object] = {}


def _once(name: str, make: Callable[[], object]) -> object:
    """The model of this worker; another name takes its place."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = make()
    return _MODELS[name]


def _in_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of exactly size rows, across the borders of Arrow batches, and one with the rest."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            rest = table.slice(size)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- embeddings


class HashedTokens:
    """A deterministic stand-in for an embedding model: signed counts of tokens, placed by their MD5."""

    def __init__(self, dimension: int):
        self.dimension, self.seen = dimension, _Places(dimension)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out, n = [], self.dimension
        for t in texts:
            if len(self.seen) > 200_000:
                self.seen.clear()
            counts = np.bincount(np.fromiter(map(self.seen.__getitem__, words_of(t)), np.int64), minlength=2 * n)
            out.append((counts[:n] - counts[n:]).astype(float).tolist())
        return out


class _Places(dict):
    """The entry of a token, and beyond the dimension for those that count negatively."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, token: str) -> int:
        h = hashlib.md5(token.encode()).hexdigest()
        at = self[token] = int(h[:4], 16) % self.dimension + (0 if h[4] < "8" else self.dimension)
        return at


class _LettersAndDigits(dict):
    """Letters and digits as they are, all other characters as spaces."""

    def __missing__(self, code: int) -> int:
        at = self[code] = code if regex.match(r"[\p{L}\p{N}]", chr(code)) else 32
        return at


_KEPT = _LettersAndDigits()


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as cairn.functions.text.tokens has them."""
    return text.lower().translate(_KEPT).split()


def embedded(nodes: DataFrame, model: Callable[[], Embedder], dimension: int, batch: int = 100, name: str | None = None) -> DataFrame:
    """nodes (node_id, ref_doc_id, text) with their embedding as array<float>; other columns stay.

    The model is called with batch texts at a time, across the borders of Arrow batches.  A vector of another
    length, a number that is not finite or a missing vector fails the run: half an index is worse than none.  A null text is
    embedded as an empty one.
    """
    name = name or uuid.uuid4().hex
    at = nodes.columns.index("text")

    def run(batches):
        own = _once(name, model)
        for rows in _in_batches(batches, batch):
            vectors = own([t or "" for t in rows.column(at).to_pylist()])
            if len(vectors) != rows.num_rows:
                raise ValueError(f"{len(vectors)} vectors for {rows.num_rows} texts")
            for v in vectors:
                if len(v) != dimension or not all(map(math.isfinite, v)):
                    raise ValueError(f"a vector has {len(v)} entries, wanted {dimension} finite ones")
            yield from rows.append_column("embedding", pa.array(vectors, pa.list_(pa.float32()))).to_batches()

    ship(nodes.sparkSession)
    return nodes.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), "embedding array<float>"]))


# ---------------------------------------------------------------- cross-encoders


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's tokens that the text has."""
    out = []
    for query, text in pairs:
        q = set(words_of(query))
        out.append(len(q & set(words_of(text))) / len(q) if q else 0.0)
    return out


def cross_encoded(results: DataFrame, queries: DataFrame, docs: DataFrame, model: Callable[[], Scorer], cutoff: float = 0.2, k: int = 30, batch: int = 32, name: str | None = None) -> DataFrame:
    """Results (query, id, score) of at least the cutoff, ordered by a scorer of pairs: query, id, retrieval, score, nth.

    Texts come from queries (query, text) and docs (id, text); a result without a text is scored against an empty one.  Pairs
    are scored in batches of about the same length, the longest first.  Ties go by the retrieval score, then by id.  If the scorer
    fails on a batch, its pairs are tried one by one, and a pair that fails alone, or has no finite score, stands behind all
    scored ones in the order of its retrieval score, with a null score.
    """
    name = name or uuid.uuid4().hex
    kept = results.where(F.col("score") >= cutoff).select("query", "id", F.col("score").alias("retrieval"))
    pairs = kept.join(queries.select("query", F.col("text").alias("q_text")), "query", "left").join(docs.select("id", F.col("text").alias("d_text")), "id", "left")
    pairs = pairs.select("query", "id", "retrieval", F.coalesce("q_text", F.lit("")).alias("q_text"), F.coalesce("d_text", F.lit("")).alias("d_text"))

    def tried(own: Scorer, some: list[tuple[str, str]]) -> list[float | None]:
        try:
            scores = list(own(some))
            if len(scores) == len(some):
                return [float(s) if s is not None and math.isfinite(s) else None for s in scores]
        except Exception:  # noqa: BLE001 - whatever a model raises
            pass
        return [None] if len(some) == 1 else [x for p in some for x in tried(own, [p])]

    def run(batches):
        own = _once(name, model)
        for rows in batches:
            texts = list(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True))
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]) - len(texts[i][1]))
            scores: list[float | None] = [None] * len(texts)
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                for i, s in zip(some, tried(own, [texts[i] for i in some]), strict=True):
                    scores[i] = s
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(scores, pa.float64())], ["query", "id", "retrieval", "score"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    ship(pairs.sparkSession)
    scored = pairs.mapInArrow(run, f"query {kind['query']}, id {kind['id']}, retrieval {kind['retrieval']}, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), F.desc("retrieval"), "id"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k)


# ---------------------------------------------------------------- answers that are kept


class Answers:
    """A table of answers by model, kind of question and text, read before a model is asked.

    New answers are appended in one Parquet write, whose files appear together; a run that fails before it leaves
    nothing, and one that is tried again finds what the first has written, so that no text is asked for twice.  Two runs that write at
    the same time may both ask for a text; then the smaller answer counts, for both and ever after.
    """

    SCHEMA = "model string, kind string, hash string, text string, answer string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def of(self, texts: DataFrame, model: str, kind: str, make: Callable[[], Complete], retries: int = 3, timeout: float | None = None, threads: int = 4) -> DataFrame:
        """(text, answer) of the distinct texts (text); only those without an answer are asked for, and their answers kept.

        An answer is a JSON object; after so many tries without one, or beyond the time, it is {}, which is not kept, so that a
        later run asks again.
        """
        asked = texts.select("text").where("text is not null").distinct().withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
        own = (F.col("model") == model) & (F.col("kind") == kind)
        known = self.read().where(own).select("hash").distinct()
        found = answered(asked.join(known, "hash", "left_anti").select("hash", "text"), make, retries, timeout, threads)
        stage = found.select(F.lit(model).alias("model"), F.lit(kind).alias("kind"), "hash", "text", "answer")
        stage.where("answer <> '{}'").write.mode("append").parquet(self.folder)
        kept = self.read().where(own).groupBy("hash").agg(F.min("answer").alias("answer"))
        return asked.join(kept, "hash", "left").select("text", F.coalesce("answer", F.lit("{}")).alias("answer"))


def answered(asked: DataFrame, make: Callable[[], Complete], retries: int = 3, timeout: float | None = None, threads: int = 4, name: str | None = None) -> DataFrame:
    """asked with the answer to its column text: a JSON object, or {} after so many tries or beyond the time of a call.

    A task has at most `threads` calls under way.  A call that takes longer than timeout seconds is left behind and
    tried again.
    """
    name = name or uuid.uuid4().hex
    at = asked.columns.index("text")

    def run(batches):
        call = _once(name, make)
        pool = ThreadPoolExecutor(threads)

        def one(first, text: str) -> str:
            for turn in range(retries):
                try:
                    said = (first if not turn else pool.submit(call, text)).result(timeout)
                    if isinstance(json.loads(said), dict):
                        return said
                except (CallTimeout, TimeoutError, ValueError, TypeError):
                    continue
            return "{}"

        try:
            for rows in _in_batches(batches, threads):
                texts = [t or "" for t in rows.column(at).to_pylist()]
                calls = [pool.submit(call, t) for t in texts]
                yield from rows.append_column("answer", pa.array([one(c, t) for c, t in zip(calls, texts, strict=True)], pa.string())).to_batches()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    ship(asked.sparkSession)
    return asked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema), "answer string"]))


def enriched_in_chunks(datasets: DataFrame, enrich: Callable[[DataFrame], DataFrame], stage: str, key: str = "url", size: int = 32, at_once: int = 64) -> DataFrame:
    """enrich(rows) over chunks of size rows in key order, kept as they are done: a run that stopped goes on with the first chunk
    that is not there.  All rows, enriched.

    at_once chunks are one Spark job, whose tasks take a chunk or several each; each job's rows are one Parquet write with the numbers of its
    chunks, so that a chunk is there as a whole or not at all.
    """
    from cairn.operators.ingest import batches

    spark = datasets.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stage}/chunks")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{stage}/input/_SUCCESS")):
        batches(datasets, key, size).write.mode("overwrite").parquet(f"{stage}/input")  # chunks keep their numbers in all runs
    rows = spark.read.parquet(f"{stage}/input")
    last = rows.agg(F.max("batch")).first()[0]
    wave = 0
    while last is not None and wave <= last:
        done = f"{stage}/chunks/{wave:012d}"
        if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{done}/_SUCCESS")):
            own = rows.where(F.col("batch").between(wave, wave + at_once - 1)).repartition(min(at_once, 4 * spark.sparkContext.defaultParallelism), "batch").drop("batch")
            enrich(own).write.mode("overwrite").parquet(done)
        wave += at_once
    if last is None:
        return enrich(rows.drop("batch"))
    return spark.read.parquet(f"{stage}/chunks/*")
