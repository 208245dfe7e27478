"""Documents, their nodes and their vectors as three tables of one store: a change of documents is one commit of all three."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.chunking import sentence_chunks
from cairn.operators.models import Embedder, embedded
from cairn.sources.store import Store, Table

_TABLES = {
    "documents": Table(("doc_id",), ("doc_id",)),
    "nodes": Table(("ref_doc_id",), ("node_id",)),
    "vectors": Table(("ref_doc_id",), ("node_id",)),
}


class DocumentStore:
    """documents (doc_id, text, metadata as JSON), nodes (node_id, ref_doc_id, chunk, text), vectors (node_id, ref_doc_id, embedding).

    Documents without an id, or with one that another has, refuse the whole commit.
    """

    def __init__(self, spark: SparkSession, folder: str, model: Callable[[], Embedder], dimension: int, size: int = 8096, overlap: int = 50, batch: int = 100, compact_at: int = 16):
        self.store = Store(spark, folder, _TABLES)
        self.model, self.dimension, self.size, self.overlap, self.batch, self.compact_at = model, dimension, size, overlap, batch, compact_at

    def _tables(self, docs: DataFrame) -> dict:
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        metadata = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), metadata.alias("metadata"))
        return {
            "documents": rows,
            "nodes": lambda made: sentence_chunks(made["documents"], self.size, self.overlap).drop("n_words"),
            "vectors": lambda made: embedded(made["nodes"].select("node_id", "ref_doc_id", "text"), self.model, self.dimension, self.batch).drop("text"),
        }

    def load(self, docs: DataFrame) -> int:
        """docs (doc_id, text and others) in place of all; the state before stays until the next commit."""
        return self.store.commit(self._tables(docs))

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Put in docs in place of those with their ids and take out gone (doc_id); writes these documents only."""
        keys = docs.select(F.col("doc_id").cast("string"))
        keys = keys if gone is None else keys.union(gone.select(F.col("doc_id").cast("string")))
        number = self.store.commit(self._tables(docs), keys)
        return self.store.compact() if len(self.store.record().layers) > self.compact_at else number

    def delete(self, gone: DataFrame) -> int:
        return self.store.commit({}, gone.select(F.col("doc_id").cast("string")))

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    def nodes_of_documents(self) -> DataFrame:
        """(doc_id, node_ids) of all documents."""
        return self.read("nodes").groupBy(F.col("ref_doc_id").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "node_id"))), lambda x: x["node_id"]).alias("node_ids"))
