"""The graph of datasets as tables of one store, with the constraints that its nodes and edges must meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import graph
from cairn.sources.store import ConstraintError, Store, Table

_TABLES = {
    "datasets": Table(("url",), ("url",)),
    "edges": Table(("url",), ("url", "rel_type", "name")),
    "similar": Table(("url_lo", "url_hi"), ("url_lo", "url_hi")),
}
#: (urls) -> (a, b, score) of the datasets nearest to them.
Nearest = Callable[[DataFrame], DataFrame]


class GraphStore:
    """datasets (url, title), edges (url, rel_type, node_label, name), similar (url_lo, url_hi, score).

    A commit is refused, and the graph stays as it was, if two datasets have one url, an edge or a pair is there twice, an edge
    belongs to no dataset, a pair is of a dataset with itself, the wrong way round or without a score, or a relation leads
    to nodes of another label than its own.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_at: int = 16):
        self.store, self.compact_at = Store(spark, folder, _TABLES), compact_at

    def _check(self, written: dict[str, DataFrame]) -> None:
        labels = F.create_map(*(F.lit(x) for r, label, _, _ in graph.RELATIONS for x in (r, label)))
        edges, similar = written["edges"], written["similar"]
        tests = {
            "edges without a dataset": edges.join(written["datasets"].select("url"), "url", "left_anti"),
            "edges to nodes of a wrong label": edges.where(~F.coalesce(F.element_at(labels, F.col("rel_type")) == F.col("node_label"), F.lit(False))),
            "pairs that are none": similar.where("not coalesce(url_lo < url_hi, false) or score is null"),
        }
        for what, bad in tests.items():
            some = [tuple(r) for r in bad.limit(3).collect()]
            if some:
                raise ConstraintError(f"{what}, such as {some}")

    @staticmethod
    def _datasets(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("url"), F.col("title"))

    def build(self, datasets: DataFrame, nearest: Nearest) -> int:
        """The whole graph of datasets, in place of what there was."""
        tables = {
            "datasets": self._datasets(datasets),
            "edges": lambda _: graph.metadata_edges(datasets),
            "similar": lambda made: graph.with_similar(None, nearest(made["datasets"].select("url"))),
        }
        return self.store.commit(tables, check=self._check)

    def update(self, new: DataFrame, removed: DataFrame, nearest: Nearest) -> int:
        """Put in new datasets in place of those with their urls, take out removed (url), and ask again for the neighbours of the
        new ones and of all that lost one.  Writes the rows of these datasets only; their pairs may lead to any dataset."""
        since = self.store.record()
        if not since.layers:
            return self.build(new, nearest)
        gone = removed.select("url").union(new.select("url")).distinct()
        similar = self.store.read("similar", since.number)
        left = graph.both_ways(similar).join(gone, "url", "left_semi").select(F.col("other").alias("url")).distinct()
        asked = new.select("url").union(left.join(removed.select("url"), "url", "left_anti")).distinct()

        tables = {
            "datasets": self._datasets(new),
            "edges": lambda _: graph.metadata_edges(new),
            "similar": lambda _: graph.with_similar(None, nearest(asked)),
        }
        number = self.store.commit(tables, gone, check=self._check, since=since.number)
        return self.store.compact() if len(self.store.record().layers) > self.compact_at else number

    def delete(self, gone: DataFrame) -> int:
        """Take out datasets (url) with all their edges and pairs."""
        return self.store.commit({}, gone.select("url"))

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    def nodes(self) -> DataFrame:
        """(node_label, name) of all nodes; values that no dataset has are none."""
        values = self.read("edges").select("node_label", "name").distinct()
        return values.union(self.read("datasets").select(F.lit("Dataset"), "url"))
