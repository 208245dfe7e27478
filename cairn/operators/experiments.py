"""Grids of search settings over judged queries, in one plan, and a table of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import evaluate, retrieval
from cairn.sources.store import Store, Table

#: Columns of a grid: the run's name, the retrieval that it uses, and what follows it.
GRID = "run string, setting string, mode string, vector_weight double, bm25_weight double, fused_k int, cutoff double, k int"


def grid_rows(spark: SparkSession, settings: dict[str, str], mode: list[str], weights: list[tuple[float, float]], cutoff: list[float], fused_k: tuple[int, ...] = (40,), k: tuple[int, ...] = (30,)) -> DataFrame:
    """All combinations as rows; settings are names and the retrievals that they lead to, which some may share."""
    options = {"name": list(settings), "mode": mode, "weights": weights, "fused_k": list(fused_k), "cutoff": cutoff, "k": list(k)}
    rows = [(c["name"], c["mode"], float(c["weights"][0]), float(c["weights"][1]), c["fused_k"], float(c["cutoff"]), c["k"]) for c in evaluate.grid(options)]
    return spark.createDataFrame([(f"{r[0]}/{r[1]}/{r[2]:g}/{r[3]:g}/{r[4]}/{r[5]:g}/{r[6]}", settings[r[0]], *r[1:]) for r in rows], GRID)


def grid_results(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """(run, query, id, score, nth) of every run, from scores (setting, query, retriever, id, parent, score).

    Each setting is retrieved once; scores are normalised once for each mode, and all runs are fused, folded, cut and
    ranked together, a run and a query being one key.  The same rows as a run alone gives.
    """
    keyed = scores.select(F.struct("setting", "query").alias("query"), "retriever", "id", "score")
    modes = [retrieval.normalized(keyed, m).withColumn("mode", F.lit(m)) for m in ("relative_score", "dist_based_score")]
    norms = modes[0].unionByName(modes[1]).select(F.col("query.setting").alias("setting"), "mode", F.col("query.query").alias("query"), "retriever", "id", "norm")
    weight = F.when(F.col("retriever") == "vector", F.col("vector_weight")).otherwise(F.col("bm25_weight"))
    key = F.struct("run", "query").alias("query")
    sums = norms.join(F.broadcast(grid), ["setting", "mode"]).groupBy("run", "query", "id", "setting", "fused_k", "cutoff", "k").agg(F.round(F.sum(F.col("norm") * weight), 9).alias("score"))  # the grid is given by the caller
    fused = retrieval.ranked(sums.withColumn("query", key)).where("nth <= fused_k").drop("nth")
    parents = scores.select("setting", F.col("query").alias("q"), "id", "parent").distinct()
    rows = fused.withColumn("q", F.col("query.query")).join(parents, ["setting", "q", "id"])
    folded = retrieval.folded(rows.select("query", "id", "parent", "score"))
    limits = grid.select("run", "cutoff", "k")
    kept = folded.withColumn("run", F.col("query.run")).join(F.broadcast(limits), "run").where("score >= cutoff").select("query", "id", "score", "k")
    best = retrieval.ranked(kept).where("nth <= k")
    return best.select("query.run", "query.query", "id", "score", "nth")


def grid_metrics(results: DataFrame, grid: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(run, query, ndcg, recall, mrr, results) of every run and judged query, whether it found anything or not."""
    every = grid.select("run").distinct().join(F.broadcast(judgments.select("query").distinct()), how="cross")  # runs x judged queries is what is asked for
    judged = every.join(judgments, "query").select(F.struct("run", "query").alias("query"), "url", "ranking")
    found = results.select(F.struct("run", "query").alias("query"), F.col("id").alias("url"), "nth")
    counts = results.groupBy("run", "query").agg(F.count("*").alias("results"))
    rows = evaluate.metrics(found, judged, k).select("query.run", "query.query", "ndcg", "recall", "mrr")
    return rows.join(counts, ["run", "query"], "left").withColumn("results", F.coalesce("results", F.lit(0)))


def macro_of_runs(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run").agg(*(F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr")))


class ExperimentLog:
    """Runs with parameters and metrics, and for each run its queries with metrics and results, as tables of one store.

    A run that is logged again takes the place of the earlier one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder, {"results": Table(("run",), ("run", "query", "nth")), "queries": Table(("run",), ("run", "query")), "runs": Table(("run",), ("run",))})

    def log(self, grid: DataFrame, results: DataFrame, judgments: DataFrame, k: int = 10) -> int:
        """Write the results of the runs of a grid, and what follows from them; the results are made once."""
        params = F.create_map(*(x for c in grid.columns if c != "run" for x in (F.lit(c), F.col(c).cast("string"))))

        def queries(made: dict) -> DataFrame:
            lists = made["results"].groupBy("run", "query").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))  # k rows of a run at most
            return grid_metrics(made["results"], grid, judgments, k).join(lists, ["run", "query"], "left")

        tables = {"results": results, "queries": queries, "runs": lambda made: grid.select("run", params.alias("params")).join(macro_of_runs(made["queries"]), "run")}
        return self.store.commit(tables, grid.select("run") if self.store.exists() else None)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)
