"""Retrieval quality and chat memory."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graded(judgments: DataFrame) -> DataFrame:
    """(query, url, relevance): the worst ranking of a query has 1."""
    most = F.max("ranking").over(Window.partitionBy("query"))
    return judgments.select("query", "url", (most - F.col("ranking") + 1).alias("relevance"))


def metrics(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, recall, mrr) of results (query, url, nth) for each judged query; 0 where nothing relevant was found.

    The ideal order is that of what was retrieved, so that relevant datasets that were not do not lower nDCG.
    """
    truth = graded(judgments)
    seen = results.join(truth, ["query", "url"], "left").select("query", "nth", F.coalesce("relevance", F.lit(0)).alias("rel"))
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "nth"))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col("rel") / F.log2(F.col(place) + 1)).otherwise(0.0))
    sums = seen.withColumn("best", ideal).groupBy("query").agg(
        gain("nth").alias("dcg"),
        gain("best").alias("idcg"),
        F.sum(F.when((F.col("nth") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when((F.col("nth") <= k) & (F.col("rel") > 0), F.col("nth"))).alias("first"),
    )
    judged = truth.groupBy("query").agg(F.count("*").alias("judged"))
    return judged.join(sums, "query", "left").select(
        "query",
        F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg"),
        (F.coalesce("hits", F.lit(0)) / F.col("judged")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*(F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr")))


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations of the options, each as named values."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def recent_turns(turns: DataFrame, limit: int, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The newest turns of each conversation whose words, counted from the end, are at most limit."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    rows = turns.withColumn("n_tokens", words)
    total = F.sum("n_tokens").over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("upto", total).where(F.col("upto") <= limit)
