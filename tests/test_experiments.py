"""A grid of settings gives for each run what that run alone gives, and the log keeps it."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cairn.operators import evaluate, experiments, retrieval


def test_each_run_of_a_grid_is_that_run_alone(spark, tmp_path):
    r = random.Random(3)
    rows = [(s, q, kind, f"d{i}", f"d{i - i % 3}", round(r.random(), 3)) for s in ("one", "two") for q in ("q1", "q2", "q3") for kind in ("vector", "bm25") for i in r.sample(range(40), 15)]
    scores = spark.createDataFrame(rows, "setting string, query string, retriever string, id string, parent string, score double")
    judged = spark.createDataFrame([(q, f"d{i}", 1 + i % 4) for q in ("q1", "q2", "q4") for i in range(0, 30, 5)], "query string, url string, ranking int")
    grid = experiments.grid_rows(spark, {"a": "one", "b": "two", "c": "one"}, ["relative_score", "dist_based_score"], [(0.5, 0.5), (0.7, 0.3)], [0.2, 0.6], (10, 40), (5,))
    results = experiments.grid_results(scores, grid)
    got = {}
    for x in results.collect():
        got.setdefault(x["run"], Counter())[(x["query"], x["id"], x["score"], x["nth"])] += 1
    runs = grid.collect()
    assert len(runs) == 48 and len({x["run"] for x in runs}) == 48
    for x in runs[::13]:
        own = scores.where(F.col("setting") == x["setting"])
        found = retrieval.fused(own.select("query", "retriever", "id", "score"), {"vector": x["vector_weight"], "bm25": x["bm25_weight"]}, x["fused_k"], x["mode"])
        found = retrieval.folded(found.join(own.select("query", "id", "parent").distinct(), ["query", "id"]).select("query", "id", "parent", "score"))
        alone = retrieval.reranked(found, x["cutoff"], x["k"])
        assert got.get(x["run"], Counter()) == Counter((y["query"], y["id"], y["score"], y["nth"]) for y in alone.collect())
        want = {y["query"]: y for y in evaluate.metrics(alone.select("query", F.col("id").alias("url"), "nth"), judged).collect()}
        metrics = {y["query"]: y for y in experiments.grid_metrics(results.where(F.col("run") == x["run"]), grid.where(F.col("run") == x["run"]), judged).collect()}
        assert set(metrics) == {"q1", "q2", "q4"} and all(abs(metrics[q][m] - want[q][m]) < 1e-12 for q in want for m in ("ndcg", "recall", "mrr"))
    log = experiments.ExperimentLog(spark, f"file://{tmp_path}/log")
    some = grid.where("mode = 'relative_score'")
    log.log(some, results.where("run like '%relative_score%'"), judged)
    log.log(some.limit(1), results.limit(0), judged)  # logged again, with nothing found
    runs = {x["run"]: x for x in log.read("runs").collect()}
    again = some.first()["run"]
    assert len(runs) == 24 and runs[again]["recall"] == 0 and runs[again]["params"]["mode"] == "relative_score"
    assert {x["run"] for x in log.read("results").collect()} == {x["run"] for x in results.where("run like '%relative_score%'").collect()} - {again}
    assert all(x["results"] == len(x["found"] or []) for x in log.read("queries").collect())
