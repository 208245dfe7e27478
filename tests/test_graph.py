"""Similar datasets by shared values: the rows of a plain count over all pairs, from few of many copies."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph


def plain_best(values, anchors, relation, k):
    out = []
    for a in anchors:
        found = []
        for u, own in values.items():
            both = own & values[a]
            shared = {v for v in both if v[0] == relation}
            if u != a and shared:
                found.append((-len(shared), -len({v for v in both if v[0].startswith("HAS_")} - shared), u, ",".join(sorted(n for _, n in shared))))
        out += [(a, u, -s, -o, n) for s, o, u, n in sorted(found)[:k]]
    return sorted(out)


def test_copies_meet_anchors_once(spark, monkeypatch):
    r = random.Random(4)
    kinds = [{("HAS_KEYWORD", f"K{r.randint(0, 5)}") for _ in range(3)} | {("HAS_THEME", f"T{r.randint(0, 2)}"), ("PROVIDED_BY", f"P{i % 2}")} for i in range(6)]
    values = {f"u{i:04d}": kinds[i % 6] | {("HAS_KEYWORD", f"own {i}")} for i in range(300) if i % 7}
    anchors = [u for i, u in enumerate(values) if i % 50 == 0]
    edges = spark.createDataFrame([(u, t, n) for u, own in values.items() for t, n in own], "url string, rel_type string, name string").repartition(3)
    seen = []
    blocks = graph._blocks
    monkeypatch.setattr(graph, "_blocks", lambda rows, size: seen.append(rows.count()) or blocks(rows, size))
    got = graph.similar_by_attribute(edges, spark.createDataFrame([(a,) for a in anchors], "url string"), "HAS_KEYWORD", 4)
    assert sorted((x["anchor"], x["url"], x["shared"], x["other"], ",".join(x["names"])) for x in got.collect()) == plain_best(values, anchors, "HAS_KEYWORD", 4)
    assert seen[0] <= len(anchors) and seen[1] < 60 < len(values)  # kinds, and the first five of each


def test_values_become_rows_in_many_tasks(spark):
    none = F.array().cast("array<string>")
    rows = spark.range(0, 500, numPartitions=1).select(F.col("id").cast("string").alias("url"), F.lit("p").alias("provider"), F.array(F.lit("a b"), F.lit("A b")).alias("keywords"), *(none.alias(c) for c in ("themes", "categories", "spatial_coverage", "temporal_coverage")))
    edges = graph.metadata_edges(rows.union(rows))
    assert edges.count() == 1000 and edges.rdd.getNumPartitions() >= graph.EDGE_PARTS


def test_a_class_is_linked_with_its_first(spark):
    rows = [(f"u{i:02d}", "t" if i % 3 else None, f"p{i % 2}") for i in range(40)] + [("alone", "x", "y")]
    table = spark.createDataFrame(rows, "url string, title string, provider string")
    got = sorted((r["a"], r["b"]) for r in graph.to_representative(table, table.select("url"), ["title", "provider"]).collect())
    classes = [sorted(u for u, t, p in rows if t == "t" and p == own) for own in ("p0", "p1")]
    assert got == sorted((u, c[1] if u == c[0] else c[0]) for c in classes for u in c)  # one link for each, not all pairs


def shared_case():
    """(url -> values, anchors): few sets of HAS_ values, each with many providers, some with two, and datasets with values of their own or of a few."""
    r = random.Random(11)
    sets = [{("HAS_KEYWORD", f"K{r.randint(0, 4)}") for _ in range(2)} | {("HAS_THEME", f"T{i % 3}"), ("HAS_CATEGORY", f"C{i % 2}")} for i in range(8)]
    values = {f"u{i:04d}": sets[r.randint(0, 7)] | {("PROVIDED_BY", f"P{i % 40}")} | ({("PROVIDED_BY", f"P{i % 7}")} if i % 9 == 0 else set()) for i in range(900)}
    few = {f"v{i:03d}": {("HAS_KEYWORD", f"few {i // 3}"), ("HAS_KEYWORD", f"few {i // 5} b"), ("PROVIDED_BY", f"P{i % 40}")} | ({("HAS_THEME", f"T{i % 3}")} if i % 4 else set()) for i in range(120)}
    return values | few, [u for i, u in enumerate([*values, *few]) if i % 15 == 0]


def plain_lists(values, anchors, lists, k):
    out = []
    for a in anchors:
        for name, relation in lists.items():
            found = []
            for u, own in values.items():
                both = own & values[a]
                has, of = {v for v in both if v[0].startswith("HAS_")}, {v for v in both if v[0] == relation}
                shared = len(has) if relation == "PROVIDED_BY" else len(of)
                if u != a and of and shared:
                    found.append((-shared, 0 if relation == "PROVIDED_BY" else -len(has - of), u))
            out += [(a, name, u, -s, -o, n + 1) for n, (s, o, u) in enumerate(sorted(found)[:k])]
    return sorted(out)


ALL_LISTS = {"themes": "HAS_THEME", "keywords": "HAS_KEYWORD", "provider": "PROVIDED_BY"}


def shared_tables(spark, values, anchors):
    edges = spark.createDataFrame([(u, t, n) for u, own in values.items() for t, n in own], "url string, rel_type string, name string").repartition(3)
    return edges, spark.createDataFrame([(a,) for a in anchors], "url string")


def test_providers_are_searched_one_by_one(spark, monkeypatch):
    values, anchors = shared_case()
    seen, blocks = [], graph._blocks

    def spy(rows, size):
        by = ["part"] if "part" in rows.columns else []
        seen.append({r[0] if by else None: r["n"] for r in rows.groupBy(*by).agg(F.count("*").alias("n")).collect()})
        return blocks(rows, size)

    monkeypatch.setattr(graph, "_blocks", spy)
    got = graph.best_shared(*shared_tables(spark, values, anchors), ALL_LISTS, 5)
    assert sorted(tuple(r) for r in got.collect()) == plain_lists(values, anchors, ALL_LISTS, 5)
    pairs = sum(n * seen[1].get(part, 0) for part, n in seen[0].items())
    assert pairs < len(anchors) * len(values) / 10  # each with each would be over half of it


@pytest.mark.parametrize("sizes", [(3, 5, 1), (64, 16, 2), (512, 4096, 256)])
def test_lists_are_the_same_for_any_blocks(spark, monkeypatch, sizes):
    for name, size in zip(("ANCHOR_BLOCK", "DATASET_BLOCK", "REMEMBERED"), sizes, strict=True):
        monkeypatch.setattr(graph, name, size)
    values, anchors = shared_case()
    got = graph.best_shared(*shared_tables(spark, values, anchors), ALL_LISTS, 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_lists(values, anchors, ALL_LISTS, 4)
