"""A small catalogue from raw rows to the next state, and the parts that have no SQL."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import ship
from cairn.operators import enrich, evaluate, facets, graph, ingest, retrieval, service, snapshot, vocabulary
from cairn.sources.files import VersionedTable, append_missing, read_csv, read_split_json

RAW = """datová_sada,název,popis,poskytovatel,klíčová_slova,téma
http://x/1,One,First,P1,alpha,t1
http://x/1,One,First,P1,beta,t1
http://x/2,Two,"Second,
with a line",P2,alphas,t2
http://x/3,Three,Third,P1,,Energie
http://x/3,Three,Third,P1,,t2
http://x/4,Four,Fourth,P1,alpha,t1
"""


@pytest.fixture(scope="module")
def datasets(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "raw.csv"
    path.write_text(RAW)
    return ingest.transformed(read_csv(spark, str(path))).cache()


def test_transformed(datasets):
    rows = {r["url"]: r for r in datasets.collect()}
    assert len(rows) == 4
    assert rows["http://x/1"]["keywords"] == ["alpha", "beta"]
    assert rows["http://x/2"]["keywords"] == ["alpha"]  # one letter from the more frequent spelling
    assert rows["http://x/3"]["categories"] == ["Energie"] and rows["http://x/3"]["themes"] == ["t2"]
    assert rows["http://x/2"]["full_description"] == "Two\nSecond,\nwith a line\n(P2 | alphas | t2 |  | )"  # before cleaning


def test_next_state(spark, datasets):
    old = spark.createDataFrame([("http://x/1", datasets.where("url = 'http://x/1'").first()["full_description_hash"]), ("http://x/2", "changed"), ("http://x/9", "gone")], "url string, full_description_hash string")
    new, removed, kept = snapshot.difference(datasets.select("url", "full_description_hash"), old)
    assert {r["url"] for r in new.collect()} == {"http://x/2", "http://x/3", "http://x/4"}
    assert {r["url"] for r in removed.collect()} == {"http://x/2", "http://x/9"}
    assert {r["url"] for r in kept.collect()} == {"http://x/1"}
    assert snapshot.difference(datasets, None)[0].count() == 4


def test_graph_and_facets(spark, datasets):
    edges = graph.metadata_edges(datasets)
    assert {r["name"] for r in edges.where("node_label = 'Keyword'").collect()} == {"Alpha", "Beta"}
    near = graph.similar_by_attribute(edges, spark.createDataFrame([("http://x/1",)], "url string"), "HAS_KEYWORD").collect()
    assert [(r["url"], r["shared"], r["other"]) for r in sorted(near, key=lambda r: r["url"])] == [("http://x/2", 1, 0), ("http://x/4", 1, 1)]
    assert facets.filtered(datasets, {"provider": ["P1", "P2"]}).count() == 0
    counts = {(r["facet"], r["value"]): r["n"] for r in facets.facet_counts(datasets).collect()}
    assert counts[("provider", "P1")] == 3 and counts[("keywords", "alpha")] == 3


def test_enrichment(spark, datasets):
    ship(spark)
    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        seen.add(len(prompts))
        return ["not json" if "Two" in p else json.dumps({"keywords": ["k1", "k2", "k3", "k4"], "categories": ["c"], "spatial_coverage": ["Brno"], "temporal_coverage": []}) for p in prompts]

    rows = {r["url"]: r for r in enrich.enriched(datasets, model).collect()}
    assert rows["http://x/1"]["keywords"] == ["alpha", "beta", "k1"]  # no more than was missing
    assert rows["http://x/2"]["keywords"] == ["alpha"] and rows["http://x/2"]["spatial_coverage"] == []
    assert rows["http://x/3"]["categories"] == ["Energie"]
    assert seen.value >= 4
    assert enrich.preprocessed_query("q", lambda q: q + " more", lambda q: 'x {"a": 1} y') == ("q more", {"a": 1})
    assert enrich.preprocessed_query("q", None, lambda q: "no json") == ("q", None)


def test_versions(spark, datasets, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/datasets")
    assert table.read() is None
    table.write(datasets.limit(1))
    table.write(datasets.limit(2))
    table.write(datasets)
    assert table.read().count() == 4 and len(table.versions()) == 2
    stage = f"file://{tmp_path}/stage"
    append_missing(datasets.where("url < 'http://x/3'").select("url"), stage, "url")
    assert append_missing(datasets.select("url"), stage, "url").count() == 4


def test_stream(spark, tmp_path):
    from cairn.streaming.refresh import refresh

    schema = "url string, full_description_hash string"
    incoming = f"file://{tmp_path}/in"
    table = VersionedTable(spark, f"file://{tmp_path}/live")
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        refresh(spark, incoming, spark.createDataFrame([], schema).schema, table, f"{tmp_path}/cp")
        assert {(r["url"], r["full_description_hash"]) for r in table.read().collect()} == set(rows), n


def test_split_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"columns": ["url", "keywords"], "index": [0, 1], "data": [["a", ["x", "y"]], ["b", []]]}))
    rows = {r["url"]: r["keywords"] for r in read_split_json(spark, str(path), ["keywords"]).collect()}
    assert rows == {"a": ["x", "y"], "b": []}


def test_chunks_and_batches(spark):
    docs = spark.createDataFrame([("d", " ".join(map(str, range(10)))), ("e", "one"), ("f", "")], "doc_id string, text string")
    got = {r["node_id"]: r["text"] for r in ingest.chunks(docs, size=4, overlap=1).collect()}
    assert got == {"d#0": "0 1 2 3", "d#1": "3 4 5 6", "d#2": "6 7 8 9", "e#0": "one", "f#0": ""}
    batches = [r["batch"] for r in ingest.batches(spark.range(70), "id").orderBy("id").collect()]
    assert batches == [i // 32 for i in range(70)]


def test_batches_hold_all_rows_whatever_ranges_are_put_together(spark):
    """Counts and rows have ranges of other sizes in bytes, which Spark puts together in other ways."""
    settings = {"advisoryPartitionSizeInBytes": "64k", "coalescePartitions.minPartitionSize": "1k", "coalescePartitions.parallelismFirst": "false"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).repartition(4)
        got = sorted((r["id"], r["batch"]) for r in ingest.batches(rows, "id").collect())
    finally:
        for name in settings:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
    assert got == [(i, i // 32) for i in range(3000)]


def test_commas_and_rerank(spark):
    words = spark.createDataFrame([("1", ["a, b", "c"])], "url string, keywords array<string>")
    cache = spark.createDataFrame([("a, b", ["a", "b"])], "word string, parts array<string>")
    assert vocabulary.split_on_commas(words, "keywords", cache).first()["keywords"] == ["a", "b", "c"]
    scores = spark.createDataFrame([("q", f"n{i}", i / 10) for i in range(10)], "query string, id string, score double")
    kept = retrieval.reranked(scores).orderBy("nth").collect()
    assert len(kept) == 8 and [r["score"] for r in kept] == sorted((r["score"] for r in kept), reverse=True)
    assert len(evaluate.grid({"a": [1, 2], "b": [1, 2, 3]})) == 6
    assert scores.select(retrieval.hashed_embedding(F.lit("two words"), 8).alias("v")).first()["v"].count(0.0) >= 6


def test_service(spark, datasets, tmp_path):
    app = "http://app/"
    parts = spark.createDataFrame([(None, "http://x/1", "http://f/1", "CSV"), ("Named", "http://x/1", "http://f/2", "JSON")], "title string, dataset_url string, url string, file_format string")
    to_four = lambda urls: urls.where("url <> 'http://x/4'").select(F.col("url").alias("a"), F.lit("http://x/4").alias("b"), F.lit(0.9).alias("score"))
    edges, similar = service.build_or_update(datasets, datasets, datasets.limit(0), None, to_four)
    asked = spark.createDataFrame([("http://app/dataset_detail?source=http://x/1",), ("Two",)], "address string")
    records, lists = service.detail(datasets, parts, edges, similar, asked, app)
    record = records.first()
    assert record["url"] == "http://x/1" and [d["title"] for d in record["distributions"]] == ["Distribution 1", "Named"]
    got = {(r["list"], r["url"]): r["common"] for r in lists.collect()}
    assert got[("description", "http://x/4")] == [] and got[("provider", "http://x/4")] == ["alpha", "t1"] and got[("keywords", "http://x/2")] == ["alpha"]
    info = {r["address"]: r["url"] for r in service.dataset_info(datasets, parts, asked, app).collect()}
    assert info == {"http://app/dataset_detail?source=http://x/1": "http://x/1", "Two": "http://x/2"}
    gone = datasets.where("url = 'http://x/1'").select("url")
    left = datasets.join(gone, "url", "left_anti")
    after, near = service.build_or_update(left, datasets.limit(0), gone, (edges, similar), to_four)
    assert after.where("url = 'http://x/1'").count() == 0 and near.count() == 2
    (tmp_path / "app.md").write_text("about")
    assert service.info_file(spark, str(tmp_path), "app").first()["text"] == "about"
    with pytest.raises(ValueError):
        service.info_file(spark, str(tmp_path), "../secret")


def test_files(spark, tmp_path):
    import io
    from datetime import UTC, datetime, timedelta

    from cairn.sources import files

    (tmp_path / "lists.csv").write_text("url,keywords\nu1,\"['a', \"\"b's\"\", 'c\\'d']\"\nu2,[]\nu3,\n")
    rows = {r["url"]: r["keywords"] for r in files.read_literal_lists(spark, str(tmp_path / "lists.csv"), ["keywords"]).collect()}
    assert rows == {"u1": ["a", "b's", "c'd"], "u2": [], "u3": []}
    (tmp_path / "judged.csv").write_text('query,url,ranking\n"a, b",u1,1\nc,u2,3\n')
    assert [tuple(r) for r in files.read_judgments(spark, str(tmp_path / "judged.csv")).orderBy("ranking").collect()] == [("a, b", "u1", 1), ("c", "u2", 3)]
    table = spark.createDataFrame([("u", ["a"]), ("v", [])], "url string, keywords array<string>")
    assert [json.loads(r["value"]) for r in files.as_split_json(table, "url").collect()] == [{"columns": ["url", "keywords"], "index": [0, 1], "data": [["u", ["a"]], ["v", []]]}]

    path, tomorrow = f"{tmp_path}/fresh", datetime.now(UTC) + timedelta(days=1)
    assert not files.is_fresh(spark, path)
    assert files.fresh_table(spark, path, lambda: table).count() == 2
    assert files.fresh_table(spark, path, lambda: table.limit(0)).count() == 2
    assert files.fresh_table(spark, path, lambda: table.limit(1), tomorrow).count() == 1
    got = []
    open_url = lambda url: got.append(url) or io.BytesIO(b"x" * 3_000_000)
    for now in (None, None, tomorrow):
        assert files.downloaded(spark, "http://x/y", f"{tmp_path}/export.csv", now, open_url) == f"{tmp_path}/export.csv"
    assert len(got) == 2 and (tmp_path / "export.csv").stat().st_size == 3_000_000 and not (tmp_path / "export.csv.part").exists()
    live = files.Reloading(spark, f"{tmp_path}/live", "url string")
    assert live.read().count() == 0
    table.select("url").write.parquet(f"{tmp_path}/live")
    assert live.read().count() == 2 and live.read() is live.rows
    assert files.settings('{"search": {"top": 3}, "a": 1}', environment={"CAIRN_SEARCH__TOP": "5", "CAIRN_NAME": "x", "OTHER": "1"}) == {"search": {"top": 5}, "a": 1, "name": "x"}


def test_small_parts(spark, datasets):
    from cairn.functions import text as X

    assert facets.any_selected({"a": [], "b": ["x"]}) and not facets.any_selected({"a": []}) and not facets.any_selected({})
    bare = spark.createDataFrame([(None, None), ("t", ["k"])], "title string, keywords array<string>")
    assert sorted(tuple(r) for r in ingest.with_filled_fields(bare, ["title"], ["keywords"]).collect()) == [("", []), ("t", ["k"])]
    found = spark.createDataFrame([("q", 1, "One", "http://x/1")], "query string, nth int, title string, url string")
    assert [tuple(r) for r in service.titles_and_pages(found, "http://app/").collect()] == [("q", 1, "One", "http://app/dataset_detail?source=http://x/1")]
    home = [(r["facet"], r["value"], r["n"], r["title"]) for r in service.home(datasets).collect()]
    assert home[-2:] == [("themes", "t1", 2, "Themes"), ("themes", "t2", 2, "Themes")] and ("provider", "P1", 2, "Provider") in home or len(home) > 5
    answers = spark.createDataFrame([("```json\n{\"a\": 1}\n```", "m.1:b"), ("none", "m")], "answer string, model string")
    got = answers.select(X.fenced_json(F.col("answer"), "a int")["a"].alias("a"), X.model_folder(F.col("model")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(1, "m_1_b"), (None, "m")]
    ship(spark)
    words = spark.createDataFrame([("a, b",), ("c, d",), ("e",)], "word string")
    split = lambda prompts: ['{"parts": ["a", "b"]}' if "a, b" in p else "{}" for p in prompts]
    assert {r["word"]: r["parts"] for r in enrich.comma_parts(words, split).collect()} == {"a, b": ["a", "b"], "c, d": ["c, d"]}
    assert ingest.documents(datasets.limit(0)).count() == 0
