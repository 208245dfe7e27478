"""Stores of several tables, and the indexes, documents and graphs that are kept in them."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn import ship
from cairn.operators import graph
from cairn.operators.bm25_index import Bm25Index, index_of
from cairn.operators.document_store import DocumentStore
from cairn.operators.graph_store import GraphStore
from cairn.operators.models import HashedTokens
from cairn.sources.store import ConflictError, ConstraintError, Store, Table


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def folders(store, name):
    path = store._path(f"{store.folder}/{name}")
    return len(store.fs.listStatus(path)) if store.fs.exists(path) else 0


# ---------------------------------------------------------------- commits


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", {"a": Table(("id",), ("id",)), "b": Table(("id",)), "c": Table(("x", "y"), ("x", "y"))})


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id string, v int")


def broken(spark):
    fail = F.raise_error(F.lit("lost")).cast("int")
    return spark.createDataFrame([("1", 2)], "id string, v int").withColumn("v", fail)


def test_layers_hide_earlier_rows(spark, store):
    assert not store.exists() and store.read("a") is None
    store.commit({"a": rows(spark, ("1", 1), ("2", 2), ("3", 3)), "b": rows(spark, ("1", 1), ("1", 2), ("3", 3))}, facts={"n": 3})
    store.commit({"a": rows(spark, ("2", 20), ("4", 4))}, spark.createDataFrame([("2",), ("4",), ("3",), (None,)], "k string"), {"m": 1})
    assert bag(store.read("a")) == Counter([("1", 1), ("2", 20), ("4", 4)])
    assert bag(store.read("b")) == Counter([("1", 1), ("1", 2)])  # 3 went from all tables
    assert store.record().facts == {"n": 3, "m": 1}
    store.commit({}, spark.createDataFrame([("1",)], "k string"))
    assert bag(store.read("a")) == Counter([("2", 20), ("4", 4)]) and bag(store.read("b")) == Counter()
    before = bag(store.read("a"))
    store.compact()
    assert len(store.record().layers) == 1 and bag(store.read("a")) == before and store.record().facts == {"n": 3, "m": 1}


def test_pairs_of_keys(spark, store):
    pairs = lambda *p: spark.createDataFrame(list(p), "x string, y string, s double")
    store.commit({"c": pairs(("1", "2", 0.1), ("2", "3", 0.2), ("3", "4", 0.3))})
    store.commit({"c": pairs(("1", "5", 0.5), ("3", "4", 0.9))}, spark.createDataFrame([("2",)], "k string"))
    assert bag(store.read("c")) == Counter([("3", "4", 0.9), ("1", "5", 0.5)])


def test_a_failure_between_two_tables_leaves_all_as_they_were(spark, store):
    store.commit({"a": rows(spark, ("1", 1)), "b": rows(spark, ("1", 1)), "c": spark.createDataFrame([("1", "2")], "x string, y string")})
    state = {n: bag(store.read(n)) for n in "abc"}
    kept = {n: folders(store, n) for n in "abc"}
    for keys in (None, spark.createDataFrame([("1",)], "k string")):
        with pytest.raises(Exception, match="lost"):
            store.commit({"a": rows(spark, ("1", 9)), "b": broken(spark), "c": spark.createDataFrame([("7", "8")], "x string, y string")}, keys)
        assert {n: bag(store.read(n)) for n in "abc"} == state and store.record().number == 1
        assert {n: folders(store, n) for n in "abc"} == kept


@pytest.mark.parametrize("bad", [[("1", 1), ("1", 2)], [(None, 1)]])
def test_rows_that_are_not_unique_are_refused(spark, store, bad):
    store.commit({"a": rows(spark, ("5", 5))})
    with pytest.raises(ConstraintError, match="a has rows"):
        store.commit({"a": rows(spark, *bad)}, spark.createDataFrame([("1",)], "k string"))
    assert bag(store.read("a")) == Counter([("5", 5)])


def test_rollback_and_removal_of_what_no_record_names(spark, store):
    with pytest.raises(ConflictError):
        store.rollback()
    for v in range(1, 5):
        store.commit({"a": rows(spark, ("1", v))})
    assert folders(store, "a") == 2 and len(store.records()) == 2
    store.rollback()
    assert bag(store.read("a")) == Counter([("1", 3)])
    store.commit({"a": rows(spark, ("1", 9))})
    assert bag(store.read("a")) == Counter([("1", 9)])


def test_two_commits_from_one_state_conflict(spark, store):
    store.commit({"a": rows(spark, ("1", 1))})
    with pytest.raises(ConflictError):
        store.commit({"a": rows(spark, ("1", 2))}, since=0)

    def other(_):  # another commit comes while this one is being written
        Store(spark, store.folder, store.tables).commit({"a": rows(spark, ("1", 7))})
        return rows(spark, ("1", 8))

    with pytest.raises(ConflictError):
        store.commit({"a": other})
    assert bag(store.read("a")) == Counter([("1", 7)])


# ---------------------------------------------------------------- BM25


def plain_bm25(docs, queries, k, within=None, k1=1.5, b=0.75):
    words = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in docs.items()}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = set()
    for q, t in queries.items():
        terms = set(re.findall(r"[^\W_]+", t.lower()))
        found = []
        for d, ws in words.items():
            c = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(ws) / mean)) for w in terms if c[w])
            if s and (within is None or d in within):
                found.append((-round(s, 6), d))
        out |= {(q, d, -s) for s, d in sorted(found)[:k]}
    return out


def texts(n, seed=0):
    r = random.Random(seed)
    return {str(i): " ".join(f"w{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randint(0, 60))) for i in range(n)}


def as_docs(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string").repartition(3)


def top(index, queries, **options):
    found = index.top_k(index.spark.createDataFrame(list(queries.items()), "query string, text string"), **options)
    return {(r["query"], r["id"], round(r["score"], 6)) for r in found.collect()}


QUERIES = {"q1": "w1 W2 w2 w30", "q2": "w50", "q3": "nothing here", "q4": "", "q5": "w0 w1 w2 w3 w4 w5"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = texts(900) | {"null": None, "blank": " \n", "ü": "Ünï w1 WORT wort"}
    return docs, Bm25Index(spark, f"file://{tmp_path_factory.mktemp('bm')}/i").build(as_docs(spark, docs))


@pytest.mark.parametrize("prune", [True, False])
def test_top_k(index, prune):
    docs, made = index
    assert top(made, QUERIES, k=7, prune=prune) == plain_bm25(docs, QUERIES, 7)
    allowed = {d for d in docs if d.endswith("3")} | {"ü"}
    within = made.spark.createDataFrame([(d,) for d in allowed], "id string")
    assert top(made, QUERIES | {"q6": "wort"}, k=30, prune=prune, within=within) == plain_bm25(docs, QUERIES | {"q6": "wort"}, 30, allowed)


def test_pages_whose_bound_is_too_small_are_not_scored(spark, tmp_path, monkeypatch):
    import cairn.operators.bm25_index as module

    monkeypatch.setattr(module, "PAGE", 8)
    docs = texts(400, 3) | {f"hit{i}": "rare " * 5 + "w1" for i in range(4)}
    made = Bm25Index(spark, f"file://{tmp_path}/i").build(as_docs(spark, docs))
    seen = []
    of_pages = Bm25Index._of_pages
    monkeypatch.setattr(Bm25Index, "_of_pages", staticmethod(lambda shown, terms, pages: seen.append(pages.select("layer", "page").distinct().count()) or of_pages(shown, terms, pages)))
    assert top(made, {"q": "rare w1"}, k=4, prune=True) == plain_bm25(docs, {"q": "rare w1"}, 4)
    assert seen[1] < 20 < 404 // 8


def test_updates_are_layers_with_the_rows_of_a_full_build(spark, tmp_path):
    docs = texts(600, 5)
    made = Bm25Index(spark, f"file://{tmp_path}/i").build(as_docs(spark, docs))
    written = lambda: [made.spark.read.parquet(x["tables"]["postings"]).select("page", F.explode("slots").alias("s")).distinct().count() for x in made.store.record().layers]
    for turn in range(3):
        new = {k: v + " w50 extra" for k, v in texts(4, 50 + turn).items()} | {f"new{turn}": "w50 w1 fresh", "null": None}
        gone = [str(100 + turn), "no such"]
        made.update(as_docs(spark, new), spark.createDataFrame([(g,) for g in gone], "id string"))
        docs = {k: v for k, v in (docs | new).items() if k not in gone}
        assert len(made.store.record().layers) == turn + 2 and written()[-1] == sum(bool(v) for v in new.values())
        for prune in (True, False):
            assert top(made, QUERIES | {"q6": "fresh extra"}, k=9, prune=prune) == plain_bm25(docs, QUERIES | {"q6": "fresh extra"}, 9)
    made.compact()
    assert len(made.store.record().layers) == 1 and top(made, QUERIES, k=9) == plain_bm25(docs, QUERIES, 9)
    many = texts(300, 9)
    made.update(as_docs(spark, many))
    assert len(made.store.record().layers) == 1 and top(made, QUERIES, k=9) == plain_bm25(docs | many, QUERIES, 9)


def test_empty_index_and_repeated_ids(spark, tmp_path):
    none = Bm25Index(spark, f"file://{tmp_path}/e").build(as_docs(spark, {"1": "a"}).limit(0))
    assert top(none, QUERIES) == set()
    with pytest.raises(ConstraintError):
        Bm25Index(spark, f"file://{tmp_path}/r").build(spark.createDataFrame([("1", "a"), ("1", "b")], "id string, text string"))


def test_an_index_is_built_once_for_each_state_of_its_file(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    as_docs(spark, texts(20)).write.parquet(path)
    first = index_of(spark, f"file://{tmp_path}", path, spark.read.parquet(path))
    assert index_of(spark, f"file://{tmp_path}", path, None).store.folder == first.store.folder
    as_docs(spark, texts(30)).write.mode("overwrite").parquet(path)
    assert index_of(spark, f"file://{tmp_path}", path, spark.read.parquet(path)).store.folder != first.store.folder


# ---------------------------------------------------------------- documents, nodes and vectors


def test_documents_nodes_and_vectors_change_together(spark, tmp_path):
    ship(spark)
    made = DocumentStore(spark, f"file://{tmp_path}/d", lambda: HashedTokens(16), 16, size=6, overlap=2)
    docs = spark.createDataFrame([("1", "One two. Three four five. Six seven eight nine ten.", "x"), ("2", "short", "y"), ("3", None, "z")], "doc_id string, text string, title string")
    made.load(docs)
    nodes = {r["node_id"]: r for r in made.read("nodes").collect()}
    assert {r["ref_doc_id"] for r in nodes.values()} == {"1", "2", "3"} and len(nodes) > 3
    assert {r["node_id"]: list(r["embedding"]) for r in made.read("vectors").collect()} == {n: HashedTokens(16)([r["text"]])[0] for n, r in nodes.items()}
    assert {r["doc_id"]: r["metadata"] for r in made.read("documents").collect()}["2"] == '{"title":"y"}'
    made.upsert(spark.createDataFrame([("2", "longer now. It has. Many words to be cut into nodes.", "y")], docs.schema), spark.createDataFrame([("3",)], "doc_id string"))
    found = {r["doc_id"]: r["node_ids"] for r in made.nodes_of_documents().collect()}
    assert set(found) == {"1", "2"} and found["2"] == [f"2#{i}" for i in range(len(found["2"]))] and len(found["2"]) > 1
    assert {r["node_id"] for r in made.read("vectors").collect()} == {n for ids in found.values() for n in ids}
    state = {n: bag(made.read(n).drop("embedding")) for n in ("documents", "nodes", "vectors")}

    def lost(texts):
        raise OSError("the model is gone")

    made.model = lambda: lost
    with pytest.raises(Exception, match="the model is gone"):
        made.upsert(docs)
    assert {n: bag(made.read(n).drop("embedding")) for n in state} == state
    made.delete(spark.createDataFrame([("1",)], "doc_id string"))
    assert {r["ref_doc_id"] for r in made.read("vectors").collect()} == {"2"}
    made.model = lambda: HashedTokens(16)
    with pytest.raises(ConstraintError, match="documents"):
        made.upsert(docs.union(docs))


# ---------------------------------------------------------------- graph

_DATASETS = "url string, title string, provider string, keywords array<string>, themes array<string>, categories array<string>, spatial_coverage array<string>, temporal_coverage array<string>"


def datasets(spark, *numbers, mark=""):
    return spark.createDataFrame([(f"u{n:02d}", f"t{n}{mark}", f"p{n % 3}", [f"k{n % 4}{mark}", f"k{n % 5}"], ["th"], [], [f"s{n % 2}"] if n % 2 else [], None) for n in numbers], _DATASETS)


def nearest_of(live):
    """All pairs of live datasets with a keyword in common."""

    def nearest(urls):
        words = live().select("url", F.explode(F.array_distinct("keywords")).alias("k"))
        pairs = words.join(words.withColumnRenamed("url", "b"), "k").where("url <> b").groupBy("url", "b").agg((F.count("*") / 2).alias("score"))
        return pairs.join(urls.distinct(), "url").select(F.col("url").alias("a"), "b", "score")

    return nearest


def test_incremental_graph_is_that_of_a_full_build(spark, tmp_path):
    state = {"now": datasets(spark, *range(20))}
    nearest = nearest_of(lambda: state["now"])
    made = GraphStore(spark, f"file://{tmp_path}/g")
    made.build(state["now"], nearest)
    for turn in range(3):
        new = datasets(spark, 2 * turn, 30 + turn, mark="x" if turn else "")
        removed = spark.createDataFrame([(f"u{10 + turn:02d}",), ("no such",)], "url string")
        state["now"] = state["now"].join(new.select("url").union(removed), "url", "left_anti").select(*new.columns).union(new)
        made.update(new, removed, nearest)
        full = GraphStore(spark, f"file://{tmp_path}/f{turn}")
        full.build(state["now"], nearest)
        for name in ("datasets", "edges", "similar"):
            columns = sorted(full.read(name).columns)
            assert bag(made.read(name).select(*columns)) == bag(full.read(name).select(*columns)), name
        assert bag(made.nodes()) == bag(full.nodes())
    assert len(made.store.record().layers) == 4


def test_graph_constraints(spark, tmp_path):
    made = GraphStore(spark, f"file://{tmp_path}/g")
    none = lambda urls: spark.createDataFrame([], "a string, b string, score double")
    one = datasets(spark, 1, 2, 3)
    with pytest.raises(ConstraintError, match="datasets"):
        made.build(one.union(one), none)
    assert not made.store.exists()
    made.build(one, none)
    state = bag(made.read("edges"))
    itself = lambda urls: spark.createDataFrame([("u01", "u01", 0.5)], "a string, b string, score double")
    with pytest.raises(ConstraintError, match="pairs"):
        made.update(datasets(spark, 4), one.select("url").limit(0), itself)
    no_score = lambda urls: spark.createDataFrame([("u01", "u02", None)], "a string, b string, score double")
    with pytest.raises(ConstraintError, match="pairs"):
        made.update(datasets(spark, 4), one.select("url").limit(0), no_score)
    assert bag(made.read("edges")) == state
    made.delete(spark.createDataFrame([("u01",)], "url string"))
    assert bag(made.read("edges")) == Counter({r: n for r, n in state.items() if r[0] != "u01"})
    assert bag(graph.nodes(made.read("edges")).where("node_label = 'Dataset'")) == Counter([("Dataset", "u02"), ("Dataset", "u03")])


def test_a_task_gives_the_best_of_its_pages_only(spark):
    """Rows that leave a task are k for each query, and those that are level, however many documents have its words."""
    import numpy as np
    import pyarrow as pa

    from cairn.operators.bm25_index import _page_scores

    def batches():
        for page in range(50):
            n = 256
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = ([0], [page], [0], [0.5], [[1, 2]], [list(range(n))], [[1 + (page * n + i) % 9000 for i in range(n)]], [[10_000] * n])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f"c{i}" for i in range(8)])

    got = pa.Table.from_batches(list(_page_scores(7, 1.5, 0.75, 10_000.0, False)(batches())))
    assert sorted(got.column("nr").to_pylist()) == [1] * 7 + [2] * 7
    assert np.ptp(got.column("score").to_numpy()) < 1e-3


def test_more_level_documents_than_are_asked_for(spark, tmp_path):
    docs = {f"d{i:04d}": "same words here" for i in range(700)} | {"other": "words"}
    made = Bm25Index(spark, f"file://{tmp_path}/i").build(as_docs(spark, docs))
    for prune in (True, False):
        assert top(made, {"q": "same", "p": "words"}, k=3, prune=prune) == plain_bm25(docs, {"q": "same", "p": "words"}, 3)


def test_words_are_counted_in_each_document(spark):
    """F16, F19, F22: the build of the index counts words in Arrow batches; null, empty and repeated texts too."""
    from collections import Counter

    from cairn.operators.bm25_index import counted

    texts = ["b a B", None, "", "a", "b a B", "é É x-1 x"]
    df = counted(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2))
    got = {r["id"]: (r["length"], dict(zip(r["terms"], r["counts"], strict=True))) for r in df.collect()}
    want = [Counter((t or "").lower().replace("-", " ").split()) for t in texts]
    assert got == {str(i): (sum(c.values()), dict(c)) for i, c in enumerate(want)}
    assert "ArrayTransform" not in df._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
