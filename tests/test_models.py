"""Sentence chunks, embeddings, cross-encoders, kept answers and resumed enrichment against plain Python."""

import json
import math
import random
import time
from collections import Counter
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from cairn import ship
from cairn.operators import models, retrieval
from cairn.operators.chunking import sentence_chunks
from cairn.operators.models import Answers, HashedTokens, answered, cross_encoded, embedded, enriched_in_chunks, overlap_scorer

SPACE = " \t\n\x0b\f\r"


def sentences_of(text):
    """Cut before a character that is no space where the spaces before it follow an end mark or hold a line feed."""
    out, start = [], 0
    for i in range(1, len(text)):
        if text[i] in SPACE or text[i - 1] not in SPACE:
            continue
        j = i
        while j and text[j - 1] in SPACE:
            j -= 1
        close = j
        while close and j - close < 3 and text[close - 1] in "\"'“”’)]":
            close -= 1
        ended = any(k > 0 and text[k - 1] in ".!?…" for k in range(close, j + 1))
        if ended or "\n" in text[j:i]:
            out.append(text[start:i])
            start = i
    return [*out, text[start:]] if text else []


def chunks_of(text, size, overlap):
    pieces = []
    for s in sentences_of(text or ""):
        words = regex.findall(rf"[{SPACE}]*[^{SPACE}]+(?:[{SPACE}]+\Z)?", s)
        if len(words) > size:
            pieces += [("".join(words[i : i + size]), len(words[i : i + size])) for i in range(0, len(words), size)]
        else:
            pieces.append((s, len(words)))
    out, first, total = [], 0, 0
    for i, (_, n) in enumerate(pieces):
        if total and total + n > size:
            out.append((first, i))
            back = i
            while back > first and sum(p[1] for p in pieces[back - 1 : i]) <= min(overlap, size - n):
                back -= 1
            first, total = back, sum(p[1] for p in pieces[back:i])
        total += n
    out.append((first, len(pieces)))
    return [("".join(p[0] for p in pieces[a:b]).strip(SPACE), sum(p[1] for p in pieces[a:b])) for a, b in out]


def some_texts():
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "beta", "é", "Sb.", "x", "3.14", "(ok)", "“quoted.”", "end."])
    texts = [None, "", "  \n ", "one", "No end mark here", "One. Two three! Four five six? Seven…", "a b c d e f g h i j k l m n o p", "  lead.  trail.  \n\n", "x." + " " * 50 + "y", "a\n" + " " * 60 + "b", "Say “Stop.” Then go.)) On"]
    texts += [" ".join(word() for _ in range(r.randint(1, 80))).replace("x ", r.choice(["x\n", "x ", "x.  "])) for _ in range(60)]
    return [*texts, "Sentence number one is here. " * 5000, "word " * 20_000]


@pytest.mark.parametrize(("size", "overlap"), [(7, 3), (12, 0), (20, 19)])
def test_chunks(spark, size, overlap):
    texts = some_texts()
    docs = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "doc_id string, text string, chunk string").repartition(4)
    got = {(r["ref_doc_id"], r["chunk"]): (r["text"], r["n_words"], r["node_id"]) for r in sentence_chunks(docs, size, overlap).collect()}
    want = {(str(i), k): (*c, f"{i}#{k}") for i, t in enumerate(texts) for k, c in enumerate(chunks_of(t, size, overlap))}
    assert got == want
    assert all(n <= size for _, n, _ in got.values())


def test_no_chunk_cuts_a_sentence_that_fits(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    whole = {str(i): [s.strip(SPACE) for s in sentences_of(t or "") if len(s.split()) <= 15] for i, t in enumerate(texts)}
    found = {}
    for r in sentence_chunks(docs, 15, 5).collect():
        found.setdefault(r["ref_doc_id"], []).append(r["text"])
    for d, own in whole.items():
        assert all(any(s in c for c in found[d]) for s in set(own))
    assert sentence_chunks(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        sentence_chunks(docs, 5, 5)


# ---------------------------------------------------------------- embeddings


def test_embeddings_in_batches_of_the_size_asked_for(spark, tmp_path):
    ship(spark)
    nodes = spark.createDataFrame([(f"n{i}", f"d{i % 7}", None if i == 3 else f"text {i} of w{i % 5}", i) for i in range(257)], "node_id string, ref_doc_id string, text string, extra int").coalesce(1)
    log = str(tmp_path)

    def make():
        model = HashedTokens(8)

        def call(texts):
            Path(log, f"{time.time_ns()}-{len(texts)}").touch()
            return model(texts)

        Path(log, f"made-{time.time_ns()}").touch()
        return call

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = {r["node_id"]: r for r in embedded(nodes, make, 8, batch=100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {n: list(r["embedding"]) for n, r in got.items()} == {r["node_id"]: HashedTokens(8)([r["text"] or ""])[0] for r in nodes.collect()}
    sizes = [p.name.rsplit("-", 1)[1] for p in Path(log).iterdir() if not p.name.startswith("made")]
    assert sorted(sizes) == ["100", "100", "57"] and sum(p.name.startswith("made") for p in Path(log).iterdir()) == 1
    assert got["n5"]["extra"] == 5 and embedded(nodes.limit(0), make, 8).collect() == []


@pytest.mark.parametrize("bad", [lambda t: [[1.0] * 7] * len(t), lambda t: [[math.nan] * 8] * len(t), lambda t: [[1.0] * 8]])
def test_wrong_vectors_fail_the_run(spark, bad):
    ship(spark)
    nodes = spark.createDataFrame([("a", "a", "x"), ("b", "b", "y")], "node_id string, ref_doc_id string, text string").coalesce(1)
    with pytest.raises(Exception, match="vector"):
        embedded(nodes, lambda: bad, 8).collect()


def test_several_nodes_of_a_document_count_by_their_best(spark):
    """Each own node asks for k and the number of own nodes; the best pair of nodes counts."""
    ship(spark)
    r = random.Random(1)
    vectors = {f"d{d}#{c}": [r.gauss(0, 1) for _ in range(6)] for d in range(30) for c in range(d % 4 + 1)}
    nodes = spark.createDataFrame([(n, n.split("#")[0], v) for n, v in vectors.items()], "node_id string, ref_doc_id string, embedding array<double>")
    got = {(x["a"], x["b"]): x["score"] for x in retrieval.similar_documents(nodes, 3, 0.1).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {}
    for d in {n.split("#")[0] for n in vectors}:
        own = [n for n in vectors if n.split("#")[0] == d]
        best = {}
        for n in own:
            near = sorted(vectors, key=lambda m: (-cos(vectors[n], vectors[m]), m))[: 3 + len(own)]
            for m in near:
                e, s = m.split("#")[0], cos(vectors[n], vectors[m])
                if e != d and s >= 0.1 and e >= d:
                    best[e] = max(best.get(e, -1), s)
        want |= {(d, e): s for e, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


# ---------------------------------------------------------------- cross-encoders


def results(spark):
    rows = [("q1", f"d{i}", 0.1 * i) for i in range(12)] + [("q2", "d3", 0.9), ("q2", "d4", 0.9), ("q2", "gone", 0.5), ("q3", "d1", 0.1)]
    queries = spark.createDataFrame([("q1", "red blue"), ("q2", None), ("q3", "x")], "query string, text string")
    docs = spark.createDataFrame([(f"d{i}", "red " * (i % 3) + "blue" * (i % 2) if i != 5 else "poison red blue") for i in range(12)], "id string, text string")
    return spark.createDataFrame(rows, "query string, id string, score double"), queries, docs


def test_cross_encoder_orders_by_pairs(spark):
    ship(spark)
    found, queries, docs = results(spark)
    got = sorted((r["query"], r["nth"], r["id"], r["score"]) for r in cross_encoded(found, queries, docs, lambda: overlap_scorer, k=5).collect())
    text = {r["id"]: r["text"] for r in docs.collect()}
    want = sorted(((-overlap_scorer([("red blue", text[f"d{i}"])])[0], -round(0.1 * i, 9), f"d{i}") for i in range(2, 12)))[:5]
    assert [(x[2], x[3]) for x in got if x[0] == "q1"] == [(w[2], -w[0]) for w in want]
    assert [x[2] for x in got if x[0] == "q2"] == ["d3", "d4", "gone"]  # a null query: all 0, then by score and id
    assert not [x for x in got if x[0] == "q3"]  # below the cutoff


def test_a_pair_that_fails_stands_behind_and_fails_no_other(spark):
    ship(spark)
    found, queries, docs = results(spark)

    def make():
        def score(pairs):
            if any("poison" in t for _, t in pairs):
                raise RuntimeError("bad pair")
            return [math.inf if t == "blue" else s for s, (_, t) in zip(overlap_scorer(pairs), pairs, strict=True)]

        return score

    rows = [r for r in cross_encoded(found, queries, docs, make, batch=4).collect() if r["query"] == "q1"]
    rows.sort(key=lambda r: r["nth"])
    text = {r["id"]: r["text"] for r in docs.collect()}
    behind = [r["id"] for r in rows if r["score"] is None]
    assert set(behind) == {r["id"] for r in rows if text[r["id"]] == "blue" or "poison" in text[r["id"]]}
    assert [r["id"] for r in rows][-len(behind) :] == behind and len(rows) == 10
    assert all(r["score"] == overlap_scorer([("red blue", text[r["id"]])])[0] for r in rows if r["score"] is not None)


# ---------------------------------------------------------------- answers


def counting(log, fail=()):
    def make():
        def call(text):
            Path(log, f"{time.time_ns()}-{text}").touch()
            if text in fail:
                raise ValueError("no")
            return json.dumps({"of": text})

        return call

    return make


def calls(log):
    return Counter(p.name.split("-", 1)[1] for p in Path(log).iterdir())


def test_a_second_run_makes_no_call(spark, tmp_path):
    ship(spark)
    log = tmp_path / "log"
    log.mkdir()
    kept = Answers(spark, f"file://{tmp_path}/answers")
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("bad",)], "text string").repartition(3)
    first = {r["text"]: r["answer"] for r in kept.of(texts, "m", "expand", counting(str(log), {"bad"}), retries=2).collect()}
    assert first == {"a": '{"of": "a"}', "b": '{"of": "b"}', "bad": "{}"} and calls(log) == {"a": 1, "b": 1, "bad": 2}
    again = {r["text"]: r["answer"] for r in kept.of(texts.union(texts), "m", "expand", counting(str(log))).collect()}
    assert again == first | {"bad": '{"of": "bad"}'} and calls(log) == {"a": 1, "b": 1, "bad": 3}  # what failed is asked again
    kept.of(texts, "m", "expand", counting(str(log))).collect()
    assert calls(log) == {"a": 1, "b": 1, "bad": 3}
    kept.of(texts.where("text = 'a'"), "m", "split", counting(str(log))).collect()
    kept.of(texts.where("text = 'a'"), "other", "expand", counting(str(log))).collect()
    assert calls(log)["a"] == 3  # another kind of question, and another model


def test_a_failed_run_leaves_nothing_and_the_next_one_asks_again(spark, tmp_path):
    ship(spark)
    kept = Answers(spark, f"file://{tmp_path}/answers")

    def make():
        raise OSError("no model")

    texts = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="no model"):
        kept.of(texts, "m", "k", make).collect()
    assert kept.read().collect() == []
    assert kept.of(texts, "m", "k", lambda: lambda t: "{}").collect()[0]["answer"] == "{}"


def test_slow_calls_end_as_empty_answers_and_calls_are_bounded(spark, tmp_path):
    ship(spark)
    log = str(tmp_path)

    def make():
        import threading

        lock, under_way = threading.Lock(), [0]

        def call(text):
            with lock:
                under_way[0] += 1
                Path(log, f"{under_way[0]}-{time.time_ns()}").touch()
            time.sleep(3 if text == "slow" else 0.02)
            with lock:
                under_way[0] -= 1
            return "{}" if text == "slow" else '{"ok": 1}'

        return call

    asked = spark.createDataFrame([("slow" if i == 5 else f"t{i}", i) for i in range(12)], "text string, n int").coalesce(1)
    got = {r["text"]: r["answer"] for r in answered(asked, make, retries=1, timeout=0.5, threads=3).collect()}
    assert got == {t: "{}" if t == "slow" else '{"ok": 1}' for t in got} and len(got) == 12
    assert max(int(p.name.split("-")[0]) for p in Path(log).iterdir()) <= 3


def test_enrichment_goes_on_where_it_stopped(spark, tmp_path):
    data = spark.createDataFrame([(f"u{i:03d}", i) for i in range(100)], "url string, v int").repartition(3)
    seen = []

    def enrich(rows):
        urls = sorted(r["url"] for r in rows.collect())
        if len(seen) == 2 and not allowed:
            raise KeyboardInterrupt
        seen.append(urls)
        return rows.withColumn("w", F.col("v") + 1)

    allowed = []
    stage = f"file://{tmp_path}/stage"
    with pytest.raises(KeyboardInterrupt):
        enriched_in_chunks(data, enrich, stage, size=8, at_once=2)
    allowed.append(True)
    found = enriched_in_chunks(data, enrich, stage, size=8, at_once=2)
    assert sorted((r["url"], r["v"], r["w"]) for r in found.collect()) == [(f"u{i:03d}", i, i + 1) for i in range(100)]
    assert seen == [[f"u{i:03d}" for i in range(lo, min(lo + 16, 100))] for lo in range(0, 100, 16)]
    assert enriched_in_chunks(data.limit(0), lambda d: d, f"file://{tmp_path}/none").collect() == []


def test_tokens_are_those_of_the_column_function(spark):
    from cairn.functions.text import tokens

    r = random.Random(2)
    texts = ["".join(r.choice("aB9_ -.²é٣ßǅ\u0301漢x") for _ in range(r.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert all(models.words_of(x["t"]) == x["w"] for x in rows)
