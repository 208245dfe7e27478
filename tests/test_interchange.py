"""Files in forms of other programs, and small operators of the enrichment, against Python's own reading of them."""

import csv
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn import ship
from cairn.operators import enrich, ingest
from cairn.sources import files

R = random.Random(8)
ITEMS = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "two\\\\", "line\nfeed", "tab\t", "cr\r", "\x00\x07", "\xa0\u200b\ufeff", "😀\U000e0001", "ž, [x]", "", " ", "\\n", "\\x41", "c:\\new", "]", "['q']", "x" * 20_000, "\\" * 3000 + "'"]


def lists():
    some = [[i] for i in ITEMS] + [[], ITEMS]
    alphabet = "ab'\"\\nxu,[] \n\té\u2028😀"
    return some + [["".join(R.choice(alphabet) for _ in range(R.randint(0, 9))) for _ in range(R.randint(0, 5))] for _ in range(300)]


def test_python_lists_in_csv(spark, tmp_path):
    rows = {f"u{i:03d}": x for i, x in enumerate(lists())}
    with open(tmp_path / "t.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["url", "keywords", "other"])
        out.writerows([u, repr(x), "text with 'quotes'"] for u, x in rows.items())
        out.writerows([["n1", "", "x"], ["n2", "nan", "x"], ["n3", "it's 'no' list", "x"], ["n4", " ['a', None, 3]\n", "x"]])
    got = {r["url"]: r["keywords"] for r in files.read_literal_lists(spark, str(tmp_path / "t.csv"), ["keywords"]).collect()}
    assert got == rows | {"n1": [], "n2": [], "n3": [], "n4": ["a"]}


def test_a_table_with_list_cells_and_line_feeds(spark, tmp_path):
    """As data frames are written to CSV: lists as Python has them, other cells with line feeds."""
    (tmp_path / "t.csv").write_text('url,title,keywords,themes,full\nhttp://e/1,One,"[\'k_two\', \'k_one\']",[\'t1\'],"One\nDesc\n(P | k_one, k_two | t1 |  | )"\nhttp://e/4,Four,[],"[\'t2\', \'t4\']",x\n')
    got = [tuple(r) for r in files.read_literal_lists(spark, str(tmp_path / "t.csv"), ["keywords", "themes"]).orderBy("url").collect()]
    assert got == [("http://e/1", "One", ["k_two", "k_one"], ["t1"], "One\nDesc\n(P | k_one, k_two | t1 |  | )"), ("http://e/4", "Four", [], ["t2", "t4"], "x")]


@pytest.mark.parametrize("size", [10_000, 7])
def test_split_json_round_trip(spark, tmp_path, size):
    rows = [(f"u{i:03d}", None if i % 5 == 0 else f'title "{i}" \\ \n é', x if i % 7 else None) for i, x in enumerate(lists())]
    table = spark.createDataFrame(rows, "url string, title string, keywords array<string>").repartition(3)
    files.write_split_json(table, f"{tmp_path}/s", "url", size)
    texts = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/s").collect()]
    assert sorted(i for o in texts for i in o["index"]) == list(range(len(rows))) and all(len(o["data"]) == len(o["index"]) <= size for o in texts)
    assert sorted((tuple(x) for o in texts for x in o["data"]), key=lambda x: x[0]) == [(u, t, k) for u, t, k in rows]
    back = files.read_split_json(spark, f"{tmp_path}/s", ["keywords"], lines=True)
    assert back.columns == ["url", "title", "keywords"]
    assert sorted((tuple(r) for r in back.collect()), key=lambda x: x[0]) == rows
    if size > len(rows):  # one object, as other programs write it
        back = files.read_split_json(spark, f"{tmp_path}/s", ["keywords"])
        assert back.count() == len(rows)


def test_rows_of_split_json_do_not_carry_their_object(spark, tmp_path):
    files.write_split_json(spark.range(3).select(F.col("id").cast("string").alias("url"), F.lit("t").alias("title")), f"{tmp_path}/s", "url")
    plan = files.read_split_json(spark, f"{tmp_path}/s", [], lines=True)._jdf.queryExecution().optimizedPlan().toString()
    carried = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert re.search(r"\), \[\d+\], false, \[r#\d+\]", carried), carried  # the column below is dropped


def test_numbers_in_split_json(spark):
    table = spark.createDataFrame([("a", 1, 2.5, True), ("b", None, None, None)], "k string, n int, x double, f boolean")
    assert json.loads(files.as_split_json(table, "k").first()["value"]) == {"columns": ["k", "n", "x", "f"], "index": [0, 1], "data": [["a", 1, 2.5, True], ["b", None, None, None]]}


# ---------------------------------------------------------------- documents, coverage and prompts

SCHEMA = "url string, title string, description string, provider string, keywords array<string>, themes array<string>, categories array<string>, spatial_coverage array<string>, temporal_coverage array<string>"


def datasets(spark):
    return spark.createDataFrame([("u1", "T1", "D1", None, ["k"], [], [], ["s"], []), ("u2", None, None, "P", None, ["t"], [], [], ["2020"])], SCHEMA)


def test_metadata_has_all_columns_but_the_description(spark):
    rows = {r["doc_id"]: r["metadata"].asDict() for r in ingest.documents(datasets(spark)).collect()}
    assert rows["u1"] == {"url": "u1", "title": "T1", "provider": None, "keywords": ["k"], "themes": [], "categories": [], "spatial_coverage": ["s"], "temporal_coverage": []}
    assert rows["u2"]["title"] is None and rows["u2"]["keywords"] is None and "description" not in rows["u2"]
    assert ingest.documents(datasets(spark).limit(0)).collect() == []


def test_coverage_by_url_is_empty_where_there_is_none(spark):
    coverage = spark.createDataFrame([("u1", ["Brno"], None), ("u9", ["x"], ["y"])], "url string, spatial_coverage array<string>, temporal_coverage array<string>")
    rows = {r["url"]: (r["spatial_coverage"], r["temporal_coverage"]) for r in ingest.with_coverage(datasets(spark), coverage).collect()}
    assert rows == {"u1": (["Brno"], []), "u2": ([], [])}
    rows = {r["url"]: (r["spatial_coverage"], r["temporal_coverage"]) for r in ingest.with_coverage(datasets(spark), None).collect()}
    assert rows == {"u1": ([], []), "u2": ([], [])}


def test_prompts(spark):
    d = datasets(spark).withColumn("n", F.lit(3))
    text = enrich.templated("Title: {title}; keywords: {keywords}/{themes}. {{n}} = {n}")
    assert [r[0] for r in d.orderBy("url").select(text).collect()] == ["Title: T1; keywords: k/. {n} = 3", "Title: ; keywords: /t. {n} = 3"]
    asked = enrich.gate(datasets(spark).fillna("")).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    texts = {r["url"]: r["p"] for r in enrich.gate(asked.select(*datasets(spark).columns)).select("url", enrich.prompt().alias("p")).collect()}
    assert texts["u1"] == "Describe the dataset in JSON with lists: keywords (2), categories (2), temporal_coverage\n\nT1\nD1"
    assert texts["u2"] == "Describe the dataset in JSON with lists: keywords (3), categories (2), spatial_coverage\n\n\n"


def test_answers_with_unknown_keys_are_asked_again(spark):
    ship(spark)
    asked = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "url string, prompt string").coalesce(1)
    turns = {"p1": ['{"x": 1, "other": 2}', '{"x": 1}'], "p2": ['{"other": 1}'] * 3, "p3": ["[1]", "null", "{}"]}

    def complete(prompts, seen={}):  # noqa: B006 - kept over the calls of a task
        out = []
        for p in prompts:
            seen[p] = seen.get(p, -1) + 1
            out.append(turns[p][seen[p]])
        return out

    got = {r["url"]: r["answer"] for r in enrich.answers(asked, complete, allowed=["x"]).collect()}
    assert got == {"a": '{"x": 1}', "b": "{}", "c": "{}"}


def test_settings_in_yaml():
    if files.yaml is None:
        pytest.skip("no YAML library")
    text = "search:\n  top: 3  # a comment\n  weights: [0.6, 0.4]\nname: x\n"
    assert files.settings(text, environment={"CAIRN_SEARCH__TOP": "5"}) == {"search": {"top": 5, "weights": [0.6, 0.4]}, "name": "x"}
