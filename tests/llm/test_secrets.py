"""Secret scans against plain Python that counts every window anew, and against SQL."""

import base64
import collections
import hashlib
import random
import re

import pytest

from cairn import ship
from cairn.llm import secrets as S
from cairn.llm.oracles import OP11

SCHEMA = "doc_id long, text string, base string, added string, runs string, spans string"
SF = "/root/testdata/sf0.01"
R = random.Random(11)
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_of(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def added_of(text, allowed=()):
    out = []
    for k, c in enumerate(S.CLASSES):
        table = S.terms(c.window)
        for m in re.finditer(f"[{c.characters}]{{{c.window},}}", text):
            run, low = m[0], m[0].lower()
            if k and re.fullmatch(f"[{S.CLASSES[k - 1].characters}]+", run):
                continue
            if not re.search(S.TOUCHING, run) or re.search(S.UUID.replace(r"\z", r"\Z"), run) or "example" in low or any(low in s for s in S.SEQUENCES) or any(re.search(p, run) for p in allowed):
                continue
            before = text[max(0, m.start() - S.BEFORE) : m.start()]
            if re.search(S.DECLARED.replace(r"\z", r"\Z"), "".join(x.lower() if x.isascii() else x for x in before)):
                continue
            spans = []
            for i in range(len(run) - c.window + 1):
                if sum(table[n] for n in collections.Counter(run[i : i + c.window]).values()) <= S.most_sum(c.window, c.bits):
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
            out += [(m.start() + a, 3 + k, c.kind, m.start() + b) for a, b in spans]
    return sorted(out)


def key(n):
    return base64.b64encode(R.randbytes(n)).decode()


def texts():
    h = lambda n: R.randbytes(n).hex()
    some = [None, "", " ", "no secret here", "ä😀 password=hunter2hunter2 é", "password= short", "PassWord' : \"abcdefgh\" and api_key=12345678, apikey:::", "token: secret: abcdefgh1 token=secret=abcdefgh1"]
    some += [f"AKIA{'A1B2' * 3} AKIAAKIA{'Z9' * 6} AKIA1234567890 xAKIAQQQQQQQQQQQQ", h(20), h(16), h(15), h(40) + "G", h(16).upper(), f"sha256:{h(32)} sha256 = '{h(32).upper()}' commit {h(20)} x{h(20)}"]
    some += [key(24), key(60), f"key {key(33)} and 😀{key(33)}", "a" * 500, "0123456789abcdef" * 30, "0123456789abcdefghijklmnop", "AbCdEfGhIjKlMnOpQrStUvWxYz0123456789", "123e4567-e89b-12d3-a456-426614174000"]
    some += ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "2024-01-15/some-long-slug-of-words_and_more", "verylongwordwithoutanydigitsatall", "abc123" * 20, key(30) + "aaaaaaaaaaaaaaaaaaaaaaaaa1" + key(30), key(30) + "-" * 30 + key(30)]
    some += [f"sha1={key(16)}={h(20)}", f"md5-checksum-of-{key(9)} : {key(30)}", f"{key(12)}:{key(30)}", "\n".join(f"t{i} = {key(18)}; {h(18)}" for i in range(150))]
    some += ["Kelvin: toKen=abcdefghij, ſecret=abcdefghij", "token= abcdefghij", "secret\n=abcdefghij", "wort " * 30_000 + key(40) + " ä" * 40_000 + h(20)]
    some += ["".join(R.choice("abc01 =:\"'AKIsecrtokn-/+") for _ in range(R.randint(1, 400))) for _ in range(150)]
    some += ["".join(R.choice([h(R.randint(5, 30)), key(R.randint(5, 60)), "AKIA" + key(20).upper(), " ", "-", "password=", "token: '", "ä", "sha1 "]) for _ in range(R.randint(1, 25))) for _ in range(120)]
    return some


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "b", "a", "r", "s") for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, rows[9][1], "b", "a", "r", "s"), (4, "another text with one id: " + key(40), "b", "a", "r", "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def bag(rows):
    return collections.Counter(map(repr, rows))


def test_spans(docs):
    got = bag((r["doc_id"], [tuple(x) for x in r["base"]], [tuple(x) for x in r["added"]]) for r in S.find_secrets(docs).collect())
    want = bag((r["doc_id"], base_of(r["text"] or ""), added_of(r["text"] or "")) for r in docs.collect())
    assert got == want
    kinds = {x[2] for r in docs.collect() for x in base_of(r["text"] or "") + added_of(r["text"] or "")}
    assert kinds == {*S.BASE_KINDS, *(c.kind for c in S.CLASSES)}


def test_digests(docs):
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    got = bag(tuple(r) for r in S.with_digest(S.find_secrets(docs)).collect())
    want = []
    for r in docs.collect():
        base, added = base_of(r["text"] or ""), added_of(r["text"] or "")
        n = [sum(x[2] == k for x in base) for k in S.BASE_KINDS]
        want.append((r["doc_id"], *n, hashlib.sha256(text(base).encode()).hexdigest(), text(sorted(base + added))))
    assert got == bag(want)


def test_allow_list_of_the_caller_and_no_classes(docs):
    got = bag((r["doc_id"], [tuple(x) for x in r["added"]]) for r in S.find_secrets(docs, allowed=["[+/]"]).collect())
    assert got == bag((r["doc_id"], added_of(r["text"] or "", ["[+/]"])) for r in docs.collect())
    only = S.find_secrets(docs, classes=[]).collect()
    assert not any(r["added"] for r in only) and any(r["base"] for r in only)
    with pytest.raises(ValueError, match="127"):
        S.find_secrets(docs, classes=[S.Class("x", "a-z", 200, 3.0)])


def test_empty_table(spark):
    assert S.with_digest(S.find_secrets(spark.createDataFrame([], SCHEMA))).collect() == []


def test_very_long_run_is_cut_into_segments_with_the_same_windows(spark):
    ship(spark)
    run = key(9000)[:12000].replace("=", "A") + "a" * 5000 + key(6000).replace("=", "B") + "ab1" * 4000
    text = "x " + run + " ä " + R.randbytes(6000).hex()
    row = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["added"]] == added_of(text) and [tuple(x) for x in row["base"]] == base_of(text)


def test_no_python_and_no_shuffle(docs):
    plan = S.with_digest(S.find_secrets(docs.select("*")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]


def test_sql_over_the_planted_texts(spark, docs, tmp_path):
    from compare import difference

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    spark.read.parquet(f"{tmp_path}/d").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert difference(S.with_digest(S.find_secrets(docs)), OP11, str(tmp_path)) == ""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert difference(S.with_digest(S.find_secrets(given)), OP11, SF) == ""
