"""Fill-in-middle against plain Python, with nulls, empty and very long texts, copies and clashing columns."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn import ship
from cairn.llm.fill_middle import MARKS, fill_in_middle, original, transform, unit_ends, with_digests

SCHEMA = "doc_id long, text string, n long, form string, output string, id string, f string"
UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def expected(doc_id, text):
    """By the contract, word by word."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    lo, hi = min(h[0] % (len(units) + 1), h[1] % (len(units) + 1)), max(h[0] % (len(units) + 1), h[1] % (len(units) + 1))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), out[0], len(p), len(m), out[1]


def texts():
    some = ["one two three", "  lead and trail \n\n", "\n\t ", " ", "x", "", None, "Zwölf Ärzte 😀 nach Süd", "a <P> b", "a <S>", "<M>", "< P> <P <<S M>", "a\x0bb\x0cc\rd\x1ce\x85f"]
    return [t for t in some for _ in range(12)] + ["wort 😀 " * 300_000, "y" * 1_000_000, " " * 500_000]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, 1, "f", "o", "i", "f") for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, "no id here", 1, "f", "o", "i", "f"), (None, "no id here", 1, "f", "o", "i", "f"), ((1 << 60) + 1, "a large id", 1, "f", "o", "i", "f"), (-5, "a b c d", 1, "f", "o", "i", "f")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_rows(docs):
    got = sorted((tuple(r) for r in fill_in_middle(docs).collect()), key=repr)
    want = sorted(((r["doc_id"], *expected(r["doc_id"], r["text"])) for r in docs.collect()), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digests_and_restored_texts(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((r["doc_id"] or 0, r["output_sha256"], r["restored_sha256"]) for r in with_digests(fill_in_middle(docs)).collect())
    assert got == sorted((r["doc_id"] or 0, sha(expected(r["doc_id"], r["text"])[4]), sha(r["text"] or "")) for r in docs.collect())


def test_empty_table_and_rates(spark, docs):
    assert with_digests(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
    assert {r["form"] for r in fill_in_middle(docs, rate=0).select("form").collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle(docs, rate=100, spm_rate=0).select("form").collect()} == {"plain", "psm"}


@given(st.text(alphabet="<>PSM \néa", max_size=40), st.integers())
def test_every_output_can_be_undone(text, doc_id):
    n, form, prefix, middle, output = transform(text, str(doc_id), rate=100, spm_rate=50)
    assert original(output, form) == text
    assert (form == "plain") == (not text or any(m in text for m in MARKS))
    assert list(unit_ends(text)) == [m.end() for m in UNIT.finditer(text)] and n == len(UNIT.findall(text))
