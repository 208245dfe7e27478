"""Fill-in-middle transformation: texts are cut at unit ends and their middle moves to the end, behind marks.

A unit is a word with the white space before it, or white space without a word behind it.  An Arrow-batched pandas
UDF finds the ends of the units of a text with the regex library and keeps them in one compact array of numbers; two
look-ups in it give the places of both cuts, and the text is sliced there.  Seeds come from SHA-256 of a fixed word and
the document's id, so that a row's form depends on nothing but the row: any partitioning and any repeated task give
the same output.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle, and what stands before an id in its seed.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = "42"
_UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def numbers(seed: str, doc_id: str) -> tuple[int, ...]:
    """Four 32-bit numbers of a document by its id in decimal, which is empty for a row without one."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points: 4 bytes for each unit, or 8 in texts beyond 2**32 code points."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in _UNIT.finditer(text)))


def transform(text: str | None, doc_id: str, seed: str = SEED, rate: int = 50, spm_rate: int = 80) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def original(output: str, form: str) -> str:
    """The text that an output was made of, from its marks alone.

    A mark cannot arise across the end of a part: every mark begins with a character that no mark has further on.
    """
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, rest = output[len(PREFIX) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of units of the whole text; form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle); rate of 100 texts are transformed, and spm_rate of 100 of these as spm.  prefix_chars and
    middle_chars are code points, null if plain.  A null text counts as an empty one, and both are plain, as are texts that hold
    a mark.  Rows that share an id have the same seed, and rows without an id share one; other columns are
    ignored, and an empty table gives none.  A very long text is transformed whole, beside an array of 4 bytes for each unit.
    """

    @F.pandas_udf(FIELDS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [transform(t, i, seed, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # pandas has no nulls among long numbers
    return docs.select("doc_id", cut(as_text, "text").alias("f")).select("doc_id", "f.*")


def with_digests(transformed: DataFrame) -> DataFrame:
    """Rows of fill_in_middle with output_sha256, and restored_sha256 of the text rebuilt from output and form, in place of the output."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for outputs, forms in batches:
            yield pd.DataFrame([(sha(o), sha(original(o, f))) for o, f in zip(outputs, forms, strict=True)], columns=["output_sha256", "restored_sha256"])

    return transformed.select("*", digests("output", "form").alias("d")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")
