"""Enrichment by a language model, behind callables that tests and defaults make deterministic."""

from __future__ import annotations

import json
from collections.abc import Callable
from string import Formatter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import union_of
from cairn.operators.models import Answers

#: Completes prompts to JSON texts, one for each.
Completer = Callable[[list[str]], list[str]]
KEYWORDS, CATEGORIES = 3, 2


def no_answers(prompts: list[str]) -> list[str]:
    return ["{}"] * len(prompts)


def gate(datasets: DataFrame) -> DataFrame:
    """What each dataset lacks: numbers of keywords and categories, whether coverages, and whether to ask at all."""
    need = datasets.withColumns(
        {
            "need_keywords": F.greatest(F.lit(KEYWORDS) - F.size("keywords"), F.lit(0)),
            "need_categories": F.when(F.size("categories") > 0, 0).otherwise(CATEGORIES),
            "need_spatial": F.size("spatial_coverage") == 0,
            "need_temporal": F.size("temporal_coverage") == 0,
        }
    )
    return need.withColumn("ask", (F.col("need_keywords") > 0) | (F.col("need_categories") > 0) | F.col("need_spatial") | F.col("need_temporal"))


def prompt() -> F.Column:
    """Request for what the gate says is missing."""
    wish = lambda c, n: F.when(F.col(c) > 0, F.concat(F.lit(n), F.lit(" ("), F.col(c).cast("string"), F.lit(")")))
    wishes = F.concat_ws(", ", wish("need_keywords", "keywords"), wish("need_categories", "categories"), F.when(F.col("need_spatial"), "spatial_coverage"), F.when(F.col("need_temporal"), "temporal_coverage"))
    return F.concat(F.lit("Describe the dataset in JSON with lists: "), wishes, F.lit("\n\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))


def templated(template: str, mark: str = ", ") -> F.Column:
    """A text with {column} in it, filled from each row; lists are joined, nulls are empty, and {{ and }} are braces."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            filled = F.concat_ws(mark, F.col(name))  # a list or a single value
            parts.append(filled)
    return F.concat(*parts) if parts else F.lit("")


def answers(asked: DataFrame, complete: Completer, key: str = "url", batch: int = 32, retries: int = 3, allowed: list[str] | None = None) -> DataFrame:
    """(key, answer): a JSON object for each row (key, prompt); {} after so many tries without valid JSON.

    An object with other keys than the allowed ones is not valid.
    """
    known = None if allowed is None else set(allowed)

    def valid(text: str) -> bool:
        said = json.loads(text)
        return isinstance(said, dict) and (known is None or set(said) <= known)

    def run(batches):
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                prompts = part.column(1).to_pylist()
                out: list[str | None] = [None] * len(prompts)
                for _ in range(retries):
                    open_ = [i for i, x in enumerate(out) if x is None]
                    if not open_:
                        break
                    for i, x in zip(open_, complete([prompts[i] for i in open_]), strict=True):
                        try:
                            out[i] = x if valid(x) else None
                        except (ValueError, TypeError):
                            pass
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x or "{}" for x in out], pa.string())], [key, "answer"])

    return asked.select(F.col(key).cast("string").alias(key), "prompt").mapInArrow(run, f"{key} string, answer string")


def enriched(datasets: DataFrame, complete: Completer = no_answers, key: str = "url") -> DataFrame:
    """Datasets with generated values joined to their own; only those that lack something are asked for, and no more than
    is lacking is taken.  Themes are never generated."""
    needs = gate(datasets)
    asked = needs.where("ask").select(key, prompt().alias("prompt"))
    said = F.from_json("answer", "keywords array<string>, categories array<string>, spatial_coverage array<string>, temporal_coverage array<string>")
    found = answers(asked, complete, key, allowed=["keywords", "categories", "spatial_coverage", "temporal_coverage"]).select(key, said.alias("said"))
    none = F.array().cast("array<string>")
    got = lambda c: F.filter(F.coalesce(F.col(f"said.{c}"), none), lambda x: x.isNotNull())
    joined = needs.join(found, key, "left")
    joined = joined.withColumns(
        {
            "keywords": union_of(F.col("keywords"), F.slice(got("keywords"), F.lit(1), F.col("need_keywords"))),
            "categories": union_of(F.col("categories"), F.slice(got("categories"), F.lit(1), F.col("need_categories"))),
            "spatial_coverage": F.when(F.col("need_spatial"), F.array_sort(F.array_distinct(got("spatial_coverage")))).otherwise(F.col("spatial_coverage")),
            "temporal_coverage": F.when(F.col("need_temporal"), F.array_sort(F.array_distinct(got("temporal_coverage")))).otherwise(F.col("temporal_coverage")),
        }
    )
    return joined.select(*datasets.columns)


def comma_parts(words: DataFrame, complete: Completer) -> DataFrame:
    """(word, parts) for words with a comma: the parts that the model names, or the word itself."""
    asked = words.where(F.contains(F.col("word"), F.lit(","))).distinct().withColumn("prompt", F.concat(F.lit("Split into keywords as JSON with a list named parts, or leave whole: "), F.col("word")))
    parts = F.from_json("answer", "parts array<string>")["parts"]
    return answers(asked, complete, "word").select("word", F.when(F.size(parts) > 0, parts).otherwise(F.array("word")).alias("parts"))


def kept_comma_parts(words: DataFrame, kept: Answers, model: str, make: Callable[[], Callable[[str], str]], **options) -> DataFrame:
    """(word, parts) for words with a comma, as comma_parts, from a table of answers; only unknown words are asked for."""
    asked = words.where(F.contains(F.col("word"), F.lit(","))).select(F.col("word").alias("text"))
    said = F.from_json("answer", "parts array<string>")["parts"]
    return kept.of(asked, model, "comma", make, **options).select(F.col("text").alias("word"), F.when(F.size(said) > 0, said).otherwise(F.array("text")).alias("parts"))


def expanded_queries(queries: DataFrame, kept: Answers, model: str, expand: Callable[[], Callable[[str], str]] | None = None, intent: Callable[[], Callable[[str], str]] | None = None, **options) -> DataFrame:
    """queries (query, text) with what is searched for (text) and the intent as JSON, for all queries at once, from a table of answers.

    The text is followed by a comma and the answer's expansion; without one, or without a call, it stays as it is, and
    without an answer the intent is null.
    """
    rows = queries.select("query", "text")
    if expand:
        said = kept.of(rows, model, "expand", expand, **options).select("text", F.get_json_object("answer", "$.expansion").alias("more"))
        rows = rows.join(said, "text", "left").select("query", "text", F.when(F.length("more") > 0, F.concat("text", F.lit(", "), "more")).otherwise(F.col("text")).alias("searched"))
    else:
        rows = rows.withColumn("searched", F.col("text"))
    if intent:
        said = kept.of(rows, model, "intent", intent, **options).select("text", F.when(F.col("answer") != "{}", F.col("answer")).alias("intent"))
        rows = rows.join(said, "text", "left")
    else:
        rows = rows.withColumn("intent", F.lit(None).cast("string"))
    return rows.select("query", F.col("searched").alias("text"), "intent")


def preprocessed_query(query: str, expand: Callable[[str], str] | None = None, intent: Callable[[str], str] | None = None) -> tuple[str, dict | None]:
    """(expanded query, intent): on a failure of a call the query as it is, and no intent."""
    found = None
    if intent:
        try:
            answer = intent(query)
            found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
        except (ValueError, TimeoutError):
            found = None
    if expand:
        try:
            query = expand(query) or query
        except TimeoutError:
            pass
    return query, found
