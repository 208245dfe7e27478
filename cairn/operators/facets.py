"""Facets, facet filters and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import detail_prefix
from cairn.schemas import DISTRIBUTION_NAMES, LIST_COLUMNS

#: The facets and their titles.
FACETS = {c: c.replace("_", " ").capitalize() for c in [*LIST_COLUMNS, "provider"]}


def facet_counts(datasets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, facet, value, n) over the list columns and the provider in one pass; a null list has no values."""
    by = by or []
    none = F.array().cast("array<string>")
    values = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), none).alias("values")) for c in LIST_COLUMNS]
    values.append(F.struct(F.lit("provider").alias("facet"), F.when(F.col("provider").isNotNull(), F.array("provider")).otherwise(none).alias("values")))
    rows = datasets.select(*by, F.explode(F.array(*values)).alias("f")).select(*by, "f.facet", F.explode("f.values").alias("value"))
    return rows.groupBy(*by, "facet", "value").agg(F.count("*").alias("n"))


def ordered_facets(counts: DataFrame) -> DataFrame:
    titles = F.create_map(*(F.lit(x) for kv in FACETS.items() for x in kv))
    return counts.withColumn("title", F.element_at(titles, F.col("facet"))).orderBy("facet", F.desc("n"), "value")


def filtered(datasets: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """Datasets that have every selected value of every facet."""
    for column, values in selected.items():
        if values:
            wanted = F.array(*(F.lit(v) for v in values))
            own = F.array("provider") if column == "provider" else F.coalesce(F.col(column), F.array().cast("array<string>"))
            datasets = datasets.where(F.size(F.array_except(wanted, own)) == 0)
    return datasets


def any_selected(selected: dict[str, list[str]]) -> bool:
    return any(selected.values())


def live_filters(selected: DataFrame, counts: DataFrame) -> DataFrame:
    """Of the selected (facet, value) those that occur in the results."""
    return selected.join(counts.select("facet", "value"), ["facet", "value"], "left_semi")


def by_url(datasets: DataFrame, asked: DataFrame, app: str) -> DataFrame:
    """Record for each asked address, which may be a dataset's url or its detail page; the url comes first, and there is one."""
    page = detail_prefix(app)
    own = asked.select("address").distinct()
    inner = F.when(F.col("address").startswith(page), F.substr(F.col("address"), F.lit(len(page) + 1)))
    forms = own.select("address", F.explode(F.array(F.struct(F.col("address").alias("url"), F.lit(0).alias("form")), F.struct(inner.alias("url"), F.lit(1).alias("form")))).alias("x"))
    found = forms.select("address", "x.url", "x.form").where("url is not null").join(datasets, "url")
    others = [c for c in datasets.columns if c != "url"]
    best = found.groupBy("address").agg(F.min_by(F.struct("url", *others), F.struct("form", *others)).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in datasets.columns), "address")


def by_title(datasets: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, url): of the datasets with an asked title the smallest url."""
    return datasets.join(titles.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.min("url").alias("url"))


def distribution_columns(raw: DataFrame) -> DataFrame:
    """Only the known columns of a distribution, under their names here."""
    return raw.select(*(F.col(old).alias(new) for old, new in DISTRIBUTION_NAMES.items()))


def with_distributions(datasets: DataFrame, distributions: DataFrame) -> DataFrame:
    """Datasets with an array of their distributions, a missing title being Distribution and its number."""
    nth = F.row_number().over(Window.partitionBy("dataset_url").orderBy("url"))
    named = distributions.withColumn("nth", nth).withColumn("title", F.coalesce("title", F.concat(F.lit("Distribution "), F.col("nth").cast("string"))))
    lists = named.groupBy(F.col("dataset_url").alias("url")).agg(F.sort_array(F.collect_list(F.struct("nth", "title", F.col("url").alias("access_url"), "file_format"))).alias("distributions"))
    return datasets.join(lists, "url", "left")
