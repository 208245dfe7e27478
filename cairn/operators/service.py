"""What a search platform asks of the catalogue: home page, details, and the tools of a chat assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import facets, graph
from cairn.sources.files import read_texts

#: The texts about the catalogue that the assistant may read.
INFO_FILES = ["metadata", "data_catalog", "app"]
LISTED = ["themes", "categories", "provider"]


def home(datasets: DataFrame) -> DataFrame:
    """Facets of the whole catalogue, most frequent values first."""
    return facets.ordered_facets(facets.facet_counts(datasets))


def detail(datasets: DataFrame, distributions: DataFrame, edges: DataFrame, similar: DataFrame, asked: DataFrame, app: str) -> tuple[DataFrame, DataFrame]:
    """(records with their distributions, similar datasets with previews) of asked addresses (address).

    An address may be a dataset's url or its detail page; similar datasets belong to the dataset's own url.
    """
    found = facets.by_url(datasets, asked, app)
    records = facets.with_distributions(found, distributions)
    lists = graph.all_similar(edges, similar, found.select("url").distinct())
    return records, graph.with_previews(lists, datasets)


def build_or_update(datasets: DataFrame, new: DataFrame, removed: DataFrame, state: tuple[DataFrame, DataFrame] | None, nearest) -> tuple[DataFrame, DataFrame]:
    """Edge tables: built in full without a state or when everything is new, else updated."""
    if state is None or datasets.join(new.select("url"), "url", "left_anti").isEmpty():
        return graph.metadata_edges(datasets), graph.with_similar(None, nearest(datasets.select("url")))
    return graph.updated(*state, new, removed, nearest)


def list_values(datasets: DataFrame, attribute: str) -> DataFrame:
    """Distinct themes, categories or providers."""
    if attribute not in LISTED:
        raise ValueError(f"one of {', '.join(LISTED)} is asked for, not {attribute}")
    values = F.col(attribute) if attribute == "provider" else F.explode(attribute)
    return datasets.select(values.alias("value")).where("value is not null").distinct()


def dataset_info(datasets: DataFrame, distributions: DataFrame, asked: DataFrame, app: str) -> DataFrame:
    """Records of asked (address), an url or a title; the url comes first."""
    by_url = facets.by_url(datasets, asked, app)
    titles = asked.join(by_url.select("address"), "address", "left_anti").select(F.col("address").alias("title"))
    named = facets.by_title(datasets, titles).select(F.col("title").alias("address"), "url")
    both = by_url.unionByName(named.join(datasets, "url"), allowMissingColumns=True)
    return facets.with_distributions(both, distributions)


def info_file(spark, folder: str, name: str) -> DataFrame:
    """One of the allowed texts."""
    if name not in INFO_FILES:
        raise ValueError(f"no such text: {name}")
    return read_texts(spark, folder, [name])


def titles_and_pages(results: DataFrame, app: str) -> DataFrame:
    """Search results (query, nth, title, url) as titles and detail pages."""
    from cairn.functions.text import detail_url

    return results.select("query", "nth", "title", detail_url(app, F.col("url")).alias("page"))
