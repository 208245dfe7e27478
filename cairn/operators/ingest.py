"""From denormalised rows to one row per dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.schemas import CATEGORIES, DATASET_NAMES, IRRELEVANT_COLUMNS
from cairn.sources.store import kept_rows


def with_known_names(raw: DataFrame, names: dict[str, str] = DATASET_NAMES, drop: list[str] = IRRELEVANT_COLUMNS) -> DataFrame:
    return raw.drop(*drop).withColumnsRenamed(names)


def merged_rows(raw: DataFrame, lists: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per url: distinct values of the list columns, and the other columns of its first row.

    The first row is the smallest by `order`, by default by all other columns.  One aggregation does both.
    """
    others = [c for c in raw.columns if c not in lists and c != "url"]
    first = F.min_by(F.struct(*others), F.struct(*(order or others))).alias("first")
    sets = [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c) for c in lists]
    merged = raw.where(F.col("url").isNotNull()).groupBy("url").agg(first, *sets)
    return merged.select("url", *(F.col(f"first.{c}").alias(c) for c in others), *lists)


def with_fingerprint(datasets: DataFrame) -> DataFrame:
    """Full description and its MD5, which tells whether a dataset has changed; taken before any cleaning."""
    full = X.full_description(*(F.col(c) for c in ("title", "description", "provider", "keywords", "themes", "spatial_coverage", "temporal_coverage")))
    return datasets.withColumn("full_description", full).withColumn("full_description_hash", F.md5(F.col("full_description").cast("binary")))


def promoted(datasets: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """Values move up: what is a category from themes and keywords to categories, what is a theme anywhere
    from keywords to themes.  The vocabulary of themes is that before the change; keywords meet it as rows."""
    known = F.array(*(F.lit(c) for c in categories)) if categories else F.array().cast("array<string>")
    themes = datasets.select(F.explode("themes").alias("word")).distinct()
    words = datasets.select("url", F.explode("keywords").alias("word")).distinct().join(themes, "word")
    found = words.groupBy("url").agg(F.collect_set("word").alias("_themes"))
    k, t, c, own = F.col("keywords"), F.col("themes"), F.col("categories"), F.coalesce("_themes", F.array().cast("array<string>"))
    return datasets.join(found, "url", "left").withColumns(
        {
            "categories": F.array_sort(F.array_union(F.array_union(c, F.array_intersect(t, known)), F.array_intersect(k, known))),
            "themes": F.array_sort(F.array_except(F.array_union(t, own), known)),
            "keywords": F.array_sort(F.array_except(F.array_except(k, known), own)),
        }
    ).drop("_themes")


def coverage_from_triples(triples: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(url, spatial_coverage, temporal_coverage) from (s, p, o, lang).

    A dataset needs both a period and a place.  Start, end and the place's name are optional; of two kinds of names
    the first counts, and a name in another language than Czech removes the row.
    """
    n = {"temporal": "temporal", "spatial": "spatial", "start": "startDate", "end": "endDate", "name": "name", "label": "label"} | (names or {})
    of = lambda key, s, *o: triples.where(F.col("p") == n[key]).select(F.col("s").alias(s), *o)
    rows = of("temporal", "url", F.col("o").alias("period")).join(of("spatial", "url", F.col("o").alias("place")), "url")
    rows = rows.join(of("start", "period", F.col("o").alias("start")), "period", "left").join(of("end", "period", F.col("o").alias("end")), "period", "left")
    rows = rows.join(of("name", "place", F.struct("o", "lang").alias("name")), "place", "left").join(of("label", "place", F.struct("o", "lang").alias("label")), "place", "left")
    rows = rows.withColumn("named", F.coalesce("name", "label")).where(F.col("named").isNull() | (F.col("named.lang") == "cs"))
    return rows.groupBy("url").agg(F.array_sort(F.collect_set("named.o")).alias("spatial_coverage"), F.array_sort(F.collect_set(X.year_range(F.col("start"), F.col("end")))).alias("temporal_coverage"))


def with_coverage(datasets: DataFrame, coverage: DataFrame | None) -> DataFrame:
    """Both coverages by url; empty for datasets, or sources, without."""
    names = ["spatial_coverage", "temporal_coverage"]
    base = datasets.drop(*names)
    none = F.array().cast("array<string>")
    if coverage is None:
        return base.withColumns(dict.fromkeys(names, none))
    return base.join(coverage, "url", "left").withColumns({c: F.coalesce(c, none) for c in names})


def transformed(raw: DataFrame, coverage: DataFrame | None = None, categories: list[str] = CATEGORIES) -> DataFrame:
    """Raw rows to datasets with fingerprints, cleaned keywords and promoted values."""
    from cairn.operators.vocabulary import cleaned_words

    datasets = with_coverage(merged_rows(with_known_names(raw), ["keywords", "themes"]), coverage)
    datasets = with_fingerprint(datasets.withColumn("categories", F.array().cast("array<string>")))
    return promoted(cleaned_words(datasets, "keywords"), categories)


def documents(datasets: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of each dataset."""
    body = X.document_text(*(F.col(c) for c in ("title", "description", "provider", "keywords", "themes", "categories", "spatial_coverage", "temporal_coverage")))
    rest = [c for c in datasets.columns if c != "description"]
    return datasets.select(F.col("url").alias("doc_id"), body.alias("text"), F.struct(*rest).alias("metadata"))


def chunks(docs: DataFrame, size: int = 8096, overlap: int = 50) -> DataFrame:
    """(node_id, ref_doc_id, chunk, text): runs of white-space tokens with an overlap; a short text is one chunk."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size("words") - overlap) / F.lit(step))).cast("int")
    starts = docs.select("doc_id", words.alias("words")).select("doc_id", "words", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    body = F.array_join(F.slice("words", F.col("chunk") * step + 1, size), " ")
    return starts.select(F.concat_ws("#", "doc_id", "chunk").alias("node_id"), F.col("doc_id").alias("ref_doc_id"), "chunk", body.alias("text"))


def batches(rows: DataFrame, key: str, size: int = 32) -> DataFrame:
    """Rows with the number of their batch in key order, counted within ranges that many tasks sort.

    The ranges are written once and read twice, so that their numbers are the same for the counts and for the rows, however
    Spark puts partitions together.
    """
    ranged = kept_rows(rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "batches")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_nth") - 1) / size)).drop("_part", "_before", "_nth")


def with_filled_fields(records: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Empty texts and lists for nulls."""
    filled = {c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}
    return reduce(lambda df, kv: df.withColumn(*kv), filled.items(), records)
