"""Unifying the values of list attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X


def vocabulary(datasets: DataFrame, column: str) -> DataFrame:
    """Distinct values of a list column."""
    return datasets.select(F.explode(column).alias("word")).distinct()


def counts(datasets: DataFrame, column: str) -> DataFrame:
    return datasets.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def case_variants(words: DataFrame) -> DataFrame:
    """(lowered, variants, unified) of words (word) that differ in case only: upper case if a variant is all capitals."""
    groups = words.distinct().groupBy(F.lower("word").alias("lowered")).agg(F.array_sort(F.collect_set("word")).alias("variants"), F.bool_or(X.is_all_caps(F.col("word"))).alias("caps"))
    return groups.where(F.size("variants") > 1).select("lowered", "variants", F.when(F.col("caps"), F.upper("lowered")).otherwise(F.col("lowered")).alias("unified"))


def replaced(datasets: DataFrame, column: str, mapping: DataFrame, key: str = "url") -> DataFrame:
    """datasets with the items of a list column replaced by mapping (word, new), sorted and distinct."""
    items = datasets.select(key, F.explode(column).alias("word")).join(mapping.select("word", "new"), "word", "left")
    lists = items.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("new", "word"))).alias("_new"))
    none = F.array().cast("array<string>")
    return datasets.join(lists, key, "left").withColumn(column, F.coalesce("_new", none)).drop("_new")


def case_unified(datasets: DataFrame, column: str, key: str = "url") -> DataFrame:
    mapping = case_variants(vocabulary(datasets, column)).select(F.explode("variants").alias("word"), F.col("unified").alias("new"))
    return replaced(datasets, column, mapping, key)


def _deletions(word):
    """The word and what is left when one character is dropped."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))))
    return F.when(F.length(word) == 0, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), less)))


def close_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of words (word) with an edit distance of 1.

    Such words share themselves or a deletion, so that an equi-join finds them, and the distance confirms.
    """
    one = words.select(F.col("word").alias("a"), F.explode(_deletions(F.col("word"))).alias("key"))
    two = one.select(F.col("a").alias("b"), "key")
    pairs = one.join(two, "key").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def merge_mapping(frequencies: DataFrame) -> DataFrame:
    """(word, new): each of the words (word, n) to its most frequent neighbour at distance 1, if that is more
    frequent, or as frequent and smaller.  One pass; ties go to the smallest neighbour."""
    pairs = close_pairs(frequencies.select("word"))
    both = pairs.union(pairs.select("b", "a"))
    seen = both.join(frequencies.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(frequencies.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    better = seen.where("nb > na or (nb = na and b < a)")
    return better.groupBy(F.col("a").alias("word")).agg(F.min_by("b", F.struct((-F.col("nb")).alias("n"), "b")).alias("new"))


def cleaned_words(datasets: DataFrame, column: str, key: str = "url") -> DataFrame:
    """Items stripped and without final marks, case unified, and close spellings merged into the more frequent one."""
    tidy = lambda x: X.without_trailing_mark(X.strip(x))
    datasets = datasets.withColumn(column, F.array_sort(F.array_distinct(X.texts(F.transform(column, tidy)))))
    datasets = case_unified(datasets, column, key)
    lowered = counts(datasets, column).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    return replaced(datasets, column, merge_mapping(lowered), key)


def split_on_commas(datasets: DataFrame, column: str, cache: DataFrame, key: str = "url") -> DataFrame:
    """Items with a comma become the parts that the cache (word, parts) has for them; others, and unknown ones, stay."""
    items = datasets.select(key, F.explode(column).alias("word")).join(cache.select("word", "parts"), "word", "left")
    parts = items.select(key, F.explode(F.coalesce("parts", F.array("word"))).alias("part"))
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("_new"))
    return datasets.join(lists, key, "left").withColumn(column, F.coalesce("_new", F.array().cast("array<string>"))).drop("_new")


def cleaned_coverage(datasets: DataFrame, as_of_year: int, key: str = "url") -> DataFrame:
    """Temporal and spatial coverages in their simplest form."""
    datasets = datasets.withColumn("temporal_coverage", X.simple_periods(X.years_and_months(F.col("temporal_coverage")), as_of_year))
    return case_unified(datasets, "spatial_coverage", key).withColumn("spatial_coverage", X.local_places(F.col("spatial_coverage")))
