"""A corpus pipeline of five stages, each applying one operator of cairn.llm to all that the stage before kept.

quality rules -> MinHash near-dedup -> benchmark decontamination -> mixing to target weights -> token shards.

Every stage but the last returns rows of documents, unchanged, with all their columns, whatever else these are
called.  A decision names documents by doc_id: rows that share an id share its fate, and rows without an id stay.
The mix orders rows and drops none; its order is that of the rows in its files, and the shards of the last stage follow it.
An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import ship
from cairn.llm.common import fresh_path, scanned, staged
from cairn.llm.decontaminate import contamination
from cairn.llm.mixing import exact_order
from cairn.llm.near_dup import near_duplicates
from cairn.llm.quality import quality_rules
from cairn.llm.queries import tokenizer_path
from cairn.llm.tokens import token_shards


def _without(docs: DataFrame, decisions: DataFrame, kept: str) -> DataFrame:
    """docs without those whose decision is not to keep them.

    The hash of the decisions spares the texts a sort; it is a shuffled one, since decisions grow with the input.
    """
    out = staged(decisions.where(~F.col(kept) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "pipeline-out")
    return docs.join(out.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go.

    Null, empty and short texts fail the base rules; long ones are judged whole; equal texts share their fate.
    """
    ship(spark)
    return _without(docs, quality_rules(docs), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without a word are in no group.  Rows of one id that are copies of each other all stay or all go.
    """
    ship(spark)
    return _without(docs, near_duplicates(docs), "kept")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go; null texts hold none, and without items all stay.

    Texts of any length are searched whole, and equal texts share their fate.
    """
    ship(spark)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.withColumn("clean", ~F.col("contaminated")), "clean")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All documents, in the order in which the mix places them; texts are carried along, whatever they are.

    weights are target weights (source, weight), by default the sources' sizes to the power of 0.9; documents
    of sources that are given without a positive weight go.  Rows that share an id are neighbours, in no defined order;
    texts of any length move as they are.
    """
    placed = exact_order(docs, weights).where("kept").select("slot", "place", "row")
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, as read back from the files; a null or empty text is its end id alone.

    The shards have documents in the order in which docs are stored, which is that of the mix; docs is a stored table, as it was
    read.  mix_start is the number of ids before a document in the shards, start that of all documents with smaller
    ids; documents without an id come first there, and rows that share an id are in the order of their ids' crc32.
    """
    ship(spark)
    stored = docs.metadataColumn("_metadata")
    name = lambda pattern: F.regexp_extract(stored["file_name"], pattern, 1).try_cast("long")
    # a task's files are numbered, and so are the parts that it rolled them into
    file = name(r"^part-(\d+)") * (1 << 20) + F.coalesce(name(r"-c(\d+)[^-]*$"), F.lit(0))
    shards = token_shards(docs, tokenizer_path(), order=(file, stored["row_index"])).withColumnRenamed("start", "mix_start")
    placed = scanned(shards, ["doc_id", "ids_crc32", "n_tokens", "mix_start"], ["n_tokens"], "pipeline-tokens")
    return placed.select("doc_id", F.col("n_tokens_before").alias("start"), "n_tokens", "ids_crc32", "mix_start")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_output),
]

#: The quality and token stages are not expressible in SQL; tests/llm compares run() with a plain Python run of all stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
