"""Queries of this subpackage for __spark_entry__.py: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn import ship
from cairn.llm.oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file, which is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.url_filter import RULES, judge_urls, rule_table

    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes = b"cairn demonstration key") -> DataFrame:
    from cairn.llm.pseudonyms import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents"), key)


def op5_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.warc import read_warc, write_warc

    return read_warc(write_warc(_table(spark, sf_dir, "pages")))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.kneser_ney import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op7_prefix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.mixing import exact_order

    return exact_order(_table(spark, sf_dir, "documents")).drop("row")


def op9_wavelet_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from cairn.llm.tokens import token_shards

    return token_shards(_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op11_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.secrets import find_secrets, with_digest

    return with_digest(find_secrets(_table(spark, sf_dir, "documents")))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.fill_middle import fill_in_middle, with_digests

    return with_digests(fill_in_middle(_table(spark, sf_dir, "documents")))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_redirect_url_filter": op1_redirect_url_filter,
    "op2_quality_outliers": op2_quality_outliers,
    "op3_debruijn_repeats": op3_debruijn_repeats,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_sharded_warc": op5_sharded_warc,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_prefix_decontaminate": op7_prefix_decontaminate,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_wavelet_token_shards": op9_wavelet_token_shards,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_entropy_secrets": op11_entropy_secrets,
    "op12_lanczos_whitening": op12_lanczos_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}
