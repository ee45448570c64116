"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm import (
    decontaminate,
    divergence,
    exact,
    language,
    licenses,
    mixing,
    phrases,
    quality,
    secrets,
    simhash,
    substrings,
    token_files,
    warc,
)
from sightings.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hex64(c: str) -> F.Column:
    """16 lower-case digits of a long's bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@query
def op1_simple8b_tokens(spark, sf):
    return token_files.token_digests(table(spark, sf, "documents"), tokenizer_path()).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


@query
def op2_mix_sources(spark, sf):
    d = mixing.repetitions(table(spark, sf, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


@query
def op3_ppm_language(spark, sf):
    return language.languages(table(spark, sf, "documents"))


@query
def op4_license_scan(spark, sf):
    files = licenses.document_files(table(spark, sf, "documents"))
    return licenses.license_scan(files).select(
        "file_id", "path", "own_license", F.round("own_cosine", 6).alias("own_cosine"), "license", "from_path"
    )


@query
def op5_cqf_exact(spark, sf):
    return exact.exact_groups(table(spark, sf, "documents"))


@query
def op6_simhash_variants(spark, sf):
    d = simhash.near_groups(table(spark, sf, "documents"))
    return d.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@query
def op7_ordinal_quality(spark, sf):
    return quality.grades(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_owned_secrets(spark, sf):
    return secrets.secrets(table(spark, sf, "documents"))


@query
def op9_seekable_warc(spark, sf):
    return warc.page_records(table(spark, sf, "pages"))


@query
def op10_decontaminate(spark, sf):
    d = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return d.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query
def op11_source_divergence(spark, sf):
    return divergence.divergence(table(spark, sf, "documents"))


@query
def op12_repeated_substrings(spark, sf):
    d = substrings.without_repeats(table(spark, sf, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))
