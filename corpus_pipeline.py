"""From raw documents to token files: five stages, each an operator of `sightings.llm`.

A stage takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is
written as Parquet and read again. All but the last return the columns of documents, whatever other
columns are there, also with names that operators use inside. Each gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightings.llm import decontaminate, mixing, quality, shingles, simhash, token_files
from sightings.llm.queries import table, tokenizer_path
from sightings.session import cut, prepare


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects; it learns from the labels.

    A null or empty text has no words and a score like any other; rows that repeat are selected
    alike and all stay.
    """
    return quality.select_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id.

    Near are texts whose whole sets of five-word shingles have a Jaccard similarity of 0.8. The
    SimHash index finds those whose fingerprints are near; pairs that it can't reach meet by
    shared shingles, so none is missed. Null and empty texts are copies of each other. Rows
    without an id stay only where no row of their group has one; rows that repeat give one.
    """
    return simhash.keep_first(docs, shingles.similar_groups(docs, shingle=5, similarity=0.8))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and empty texts are clean.

    Rows that repeat share their fate.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has the size 0; rows that repeat are documents of their own, as are rows
    without an id, and a null source is a source.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; each repetition of a document is written. Workers
    of the stages before are still there, so none keeps its encoder, and files are smaller.
    """
    return token_files.token_digests(docs, tokenizer_path(), keep=False, file_ids=1_000_000).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

#: A stage learns a model and another runs a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
