"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import line_dedup, packing, quality, simhash, substring_dedup
from siftwork.llm.common import column
from siftwork.llm.queries import tokenizer_path
from siftwork.session import fresh_path, tune


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cutoffs certified on the labels; whole documents, unchanged.

    A null text fails the base rule; repeated rows stay or go together; without labels only the base rule decides.
    """
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels)


def rare_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines found in ten documents or more; n_chars follows the text, emptied documents stay.

    Columns of `docs` keep their values whatever their names; an empty table gives an empty one.
    """
    tune(spark)
    return _with_text_of(docs, line_dedup.drop_frequent_lines, line_dedup.OUTPUTS)


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of SimHash near duplicates: three-word shingles,
    3 or fewer differing bits.  Texts without words (null ones too) are duplicates of each other."""
    tune(spark)
    return simhash.one_of_each(docs)


def single_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of twenty words that occur earlier; n_chars follows the text, emptied documents stay."""
    tune(spark)
    return _with_text_of(docs, substring_dedup.remove_repeats, substring_dedup.OUTPUTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of at most 4,096 token ids; a null text counts as empty."""
    tune(spark)
    return packing.piece_digests(packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))


def _with_text_of(docs: DataFrame, operator, outputs: list[str]) -> DataFrame:
    """The operator's texts with the columns of `docs`; those named like one of its outputs wait under another name."""
    taken = [c for c in docs.columns if c.lower() in {o.lower() for o in outputs}]
    aside = {c: f"_aside_{i}_{c}" for i, c in enumerate(taken)}
    done = operator(docs.withColumnsRenamed(aside)).drop(*outputs)
    return done.withColumnsRenamed({new: old for old, new in aside.items()}).transform(_recounted).select(
        *[column(c) for c in docs.columns])


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, null where the text is."""
    columns = {c: f"`{c}`" for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = "CAST(char_length(text) AS BIGINT) AS n_chars"
    return docs.selectExpr(*columns.values())


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", rare_lines),
    ("near_dedup", single_documents),
    ("substring_dedup", single_passages),
    ("packing", sequences),
]

#: SimHash near dedup and packing are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as parquet and read again by the next."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
