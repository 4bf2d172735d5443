"""A corpus pipeline made of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.llm import _common, bpe, decontamination, line_dedup, quality, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of labelled documents, scores as good."""
    return quality.keep_good(docs, quality.fit(docs, _common.table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows of three lines; n_chars is that of the text that is left."""
    out = line_dedup.line_dedup(docs, counts=False)
    return out.select(*[F.length("text").cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else F.col(x) for x in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8 or more), that with the least id."""
    return simhash.one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, _common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its token ids and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, *bpe.default_ranks())


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _common.table(spark, sf_dir, "documents")
    paths: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs, path = _common.saved(out, "stage-" + name.replace(" ", "-"))
        paths.append(path)
        if len(paths) > 1:
            _common.remove(spark, paths.pop(0))
    return docs
