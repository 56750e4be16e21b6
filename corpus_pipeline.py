"""Corpus pipeline: toxic documents out, shared lines out, near duplicates out, benchmark leaks out, the rest packed.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and (but
for the last) returns the columns of `documents`. Rows with null ids pass the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.llm.common import pick, table, written
from archipel.llm.decontamination import contaminated
from archipel.llm.line_dedup import dedup_lines
from archipel.llm.minhash import Sketching, near_duplicates
from archipel.llm.packing import pack_documents
from archipel.llm.toxicity import score_toxicity


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", written(ids.select("doc_id").distinct(), "gone"), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled ones among them, predicts as toxic."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share stay in one of them."""
    out = dedup_lines(docs)
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return _without(docs, near_duplicates(docs, Sketching()).where("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, re-parameterised or not."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, _tokenizer())


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]

#: The first stage is a trained model and the last a search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
