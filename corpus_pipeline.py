"""From documents to packed training sequences: toxic documents go, near duplicates go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bagminhash import near_duplicates
from quire.llm.packing import pack
from quire.llm.substring_dedup import substring_dedup
from quire.llm.text import table, written
from quire.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic, rows and columns as they are.

    Null and empty texts have no words: they stay, unless the labels make most documents toxic. Repeated rows stay or go
    together. No documents, no rows.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; rows without an id stay.

    Of rows alike in id and text one stays. Texts without words are one class: of null and empty ones the smallest id
    stays. No documents, no rows.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    # a struct holds the row, so that no name can clash
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("print"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    known = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "print"]).select("row.*")
    return known.unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start in an earlier one; texts that lose nothing stay as they are.

    A document that loses all its words stays with an empty text. Null texts stay null; rows without an id lose nothing;
    rows of one id take nothing from each other. n_chars follows the text where there is such a column.
    """
    carry = tuple(c for c in docs.columns if c != "doc_id")
    out = substring_dedup(docs, carry=carry)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("rest.text"))
    new = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids.

    Null and empty texts are an end token alone; rows without an id and repeated rows are packed each on its own; other
    columns are left behind. No documents, no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", passages), ("packing", packing)]

#: No stage but the third could be said in SQL: they hold a trained model, a randomised signature and a greedy packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
