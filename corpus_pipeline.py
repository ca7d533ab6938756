"""A corpus pipeline: toxicity, exact dedup, near-duplicate join, mixing, SentencePiece ids and back.

Each stage gets what the one before wrote and returns the columns of documents; the last returns token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.llm import exact_dedup, mixing, ngram_join, pieces
from readqc_spark.llm import toxicity as toxic
from readqc_spark.llm.common import cut, id_text, packed, quoted, repeated, shared_dir, table


def _only(docs: DataFrame, kept: DataFrame, digest) -> DataFrame:
    """The rows of docs whose doc_id and digest of the text (null as empty) are in kept (one column, row_key), one for each key."""
    mine = packed(docs)
    mine = mine.select("row", F.concat(id_text(F.col("doc_id")), F.lit(":"), digest(F.col("text"))).alias("row_key"))
    return mine.join(kept, "row_key").dropDuplicates(["row_key"]).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold, every column as it was.

    Null and empty texts are scored as texts without words. Repeated rows, null ids and very long texts each get their score. Without
    labels, or with one of them only, scores are constant. An empty table gives an empty one.
    """
    return toxic.without_flagged(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id (a null one counts as smallest).

    Null and empty texts are equal. Of rows that share doc_id and text, whatever else they hold, one stays. An empty table gives an
    empty one; columns of any name pass through.
    """
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    kept = cut(kept.select(F.concat(id_text(F.col("doc_id")), F.lit(":"), F.col("text_sha256")).alias("row_key")))
    return _only(docs, kept, lambda t: F.sha2(t, 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that link at 80 of 100: that of the smallest doc_id, null ids last.

    Documents are told apart by doc_id and text, so another text of the same id stays. Texts without words stay. Of rows that share
    doc_id and text one stays. An empty table gives an empty one; columns of any name pass through.
    """
    kept = ngram_join.one_of_each(docs, words=5, percent=80)
    kept = cut(kept.select(F.concat(id_text(F.col("doc_id")), F.lit(":"), F.col("text_key").cast("string")).alias("row_key")))
    return _only(docs, kept, lambda t: F.xxhash64(t).cast("string"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A row is told apart by all its columns; rows alike in all of them share their copies. Texts without words are never taken. An empty
    table gives an empty one; columns of any name pass through.
    """
    mine = packed(docs).select("row", F.sha2(F.to_json(F.struct("row")), 256).alias("row_key"))
    whole = F.sha2(F.to_json(F.struct(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))), 256)
    taken = mixing.mix(docs, row_key=whole).filter("copies > 0").groupBy("row_key").agg(F.sum("copies").alias("copies"))
    return repeated(mine.join(cut(taken), "row_key").dropDuplicates(["row_key"]), "copies", "copy").select("row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to: doc_id, chunk, n_chunks, ids, n_tokens, ids_crc32, n_chars, text_sha256.

    A null or empty text has a row without ids. Repeated rows each get theirs; very long texts have a row for each chunk.
    An empty table gives an empty one; other columns aren't looked at.
    """
    return pieces.encode_and_back(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing", mixing_stage), ("SentencePiece", pieces_stage)]
#: SQL can express neither a fitted network nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
