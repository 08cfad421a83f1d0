"""From documents to token ids: five stages, each over all that the one before kept.

``run`` applies the stages to the documents table; a scheduler may as well write each
stage's rows as Parquet and read them again for the next. No stage drops a clean document: toxic
texts go, later copies of repeated passages are cut out of texts (a document of which
nothing is left goes), one document of each near-duplicate group stays, sources are
mixed to their target weights, and the result is encoded.

In every stage columns other than doc_id, text, source and n_chars pass through unseen, whatever their names; an
empty table gives an empty one. Each stage first lets Spark remove the shuffle files of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import graph, linededup, mixing, neardup, sentencepieces, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_TOXICITY = 0.7


def _measured(docs: DataFrame, columns: list[str], changed) -> DataFrame:
    """n_chars, if there is one, of the texts that have changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under MAX_TOXICITY.

    Null and empty texts get the score of the bias alone; repeated rows and ids are scored one by one. Without a
    usable label every score is 0.5, so all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels), MAX_TOXICITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents that lose every word go.

    Null and empty texts, and rows with a null id, stay as they are. Of equal runs the first by id and place stays; rows with
    one id and text are one document.
    """
    graph.release(spark)
    # names of their own: the documents' n_lines and n_gone, if they have such columns, stay
    cut = linededup.dedup(docs, counts=("__line_total", "__line_lost"))
    left = (F.col("__line_lost") == 0) | F.col("text").rlike(mixing.WORD)
    return _measured(cut.where(left), docs.columns, F.col("__line_lost") > 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Null texts are no copies of anything, empty texts of each other; rows with a null id stay, and of those with one id one.
    """
    graph.release(spark)
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out so that sources have their target shares.

    Null and empty texts have no words, so nothing of them is taken; a null source is one of its own. Rows alike in
    id and size tie, in any order.
    """
    graph.release(spark)
    return _measured(mixing.apply(docs), docs.columns, F.lit(True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, parity and round_trip of every row.

    Null and empty texts have no ids, and both marks hold; rows are encoded one by one, repeated ones too.
    """
    graph.release(spark)
    return sentencepieces.encode(docs, sentencepieces.load(spark, MODEL), keep=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the learnt and hashed stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
