"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and read again as the next one's docs.  All but the last return the
columns of `documents`; the last adds `mix_copies`, how often the mix uses a document.
A learned score has no SQL, so ORACLE_SQL is None.  tests/llm holds line dedup, near dedup and
decontamination against brute force, mixing against a plain loop and toxicity against labels
it hasn't seen; the run as a whole is only tested to give rows within its bounds.

In every stage: null and empty texts are documents without words, lines or hits; a null
doc_id is kept until mixing; rows that repeat a doc_id are judged as the stage's operator
says; an empty table gives an empty table; other columns may have any name and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import stored, table
from glyphmark.llm.decontaminate import remove_contaminated
from glyphmark.llm.linededup import drop_lines
from glyphmark.llm.minhash import keep_representatives
from glyphmark.llm.mixing import mix
from glyphmark.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; null and empty texts score as texts without hits, repeated rows one by one."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops frequent lines; n_chars follows the text.  A null text stays null; rows that repeat a doc_id count as one document."""
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8), the smallest doc_id; texts without words and null doc_ids stay, and all rows of a kept doc_id."""
    return keep_representatives(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of the benchmark; null and empty texts stay, repeated rows are judged one by one."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents towards the sources' target weights; those without words are taken 0 times and go, a null source is one of its own."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
