"""A corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, mix.

Each stage works on all rows that the one before it kept. Stages take (spark, docs, sf_dir) and return a DataFrame,
which is written as Parquet in the shared folder and read again as the next one's docs. All stages take the columns
doc_id, text and source (and lang and n_chars, where the table has them); others, whatever their names, pass through
all stages but for `mix_slot`, `mix_pos` and `in_target`, which the last one replaces. An empty table passes all stages
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.llm import decontam, langid, lines, minhash, mixing
from sagebrush.llm.common import drop, keyed, stored
from sagebrush.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, no text, or a prediction hardly surer than chance.

    Rows of null or empty text go; those of null doc_id or lang are judged like others, but not learned from. Very long
    texts are read whole. Repeated rows stay or go together. Where nothing can be learned (no lang at all), all go.
    """
    return langid.with_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, save in the largest doc_id that holds them; n_chars follows the text. Every document stays.

    A null text stays null, an empty one empty. Rows of null doc_id lose no line. Repeated rows lose the same lines.
    Very long texts are split whole.
    """
    own = ("_ld_lines", "_ld_dropped")
    out = lines.dedup_lines(docs, counts=own).drop(*own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_names(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the least doc_id.

    Rows are judged one by one: of rows that repeat an id each has a place of its own, rows without an id come last.
    Null texts and texts without words are like nothing and stay. Very long texts are compared whole.
    """
    rows = keyed(docs)
    gone = minhash.minhash_components(rows, id_col="_row_key").where("not kept").select(F.col("doc_id").alias("_row_key")).distinct()
    return rows.join(gone, "_row_key", "left_anti").select(*_names(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, whole or for the most part, go.

    Each row is judged by its own text, whether its doc_id is null or repeated. Null and empty texts stay. Very long
    texts are searched whole. With an empty benchmark all stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix of sources, with mix_slot, mix_pos and in_target.

    A null source is a source of its own. Null and repeated ids have places of their own; texts are not looked at.
    """
    return mixing.mixed(docs)


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{name}`") for name in docs.columns]


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: The language stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
