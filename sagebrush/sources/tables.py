"""Input tables: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts, which cost much more to work through than to read.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that would be read in fewer tasks than there are cores is dealt out to all of them.

    Larger tables have more splits than cores and are read as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TEXTS:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
