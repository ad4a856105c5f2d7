"""Session settings and the spreading of inputs with few partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Generated methods beyond 8000 bytecodes are never compiled by HotSpot; Spark then had better split them up.

    Ranked groups are cut on the map side up to the largest number of records that a model keeps.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "20000")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Dealt out where a table has fewer partitions than the cluster has cores: one small file, one row group.

    Large tables have more and are left alone, so no text is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
