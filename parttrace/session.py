"""Sessions, and data that outlives its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import ConfigError


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).appName("parttrace").config(map=conf).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder the cluster shares; one is set only where the session names none."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ConfigError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir("/tmp/checkpoints/parttrace")
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in the order of columns, by range partitions: no task sees more than its own range.

    Rows that tie in all of ``order`` are numbered in any order.
    """
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_part", "_within", "_before")
