"""One place for the session settings that the plans count on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's settings take its place."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("riboplan")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    return b.config(map=settings | conf).getOrCreate()


#: Rows of a record table that one task takes where plans name the number of partitions.
TASK_ROWS = 250_000


def parts_of(*tables: DataFrame) -> int:
    """Partitions that grow with the counted rows of tables as stored, so that no task's share does; at least the session's number."""
    rows = sum(t.count() for t in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def within(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no more than one above that."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A side of a join of narrow rows, sent to all tasks if it has at most ``rows`` of them (tens of MB)."""
    return F.broadcast(df) if within(df, rows) else df


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's checkpoint folder, set if it is not; the cluster shares it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the cluster {sc.master} shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the checkpoint folder that the cluster shares."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
