"""Session defaults, the shared scratch folder, and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "freshet", **conf: str) -> SparkSession:
    """A session with the settings the package relies on; ``conf`` adds more.

    The master and the shuffle partition count are left to the cluster unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, where there is one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` once to the shared folder; give back the stored table and its row count.

    With ``counted`` only rows that meet the condition are counted.  Loops use this
    to cut lineage.  Unlike a cached block the files outlive a lost executor, and
    their real size lets the optimizer pick the next join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    seen = Observation()
    rows = F.count(F.lit(1) if counted is None else F.when(counted, 1))
    df.observe(seen, rows.alias("n")).write.parquet(path)
    # No metric comes back from a plan that was found to be empty beforehand.
    return spark.read.schema(df.schema).parquet(path), seen.get.get("n") or 0


# A stored table of so many rows at most may go to every node, and so through the driver.
FEW_ROWS = 20_000


def sized(df: DataFrame, n_rows: int) -> DataFrame:
    """Let joins go by the number of rows: with few they send ``df`` to every node, else they shuffle both sides.

    The size of stored files is no measure: names compress to a small part of what they take in memory.
    """
    return F.broadcast(df) if n_rows <= FEW_ROWS else df.hint("merge")


def stage_sized(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``stage``, and joins of the stored table go by its number of rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    seen = Observation()
    some = F.count(F.lit(1) if counted is None else F.when(counted, 1))
    df.observe(seen, some.alias("n"), F.count(F.lit(1)).alias("rows")).write.parquet(path)
    n = seen.get
    return sized(spark.read.schema(df.schema).parquet(path), n.get("rows") or 0), n.get("n") or 0


def scratch_schema(spark: SparkSession, prefix: str = "freshet") -> str:
    """A new, empty schema whose tables live in the shared folder."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name
