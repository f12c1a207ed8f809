"""The session and shared paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine is meant for; ``conf`` overrides them. An existing
    session is used as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if it is set, else a new local one,
    which is right only where driver and executors are one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder, its lineage cut. Executors may be lost afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet in a folder of its own below the shared one, its lineage cut; it is computed
    once, and what was shuffled for it is deleted as soon as it is there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    at, was = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(at)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` gave; nothing may read them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for at in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
