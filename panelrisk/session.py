"""Session set-up, pinned intermediates and shared scratch folders."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, app="panelrisk"):
    """Session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where nothing is configured and the master is local (tests) is a
    temporary folder made; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="panelrisk-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values):
    """Settings of the session (dots as double underscores) for the actions inside."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


_owned: list = []


@contextmanager
def owned_pins(spark: SparkSession):
    """Delete on leaving what was pinned inside; results must be written or read out by then.

        with owned_pins(spark):
            panels.annual_index(...).write.parquet(target)
    """
    mine: list = []
    _owned.append(mine)
    try:
        yield mine
    finally:
        _owned.remove(mine)
        for path in mine:
            delete(spark, path)


def delete(spark: SparkSession, path: str):
    """Delete a table that this library has written below the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Cuts the lineage and gives several readers the same rows. Unlike a
    checkpoint the written table is compressed and can be read by column.
    """
    path = scratch(df.sparkSession, "pin")
    if _owned:
        _owned[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
