"""Session helpers: a local session for tests and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "maskwright") -> SparkSession:
    """Session for tests and benchmarks. Cluster jobs bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MASKWRIGHT_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; make one only for a local master without it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: list[DataFrame] = []


def kept_once(df: DataFrame) -> DataFrame:
    """Persist rows that all branches and jobs of one query start from; those of the query before are given up.

    Unlike a checkpoint they lie compressed, in memory first, and keep their partitioning.
    """
    while _kept:
        old = _kept.pop()
        if old.sparkSession is df.sparkSession and not df.sparkSession.sparkContext._jsc.sc().isStopped():
            old.unpersist()
    name = "spark.sql.adaptive.enabled"  # the partitioning of an adaptive plan is unknown to what reads the rows
    given = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "false")
    try:
        _kept.append(df.persist())
    finally:
        df.sparkSession.conf.set(name, given)
    return df


def held(df: DataFrame) -> DataFrame:
    """Persist rows that several branches read, computed at once in a job of their own; given up with those of ``kept_once``.

    A branch that moves nothing is one stage, and every sort and hash table in a task takes a page of 64 MB at least, so
    what the branches share must not be computed again inside each of them.
    """
    name = "spark.sql.adaptive.enabled"
    given = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "false")
    try:
        _kept.append(df.persist())
    finally:
        df.sparkSession.conf.set(name, given)
    df.count()
    return df


def lies_by_image(spark: SparkSession) -> bool:
    """Whether the boxes of an image lie in one task; not so where images are too crowded for it."""
    return spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"


def shared(df: DataFrame) -> DataFrame:
    """Rows that several branches read: persisted where they lie by image and are to stay there, else written once."""
    return held(df) if lies_by_image(df.sparkSession) else cut(df)


def by_image(df: DataFrame) -> DataFrame:
    """Rows that were read from files, shuffled once to where the boxes of their images lie, so that the joins and
    aggregations that follow move nothing. Left as they are where images are too crowded to lie together."""
    spark = df.sparkSession
    if not lies_by_image(spark):
        return df
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, "image_id")


ROWS_PER_TASK = 50_000  # boxes; each becomes a dozen runs of some 70 bytes, so a sort of them takes about 50 MB


def size_shuffles(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Let the number of shuffle partitions grow with the input; returns it.

    The number the session came with is the least and is remembered, so that a small input after a large one gets it again.
    """
    name, ours, given = "spark.sql.shuffle.partitions", "spark.maskwright.partitions.set", "spark.maskwright.partitions.given"
    now = spark.conf.get(name)
    least = spark.conf.get(given) if spark.conf.get(ours, None) == now else now
    tasks = str(max(int(least), -(-rows // rows_per_task)))
    for key, value in ((name, tasks), (ours, tasks), (given, least)):
        spark.conf.set(key, value)
    return int(tasks)
