"""Session, checkpoint folder and parallelism, shared by all operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "tidemark", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Rows are small and their expressions heavy: partitions are kept apart down to this size.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder the session names.

    A folder of this process is made only where neither the session nor the context
    names one and all tasks run in this process's machine, as in local tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a Python-heavy step enough tasks.

    A small input may arrive as one file and thus one task. Only then are its rows dealt
    out again; an input with a task for each core is left where it lies, without shuffle. An
    input that has a shuffle or a Python step of its own is left as well: its tasks are not known before it runs.
    """
    plan = df._jdf.queryExecution().executedPlan()
    nodes, steps = [plan], []
    while nodes:
        node = nodes.pop()
        steps.append(node.getClass().getSimpleName())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    if any("Exchange" in s or "AdaptiveSparkPlan" in s or "Arrow" in s or "Pandas" in s or "InPython" in s for s in steps):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """At least so many shuffle partitions for what is materialised inside; the setting is put back after."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
