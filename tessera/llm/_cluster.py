"""What the operators need of the cluster: the shared folder, cut lineage, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and driver and executors are one process (tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _LOCAL[app]
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """(the path, its file system) for the JVM."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here, lost executors cost a read.

    The files go when the application ends, or before by ``drop_cut``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def swept(df: DataFrame) -> DataFrame:
    """``cut``, and the shuffle files of the write go with its end, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``cut`` once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/cut-" in f}:
        folder, fs = _folder(df.sparkSession, name)
        fs.delete(folder, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``node, component`` (the least node of each).

    Alternating large-star and small-star steps: every round is grouped minima and joins.
    The minima are combined before the shuffle and written before the join, so that both
    sides of the join are plain exchanges and Spark can split a node of very many edges;
    no component meets in one task.  Nodes without an edge don't appear; null ends and
    loops are ignored.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e, before, seen = cut(e), None, None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen, before = now, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for done in (before, low, large, least):
            drop_cut(done)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    flat = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return flat.unionByName(roots)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links between nodes 0 .. n - 1, for all but the least."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label < np.arange(n))
    return node, label[node]
