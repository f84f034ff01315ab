"""What the operators share on the Spark side: tables, cut lineage, checked broadcasts, components.

Every intermediate that is reused is cut with ``checkpoint()`` in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a read and never a wrong result.
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is sent to every executor; beyond it operators shuffle instead.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A local session without one gets a local folder; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context._conf.get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="skriva-")
        shared_dir.local = where
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that later plans read it rather than run it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut``, dealt by ``key``, so that joins on it move the other side only.

    A plan made adaptively does not tell how its result is dealt, so this step is made without.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that were cut and that nothing holds any more.

    It acts when the driver collects garbage, which a driver with little to do hardly
    ever does; until then the files of every earlier step stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already cut) marked for broadcast if count x row_bytes stays in the limit, else unmarked."""
    n = df.limit(limit // row_bytes + 1).count()
    return F.broadcast(df) if n * row_bytes <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating minimum hooks: (node, label), label the least node reachable.

    Each round every node takes the least label among itself and its neighbours, then
    labels are shortened by jumping (label of the label).  Rounds are logarithmic on
    chains and one or two on stars.  Nodes are whatever type ``edges`` carries; null
    ends are ignored.  Nothing is collected.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = label.join(near, label.node == near.u, "left").select("node", F.least("label", F.coalesce("near", "label")).alias("hook"), F.col("label").alias("old"))
        # the old label of a node also learns what the node has heard
        heard = hooked.groupBy(F.col("old").alias("root")).agg(F.min("hook").alias("best"))
        step = hooked.join(heard, hooked.old == heard.root, "left").select("node", F.least("hook", "best").alias("hook"), "old")
        step = cut(step)
        jump = step.select(F.col("node").alias("k"), F.col("hook").alias("hop"))
        following = step.join(jump, step.hook == jump.k, "left").select("node", F.least("hook", F.coalesce("hop", "hook")).alias("label"), "old")
        following = cut(following)
        if following.where("label <> old").isEmpty():
            return following.select("node", "label")
        label = following.select("node", "label")
