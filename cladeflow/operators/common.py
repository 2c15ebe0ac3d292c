"""Join and checkpoint helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20    # largest side ever broadcast by hand


def sized_join(big: DataFrame, small: DataFrame, on: list[str], small_bytes: int, how: str = "inner",
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join on ``on``: broadcast ``small`` when its proven size allows it, else sort-merge.

    ``small_bytes`` is an upper bound the caller has computed.  Beyond ``limit`` the join is
    pinned to a sort-merge: file-size estimates do not see an exploded side, and a sort-merge
    is what adaptive execution can split when a key holds a large share of ``big``.
    """
    return big.join(F.broadcast(small) if small_bytes <= limit else small.hint("merge"), on, how)


def narrow(big: DataFrame, ids: DataFrame, on: str, most: int) -> DataFrame:
    """Rows of ``big`` whose unique key is among at most ``most`` ids.

    Within the broadcast bound the big side is filtered where it is read and never shuffled.
    """
    if most * 128 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return big.join(ids, on, "left_semi")


def task_count(spark: SparkSession) -> int:
    """Tasks for CPU-bound steps whose input is too small for adaptive execution to keep apart."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse if there is only one machine.

    On a cluster the warehouse may be a local folder of each machine, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cladeflow-checkpoints").rstrip("/")


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")
