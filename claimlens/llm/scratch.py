"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import ensure_checkpoint_dir


_WORKER_CACHES: list[dict] = []


def worker_cache(cache: dict) -> None:
    """Name a cache that a Python worker keeps between the tasks of a stage."""
    _WORKER_CACHES.append(cache)


def drop_worker_caches() -> None:
    """Workers serve many stages; one that begins a new kind of work drops what the earlier ones left."""
    if any(_WORKER_CACHES):
        for cache in _WORKER_CACHES:
            cache.clear()
        gc.collect()


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a
    lost executor costs a re-read instead of a recomputation."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class IdTable:
    """A bit table of the ids of a column: :meth:`may_hold` is true for every one of them and few others.

    Rows that miss it need no join. The table has 16 bits an id, 8 kB to 16 MB
    in all; beyond 2**23 ids more rows hit it, and are joined, but none is lost.
    """

    def __init__(self, ids: DataFrame, col: str):
        ids = written(ids.select(F.col(col).alias("id")), "ids")
        wanted = 16 * ids.count()
        self.bits = min(1 << 27, max(1 << 16, 1 << (wanted - 1).bit_length()))
        slot = self._slot(F.col("id"))
        words = ids.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("b"))
        every = ids.sparkSession.range(self.bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
        filled = words.union(every).groupBy("w").agg(F.bit_or("b").alias("b"))
        # the table itself: a fixed number of words, sorted in one task
        self.table = written(filled.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("t")).select(F.col("t.b").alias("t")), "id-table")

    def _slot(self, c):
        return F.pmod(F.xxhash64(c), F.lit(self.bits))

    def may_hold(self, c):
        slot = self._slot(c)
        word = F.get(self.table.scalar(), F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
