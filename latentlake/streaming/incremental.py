"""Incremental latent statistics: each micro-batch appends mergeable partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_MERGE = {"z_max": F.max, "z_sum": F.sum, "z_sum_sq": F.sum, "nnz": F.sum, "n_rows": F.sum}


def batch_partials(acts: DataFrame) -> DataFrame:
    """Partials of one batch of activation rows ``(latent_idx, z)``."""
    z = F.col("z")
    return acts.groupBy("latent_idx").agg(
        F.max(z).alias("z_max"),
        F.sum(z).alias("z_sum"),
        F.sum(z * z).alias("z_sum_sq"),
        F.count_if(z > 0).alias("nnz"),
        F.count("*").alias("n_rows"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("latent_idx").agg(*[f(c).alias(c) for c, f in _MERGE.items()])


class StatsStore:
    """Partials of a stream under one folder, folded into a base as it grows.

    ``delta/batch=<id>`` holds the partials of one micro-batch. Every ``fold_every`` batches the base and the deltas behind it become a new base,
    ``base/through=<id>``, which counts from the moment its entry ``manifest/<id>`` is there. A base that was cut off has no entry and is
    written again; a batch that is replayed overwrites its delta, and a delta that the base already holds is passed over. What the base
    before the last one needed is removed, so that readers of the last two never lose a file and the folder stays bounded.
    """

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 100):
        if fold_every < 1:
            raise ValueError("fold_every must be positive")
        self.spark, self.path, self.fold_every = spark, path.rstrip("/"), fold_every
        self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._folder(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """Numbers at the end of the names in ``folder``, in order."""
        at = self._folder(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName().rpartition("=")[2] for x in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def through(self) -> int:
        """The last batch that the base holds, -1 without a base."""
        return max(self._numbers("manifest"), default=-1)

    def _parts(self, upto: int | None = None) -> list[str]:
        last = self.through()
        deltas = [n for n in self._numbers("delta") if n > last and (upto is None or n <= upto)]
        return [f"{self.path}/base/through={last}"] * (last >= 0) + [f"{self.path}/delta/batch={n}" for n in deltas]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch_partials(batch).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0 and batch_id > self.through():
            self.fold(batch_id)

    def fold(self, batch_id: int) -> None:
        """Make a base of everything through ``batch_id``, commit it, and remove what the last two bases do not need."""
        before = self.through()
        merged = merge_partials(self.spark.read.parquet(*self._parts(batch_id)))
        merged.write.mode("overwrite").parquet(f"{self.path}/base/through={batch_id}")
        entry, final = (self._folder(f"{self.path}/manifest/{name}") for name in (f".{batch_id}.tmp", str(batch_id)))
        self._fs.create(entry, True).close()
        if not self._fs.rename(entry, final):
            raise OSError(f"cannot commit {final}")
        for folder, name, kept in (("delta", "batch=", before + 1), ("base", "through=", before), ("manifest", "", before)):
            for n in self._numbers(folder):
                if n < kept:
                    self._fs.delete(self._folder(f"{self.path}/{folder}/{name}{n}"), True)

    def read(self) -> DataFrame:
        return merge_partials(self.spark.read.parquet(*self._parts()))


def incremental_stats(stream: DataFrame, stats_path: str, checkpoint: str, available_now: bool = True, fold_every: int = 100) -> StreamingQuery:
    """Start the stream; every micro-batch adds its partials to the store at ``stats_path``.

    A replayed batch overwrites its partials, so a restart never counts rows twice.
    """
    store = StatsStore(stream.sparkSession, stats_path, fold_every)
    writer = stream.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_incremental(spark: SparkSession, stats_path: str) -> DataFrame:
    """Merged statistics over all batches written so far."""
    return StatsStore(spark, stats_path).read()


def compact(spark: SparkSession, stats_path: str, target: str) -> None:
    """Fold all batches into one, in a new folder."""
    read_incremental(spark, stats_path).write.mode("overwrite").parquet(f"{target}/delta/batch=0")
