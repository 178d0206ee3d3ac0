"""Session helpers: shared scratch space, lineage cuts and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow dimension table may be broadcast (a few tens of MB).
SMALL_ROWS = 500_000
#: Largest latent block sent to executors as one dense weight matrix.
MODEL_BLOCK_BYTES = 512 << 20


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "latentlake") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, so that kernels load from any working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(target))
    else:  # itself imported from a zip
        sc.addPyFile(str(next(p for p in package.parents if p.is_file())))
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current.rstrip("/")


#: Folders made inside each open scratch_scope, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area; an open scratch_scope removes it at its end."""
    path = f"{checkpoint_root(spark)}/latentlake/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the scratch tables made inside, but for those written with the function that it yields (a settle() into the scope around)."""
    made: list[str] = []
    _SCOPES.append(made)

    def keep(df: DataFrame) -> DataFrame:
        inner = _SCOPES.pop()
        try:
            return settle(df)
        finally:
            _SCOPES.append(inner)

    try:
        yield keep
    finally:
        _SCOPES.pop()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    Lost executors never recompute it, and later joins plan with its true size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint after counting the rows; above the bound Spark keeps its shuffle join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


#: Values over which rows without a key are spread.
SPREAD = 4096


def left_known(rows: DataFrame, dims: DataFrame, on: list[str]) -> DataFrame:
    """Left join on string keys of which many may be null or blank; such rows match nothing.

    They get keys of their own that no row of ``dims`` has, so that they are spread over the shuffle's partitions instead of meeting in one.
    """
    blank = reduce(lambda a, b: a | b, (F.coalesce(F.trim(k), F.lit("")) == "" for k in on))
    apart = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("string"))
    keys = {k: f"_known_{k}" for k in on}
    spread = rows.withColumns({v: F.when(blank, apart).otherwise(F.col(k)) for k, v in keys.items()})
    return spread.join(dims.where(~blank).withColumnsRenamed(keys), list(keys.values()), "left").drop(*keys.values())


#: Rows of a dimension table that one array holds.
BLOCK_ROWS = 10_000


def every_pair(rows: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row with each distinct row of ``items``, whose columns are new, without a join that has no keys.

    ``items`` is packed into arrays of about ``block_rows``. One array is a scalar subquery; several make a table of blocks, which meets ``rows``
    by block number and salt, so that the rows of a block are spread over the shuffle's partitions. Any number of items gives the same rows.
    """
    items = items.distinct()
    entry = F.struct(*items.columns)
    n = items.count()
    if n <= block_rows:
        return rows.select("*", F.inline(items.agg(F.sort_array(F.collect_list(entry)).alias("items")).scalar()))
    spark = rows.sparkSession
    blocks = -(-n // block_rows)
    salts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    packed = items.groupBy(F.pmod(F.xxhash64(*items.columns), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(entry).alias("_items"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(packed, ["_block", "_salt"]).select(*rows.columns, F.inline("_items"))
