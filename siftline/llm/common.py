"""What the operators of this subpackage share: scratch tables and gapless ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A cell is what one task ranks: at least this many rows, and at most about 1 / CELLS of all rows.
CELL_ROWS = 64
CELLS = 1 << 16
#: Rows with texts that a Python worker is sent at a time.
BATCH_ROWS = 1000
_scopes: list[list[tuple[DataFrame, str]]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Below file:// only: Hadoop's checked local files start a chmod process for each file and its checksum, and such a child has its JVM's memory until it is one.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode, where none is named, a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("siftline.scratch.dir", "")
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("siftline.scratch.dir", root)
    return root.rstrip("/")


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, after making sure that the session sends Python no more than so many rows at a time: documents are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def release(spark: SparkSession) -> None:
    """Executors collect their garbage and give the heap that it took back to the system, which they else keep for as long as they live.

    One task a core, which Spark deals to all executors that are free. For the time between stages: what they hold then is of no use later.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, nothing before this point runs again, so the shuffle
    files behind it go as soon as it is written. The tables stay until drop_scratch() or whoever owns the shared
    folder removes them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/siftline/{uuid.uuid4().hex}-{tag}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**PLAIN_FILES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append((back, path))
    return back


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove, at the end, the tables that were written within, but for those given to keep().

    What is returned from such a block must read kept tables alone. After an error all stay, for whoever looks.
    """
    kept: set[int] = set()
    outer, _scopes[:] = list(_scopes), [*_scopes, []]
    own = _scopes[-1]

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    try:
        yield keep
        fs = None
        for df, path in own:
            if id(df) in kept:
                if outer:
                    outer[-1].append((df, path))
                continue
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = fs or target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(target, True)
    finally:
        _scopes[:] = outer


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table below the shared folder; only when no result is still to be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/siftline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def gapless_rank(df: DataFrame, total: int, key: str, unit: str, order: list[str], name: str = "rank") -> DataFrame:
    """Add a rank, from 0 and without gaps, of the rows of each key.

    Rows rank by unit first. unit has at most 65,536 values, each within one key, which bounds what is
    broadcast; key may be unit itself. A unit with many rows is dealt over several cells by a hash of
    `order`, so no task ranks more than a cell. Rows that agree in `order` may take each other's rank.
    """
    rows = max(CELL_ROWS, total // CELLS)
    cells = df.groupBy(unit).agg(F.ceil(F.count("*") / rows).alias("_cells"))
    dealt = df.join(F.broadcast(cells), unit).withColumn("_cell", F.pmod(F.xxhash64(*order), F.col("_cells")).cast("int")).drop("_cells")
    before = Window.partitionBy(key).orderBy(unit, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*dict.fromkeys([key, unit, "_cell"])).agg(F.count("*").alias("_n"))
    first = counts.select(unit, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(unit, "_cell").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(first), [unit, "_cell"]).withColumn(name, (F.col("_first") + F.col("_own")).cast("long")).drop("_cell", "_own", "_first")
