"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on at scale. AQE coalesces small shuffle partitions, splits skewed join
# partitions (also where that costs one more exchange) and switches to a broadcast join only when
# the measured side is below spark.sql.autoBroadcastJoinThreshold.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "salesflow", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="salesflow-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


class Scratch:
    """A folder below the shared one that holds the intermediates of one piece of work.

    Used as a context manager it takes every ``materialize`` call made inside the block and deletes
    the folder at its end, so results must be written or counted before. Without a block all
    intermediates of a session go to one scratch folder, which is deleted when Python exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/salesflow-{uuid.uuid4().hex}"

    def new(self, kind: str = "table") -> str:
        """A fresh path inside the folder."""
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def close(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already; its folder's lifetime rule is left then
            pass

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        self.close()


_open: list[Scratch] = []
_by_session: dict[str, Scratch] = {}


def scratch(spark: SparkSession) -> Scratch:
    """The innermost open scratch folder, or the one of the session."""
    if _open:
        return _open[-1]
    app = spark.sparkContext.applicationId
    if app not in _by_session:
        _by_session[app] = Scratch(spark)
        atexit.register(_by_session[app].close)
    return _by_session[app]


# While a wide table is written: its shuffles are deleted as soon as it is there, not when the driver collects garbage, and
# generated code stays short enough for the JVM to compile it (longer methods are interpreted).
WIDE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    old = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, by: list[str] = (), within: Scratch | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back; this runs a Spark job now.

    Use it for an intermediate that several later steps read: it is computed once, its values no
    longer change between reads (float sums do), it survives lost executors, and Spark then knows
    its real size, so a later join broadcasts it only if that size is below the threshold. ``by`` names
    columns that become folders, so that a filter or join on them reads only what it needs. ``within`` is a scratch
    folder of its own, for a table that the caller deletes (``close``) when nothing reads it any more. ``wide`` says that
    the table has about the size of the input: it is packed tighter, and the shuffles behind it are deleted once it is stored.
    """
    path = (within or scratch(df.sparkSession)).new()
    if wide:
        with settings(df.sparkSession, WIDE_CONF):
            df.write.partitionBy(*by).parquet(path, compression="zstd")
    else:
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BUCKET_BYTES = 16 << 20   # less than a million rows of the sales views
MAX_BUCKETS = 400         # every task that writes buckets makes a file for each


def _bucket_count(df: DataFrame) -> int:
    """One for each ``BUCKET_BYTES`` of what ``df`` reads, but as many as there are cores; as for a shuffle if that is not known."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(-(-size // BUCKET_BYTES), spark.sparkContext.defaultParallelism), MAX_BUCKETS)


def materialize_buckets(df: DataFrame, key: str, within: Scratch | None = None) -> DataFrame:
    """Like ``materialize`` for a wide table, in buckets by ``key``: a later group-by or join on it needs no shuffle of these rows.

    Packed columns take a fraction of the disk that the same rows take in a shuffle. The name under which Spark writes the
    buckets is dropped at once; the files stay.
    """
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    with settings(spark, WIDE_CONF):
        df.write.bucketBy(_bucket_count(df), key).saveAsTable(name, format="parquet", path=(within or scratch(spark)).new(), compression="zstd")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored
