"""Session settings and the shared folder for staged and checkpointed data."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The JVM never compiles a method beyond 8000 bytes of code, so a wide projection
# fused into one such method runs interpreted. The limit makes Spark generate
# smaller methods for those stages, which was three times faster on the widest one.
# Adaptive execution sizes the shuffles at run time and splits skewed joins and
# rebalances; RocksDB keeps streaming state outside the executor heap.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configured(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    """A session builder of any master with the engine's settings; ``extra`` goes over them."""
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings into a session that is already there, such as a submitted job's. Those that only a new session
    can take are left; ``configured`` has them all."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(app: str, cpus: str = "8", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", cpus)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "16g"))
    return configured(builder, **extra).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    On one machine a temporary folder stands in when the setting is missing; on
    a cluster a missing setting is an error, since executors could not read it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="downfield-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Tables written by ``materialise``, by application.
_TABLES: dict[str, list[str]] = {}


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Later passes neither
    recompute it nor depend on the executors that made it, and still read only
    the columns they need. ``options`` are those of the Parquet writer. ``release`` removes such tables."""
    spark = df.sparkSession
    path = new_dir(spark, "table")
    df.write.options(**options).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of a step when that step has ended, instead of when the driver's memory is next
    cleaned, so that the steps of a long job do not add up on the executors' disks."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the tables that ``materialise`` wrote, but for the first ``keep``. A frame read from one is of no use
    afterwards, so call it when results have been written; ``held`` gives the number to keep."""
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    while len(paths) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(configuration).delete(path, True)


def held(spark: SparkSession) -> int:
    return len(_TABLES.get(spark.sparkContext.applicationId, []))
