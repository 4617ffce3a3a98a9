"""Session settings and lineage cuts."""

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes of values up to which a pinned table is broadcast; executors hold a few times as much.
BROADCAST_BYTES = 16 << 20


def build_session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume; `conf` wins over the defaults.

    Shuffle width is left to the cluster: AQE coalesces small partitions and splits skewed ones.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Pinned tables go from the shared folder once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Call sites per column expression are a debugging aid that slows the building of wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        context.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for what Spark has no writer for: listing, renaming and removing folders."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the driver ends."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            found, files = hadoop_path(spark, path)
            files.delete(found, True)

    atexit.register(drop)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once and read it from there afterwards.

    For small results of large scans that several later steps read: a lost executor then
    costs a re-read of the result and not a second pass over the source.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin_all(*frames: DataFrame) -> list[DataFrame]:
    """Pin several tables at the same time, so that small jobs do not wait for each other."""
    _ensure_checkpoint_dir(frames[0].sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(pin, frames))


def pinned_bytes(df: DataFrame) -> int:
    """Bytes of a pinned table's values, measured by one aggregate."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{name}`"))), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0])


def broadcast_if_small(pinned: DataFrame) -> DataFrame:
    """Ask for a broadcast of a pinned table only if it has been measured to be small."""
    return F.broadcast(pinned) if pinned_bytes(pinned) <= BROADCAST_BYTES else pinned


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a lookup to a big table.

    The lookup is computed once and measured. A small one is broadcast, so the big table is not
    shuffled; a larger one is joined by key and AQE splits its hot keys.
    """
    return df.join(broadcast_if_small(pin(lookup)), on, how)
