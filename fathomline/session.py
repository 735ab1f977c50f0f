"""Session helpers: a test session, cutting of lineage in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to Python; rows of long texts would otherwise make batches of gigabytes.
ARROW_BATCH_BYTES = 8 << 20


def local_session(cores: int | str = "*", app: str = "fathomline") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Bound the bytes of the Arrow batches of this session, unless a smaller bound is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    number = int("".join(c for c in now if c.isdigit() or c == "-") or -1)
    if not now.isdigit() or number <= 0 or number > size:
        spark.conf.set(key, str(size))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that is already set. Only on one
    machine, where neither is set, a temporary folder is made; a cluster without either is an error, since its executors
    couldn't read what others wrote."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathomline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df and cut its lineage with checkpoint(), in the shared folder, so that the result survives the loss of
    any executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = shared_root(df.sparkSession)
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
    return df.checkpoint(eager=True)


#: Folders that this process made, for release().
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    _made.append(f"{shared_root(spark)}/fathomline-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Delete the folders that shared_folder() and settle() made in this process, once no DataFrame needs them any more:
    the number of folders deleted."""
    n = 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def settle(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder. For what loops carry from round to round: unlike a checkpoint, a table
    that is read again brings none of the constraints of the plan that made it, which grow with every round."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
