"""Session helpers: local sessions for tests/bench, the shared checkpoint folder and staged tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tabsight") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local inputs: keep enough post-shuffle partitions busy for sort-heavy stages
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabsight-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a single-process ``local[...]`` session gets a folder of its own; on a
    cluster there is no safe default (a machine-local folder would lose rows), so that raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabsight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


_STAGED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder (not yet created) of the checkpoint folder; any file system Spark knows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _removing_shuffles(spark: SparkSession):
    """Queries that begin inside the block remove their shuffle files when they end, not when the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    One job (a reliable ``checkpoint()`` runs the plan twice unless cached); the
    lineage is cut, so a lost executor re-reads the staged files instead of
    re-running the shuffle that produced them.  The shuffle files of the job are
    removed at its end, since nothing reads them again.  ``drop_staged`` removes
    the staged files once nothing reads them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    with _removing_shuffles(spark):
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    # the schema is known: reading it back with it skips the footer-inference job
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(*frames: DataFrame) -> None:
    """Remove the files of staged frames that nothing will read again."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """Every table staged inside the block is removed at its end (results must be written or collected by then)."""
    before = set(_STAGED)
    try:
        yield
    finally:
        for path in [p for p in _STAGED if p not in before]:
            _STAGED.remove(path)
            _delete(spark, path)
