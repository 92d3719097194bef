"""Session defaults and the few cluster-facing helpers the operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their text form, beyond which a side is no longer sent to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

_settled: list[str] = []
_measured: dict[tuple, bool] = {}


def get_spark(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("locusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(master: str, named: str | None) -> str:
    """The folder for settled tables: the one that the cluster names, else one of this machine, which only the
    processes of a local master share; on a cluster without a named folder an error."""
    if named:
        return named
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "locusloom-checkpoints")


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return shared_folder(sc.master, named)


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, which `release_settled` deletes with the settled tables."""
    if not _settled:
        atexit.register(_release_at_exit)
    _settled.append(f"{checkpoint_folder(spark).rstrip('/')}/settled-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    return _settled[-1]


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a table written to the shared folder, so that later jobs read the columns they need
    of a result instead of making it again, and a lost executor costs no recomputation. `release_settled` deletes
    the tables once the results built on them have been used; what is left goes when the driver's process ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_settled(spark: SparkSession) -> int:
    """Deletes every table that `settle` has written in this process and returns their number. Frames built on them
    cannot be evaluated afterwards."""
    gone = 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _settled:
        path = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            release_settled(spark)
    except Exception:  # the context may be gone; then only folders of this machine can still be reached
        pass
    for path in _settled:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a job over at most max_rows + 1 rows proves df within both bounds. A session measures a plan once."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), max_rows, max_bytes)
    if key not in _measured:
        size = F.length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
        n, text = df.limit(max_rows + 1).select(size.alias("n")).agg(F.count("*"), F.sum("n")).first()
        _measured[key] = n <= max_rows and (text or 0) <= max_bytes
    return _measured[key]


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, within: DataFrame | None = None) -> DataFrame:
    """Marks df for broadcast if it is proven small, else leaves the choice of a join to Catalyst. `within` is a table
    of which each row gives at most a few rows of df (the spellings of a name): its size then stands for df's."""
    return F.broadcast(df) if is_small(df if within is None else within, max_rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_rows(df: DataFrame, most: int = 1000) -> list:
    """The rows of a table of fixed size that shapes a plan; an error, not a cut, if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"expected a table of at most {most} rows")
    return rows


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers: by path where they share the driver's file system, and
    as an archive sent to the executors where nothing says that they do."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not sc.master.startswith("local") and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), package), "zip", root, package)
        sc.addPyFile(archive)
