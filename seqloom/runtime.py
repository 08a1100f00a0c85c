"""Session, shared scratch space and size checks used by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator may broadcast after measuring it.
BROADCAST_BYTES = 32 << 20

_OWN_ROOT: dict[str, str] = {}


def session(app: str = "seqloom", cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); any other
    master is refused, because a machine-local folder would not survive a lost node.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        _delete_on_exit(spark, _OWN_ROOT[app])
    return _OWN_ROOT[app]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Hadoop resolves it to (a path without one lies on ``fs.defaultFS``)."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString()


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


class Scratch:
    """Written tables that cut lineage; they live in the shared folder and outlast executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/seqloom-{label}-{uuid.uuid4().hex}"
        self._n = 0
        _delete_on_exit(spark, self.base)

    def table(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` once and return it as read back from there."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}_{label}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._seqloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            p, fs = _path(self.spark, t._seqloom_path)
            fs.delete(p, True)


    def close(self) -> None:
        """Remove everything written here."""
        p, fs = _path(self.spark, self.base)
        fs.delete(p, True)


#: Longest model file, in bytes, that is read whole on the driver.
MODEL_BYTES = 256 << 20


def whole_text(spark: SparkSession, path: str) -> str:
    """A model file as one text; longer ones than ``MODEL_BYTES`` are refused."""
    p, fs = _path(spark, path)
    if fs.getFileStatus(p).getLen() > MODEL_BYTES:
        raise ValueError(f"{path} is longer than {MODEL_BYTES} bytes")
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def bytes_of(df: DataFrame) -> int:
    """Catalyst's size estimate of a (written) table, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, rows: int | None = None, width: int = 64, limit: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` provably fits ``limit``: ``rows`` counted rows of at most ``width`` bytes, else by file size."""
    return rows * width <= limit if rows is not None else bytes_of(df) <= limit


def maybe_broadcast(df: DataFrame, rows: int | None = None, width: int = 64) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the plan keeps its shuffle join."""
    return F.broadcast(df) if small(df, rows, width) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for maps whose work is not in the bytes.

    A small file is one partition; only such few partitions are shuffled, large tables stay as they are read.
    ``df`` must be a scan with projections and filters: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
