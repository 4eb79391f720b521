"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def send_by_value(module: str) -> None:
    """Ship a module's functions inside the task: executors need not have this package installed."""
    register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the session is local (tests, a laptop)
    a temporary folder is made, set as the checkpoint folder of the session and deleted at the end of the process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(spark.sparkContext, "_tidemark_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(made)
        spark.sparkContext._tidemark_dir = made
        atexit.register(shutil.rmtree, made.removeprefix("file://"), ignore_errors=True)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; all paths of an application lie in one folder."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything the application wrote to the shared folder; results that read it must be gone by then."""
    from tidemark.sources import storage

    storage.delete(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder: it survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 32 << 20) -> bool:
    """Whether a table was counted and measured and may be broadcast: few rows, and few bytes in them.

    ``df`` should be a materialized (or otherwise cheap) table: the count reads it, though not beyond ``max_rows``.
    """
    texts = [F.octet_length(F.col(f"`{n}`") if t in ("string", "binary") else F.to_json(F.struct(F.col(f"`{n}`")))) for n, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map", "struct"))]
    size = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(8 * len(df.columns)))
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return found["n"] <= max_rows and (found["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast hint only for a table that is small (see ``is_small``).  A larger one comes back without a hint, so the
    join shuffles."""
    return F.broadcast(df) if is_small(df, max_rows) else df
