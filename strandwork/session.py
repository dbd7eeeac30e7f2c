"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = 8, name: str = "strandwork") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as the checkpoint folder.

    One of our own is made only where neither is set and driver and executors are one
    process, as in tests; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandwork-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts lineage, survives lost executors, and gives the next
    plan real sizes, so that joins against it are planned from statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``materialize`` plus aggregate figures taken while the table is written, without a second job."""
    seen = Observation(uuid.uuid4().hex)
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in figures.items()]))
    return out, seen.get


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled: a table that grows with the input never goes through the driver, round after round."""
    return df.hint("merge")


def _state_of(spark: SparkSession, folder: str) -> tuple:
    """What lies in an input folder: names, sizes and times of change of its tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, key: tuple, build):
    """Build a set of written tables once for an input folder in one state, and hand out the same tables afterwards.

    ``key`` is a name and the folder; changed input is built anew.
    """
    key = (spark.sparkContext.applicationId, *key, *(_state_of(spark, k) for k in key if isinstance(k, str) and "/" in k))
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of this application the package, so that jobs run from any working folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandwork-")) / "strandwork.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    # Spark itself hands the file from the driver to the executors.
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
