"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small files are cut by row group over all cores; on a cluster the defaults suit large ones.
        .config("spark.sql.files.openCostInBytes", str(64 << 10))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder the cluster names in spark.checkpoint.dir. Where none is named, a local master takes a new local folder (as in tests);
    on any other master that is an error, since executors couldn't share it."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared checkpoint folder. Columns of it can be read alone, and its files are compressed, so
    that it takes a fraction of what a checkpoint of whole rows does."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that it needn't be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{here.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(archive)
    sc._corvane_shipped = True
