"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corpusloom", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where the session names none (local tests) a temporary folder is set once and
    reused; a session on a cluster must name one, as a folder of one machine
    would not be seen by the others.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table; ``sweep`` removes it, at the latest when the program ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if not _SCRATCH:
        atexit.register(_sweep_at_exit)
    _SCRATCH.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` and what lies below it, in whatever file system it is; nothing happens if it is gone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Deletes the intermediate tables written so far, once the caller is done with the results that read them."""
    for path in [p for p in _SCRATCH if p not in keep]:
        remove(spark, path)
        _SCRATCH.remove(path)


def _sweep_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            sweep(spark)
    except Exception:  # the session has ended before; nothing can be reached through it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read back.

    Columnar and compressed, hence smaller than a checkpoint; the plan that reads
    it prunes columns and pushes filters down.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, wherever the session was started."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-ship-"), "corpusloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("corpusloom", os.path.relpath(full, here)))
    # The driver serves the file; no executor reads this folder.
    sc.addPyFile(path)
    sc._corpusloom_shipped = True
