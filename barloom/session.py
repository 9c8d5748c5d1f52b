"""Spark session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SHARED: dict[str, str] = {}


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's plans expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers unpickle the library's functions by reference, so the package has to be importable
    there even where the repository is only on the driver's path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix=f"{name}_"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark fetches the file from here while it runs
    path = os.path.join(folder, f"{name}_pkg.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which the driver and all executors share.

    The setting is read from the session. Only on a local master (tests, a laptop) may it be unset; the folder is then one
    of the machine's own. On a cluster that would be another folder on each machine, so it is an error.
    """
    sc = spark.sparkContext
    known = _SHARED.get(sc.applicationId)
    if known is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="barloom_shared_")
        known = _SHARED[sc.applicationId] = f"{base.rstrip('/')}/barloom-{sc.applicationId}"
        atexit.register(_remove, sc, known)
    return known


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, its lineage cut, and it survives lost executors."""
    path = path or new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _remove(sc, path: str) -> None:
    """Delete the application's tables at its end, while its JVM is there."""
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM has gone: whoever owns the folder cleans it
        pass
