"""Session helpers: lineage cuts into the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelforge.core.errors import LibraryError

_OWN_FOLDER: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a session that runs within one local JVM gets a temporary folder where the setting is missing; a cluster
    without the setting is refused, since a machine's own folder is lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise LibraryError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="panelforge-"))
    return _OWN_FOLDER[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._panelforge_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what :func:`cut` wrote for ``df``; no later plan may read it."""
    path = getattr(df, "_panelforge_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass


def local_session(cores: int | str = "*", name: str = "panelforge", **conf: str) -> SparkSession:
    """A session for tests and single machines."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
