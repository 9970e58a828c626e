"""Spark session helpers.

The library never creates its own cluster settings when a session already
exists: callers on a cluster pass their session in. ``get_spark`` is for
tests, the bench and the driver's local runs.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "panelmill", extra_conf: dict | None = None) -> SparkSession:
    master = master or os.environ.get("PANELMILL_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("PANELMILL_SHUFFLE_PARTITIONS", "8"))
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELMILL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``panelmill`` importable on Python workers (pandas UDFs, applyInPandas).

    Functions run on executors are pickled by reference to this package, so
    the workers need it on their path wherever the driver was started. The
    package is zipped once per process and registered with ``addPyFile``
    (Spark uploads it to every executor, like ``--py-files``); a deployment
    that already ships it via ``--py-files`` or an installed wheel is left alone.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: code ships with the client)
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if "panelmill" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(key)
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="panelmill-code-"), "panelmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.
    Only when it is unset (local tests) do we set a folder of our own.
    """
    global _LOCAL_CHECKPOINT_ROOT
    ship_code(spark)
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server reads the conf)
        sc = None
    if conf_dir:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    sc_dir = sc.getCheckpointDir() if sc is not None else None
    if sc_dir:
        return sc_dir
    if sc is not None and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; "
                           "a folder of this machine would lose the tables that executors write")
    if _LOCAL_CHECKPOINT_ROOT is None:
        _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="panelmill-ckpt-")
    spark.conf.set("spark.checkpoint.dir", _LOCAL_CHECKPOINT_ROOT)
    if sc is not None:
        sc.setCheckpointDir(_LOCAL_CHECKPOINT_ROOT)
    return _LOCAL_CHECKPOINT_ROOT


_SCRATCH: list[str] = []  # folders handed out and not yet deleted


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location.

    It is deleted by ``clear_scratch`` when a job is done with its results, and at the latest
    when the driver ends.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    place, fs = _file_system(spark, path)
    fs.deleteOnExit(place)
    _SCRATCH.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder whose rows nobody reads any more."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


_REMEMBERED: dict[tuple, object] = {}  # results of ``remembered``; their tables are scratch tables


def remembered(spark: SparkSession, key: tuple, make):
    """The result of ``make``, made once per application and key until scratch tables are cleared."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch folders handed out from number ``since`` on; no result may still read them."""
    if len(_SCRATCH) > since:
        _REMEMBERED.clear()
    while len(_SCRATCH) > since:
        place, fs = _file_system(spark, _SCRATCH.pop())
        fs.delete(place, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made inside are deleted at the end; use the results before that."""
    since = len(_SCRATCH)
    try:
        yield
    finally:
        clear_scratch(spark, since)


def materialize(df):
    """Cut lineage at a reuse point by writing a table to the shared checkpoint folder.

    Used where a small derived table (an aggregated panel, a covariate table)
    feeds several branches of one plan: without it Spark recomputes the whole
    upstream (fact-table scans and joins) once per branch. The table is
    written as parquet under ``spark.checkpoint.dir`` (shared storage on a
    cluster, so a lost executor never forces a rescan) and read back: columnar,
    vectorised, and with its real size known to AQE for later join choices. The table is
    deleted by ``scratch_scope`` or ``clear_scratch``, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
