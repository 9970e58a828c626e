"""File-system helpers (driver side, metadata only)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p)) or len(glob(spark, path)) > 0


def glob(spark: SparkSession, pattern: str) -> list[str]:
    p, fs = _fs(spark, pattern)
    st = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in st) if st is not None else []


def list_files(spark: SparkSession, pattern: str, suffix: str = "") -> list[str]:
    """Data files under every path matching ``pattern`` (folders are walked one level)."""
    out = []
    for path in glob(spark, pattern):
        p, fs = _fs(spark, path)
        if fs.getFileStatus(p).isDirectory():
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                if s.isFile() and not name.startswith(("_", ".")) and name.endswith(suffix):
                    out.append(str(s.getPath().toString()))
        elif path.endswith(suffix):
            out.append(path)
    return sorted(out)


def listing(spark: SparkSession, folder: str) -> tuple:
    """(name, bytes, time) of the files of a folder and its folders: changes when a table under it does."""
    out = []
    for pattern in (f"{folder}/*", f"{folder}/*/*"):
        p, fs = _fs(spark, pattern)
        out += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in (fs.globStatus(p) or []) if s.isFile()]
    return tuple(sorted(out))
