"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables of ``written`` that are still referred to, and where they are.
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a folder of this machine.

    Executors of any other session do not see such a folder, so it must set one.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="weirflow-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/weirflow-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, k=id(out): _paths.pop(k, None)), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, when nothing that is still to run reads them."""
    for df in tables:
        ref, path = _paths.get(id(df), (lambda: None, ""))
        if ref() is df:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at.getParent(), True)
