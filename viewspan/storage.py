"""Tables that queries of one session share, in the folder that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset a local master gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="viewspan-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a Parquet table, written once for each ``key`` of an application; a table that is gone or was not finished is written anew."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _PATHS or not _there(spark, _PATHS[key]):
        path = f"{folder(spark)}/viewspan-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])
