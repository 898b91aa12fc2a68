"""Cutting the lineage of iterative plans with written tables.

A step of an iteration is written once as Parquet into the folder that the
cluster shares (``spark.checkpoint.dir``) and read back.  The files outlive any
executor, carry exact sizes for the planner, and are computed once, where
``DataFrame.checkpoint`` would run the last stage twice.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written steps: the session's, else on a local master one of our own; elsewhere its absence is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strandwork-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


@dataclass
class Cutter:
    """Writes steps under one folder; ``drop`` removes one that is no longer read, ``only`` all but a result."""

    spark: SparkSession
    name: str
    root: str = ""
    steps: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = f"{shared_dir(self.spark)}/strandwork-{self.name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, self.spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.steps[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self.steps.pop(id(df), None)
        if path:
            _delete(self.spark, path)

    def only(self, df: DataFrame) -> DataFrame:
        """``df`` as the last step; all steps before it are removed."""
        before, self.steps = self.steps, {}
        last = self.cut(df)
        for path in before.values():
            _delete(self.spark, path)
        return last


#: Largest number of rows and bytes of a side that is ever hinted for broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int = BROADCAST_ROWS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast after counting it; a larger one is left to a shuffle join.

    ``row_bytes`` is an upper estimate of a row.  The count stops one row past the bound.
    """
    from pyspark.sql import functions as F

    most = min(rows, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
