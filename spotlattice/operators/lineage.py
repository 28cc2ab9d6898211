"""Tables in the shared folder: cutting the lineage of iterative operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the step tables that the operator at work has made so far.
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a session on one machine (tests) takes a folder of its
    own there; on a cluster it is an error, for executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"file://{tempfile.gettempdir()}/spotlattice-{spark.sparkContext.applicationId}"
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a table there outlives the executors that made it."""
    path = shared_dir(df.sparkSession, "step")
    made = _made.get()
    if made is not None:
        made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(operator: Callable) -> Callable:
    """At the end of ``operator`` deletes its step tables, but for those that what it returns still reads.

    An operator inside another hands the tables that its result reads to the outer one; if it fails all of its tables go.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        outer, mine = _made.get(), []
        token = _made.set(mine)
        try:
            out = operator(*args, **kwargs)
        except BaseException:
            for spark, path in mine:
                _delete(spark, path)
            raise
        finally:
            _made.reset(token)
        read = "\n".join(f for df in (out if isinstance(out, tuple) else (out,)) for f in df.inputFiles())
        for spark, path in mine:
            if path.rsplit("/", 1)[1] not in read:
                _delete(spark, path)
            elif outer is not None:
                outer.append((spark, path))
        return out

    return run
