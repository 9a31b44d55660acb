"""Tables that are written once and read back, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROWS = 1 << 18  # rows that a task works on, about
_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _OWN["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    while _MADE:
        _delete(*_MADE.pop())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends or the `released` around it does."""
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: a lost executor costs no recomputation beyond this table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(rows: DataFrame, each: int = 1) -> int:
    """Tasks for a table of which every row becomes `each` rows: their number grows with the table, so what one of them works on doesn't.

    At least as many as other shuffles have, else a join would shuffle the rows anew.
    """
    return max(-(-rows.count() * each // ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, *by: str, each: int = 1) -> DataFrame:
    """Rows dealt out by some columns to as many `tasks` as they ask for, however few and large the files' pieces are. Narrow rows: they are shuffled."""
    return rows.repartition(tasks(rows, each), *by)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Removes what was written within: for tables that nothing reads any more then."""
    before = len(_MADE)
    yield
    while len(_MADE) > before:
        _delete(*_MADE.pop())
