"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process stages lies below one folder, which goes when the process ends.
_RUN = f"stemframe-{uuid.uuid4().hex}"
_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir (or the context's checkpoint folder).

    Where neither is set, a session in one process gets a folder of its own, as in tests; on a cluster a folder
    of one machine would lose data, so that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stemframe-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for root, spark in _roots.items():
        try:
            delete(spark, root)
        except Exception:  # the session is gone already; the folder's retention rule takes over
            pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    root = f"{shared_dir(spark)}/{_RUN}"
    _roots[root] = spark
    return f"{root}/{uuid.uuid4().hex}-{tag}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage where a result is used more than once; a lost executor costs nothing, since the
    files are shared. A join against such a table starts with a plain exchange, which AQE can split
    when a key is hot. ``discard`` drops a table that no result reads any more; the rest goes when the
    process ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``staged``; nothing that is still to be computed may read them."""
    for table in tables:
        delete(table.sparkSession, table._staged_path)


def publish(spark: SparkSession, path: str, to: str) -> None:
    """Move a finished folder into place in one step."""
    context = spark._jvm.org.apache.hadoop.fs
    source, target = context.Path(path), context.Path(to)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target.getParent())
    if not store.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")


def below(spark: SparkSession, path: str) -> list[str]:
    """Paths of what lies directly in a folder; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in store.listStatus(place)] if store.exists(place) else []
