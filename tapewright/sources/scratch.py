"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder once; on a
    cluster, whose machines would not share such a folder, this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tapewright-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tables that were written and not yet dropped, by session database.
_held: dict[str, dict[str, None]] = {}


def _database(spark: SparkSession) -> tuple[str, str]:
    """The database of this application and its folder."""
    app = spark.sparkContext.applicationId
    folder = f"{scratch_dir(spark)}/tapewright/{app}"
    return "tapewright_" + hashlib.md5(folder.encode()).hexdigest()[:8], folder


def tables(spark: SparkSession) -> set[str]:
    """The scratch tables that this application still has."""
    return set(_held.get(_database(spark)[0], {}))


def release(spark: SparkSession, before: set[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Drop this application's scratch tables but those of `before` (from `tables`) and the one that `keep` reads.

    Results are lazy: call it once what was made of the tables is read or written.
    Without `before` and `keep` the database goes too.
    """
    database, _ = _database(spark)
    held = _held.get(database, {})
    kept = {t for t in held if t in before or keep is not None and getattr(keep, "_scratch_table", None) == t}
    for table in [t for t in held if t not in kept]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        del held[table]
    if not held:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


@atexit.register
def _release_at_exit() -> None:
    """What a session has left goes with it; a stopped session has no catalog any more."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _held.get(_database(spark)[0]):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)


class Scratch:
    """Intermediate tables in the shared folder, each dropped after its last reader.

    They are managed tables of a database that belongs to the application and lies in
    that folder, so that dropping one deletes its files. A written table cuts the
    lineage and outlives any executor. Those that a lazy result reads are dropped by
    `release`, or with the session.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.database, self._folder = _database(spark)

    def written(self, df: DataFrame, name: str, by: str | None = None, order: str | None = None) -> DataFrame:
        """Write `df` and read it back. With `by` it is bucketed by that column, in `order`, so that windows and groups by it need no shuffle."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self._folder}'")
        table = f"{self.database}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
        _held.setdefault(self.database, {})[table] = None
        if by:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(parts, by).write.format("parquet").bucketBy(parts, by).sortBy(by, *([order] if order else [])).saveAsTable(table)
        else:
            df.write.format("parquet").saveAsTable(table)
        made = self.spark.read.table(table)
        made._scratch_table = table
        return made

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by `written`; frames that are none are left alone."""
        for frame in frames:
            table = getattr(frame, "_scratch_table", None)
            if table in _held.get(self.database, {}):
                self.spark.sql(f"DROP TABLE {table}")
                del _held[self.database][table]
