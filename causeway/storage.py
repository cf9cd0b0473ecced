"""Tables that a job writes for itself, to cut lineage where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and the warehouse elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _folders:
            alone = master == "local" or master.startswith("local[")
            _folders[app] = f"file://{tempfile.mkdtemp(prefix='causeway-')}" if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
        found = _folders[app]
    return found.rstrip("/")


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, rows_per_batch: int | None = None) -> DataFrame:
    """The same rows, written once to the shared folder: lineage ends here and lost executors cost nothing.

    rows_per_batch: rows that go to Python at a time in this one job, for wide rows; the session's setting is as it was afterwards.
    """
    spark = df.sparkSession
    if rows_per_batch:
        before = spark.conf.get(_ROWS, None)
        spark.conf.set(_ROWS, str(rows_per_batch))
        try:
            return stored(df)
        finally:
            spark.conf.unset(_ROWS) if before is None else spark.conf.set(_ROWS, before)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what `stored` has written in this application, and says how many tables that was. Results that still
    read from them must have been used up, or written elsewhere, before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
