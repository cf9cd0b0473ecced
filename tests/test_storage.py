"""Tables that jobs write for themselves."""

import glob

from causeway import storage


def test_stored_and_released(spark):
    storage.release(spark)
    folder = storage.shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    kept = storage.stored(spark.range(5), rows_per_batch=2)
    assert spark.conf.get(key) == was and sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert len(set(glob.glob(f"{folder}/*")) - before) == 1
    assert storage.release(spark) == 1 and set(glob.glob(f"{folder}/*")) == before and storage.release(spark) == 0
