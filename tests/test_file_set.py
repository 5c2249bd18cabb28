import os

import pytest
from pyspark.sql import functions as F

from cairn.sources import file_set, files


def names(root):
    return sorted(f for f in os.listdir(root) if not f.startswith("_")) if os.path.isdir(root) else []


def test_files_are_written_by_tasks_and_committed(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    rows = [(f"f{i:02d}.bin", bytes([i]) * i) for i in range(20)] + [("null.bin", None)]
    file_set.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(4), root)
    assert {n: open(f"{tmp_path}/set/{n}", "rb").read() for n in names(f"{tmp_path}/set")} == {n: c or b"" for n, c in rows}
    assert file_set.committed(spark, root) == 21 and not os.listdir(f"{tmp_path}/set/_pending")
    file_set.write_files(spark.createDataFrame([("f00.bin", b"new"), ("g.bin", b"g")], "name string, content binary"), root)
    assert open(f"{tmp_path}/set/f00.bin", "rb").read() == b"new" and len(names(f"{tmp_path}/set")) == 22 and file_set.committed(spark, root) == 2


@pytest.mark.parametrize("bad", ["raises", "twice", "outside", "hidden"])
def test_a_failed_run_leaves_no_file(spark, tmp_path, bad):
    root = f"file://{tmp_path}/set"
    t = spark.createDataFrame([(f"f{i}", b"x" * 1000) for i in range(40)], "name string, content binary").repartition(4)
    if bad == "raises":
        t = t.withColumn("content", F.when(F.col("name") == "f33", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    else:
        name = {"twice": "f1", "outside": "../f1", "hidden": "_COMMITTED"}[bad]
        t = t.withColumn("name", F.when(F.col("name") == "f33", F.lit(name)).otherwise(F.col("name")))
    with pytest.raises(Exception):
        file_set.write_files(t, root)
    assert names(f"{tmp_path}/set") == [] and file_set.committed(spark, root) is None
    pending = f"{tmp_path}/set/_pending"
    assert not os.path.isdir(pending) or not any(os.listdir(f"{pending}/{d}") for d in os.listdir(pending))


def test_logs_pass_no_driver_and_come_back(spark, tmp_path):
    logs, curves = files.synthetic_logs(spark, 10, 100)
    root = f"file://{tmp_path}/logs"
    files.write_logs(logs.drop("TVT", *files.TOPS), curves, root)
    store = files.LogStore(spark, root)
    assert store.wells().count() == 10 and store.horizontal().count() == 1000
    assert sorted(names(f"{tmp_path}/logs"))[0].endswith(files.ENDINGS["horizontal"])
