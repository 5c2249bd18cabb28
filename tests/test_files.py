import gzip
import json
import zipfile

import numpy as np
import pytest

from cairn.operators.checks import CheckFailure
from cairn.sources import files as f


def write_logs(folder, wells=3, rows=50):
    folder.mkdir(parents=True, exist_ok=True)
    for k in range(wells):
        lines = ["MD,X,Y,Z,GR,TVT_input,TVT"] + [f"{1000 + i},{i},{k},{-9000 - i},{'' if i % 9 == 0 else 50 + i},{10000 + i if i < 35 else ''},{10000 + i}" for i in range(rows)]
        (folder / f"w{k}__horizontal_well.csv").write_text("\n".join(lines))
        (folder / f"w{k}__typewell.csv").write_text("TVT,GR\n" + "\n".join(f"{9990 + i * 10},{i if i else 'bad'}" for i in range(8)))
    (folder / "alone__horizontal_well.csv").write_text("MD,X,Y,Z,GR,TVT_input\n1,1,1,1,1,1")


@pytest.mark.parametrize("kind", ["folder", "split", "zip"])
def test_store_pairs_and_types(spark, tmp_path, kind):
    where = tmp_path / ("train" if kind == "split" else "flat")
    write_logs(where)
    if kind == "zip":
        with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
            for x in where.iterdir():
                z.write(x, f"data/{x.name}")
    store = f.LogStore(spark, str(tmp_path / "all.zip") if kind == "zip" else str(tmp_path if kind == "split" else where), "train" if kind == "split" else None)
    assert [r.well for r in store.wells().collect()] == ["w0", "w1", "w2"] and store.wells(2).count() == 2
    h = store.horizontal()
    assert "TVT" not in h.columns and h.where("well = 'w1'").count() == 50
    r = h.where("well = 'w1' and row_number = 9").first()
    assert r.GR is None and r.MD == 1009.0 and r.TVT_input == 10009.0
    assert store.horizontal(truth=True).where("well = 'w0' and row_number = 40").first().TVT == 10040.0
    assert store.typewell().where("GR is null").count() == 3


def test_rules_name_what_is_broken(spark, tmp_path):
    write_logs(tmp_path / "a")
    store = f.LogStore(spark, str(tmp_path / "a"))
    h, t = store.horizontal().where("well <> 'alone'"), store.typewell()
    assert f.record_violations(h, t).count() == 0
    from pyspark.sql import functions as F

    broken = h.withColumn("TVT_input", F.when(F.col("row_number") == 10, None).otherwise(F.col("TVT_input"))).withColumn("MD", F.when(F.col("row_number") == 20, 1.0).otherwise(F.col("MD")))
    rules = {r.rule for r in f.record_violations(broken, t.where("well <> 'w0'")).collect()}
    assert rules == {"prefix_not_contiguous", "depth_not_increasing", "too_few_knots"}


def test_pinned_csv_refuses_changes(spark, tmp_path):
    p = tmp_path / "parent.csv.gz"
    p.write_bytes(gzip.compress(b"id,incumbent\na_1,1.5\na_2,2.5\n"))
    digest = f.inventory(spark, str(p)).first().sha256
    assert f.pinned_csv(spark, str(p), digest, "id string, incumbent double", "id").count() == 2
    with pytest.raises(CheckFailure):
        f.pinned_csv(spark, str(p), "0" * 64, "id string, incumbent double", "id")
    p.write_bytes(gzip.compress(b"id,incumbent\na_1,1.5\na_1,NaN\n"))
    with pytest.raises(CheckFailure, match="1 repeated keys, 1 numbers"):
        f.pinned_csv(spark, str(p), f.inventory(spark, str(p)).first().sha256, "id string, incumbent double", "id")


def test_results_and_manifest(spark, tmp_path):
    t = spark.createDataFrame([(1, 2.5), (2, None)], "k int, v double")
    root = str(tmp_path / "out")
    f.write_result({"scores": t, "rows": t}, {"n": np.int64(2), "bad": float("nan"), "w": np.array([1.0, 2.0])}, root)
    assert json.loads((tmp_path / "out/summary.json").read_text()) == {"n": 2, "bad": None, "w": [1.0, 2.0]}
    assert f.verify_result(spark, root).count() == 0
    (tmp_path / "out/.summary.json.crc").unlink()  # else the local file system refuses to read it
    (tmp_path / "out/summary.json").write_text("{}")
    (tmp_path / "out/more.txt").write_text("x")
    assert {(r.name, r.problem) for r in f.verify_result(spark, root).collect()} == {("summary.json", "changed"), ("more.txt", "unlisted")}
    assert f.digest_of(f.inventory(spark, root, "*.txt")).first().files == 1


def test_submission_checks_and_order(spark, tmp_path):
    template = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "id string, ord int")
    made = spark.createDataFrame([(0, "b", 1.0), (1, "a", 2.0), (2, "c", 3.0)], "ord int, id string, tvt double")
    f.write_submission(made, template, str(tmp_path / "s"))
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "id,tvt\nb,1.0\na,2.0\nc,3.0\n"
    for rows, name in (([(0, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "out_of_order"), ([(0, "b", 1.0), (1, "a", float("nan")), (2, "c", 3.0)], "not_finite"), ([(0, "b", 1.0), (1, "a", 1.0)], "missing_ids"), ([(0, "b", 1.0), (1, "a", 1.0), (2, "c", 1.0), (3, "x", 1.0)], "extra_ids")):
        with pytest.raises(CheckFailure, match=name):
            f.write_submission(spark.createDataFrame(rows, "ord int, id string, tvt double"), template, str(tmp_path / "t"))


def test_npz_panel_and_hashes(spark, tmp_path):
    np.savez(tmp_path / "p.npz", well=np.array(["a", "b"]), fold=np.array([0, 1]), truth=np.array([1.5, 2.5]))
    t = f.panel_from_npz(spark, str(tmp_path / "p.npz"))
    assert [tuple(r) for r in t.orderBy("well").collect()] == [("a", 0, 1.5), ("b", 1, 2.5)]
    assert f.row_order_free_hash(t).first() == f.row_order_free_hash(t.orderBy("truth", ascending=False).repartition(3)).first()
    one = f.ordered_matrix_hash(t, "well", "fold", ["truth"])
    assert one == f.ordered_matrix_hash(t.repartition(2), "well", "fold", ["truth"]) and len(one) == 64


def test_typed_csv_fails_fast(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        f.typed_csv(spark, str(tmp_path / "x.csv"), "a int, b int").collect()
    with pytest.raises(Exception):
        f.typed_csv(spark, str(tmp_path / "x.csv"), "b int, a int").collect()
    (tmp_path / "tag.json").write_text('{"schema": "v1"}')
    assert f.load_json(spark, str(tmp_path / "tag.json"), "v1") == {"schema": "v1"}
    with pytest.raises(CheckFailure):
        f.load_json(spark, str(tmp_path / "tag.json"), "v2")


def test_synthetic_logs_do_not_depend_on_partitions(spark):
    a, t = f.synthetic_logs(spark, 10, 100)
    assert a.count() == 1000 and t.count() == 16010 and f.record_violations(a, t).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert f.row_order_free_hash(a).first() == f.row_order_free_hash(f.synthetic_logs(spark, 10, 100)[0].repartition(5)).first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_paths_stay_below_their_root():
    assert f.below("/data/x/", "a/./b.csv") == "/data/x/a/b.csv" and f.below("/d", "a/../b") == "/d/a/../b"
    for bad in ("../b", "a/../../b", "/etc/passwd", "s3://x/y"):
        with pytest.raises(ValueError):
            f.below("/data", bad)


def test_release_report(spark, tmp_path):
    t = spark.createDataFrame([(1,)], "k int")
    root = str(tmp_path / "r")
    f.write_result({"t": t}, {}, root)
    assert f.release_report(spark, root, ["summary.json"])["status"] == "PASS"
    bad = f.release_report(spark, root, ["summary.json", "notes.md"])
    assert bad["status"] == "FAIL" and bad["missing"] == ["notes.md"]
