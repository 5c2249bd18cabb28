import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from cairn.llm import quality, simhash, toxicity  # noqa: E402

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ga", "le") for b in ("na", "ro", "ti", "mu", "se", "do", "pla")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, d = random.Random(1), tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for i in range(400):
        words = rnd.choices(WORDS, k=rnd.randint(30, 120))
        good, bad = i % 5 != 0, i % 7 == 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        if bad:
            words[3] = "grobnik"
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(good), int(bad)))
    docs += [(1000 + k, docs[2][1], None, None, 1) for k in range(20)] + [(2000, None, None, None, None), (None, docs[3][1], "en", "s", 1), (1000, docs[2][1], None, None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, labels


def test_stage_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "best-fit packing"]
    assert pipeline.ORACLE_SQL is None


def test_each_stage_keeps_columns_and_decides(spark, folder):
    d, docs, labels = folder
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    kept = [r.doc_id for r in pipeline.keep_quality(spark, now, d).collect()]
    truth = {i: q for i, q, _ in labels}
    assert all(truth[i] for i in kept if i in truth) and sum(truth.values()) == sum(i in truth for i in kept)
    clean = [r.doc_id for r in pipeline.drop_toxic(spark, now, d).collect()]
    toxic = {i: t for i, _, t in labels}
    assert not any(toxic.get(i, 0) for i in clean) and sum(1 - t for t in toxic.values()) == sum(i in toxic for i in clean)
    one = pipeline.drop_near_duplicates(spark, now, d)
    assert one.columns == columns
    ids = [r.doc_id for r in one.collect()]
    comp = {r[0]: r[2] for r in simhash.near_duplicates(now).collect()}
    assert sorted(ids) == sorted(set(comp[i] for i in comp if i is not None))  # the row without an id is a copy


def test_run_is_the_stages_in_turn(spark, folder, tmp_path):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    a = sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    b = sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in pipeline.run(spark, d).collect())
    assert a == b and a


def test_extra_and_clashing_columns(spark, folder):
    from pyspark.sql import functions as F

    d, *_ = folder
    t = spark.read.parquet(f"{d}/documents.parquet").limit(50).withColumn("score", F.lit("x")).withColumn("label", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("component_id", F.lit(3))
    t = t.withColumns({c: F.lit(i) for i, c in enumerate(("__score", "__stage_score", "__stay", "__row", "__id", "__text", "__rest"))})
    for _, f in pipeline.STAGES[:-1]:
        assert f(spark, t, d).columns == t.columns
    for _, f in pipeline.STAGES:
        assert f(spark, t.limit(0), d).count() == 0


def test_columns_of_any_name_and_type_stay_as_they_are(spark, folder):
    from pyspark.sql import functions as F

    d, *_ = folder
    t = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    t = t.withColumns({
        "a.b": F.lit("dotted"), "tick`s": F.lit(1.5), "c0": F.lit("plain"), "n0": F.lit(1), "sp ace": F.lit(None).cast("date"),
        "m": F.create_map(F.lit("k"), F.col("doc_id"), F.lit("l"), F.lit(None).cast("long")),
        "odd": F.struct(F.lit(1).alias("a-b"), F.array(F.create_map(F.lit("x.y"), F.lit(2))).alias("in `side"), F.col("source").alias("SELECT")),
    })
    whole = {str(r.doc_id): r for r in t.dropDuplicates(["doc_id"]).collect()}
    for _, f in pipeline.STAGES[:-1]:
        got = f(spark, t, d)
        assert got.columns == t.columns and [x.dataType.simpleString() for x in got.schema] == [x.dataType.simpleString() for x in t.schema]
        rows = got.collect()
        assert rows and all(tuple(r) == tuple(whole[str(r.doc_id)]) for r in rows)
    assert pipeline.STAGES[-1][1](spark, t, d).count() >= 60
    one = pipeline.drop_near_duplicates(spark, t.unionAll(t), d)
    assert sorted(map(str, one.collect())) == sorted(map(str, pipeline.drop_near_duplicates(spark, t, d).collect()))


def test_limits_are_those_of_the_contract():
    assert (quality.LIMIT, toxicity.LIMIT, simhash.MAX_BITS, simhash.SHINGLE) == (0.3, 0.5, 4, 4)
