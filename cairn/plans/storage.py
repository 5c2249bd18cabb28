"""Queries for sources, sinks and validators: each writes to the shared folder, reads back through the operator and returns the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import metrics
from cairn.plans import domain, evaluation, experiment, studies
from cairn.plans.relational import rounded
from cairn.plans.staging import shared_dir
from cairn.sources import files
from cairn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/storage-{name}-{uuid.uuid4().hex}"


def _log_store(spark, d, name: str) -> files.LogStore:
    t, c = domain.logs(spark, d)
    root = folder(spark, name)
    files.write_logs(t.select("well", "row_number", "MD", "X", "Y", "Z", "GR", "TVT_input"), c.select("well", "row_number", "TVT", "GR"), root)
    return files.LogStore(spark, root)


@query("SELECT DISTINCT user_id::VARCHAR AS well FROM events")
def s01_wells(spark, d):
    return _log_store(spark, d, "s01").wells().select("well")


@query("WITH s0 AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) SELECT user_id::VARCHAR AS well, rn AS row_number, rn::DOUBLE AS \"MD\", round(user_id * 900.0::DOUBLE + rn * 0.9::DOUBLE, 6) AS \"X\", CASE WHEN event_id % 7 <> 0 THEN round(value, 6) END AS \"GR\" FROM s0")
def s02_paired_logs(spark, d):
    t = _log_store(spark, d, "s02").horizontal()
    return rounded(t.select("well", F.col("row_number").cast("bigint").alias("row_number"), "MD", "X", "GR"), 6)


@query("SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def s04_typed_csv(spark, d):
    path = folder(spark, "s04")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).option("compression", "gzip").csv(path)
    return rounded(files.typed_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double"), 6)


def _regions(spark, d) -> dict[str, int]:
    return {r.r_name: int(r.r_regionkey) for r in table(spark, d, "region").select("r_name", "r_regionkey").collect()}


@query("SELECT r_name AS name, r_regionkey::BIGINT AS value FROM region")
def s05_json_load(spark, d):
    path = folder(spark, "s05") + "/config.json"
    files.write_text(spark, path, files.to_json({"schema": "regions_v1", "values": _regions(spark, d)}))
    return spark.createDataFrame(sorted(files.load_json(spark, path, "regions_v1")["values"].items()), "name string, value bigint")


@query("SELECT r_name AS name, sha256('{\n  \"key\": ' || r_regionkey || ',\n  \"name\": \"' || r_name || '\"\n}\n') AS digest FROM region")
def k03_json_texts(spark, d):
    import hashlib

    made = [(n, hashlib.sha256(files.to_json({"name": n, "key": k}).encode()).hexdigest()) for n, k in _regions(spark, d).items()]
    return spark.createDataFrame(made, "name string, digest string")


@query("SELECT s_name AS well, s_nationkey AS fold, s_acctbal AS truth FROM supplier")
def k05_npz_panel(spark, d):
    path = folder(spark, "k05")
    files.write_npz(table(spark, d, "supplier").select(F.col("s_name").alias("well"), F.col("s_nationkey").alias("fold"), F.col("s_acctbal").alias("truth")).repartition(3), path)
    return files.panel_from_npz(spark, f"{path}/*.npz")


@query("SELECT 'syn_' || lpad(w::VARCHAR, 3, '0') AS well, k AS row_number, 10000.0::DOUBLE + k AS \"MD\", round(floor(w / 2) * 8000.0::DOUBLE + w % 2 * 70 + k * 0.9::DOUBLE, 6) AS \"X\", k >= 112 AS hidden FROM (SELECT unnest(range(count(*))) AS w FROM nation), range(180) b(k)")
def s07_synthetic_logs(spark, d):
    t, _ = files.synthetic_logs(spark, table(spark, d, "nation").count(), 180, 3)  # one log for each nation
    return rounded(t.select("well", F.col("row_number").cast("bigint").alias("row_number"), "MD", "X", F.col("TVT_input").isNull().alias("hidden")), 6)


@query("SELECT s_name AS id, round(s_acctbal, 6) AS incumbent FROM supplier")
def s08_pinned_csv(spark, d):
    path = folder(spark, "s08")
    rows = [f"{r[0]},{r[1]!r}\n" for r in table(spark, d, "supplier").select("s_name", "s_acctbal").toLocalIterator()]
    files.write_text(spark, path + "/parent.csv", "id,incumbent\n" + "".join(rows))
    digest = files.inventory(spark, path + "/parent.csv").first().sha256
    return rounded(files.pinned_csv(spark, path + "/parent.csv", digest, "id string, incumbent double", "id"), 6)


def _region_files(spark, d, name: str) -> str:
    path = folder(spark, name)
    for n, k in _regions(spark, d).items():
        files.write_text(spark, f"{path}/{n}.txt", f"{n}:{k}")
    return path


@query("SELECT r_name || '.txt' AS name, length(r_name || ':' || r_regionkey)::BIGINT AS bytes, sha256(r_name || ':' || r_regionkey) AS sha256 FROM region")
def s10_inventory(spark, d):
    return files.inventory(spark, _region_files(spark, d, "s10"), "*.txt")


@query("SELECT r_name || '.txt' AS name, CASE WHEN r_regionkey = 0 THEN 'unlisted' WHEN r_regionkey = 1 THEN 'changed' END AS problem FROM region WHERE r_regionkey <= 1 UNION ALL SELECT 'gone.txt', 'missing'")
def k06_manifest(spark, d):
    found = files.inventory(spark, _region_files(spark, d, "k06"), "*.txt")
    keys = table(spark, d, "region").select(F.concat("r_name", F.lit(".txt")).alias("name"), "r_regionkey")
    listed = found.join(keys, "name").where("r_regionkey > 0").select("name", F.when(F.col("r_regionkey") == 1, F.sha2("name", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return files.manifest_violations(found, listed.unionByName(spark.createDataFrame([("gone.txt", "0")], "name string, sha256 string")))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def k01_result_tables(spark, d):
    root = folder(spark, "k01")
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    files.write_result({"nations": t}, {"rows": t.count()}, root)
    if files.verify_result(spark, root).count():
        raise files.CheckFailure("a result that was just written does not verify")
    return files.typed_csv(spark, f"{root}/nations", "k bigint, name string").select(F.col("k").cast(t.schema["k"].dataType).alias("k"), "name")


@query("SELECT unnest(['checks', 'models', 'components', 'wells', 'horizons', 'folds', 'stability']) AS name, 0 AS problems")
def k02_robustness_result(spark, d):
    root = folder(spark, "k02")
    made = evaluation.evaluate({"all_oof": domain._panel(spark, d)}, domain._registry(), fail=False)
    tables = {n: getattr(made, n) for n in ("checks", "models", "components", "wells", "horizons", "folds", "stability")}
    files.write_result(tables, {"tables": sorted(tables)}, root, "parquet")
    bad = files.verify_result(spark, root).count()
    return spark.createDataFrame([(n, bad) for n in files.load_json(spark, f"{root}/summary.json")["tables"]], "name string, problems int")


@query()
def k07_matrix_hash(spark, d):
    t = table(spark, d, "supplier")
    return spark.createDataFrame([(files.ordered_matrix_hash(t, "s_name", "s_suppkey", ["s_acctbal", "s_nationkey"]), t.count())], "digest string, rows bigint")


@query("SELECT 'all there' AS release, 'PASS' AS status, 0 AS missing, 0 AS broken UNION ALL SELECT 'notes lacking', 'FAIL', 1, 0 UNION ALL SELECT 'summary changed', 'FAIL', 0, 1")
def k09_release_report(spark, d):
    root = folder(spark, "k09")
    files.write_result({"nations": table(spark, d, "nation")}, {"n": 1}, root)
    rows = [("all there", files.release_report(spark, root, ["summary.json"])), ("notes lacking", files.release_report(spark, root, ["summary.json", "notes.md"]))]
    files.write_text(spark, f"{root}/summary.json", "{}")
    rows.append(("summary changed", files.release_report(spark, root, ["summary.json"])))
    return spark.createDataFrame([(n, r["status"], len(r["missing"]), len(r["broken"])) for n, r in rows], "release string, status string, missing int, broken int")


@query("""WITH c AS (SELECT n_nationkey AS key, 'c' || (n_nationkey // 2 * 2 + n_regionkey % 2) AS id, CASE n_nationkey % 4 WHEN 0 THEN ['x', 'y'] WHEN 1 THEN ['x', 'x'] WHEN 2 THEN [] ELSE ['y'] END AS models, CASE WHEN n_nationkey % 3 = 0 THEN 'y' ELSE 'x' END AS baseline FROM nation)
    SELECT key, 'id_repeats' AS rule FROM c WHERE id IN (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT key, 'models_repeat' FROM c WHERE len(list_distinct(models)) < len(models)
    UNION ALL SELECT key, 'no_models' FROM c WHERE len(models) = 0 UNION ALL SELECT key, 'baseline_is_no_model' FROM c WHERE NOT list_contains(models, baseline)""")
def p12_registry_rules(spark, d):
    k = F.col("n_nationkey")
    models = F.when(k % 4 == 0, F.array(F.lit("x"), F.lit("y"))).when(k % 4 == 1, F.array(F.lit("x"), F.lit("x"))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("y")))
    contracts = table(spark, d, "nation").select(k.alias("key"), F.concat(F.lit("c"), (F.floor(k / 2) * 2 + F.col("n_regionkey") % 2).cast("string")).alias("id"), models.alias("models"), F.when(k % 3 == 0, "y").otherwise("x").alias("baseline"))
    return evaluation.contract_violations(contracts)


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN repeat('../', page_id % 3) || coalesce(regexp_extract(url, '://[^/]*/(.*)$', 1), '') WHEN 1 THEN 'a/./b//' || repeat('../', page_id % 5) || 'c' WHEN 2 THEN '/' || page_id ELSE coalesce(url, 'u') END AS path FROM pages),
    s AS (SELECT page_id, path, list_transform(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END) AS l FROM p)
    SELECT page_id, path, starts_with(path, '/') OR contains(path, '://') OR coalesce(list_min(list_transform(range(1, len(l) + 1), lambda i: list_sum(l[1:i]))) < 0, false) AS refused FROM s""")
def p13_paths(spark, d):
    k = F.col("page_id")
    up = lambda n: F.expr(f"repeat('../', cast(page_id % {n} as int))")
    path = F.when(k % 4 == 0, F.concat(up(3), F.coalesce(F.regexp_extract("url", "://[^/]*/(.*)$", 1), F.lit("")))).when(k % 4 == 1, F.concat(F.lit("a/./b//"), up(5), F.lit("c"))).when(k % 4 == 2, F.concat(F.lit("/"), k.cast("string"))).otherwise(F.coalesce("url", F.lit("u")))
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("refused", files.leaves_root(F.col("path")))


@query("""WITH c AS (SELECT p_partkey, p_size % 4 AS seeds, p_size AS particles, 1 + p_size % 3 AS folds, round((p_size % 13 - 1) / 10.0::DOUBLE, 6) AS holdout FROM part)
    SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN seeds < 2 THEN 'seeds' END, CASE WHEN particles < 8 THEN 'particles' END, CASE WHEN folds < 2 THEN 'folds' END, CASE WHEN holdout < 0 OR holdout >= 1 THEN 'holdout' END]) AS rule FROM c) WHERE rule IS NOT NULL""")
def p14_config_rules(spark, d):
    size = F.col("p_size")
    settings = table(spark, d, "part").select("p_partkey", (size % 4).alias("seeds"), size.alias("particles"), (1 + size % 3).alias("folds"), F.round((size % 13 - 1) / 10.0, 6).alias("holdout"))
    return experiment.config_violations(settings).select("p_partkey", "rule")


@query("""WITH c AS (SELECT s_nationkey AS component, s_suppkey AS well FROM supplier), p AS (SELECT l_suppkey AS well, s_nationkey % 3 AS seed, (l_extendedprice - l_extendedprice * (1 + l_tax)) ** 2 AS se FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT seed::INT AS seed, 'made' AS first_run, CASE WHEN seed = 1 THEN 'made' ELSE 'kept' END AS second_run, round(sqrt(avg(se)), 4) AS rmse FROM p GROUP BY seed""")
def d38_resumed_runs(spark, d):
    """Runs registered beforehand, one of which is lost and made again; the others are kept as they are."""
    root, p = folder(spark, "d38"), domain.panel(spark, d)
    universe = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("well"), F.col("s_nationkey").cast("string").alias("component"))
    studies.register_panel(universe, universe.limit(0), table(spark, d, "supplier").count(), 7, root, "panel", 1)
    run = lambda seed: ({"score": p.where(F.col("fold") == seed).agg(metrics.rmse("truth", "candidate").alias("rmse"))}, {"fold": seed})
    first = dict(studies.resumable_runs(spark, root, "panel", [0, 1, 2], run))
    files.remove(spark, f"{root}/seed-1/manifest.json")
    second = dict(studies.resumable_runs(spark, root, "panel", [0, 1, 2], run))
    scores = {k: files.typed_csv(spark, f"{root}/seed-{k}/score", "rmse double").first().rmse for k in first}
    return rounded(spark.createDataFrame([(k, first[k], second[k], scores[k]) for k in first], "seed int, first_run string, second_run string, rmse double"))
