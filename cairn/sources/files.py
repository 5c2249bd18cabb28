"""Scans and sinks with fail-closed checks: paired CSV logs, hashed artifacts, manifests, submissions, panels.

File hashes and inventories are computed where the files are, from ``binaryFile`` rows, so they work on any store Spark reads.
Small JSON documents (configurations, manifests) are read and written through the same file systems by the driver.
"""

from __future__ import annotations

import dataclasses
import io
import json
import math
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.expr import finite, number
from cairn.operators.checks import CheckFailure
from cairn.operators.joins import numbered
from cairn.plans.staging import Stage
from cairn.sources import file_set

#: Column names and file-name endings of the paired logs.
HORIZONTAL = ("MD", "X", "Y", "Z", "GR", "TVT_input")
TOPS = ("ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA")
TYPEWELL = ("TVT", "GR")
ENDINGS = {"horizontal": "__horizontal_well.csv", "typewell": "__typewell.csv"}
SUBMISSION = ("id", "tvt")


def _ddl(columns: Sequence[str], kind: str = "string") -> str:
    return ", ".join(f"`{c}` {kind}" for c in columns)


class LogStore:
    """Pairs of CSV logs below a folder (or its sub-folder ``split``), or in a ZIP file.

    ``wells()`` lists the pairs; ``horizontal()`` and ``typewell()`` are single tables keyed by ``well`` with a zero-based
    ``row_number``, columns as doubles, null where a value is no number.
    """

    def __init__(self, spark: SparkSession, root: str, split: str | None = None, endings: dict[str, str] = ENDINGS):
        self.spark, self.zip, self.endings = spark, root.endswith(".zip"), endings
        self.root, self.split = root.rstrip("/"), split

    def _files(self, kind: str) -> DataFrame:
        ending = self.endings[kind]
        if self.zip:
            split = self.split

            def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for raw in part["content"]:
                        with zipfile.ZipFile(io.BytesIO(raw)) as z:
                            names = sorted(n for n in z.namelist() if n.endswith(ending) and (split is None or f"{split}/" in n))
                            for n in names:
                                yield pd.DataFrame({"name": [n.rsplit("/", 1)[-1]], "content": [z.read(n)]})

            files = self.spark.read.format("binaryFile").load(self.root).select("content").mapInPandas(members, "name string, content binary")
        else:
            folder = f"{self.root}/{self.split}" if self.split else self.root
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        return files.select(F.expr(f"left(name, length(name) - {len(ending)})").alias("well"), "content")

    def wells(self, limit: int | None = None) -> DataFrame:
        pairs = self._files("horizontal").select("well").join(self._files("typewell").select("well"), "well", "left_semi").orderBy("well")
        return pairs.limit(limit) if limit else pairs

    def _rows(self, kind: str, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
        wanted, rest = list(columns), list(optional)

        def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for well, raw in zip(part["well"], part["content"]):
                    t = pd.read_csv(io.BytesIO(raw), dtype=str, usecols=lambda c: c in {*wanted, *rest})
                    if missing := [c for c in wanted if c not in t]:
                        raise CheckFailure(f"{well}: {kind} log lacks {', '.join(missing)}")
                    t = t.reindex(columns=[*wanted, *rest]).astype(object)
                    t.insert(0, "row_number", np.arange(len(t), dtype=np.int32))
                    t.insert(0, "well", well)
                    yield t

        raw = self._files(kind).mapInPandas(parse, f"well string, row_number int, {_ddl([*wanted, *rest])}")
        return raw.select("well", "row_number", *(number(F.col(c)).alias(c) for c in (*wanted, *rest)))

    def horizontal(self, truth: bool = False, tops: bool = False) -> DataFrame:
        """Observables only; the truth ``TVT`` is not even parsed unless asked for."""
        return self._rows("horizontal", HORIZONTAL, [*(["TVT"] if truth else []), *(TOPS if tops else [])])

    def typewell(self) -> DataFrame:
        return self._rows("typewell", TYPEWELL)


def record_violations(horizontal: DataFrame, typewell: DataFrame, min_rows: int = 40, min_knots: int = 4, min_prefix: int = 30, min_suffix: int = 10) -> DataFrame:
    """``(well, rule)`` for each rule of the data model that a record breaks; empty if all hold."""
    w = Window.partitionBy("well").orderBy("row_number")
    h = horizontal.withColumn("step", F.col("MD") - F.lag("MD").over(w)).withColumn("known", F.col("TVT_input").isNotNull())
    h = h.groupBy("well").agg(
        F.count("*").alias("n"), F.count_if(~finite(F.col("MD"))).alias("bad_md"), F.count_if(F.col("step") <= 0).alias("back"),
        F.count_if("known").alias("prefix"), (F.coalesce(F.max(F.when(F.col("known"), F.col("row_number"))), F.lit(-1)) + 1).alias("last"),
    )
    rules = F.array_compact(F.array(
        F.when(F.col("n") < min_rows, "too_few_rows"), F.when(F.col("bad_md") > 0, "depth_not_finite"), F.when(F.col("back") > 0, "depth_not_increasing"),
        F.when(F.col("last") != F.col("prefix"), "prefix_not_contiguous"), F.when(F.col("prefix") < min_prefix, "prefix_too_short"), F.when(F.col("n") - F.col("prefix") < min_suffix, "suffix_too_short"),
    ))
    t = typewell.where(finite(F.col("TVT"))).withColumn("step", F.col("TVT") - F.lag("TVT").over(w)).groupBy("well").agg(F.count("*").alias("k"), F.count_if(F.col("step") <= 0).alias("back"))
    knots = horizontal.select("well").distinct().join(t, "well", "left")
    more = F.array_compact(F.array(F.when(F.coalesce("k", F.lit(0)) < min_knots, "too_few_knots"), F.when(F.col("back") > 0, "curve_not_increasing")))
    return h.select("well", F.explode(rules).alias("rule")).unionByName(knots.select("well", F.explode(more).alias("rule")))


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV (gzip too) with a given schema; a header that differs, or a value of another type, is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def load_json(spark: SparkSession, path: str, schema_tag: str | None = None) -> Any:
    made = json.loads(_read_text(spark, path))
    if schema_tag is not None and made.get("schema") != schema_tag:
        raise CheckFailure(f"{path}: schema {made.get('schema')!r} is not {schema_tag!r}")
    return made


def plain(value: Any) -> Any:
    """NumPy, dataclass, tuple and non-finite values as what JSON has."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = dataclasses.asdict(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, np.ndarray)):
        return [plain(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def to_json(value: Any) -> str:
    return json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file to any file system that Spark's session knows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(content)
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(name, bytes, sha256)`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest_of(files: DataFrame) -> DataFrame:
    """One row: files, bytes and a digest over names and digests in order of name. The file list is small next to the files."""
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "sha256", "name")))
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("digest"))


def manifest_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, problem)``: missing, changed or unlisted files against ``(name, sha256)``."""
    both = manifest.select("name", F.col("sha256").alias("_m")).join(files.select("name", F.col("sha256").alias("_f")), "name", "full")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("_f") != F.col("_m"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def pinned_csv(spark: SparkSession, path: str, sha256: str, schema: str, key: str) -> DataFrame:
    """A CSV that is refused unless its bytes have the digest, its keys are unique and its numbers finite."""
    found = inventory(spark, path).select("sha256").first()[0]
    if found != sha256:
        raise CheckFailure(f"{path} has digest {found}")
    t = typed_csv(spark, path, schema)
    bad = t.agg((F.count("*") - F.count_distinct(key)).alias("repeated"), F.coalesce(sum((F.count_if(~finite(F.col(c))) for c, k in t.dtypes if k == "double"), F.lit(0)), F.lit(0)).alias("not_finite")).first()
    if bad.repeated or bad.not_finite:
        raise CheckFailure(f"{path}: {bad.repeated} repeated keys, {bad.not_finite} numbers that are not finite")
    return t


def submission_checks(made: DataFrame, template: DataFrame, key: str = "id", value: str = "tvt", order: str = "ord") -> DataFrame:
    """``(check_name, violations)`` of a submission ``(ord, id, tvt)`` against the template's ids and their order."""
    ids, asked = made.select(key), template.select(key)
    shifted = numbered(made.select(key, order), [order], "_a").select(key, "_a").join(numbered(template.join(ids, key, "left_semi").select(key, order), [order], "_b").select(key, "_b"), key)
    count = lambda t, name, what: t.agg(F.coalesce(what, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    parts = [
        count(ids.subtract(asked), "extra_ids", F.count("*")), count(asked.subtract(ids), "missing_ids", F.count("*")), count(made, "repeated_ids", F.count("*") - F.count_distinct(key)),
        count(made, "not_finite", F.count_if(~finite(F.col(value)))), count(shifted, "out_of_order", F.count_if(F.col("_a") != F.col("_b"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_submission(made: DataFrame, template: DataFrame, path: str, key: str = "id", value: str = "tvt", order: str = "ord", single: bool = False) -> DataFrame:
    """Writes ``id,tvt`` in template order as CSV after every check passed; returns the inventory of what was written. Files follow one
    another in order of name; ``single`` asks for one file, which one task writes."""
    failed = [r.check_name for r in submission_checks(made, template, key, value, order).where("violations > 0").collect()]
    if failed:
        raise CheckFailure("submission: " + ", ".join(failed))
    rows = made.select(order, F.col(key).alias(SUBMISSION[0]), F.col(value).alias(SUBMISSION[1])).orderBy(order).drop(order)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).csv(path)
    return inventory(made.sparkSession, path, "*.csv")


def write_result(tables: dict[str, DataFrame], summary: Any, root: str, fmt: str = "csv") -> DataFrame:
    """Each table below ``root`` (compressed CSV or Parquet), ``summary.json``, and ``manifest.json`` of all files; returns the inventory."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        writer = t.write.mode("overwrite")
        writer.option("header", True).option("compression", "gzip").csv(f"{root}/{name}") if fmt == "csv" else writer.parquet(f"{root}/{name}")
    write_text(spark, f"{root}/summary.json", to_json(summary))
    files = inventory(spark, root).where("name not like '%manifest.json' and name not like '%.crc'")
    write_text(spark, f"{root}/manifest.json", to_json({"files": {r.name: r.sha256 for r in files.collect()}}))
    return files


def verify_result(spark: SparkSession, root: str) -> DataFrame:
    listed = load_json(spark, f"{root}/manifest.json")["files"]
    manifest = spark.createDataFrame(sorted(listed.items()), "name string, sha256 string")
    return manifest_violations(inventory(spark, root).where("name not like '%manifest.json' and name not like '%.crc'"), manifest)


def panel_from_npz(spark: SparkSession, path: str) -> DataFrame:
    """A panel of equal one-dimensional arrays from a NumPy archive, parsed in one task."""

    def arrays(raw: bytes) -> pd.DataFrame:
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            return pd.DataFrame({k: z[k] for k in z.files})

    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean", "U": "string"}
    with np.load(io.BytesIO(bytes(files.first()[0])), allow_pickle=False) as z:
        schema = ", ".join(f"`{k}` {kinds[z[k].dtype.kind]}" for k in z.files)
    return files.mapInPandas(lambda parts: (arrays(c) for p in parts for c in p["content"]), schema)


def row_order_free_hash(t: DataFrame) -> DataFrame:
    """One row: count and a digest of all rows that does not depend on their order."""
    return t.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).alias("digest"))


def ordered_matrix_hash(t: DataFrame, key: str, order: str, columns: Sequence[str]) -> str:
    """SHA-256 of length-prefixed ids and then the float32 matrix, rows in order. The sorted rows pass the driver a partition at a time."""
    import hashlib

    rows = Stage(t.sparkSession, "matrix").put(t.select(order, F.col(key).cast("string").alias("_key"), F.array(*(F.col(c).cast("float") for c in columns)).alias("_row")).orderBy(order))
    h = hashlib.sha256()
    for (k,) in rows.orderBy(order).select("_key").toLocalIterator():
        raw = k.encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    for (v,) in rows.orderBy(order).select("_row").toLocalIterator():
        h.update(np.array(v, "<f4").tobytes())
    return h.hexdigest()


def write_npz(t: DataFrame, path: str) -> int:
    """Writes a panel below a folder as NumPy archives of one-dimensional arrays, one for each partition that has rows; returns their number.

    Archives are made and written where the rows are (``file_set``). ``panel_from_npz`` reads them back, all or one.
    """
    names = t.columns

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            out, whole = io.BytesIO(), pd.concat(held)
            np.savez_compressed(out, **{c: whole[c].to_numpy(str if whole[c].dtype == object else None) for c in names})
            yield pd.DataFrame({"name": [f"panel-{TaskContext.get().partitionId():05d}.npz"], "content": [out.getvalue()]})

    file_set.write_files(t.mapInPandas(pack, "name string, content binary"), path)
    return file_set.committed(t.sparkSession, path) or 0


def write_logs(horizontal: DataFrame, typewell: DataFrame, root: str, endings: dict[str, str] = ENDINGS) -> None:
    """Paired CSV logs below a folder, as ``LogStore`` reads them: rows by ``row_number``, texts made and written where the rows are."""
    for kind, t in (("horizontal", horizontal), ("typewell", typewell)):
        names = [c for c in t.columns if c not in ("well", "row_number")]
        line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
        lines = t.groupBy("well").agg(F.sort_array(F.collect_list(F.struct("row_number", line.alias("line")))).alias("rows"))
        text = F.concat(F.lit(",".join(names) + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
        file_set.write_files(lines.select(F.concat("well", F.lit(endings[kind])).alias("name"), text.alias("content")), root)


def synthetic_logs(spark: SparkSession, wells: int, rows: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Deterministic horizontal and typewell tables, two wells to a place; noise by Box-Muller on hashes, so it does not depend on
    partitions."""
    if wells < 10 or rows < 100:
        raise ValueError("at least 10 wells of 100 rows")
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = lambda tag: F.sqrt(-2 * F.ln(unit(F.col("i"), F.col("k"), F.lit(tag)))) * F.cos(2 * math.pi * unit(F.col("i"), F.col("k"), F.lit(tag + "'")))
    curve = lambda t: 72 + 24 * F.sin(t / 9.0) + 11 * F.sin(t / 31.0) + 5 * F.cos(t / 4.0)
    base = spark.range(wells).withColumnRenamed("id", "i").withColumn("well", F.format_string("syn_%03d", "i"))
    t = base.select("i", "well", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("k"))
    pair, odd, md = F.floor(F.col("i") / 2), F.col("i") % 2, F.col("k").cast("double")
    t = t.withColumns({"MD": 10000 + md, "X": pair * 8000.0 + odd * 70 + md * 0.9, "Y": pair * 5000.0 + odd * 55 + md * 0.3, "Z": -9800 - 2 * F.sin(md / 60) - 0.02 * md})
    t = t.withColumn("TVT", 10050 + 7 * pair % 60 + 12 * F.sin(md / 45 + pair) + 0.03 * md)
    t = t.withColumn("GR", curve(F.col("TVT") - 9700) + 1.2 * noise("gr"))
    tops = {c: F.col("TVT") + F.col("Z") + 15.0 * (j + 1) for j, c in enumerate(TOPS)}
    cut = max(30, min(rows - 10, round(0.62 * rows)))
    t = t.withColumns(tops).withColumn("TVT_input", F.when(F.col("k") < cut, F.col("TVT")))
    type_rows = base.select("i", "well", F.explode(F.sequence(F.lit(0), F.lit(1600))).alias("k")).withColumn("TVT", 9700 + F.col("k") / 2.0)
    typewell = type_rows.select("well", F.col("k").alias("row_number"), "TVT", (curve(F.col("TVT") - 9700) + 0.4 * noise("tw")).alias("GR"))
    return t.select("well", F.col("k").alias("row_number"), *HORIZONTAL[:5], "TVT_input", "TVT", *TOPS), typewell


def below(root: str, relative: str) -> str:
    """``root/relative``, refused if it would leave the root."""
    parts = [p for p in relative.split("/") if p not in ("", ".")]
    depth = 0
    for p in parts:
        depth += -1 if p == ".." else 1
        if depth < 0:
            raise ValueError(f"{relative!r} leaves {root!r}")
    if relative.startswith("/") or "://" in relative:
        raise ValueError(f"{relative!r} is not a relative path")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def leaves_root(path: Column) -> Column:
    """Whether ``below`` refuses the relative path in this column: one that is absolute, has a scheme or climbs above its root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("left"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (s["left"] | (depth < 0)).alias("left"))

    return path.startswith("/") | path.contains("://") | F.aggregate(parts, start, step, lambda s: s["left"])


def release_report(spark: SparkSession, root: str, required: Sequence[str], manifests: Sequence[str] = ("manifest.json",)) -> dict[str, Any]:
    """Gates of a release below ``root``: required files are there and every listed file has its digest. ``status`` is PASS only if
    nothing failed; each manifest lists files relative to its own folder."""
    found = inventory(spark, root).select("name").where("name not like '%.crc'")
    wanted = spark.createDataFrame([(n,) for n in required], "name string")
    missing = [r.name for r in wanted.join(found, "name", "left_anti").orderBy("name").collect()]
    broken = []
    for m in manifests:
        folder = below(root, m.rpartition("/")[0]) if "/" in m else root
        listed = load_json(spark, f"{folder}/{m.rpartition('/')[2]}")["files"]
        for name in listed:
            below(folder, name)
        manifest = spark.createDataFrame(sorted(listed.items()), "name string, sha256 string")
        broken += [f"{m}: {r.name} {r.problem}" for r in manifest_violations(inventory(spark, folder), manifest).where("problem <> 'unlisted'").orderBy("name").collect()]
    return {"status": "PASS" if not missing and not broken else "FAIL", "missing": missing, "broken": broken, "required": len(required)}
