"""Snapshot tables on Parquet: versions, position and equality deletes, MERGE and compaction, without a table format's jar.

A table is a folder of data folders and of numbered manifests; a manifest lists the live data files and delete sets with
their sequence numbers, and is all that a version is. Manifests hold a row per file and are planned on the driver, as table
formats do; rows of data and of deletes are only ever joined on executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, path string, kind string, sequence long, keys array<string>"


@dataclass(frozen=True)
class Clause:
    """A MERGE clause. ``when``: matched, not_matched or not_matched_by_source; ``action``: update, delete or insert. Columns of the
    target and source are ``t.x`` and ``s.x``; a null condition is false."""

    when: str
    action: str
    condition: str | None = None
    assignments: dict[str, str] | None = None


class SnapshotTable:
    """A versioned table at ``path``; every change is a new version, and old ones stay readable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # manifests

    def versions(self) -> list[int]:
        """All versions, read with Spark's own file access."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> list[dict]:
        known = self.versions()
        if not known:
            return []
        version = known[-1] if version is None else version
        return [r.asDict() for r in self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/{version:012d}").collect()]

    def _commit(self, entries: list[dict]) -> int:
        known = self.versions()
        version = known[-1] + 1 if known else 1
        rows = [(version, e["path"], e["kind"], e["sequence"], e.get("keys")) for e in entries]
        # two writers of one version: the second finds the folder there and fails, as the mode says
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/{version:012d}")
        return version

    def tag(self, name: str, version: int | None = None) -> int:
        """Name a version (the latest by default); a name is given once."""
        version = self.versions()[-1] if version is None else version
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("errorifexists").json(f"{self.path}/tags/{name}")
        return version

    def tagged(self, name: str) -> int:
        return self.spark.read.schema("version long").json(f"{self.path}/tags/{name}").first().version

    def rollback(self, version: int) -> int:
        """A new version that is an old one again."""
        return self._commit(self.manifest(version))

    def _write(self, df: DataFrame, kind: str) -> list[str]:
        at = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        named = self.spark.read.schema(df.schema).parquet(at).select(F.col("_metadata.file_path").alias("f")).distinct()
        return sorted(r.f for r in named.collect())  # names as scans report them; files without rows are left out

    # reading

    def read(self, version: int | None = None, schema: T.StructType | None = None, positions: bool = False, deleted_flag: str | None = None) -> DataFrame:
        """The rows of a version. ``schema`` reads older files under evolved columns (missing ones are null, types are promoted);
        ``positions`` adds ``_file`` and ``_pos``; ``deleted_flag`` keeps deleted rows and marks them instead."""
        entries = self.manifest(version)
        data = [e for e in entries if e["kind"] == "data"]
        if not data:
            if schema is None:
                raise ValueError("the version has no data files; give a schema to read it as an empty table")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        rows = reader.parquet(*[e["path"] for e in data]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
        columns = [c for c in rows.columns if c not in ("_file", "_pos")]
        rows = rows.withColumn("_gone", F.lit(False))
        position = [e["path"] for e in entries if e["kind"] == "position"]
        if position:
            marks = self.spark.read.parquet(*position).select("_file", "_pos").distinct().withColumn("_hit", F.lit(True))
            rows = rows.join(marks, ["_file", "_pos"], "left").withColumn("_gone", F.col("_gone") | F.coalesce("_hit", F.lit(False))).drop("_hit")
        equality = [e for e in entries if e["kind"] == "equality"]
        if equality:
            numbers = self.spark.createDataFrame([(e["path"], e["sequence"]) for e in data], "_file string, _sequence long")
            rows = rows.join(numbers, "_file")  # a row per file of the manifest
            for e in equality:
                marks = self.spark.read.parquet(e["path"]).select(*[F.col(k).alias(f"__{k}") for k in e["keys"]]).distinct().withColumn("_hit", F.lit(True))
                same = F.lit(e["sequence"]) > F.col("_sequence")
                for k in e["keys"]:
                    a, b = F.col(k), F.col(f"__{k}")
                    same = same & a.eqNullSafe(b)
                    if isinstance(rows.schema[k].dataType, (T.DoubleType, T.FloatType)):
                        same = same & (a.cast("string").eqNullSafe(b.cast("string")))  # -0.0 and 0.0 are different keys
                rows = rows.join(marks, same, "left").withColumn("_gone", F.col("_gone") | F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"__{k}" for k in e["keys"]])
        extra = ["_file", "_pos"] if positions else []
        if deleted_flag:
            return rows.select(*columns, *extra, F.col("_gone").alias(deleted_flag))
        return rows.filter(~F.col("_gone")).select(*columns, *extra)

    # writing

    def append(self, df: DataFrame) -> int:
        entries = self.manifest()
        number = 1 + max([e["sequence"] for e in entries], default=0)
        return self._commit(entries + [{"path": p, "kind": "data", "sequence": number} for p in self._write(df, "data")])

    def overwrite(self, df: DataFrame) -> int:
        number = 1 + max([e["sequence"] for e in self.manifest()], default=0)
        return self._commit([{"path": p, "kind": "data", "sequence": number} for p in self._write(df, "data")])

    def delete_keys(self, keys: DataFrame) -> int:
        """An equality delete: rows of older files whose key columns equal a row of ``keys``; null equals null."""
        entries = self.manifest()
        number = 1 + max([e["sequence"] for e in entries], default=0)
        return self._commit(entries + [{"path": p, "kind": "equality", "sequence": number, "keys": keys.columns} for p in self._write(keys, "deletes")])

    def delete(self, condition: Column, mode: str = "copy-on-write") -> int:
        """Rows where the condition is true go: only files that have such rows are written anew, or their positions are marked."""
        if mode == "merge-on-read":
            entries = self.manifest()
            number = 1 + max([e["sequence"] for e in entries], default=0)
            marks = self.read(positions=True).filter(condition).select("_file", "_pos")
            return self._commit(entries + [{"path": p, "kind": "position", "sequence": number} for p in self._write(marks, "deletes")])
        return self._rewrite(lambda rows: rows.filter(~F.coalesce(condition, F.lit(False))), condition)

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        hit = F.coalesce(condition, F.lit(False))
        return self._rewrite(lambda rows: rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]), condition)

    def _rewrite(self, change: Callable[[DataFrame], DataFrame], condition: Column) -> int:
        entries = self.manifest()
        live = self.read(positions=True)
        touched = {r._file for r in live.filter(condition).select("_file").distinct().collect()}  # file names only
        number = 1 + max([e["sequence"] for e in entries], default=0)
        fresh = self._write(change(self._of_files(live, touched)), "data") if touched else []
        kept = [e for e in entries if not (e["kind"] == "data" and e["path"] in touched)]
        return self._commit(kept + [{"path": p, "kind": "data", "sequence": number} for p in fresh])

    def _of_files(self, live: DataFrame, files: set[str]) -> DataFrame:
        """The rows of some files; the list of names is a table, as it can be as long as the manifest."""
        names = self.spark.createDataFrame([(f,) for f in sorted(files)], "_file string")
        return live.join(names, "_file", "left_semi").drop("_file", "_pos")

    def merge(self, source: DataFrame, on: list[str], clauses: list[Clause]) -> int:
        """MERGE: in each group the first clause whose condition is true takes the row; target rows that none takes stay.

        Only files with rows that some clause may take are written anew: those that a source row matches, and with clauses for
        rows not matched by the source those that have such rows. A source row that matches nothing there matches nothing.
        """
        entries = self.manifest()
        live = self.read(positions=True).alias("t")
        matched = live.join(source.select(*on).distinct().alias("s"), on, "left_semi").select("_file")
        for clause in clauses:
            if clause.when == "not_matched_by_source":
                rest = live.join(source.select(*on).distinct().alias("s"), reduce(Column.__and__, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]), "left_anti")
                matched = matched.unionByName((rest.filter(clause.condition) if clause.condition else rest).select("_file"))
        touched = {r._file for r in matched.distinct().collect()}  # file names only
        number = 1 + max([e["sequence"] for e in entries], default=0)
        fresh = self._write(merge_rows(self._of_files(self.read(positions=True), touched), source, on, clauses), "data")
        kept = [e for e in entries if not (e["kind"] == "data" and e["path"] in touched)]
        return self._commit(kept + [{"path": p, "kind": "data", "sequence": number} for p in fresh])

    def compact(self, target_bytes: int = 512 << 20) -> int:
        """Live rows in files of about the target size, without delete files; sizes are those of the data files."""
        files = [e["path"] for e in self.manifest() if e["kind"] == "data"]
        sizes = self.spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
        total = int(sizes.agg(F.sum("n")).first()[0] or 0)
        return self.overwrite(self.read().repartition(max(1, -(-total // target_bytes))))


    def bin_pack(self, target_bytes: int = 512 << 20, least_share: float = 0.75) -> int:
        """Small files and files with deleted rows packed into bins of about the target size, a new file for each; files that are
        large enough and whole stay as they are. No deletes are left: every file that had some is new."""
        entries = self.manifest()
        rows = self.read(positions=True, deleted_flag="_gone")
        stats = rows.groupBy("_file").agg(F.count_if("_gone").alias("gone"))
        paths = [e["path"] for e in entries if e["kind"] == "data"]
        sizes = self.spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("size")).distinct()
        known = {r._file: (r.size, r.gone or 0) for r in sizes.join(stats, "_file", "left").collect()}  # a row per file of the manifest
        chosen = sorted((f for f, (size, gone) in known.items() if gone or size < least_share * target_bytes), key=lambda f: -known[f][0])
        bins: list[int] = []
        place: list[tuple[str, int]] = []
        for f in chosen:  # first fit, largest first
            at = next((i for i, used in enumerate(bins) if used + known[f][0] <= target_bytes), len(bins))
            bins[at:] = bins[at:] or [0]
            bins[at] += known[f][0]
            place.append((f, at))
        number = 1 + max([e["sequence"] for e in entries], default=0)
        kept = [e for e in entries if e["kind"] == "data" and e["path"] not in set(chosen)]
        if not chosen:
            return self._commit(kept)
        where = self.spark.createDataFrame(place, "_file string, _bin int")
        packed = rows.filter(~F.col("_gone")).join(where, "_file").repartitionById(len(bins), "_bin").drop("_file", "_pos", "_gone", "_bin")
        return self._commit(kept + [{"path": p, "kind": "data", "sequence": number} for p in self._write(packed, "data")])


def merge_rows(target: DataFrame, source: DataFrame, on: list[str], clauses: list[Clause]) -> DataFrame:
    """The rows of ``target`` after a MERGE with ``source``. A target row that two source rows match is an error, raised by the job."""
    columns = target.columns
    t = target.withColumn("__id", F.monotonically_increasing_id()).withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    condition = None
    for k in on:
        one = F.col(f"t.{k}") == F.col(f"s.{k}")
        condition = one if condition is None else condition & one
    joined = t.join(s, condition, "full_outer")
    present = {"matched": F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull(), "not_matched": F.col("t.__t").isNull(), "not_matched_by_source": F.col("s.__s").isNull()}
    keep = F.array(F.struct(*[F.col(f"t.{c}").alias(c) for c in columns]))
    none = F.filter(keep, lambda x: F.lit(False))
    result = F.when(F.col("t.__t").isNotNull(), keep).otherwise(none)
    for clause in reversed(clauses):
        takes = present[clause.when]
        if clause.condition:
            takes = takes & F.coalesce(F.expr(clause.condition), F.lit(False))
        if clause.action == "delete":
            value = none
        else:
            given = clause.assignments or {c: f"s.{c}" for c in columns}
            side = "t" if clause.action == "update" else None
            value = F.array(F.struct(*[(F.expr(given[c]) if c in given else F.col(f"{side}.{c}") if side else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in columns]))
        result = F.when(takes, value).otherwise(result)
    times = joined.select(F.col("t.__id").alias("id"), result.alias("rows"), (present["matched"]).alias("m"))
    from pyspark.sql import Window

    n = F.count(F.when(F.col("m"), 1)).over(Window.partitionBy(F.coalesce(F.col("id"), -F.monotonically_increasing_id() - 1)))
    checked = times.withColumn("n", n).select(F.when(F.col("n") > 1, F.raise_error(F.lit("MERGE_CARDINALITY_VIOLATION: a target row matches several source rows"))).otherwise(F.lit(0)).alias("ok"), "rows")
    return checked.filter(F.coalesce(F.col("ok"), F.lit(0)).cast("int") == 0).select(F.inline("rows"))
