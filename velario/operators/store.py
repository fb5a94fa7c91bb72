"""The mapping store, the audit log and output names, as append-only tables in one folder.

mapping versions are Parquet folders ``version=n`` under ``projects/<project>``; a version becomes
current when its folder is complete, so a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_BACKUPS = 20
MAPPING = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("kind_ord", T.IntegerType()),
        T.StructField("original", T.StringType()),
        T.StructField("entry_ord", T.IntegerType()),
        T.StructField("codename", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
AUDIT = T.StructType([T.StructField("project", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("action", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("files", "entities", "leaks", "unverifiable")]])


class MappingStore:
    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP_BACKUPS):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def versions(self, project: str) -> list[int]:
        names = [n for n in self._folders(f"{self.root}/projects/{project}") if n.startswith("version=")]
        fs, _ = self._fs(self.root)
        done = [n for n in names if fs.exists(self._fs(f"{self.root}/projects/{project}/{n}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in done)

    def projects(self) -> list[str]:
        return [p for p in self._folders(f"{self.root}/projects") if self.versions(p)]

    def load(self, project: str, version: int | None = None) -> DataFrame:
        """The current (or a given) version; a project never saved is empty."""
        found = self.versions(project)
        if not found:
            rows = self.spark.createDataFrame([], MAPPING)
        else:
            rows = self.spark.read.schema(MAPPING).parquet(f"{self.root}/projects/{project}/version={version or found[-1]}")
        return rows.select(F.lit(project).alias("project"), *MAPPING.names)

    def save(self, project: str, mapping: DataFrame) -> int:
        """Write a new version and drop those beyond the newest ``keep`` backups."""
        if not project or not all(c.isdigit() or "a" <= c <= "z" or c in "_-" for c in project):
            raise ValueError(f"not a project name: {project!r}")
        found = self.versions(project)
        version = (found[-1] if found else 0) + 1
        rows = mapping if "updated_at" in mapping.columns else mapping.withColumn("updated_at", F.current_timestamp())
        rows.select(*[F.col(f.name).cast(f.dataType) for f in MAPPING]).write.mode("overwrite").parquet(f"{self.root}/projects/{project}/version={version}")
        for old in [*found, version][: -self.keep - 1]:
            fs, p = self._fs(f"{self.root}/projects/{project}/version={old}")
            fs.delete(p, True)
        return version

    def save_session(self, project: str, review: DataFrame) -> None:
        """Keep an unfinished review table; a later one takes its place."""
        fs, path = self._fs(f"{self.root}/sessions/{project}")
        _, new = self._fs(f"{self.root}/sessions/{project}.new")
        review.write.mode("overwrite").parquet(f"{self.root}/sessions/{project}.new")
        fs.delete(path, True)
        fs.rename(new, path)

    def load_session(self, project: str) -> DataFrame | None:
        """The review table that was left unfinished, or None."""
        fs, path = self._fs(f"{self.root}/sessions/{project}")
        return self.spark.read.parquet(f"{self.root}/sessions/{project}") if fs.exists(path) else None

    def clear_session(self, project: str) -> None:
        fs, path = self._fs(f"{self.root}/sessions/{project}")
        fs.delete(path, True)

    def log(self, project: str, action: str, **counts: int) -> None:
        """Append one audit event: counts only, never a name."""
        extra = set(counts) - set(AUDIT.names)
        if extra:
            raise ValueError(f"not audit counts: {sorted(extra)}")
        row = self.spark.range(1).select(F.lit(project).alias("project"), F.current_timestamp().alias("ts"), F.lit(action).alias("action"), *[F.lit(counts.get(c)).cast("long").alias(c) for c in AUDIT.names[3:]])
        row.write.mode("append").json(f"{self.root}/audit")

    def audit(self) -> DataFrame:
        return read_audit(self.spark, f"{self.root}/audit")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of a JSON-lines folder or file; malformed lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def upsert(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace the codename of equal (kind, original) and follow after the others."""
    key = ["project", "kind", "original"]
    kept = mapping.join(new.select(*key, F.col("codename").alias("new_code")), key, "left").withColumn("codename", F.coalesce("new_code", "codename")).drop("new_code")
    last = mapping.groupBy("project", "kind").agg((F.max("entry_ord") + 1).alias("next"))
    added = new.join(mapping.select(*key), key, "left_anti").join(last, ["project", "kind"], "left")
    order = Window.partitionBy("project", "kind").orderBy("entry_ord", "original")
    added = added.withColumn("entry_ord", (F.coalesce("next", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    return kept.select(*new.columns).unionByName(added.select(*new.columns))


def flatten(mapping: DataFrame) -> DataFrame:
    """One (original, codename) for each original of all kinds, the later kind's; longest first."""
    order = F.struct("kind_ord", "entry_ord")
    return mapping.groupBy("original").agg(F.max_by("codename", order).alias("codename"), F.min(order).alias("o")).orderBy(F.desc(F.length("original")), "o").select("original", "codename")


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(project, entries): the nested JSON form, kind -> original -> codename."""
    per_kind = mapping.groupBy("project", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "codename")))).alias("m"))
    return per_kind.groupBy("project").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.to_json("m").alias("m")))))).alias("entries"))


def read_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows of JSON files {project, entries: {kind: {original: codename}}}."""
    raw = spark.read.schema("project string, entries map<string, map<string, string>>").option("multiLine", True).json(path)
    kinds = raw.select("project", F.posexplode(F.map_entries("entries")).alias("kind_ord", "k"))
    return kinds.select("project", F.col("k.key").alias("kind"), "kind_ord", F.posexplode(F.map_entries("k.value")).alias("entry_ord", "e")).select("project", "kind", "kind_ord", F.col("e.key").alias("original"), "entry_ord", F.col("e.value").alias("codename"))


def project_totals(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("project").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("kind").alias("kinds"))


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("project", "action").agg(F.count(F.lit(1)).alias("events"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AUDIT.names[3:]])


def keep_newest(versions: DataFrame, keep: int = KEEP_BACKUPS) -> DataFrame:
    """versions(project, version): the newest ``keep`` of each project."""
    order = Window.partitionBy("project").orderBy(F.desc("version"))
    return versions.withColumn("age", F.row_number().over(order)).where(F.col("age") <= keep)


def output_name(path: Column, suffix: str) -> Column:
    """``<stem>.<suffix><ext>`` of a file name."""
    return F.regexp_replace(path, r"(\.[^./]*)$", f".{suffix}$1")


def error_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", ".ERROR.txt")
