"""Parquet tables in versioned folders behind a manifest that is swapped last, a registry of them, and stored models."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days until data of a frequency is stale.
FRESH_DAYS = {"D": 1, "W": 7, "M": 30, "Q": 30}


class StoreError(Exception):
    """A stored table or model is absent, incomplete, altered or of another schema version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    """name and sha256 of the data files, computed by the executors; Spark's own file size keeps a file well under 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Sizes of the data files as the file system lists them; nothing is read."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file and swap it in; a reader sees the old text or the new one, whole."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, t = _fs(spark, temporary)
    out = fs.create(t, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(t.toUri(), spark._jsc.hadoopConfiguration()).rename(t, target, options)


def _get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise StoreError(f"{path}: absent")
    return spark.read.text(path, wholetext=True).first()["value"]


def write_table(df: DataFrame, path: str, schema_version: str, **meta) -> dict:
    """Write df into a new folder under path, then swap path/manifest.json; a failed write leaves the old table readable.

    The folder before the one replaced is removed, so that readers of the replaced
    one can finish. The manifest has size and digest of every file; meta is the
    caller's, such as pipeline_processed.
    """
    spark = df.sparkSession
    try:
        old = read_manifest(spark, path)
    except StoreError:
        old = {}
    folder = f"data-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    try:
        df.write.parquet(f"{path}/{folder}")
    except Exception:
        fs, partial = _fs(spark, f"{path}/{folder}")
        fs.delete(partial, True)
        raise
    sizes = _sizes(spark, f"{path}/{folder}")
    manifest = {
        "schema_version": schema_version, "row_count": spark.read.schema(df.schema).parquet(f"{path}/{folder}").count(),
        "written_at": datetime.now(UTC).isoformat(), "folder": folder, "replaced": old.get("folder"),
        "files": {r["name"]: [sizes[r["name"]], r["sha256"]] for r in _sums(spark, f"{path}/{folder}").toLocalIterator()}, "meta": meta,
    }
    _put_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1))
    if old.get("replaced"):
        fs, gone = _fs(spark, f"{path}/{old['replaced']}")
        fs.delete(gone, True)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        manifest = json.loads(_get_text(spark, f"{path}/manifest.json"))
    except ValueError as e:
        raise StoreError(f"{path}: unreadable manifest") from e
    if not {"schema_version", "row_count", "written_at", "folder", "files"} <= set(manifest):
        raise StoreError(f"{path}: incomplete manifest")
    return manifest


def audit_table(spark: SparkSession, path: str) -> DataFrame:
    """name and issue of every file that is missing, unlisted or altered, by digests of all files."""
    manifest = read_manifest(spark, path)
    said = spark.createDataFrame([(n, sha) for n, (_, sha) in manifest["files"].items()] or [("", "")], "name string, said string").where("name <> ''")
    folder = f"{path}/{manifest['folder']}"
    fs, p = _fs(spark, folder)
    have = _sums(spark, folder) if fs.exists(p) else spark.createDataFrame([], "name string, sha256 string")
    return said.join(have, "name", "full").select(
        "name", F.when(F.col("sha256").isNull(), "missing").when(F.col("said").isNull(), "unlisted").when(F.col("said") != F.col("sha256"), "altered").alias("issue")
    ).where("issue is not null")


def read_table(
    spark: SparkSession, path: str, schema_version: str | None = None, least_rows: int = 0, digests: bool = False, fresh: tuple[str, datetime] | None = None
) -> DataFrame | None:
    """The table, if its files are as written; else StoreError. None if fresh(frequency, now) is asked for and it is stale.

    Names and sizes are compared with one listing; with digests, also the contents
    of all files, which reads them.
    """
    manifest = read_manifest(spark, path)
    if schema_version is not None and manifest["schema_version"] != schema_version:
        raise StoreError(f"{path}: schema version {manifest['schema_version']}, not {schema_version}")
    if manifest["row_count"] < least_rows:
        raise StoreError(f"{path}: {manifest['row_count']} rows")
    said, have = {n: size for n, (size, _) in manifest["files"].items()}, _sizes(spark, f"{path}/{manifest['folder']}")
    issues = [f"{n} missing" for n in said.keys() - have.keys()] + [f"{n} unlisted" for n in have.keys() - said.keys()]
    issues += [f"{n} altered" for n in said.keys() & have.keys() if said[n] != have[n]]
    if digests and not issues:
        issues = [f"{r['name']} {r['issue']}" for r in audit_table(spark, path).limit(5).collect()]
    if issues:
        raise StoreError(f"{path}: " + "; ".join(sorted(issues)[:5]))
    if fresh is not None and not is_fresh(manifest, *fresh):
        return None
    return spark.read.parquet(f"{path}/{manifest['folder']}")


def is_fresh(manifest: dict, frequency: str, now: datetime) -> bool:
    age = now - datetime.fromisoformat(manifest["written_at"])
    return age.total_seconds() < FRESH_DAYS.get(frequency[:1].upper(), 1) * 86_400


@dataclass
class Registry:
    """Tables and models under one root, found by name; looked up anew once before a name is called unknown."""

    spark: SparkSession
    root: str
    known: dict[str, str] | None = None

    def names(self) -> dict[str, str]:
        """Names with their paths, from one listing; a folder without a manifest is none."""
        fs, p = _fs(self.spark, self.root)
        found = {}
        for s in fs.listStatus(p) if fs.exists(p) else []:
            path = f"{self.root}/{s.getPath().getName()}"
            if s.isDirectory() and fs.exists(_fs(self.spark, f"{path}/manifest.json")[1]):
                found[s.getPath().getName()] = path
        self.known = found
        return found

    def path(self, name: str) -> str:
        if self.known is None or name not in self.known:
            self.names()
        if name not in self.known:
            raise StoreError(f"{name}: not in {self.root}")
        return self.known[name]

    def read(self, name: str, **how) -> DataFrame | None:
        return read_table(self.spark, self.path(name), **how)

    def write(self, name: str, df: DataFrame, schema_version: str, **meta) -> dict:
        manifest = write_table(df, f"{self.root}/{name}", schema_version, **meta)
        self.names()
        return manifest

    def write_vintages(self, name: str, panel: DataFrame, keys: list[str], published: str, schema_version: str) -> dict:
        """A panel in the order in which its readers ask for it, with its counts and extents in the manifest."""
        e = panel.agg(F.min(published).cast("string").alias("first"), F.max(published).cast("string").alias("last"), F.count("*").alias("n")).first()
        placed = panel.repartitionByRange(*keys, published).sortWithinPartitions(*keys, published)
        return self.write(name, placed, schema_version, vintages=True, first_published=e["first"], last_published=e["last"], rows=e["n"])

    def build_or_read(self, name: str, build, schema_version: str) -> DataFrame:
        """The stored table, or, where it is absent or damaged, the one that build() makes, stored first."""
        try:
            return self.read(name, schema_version=schema_version)
        except StoreError:
            self.write(name, build(), schema_version)
            return self.read(name, schema_version=schema_version)


def write_model(spark: SparkSession, path: str, kind: str, version: str, body: dict) -> str:
    """Store a model's parameters as JSON with their digest, in one swap; returns the digest."""
    text = json.dumps(body, sort_keys=True)
    digest = hashlib.sha256(text.encode()).hexdigest()
    _put_text(spark, path, json.dumps({"kind": kind, "version": version, "sha256": digest, "written_at": datetime.now(UTC).isoformat(), "body": text}))
    return digest


def read_model(spark: SparkSession, path: str, kind: str, version: str, keys: set[str] = frozenset()) -> dict:
    """A stored model's parameters; another kind or version, a wrong digest or a missing key raises StoreError."""
    try:
        held = json.loads(_get_text(spark, path))
        text = held["body"]
        if (held["kind"], held["version"]) != (kind, version):
            raise StoreError(f"{path}: {held['kind']} {held['version']}, not {kind} {version}")
        if hashlib.sha256(text.encode()).hexdigest() != held["sha256"]:
            raise StoreError(f"{path}: altered")
        body = json.loads(text)
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError(f"{path}: unreadable model") from e
    if not keys <= set(body):
        raise StoreError(f"{path}: without {sorted(keys - set(body))}")
    return body
