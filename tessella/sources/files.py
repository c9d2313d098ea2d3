"""Source trees, file attributes, mounts and blob indexes as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.languages import FILTER, SKIPPED_BY_BUILD, SKIPPED_BY_CLASSIFY, collected, language
from tessella.functions.text import attribute_key, digest, extension, iso_time


def scan(spark: SparkSession, root: str, classify: bool = False, with_text: bool = True) -> DataFrame:
    """``path, extension, language, modified, size, text`` of the source files under ``root``.

    The build scan skips names that start with a dot and five folders and takes
    parsed extensions only; the classify scan skips other folders and takes
    any file.  Content is only read where it is selected.  The file source
    leaves out empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + _quoted(base) + "/", "")
    out = raw.select(path.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if with_text else []))
    parts = F.split("path", "/")
    if classify:
        out = out.where(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED_BY_CLASSIFY])))
    else:
        hidden = F.exists(parts, lambda p: p.startswith("."))
        out = out.where(~hidden & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED_BY_BUILD])) & extension(F.col("path")).isin(collected()))
    found = extension(F.col("path"))
    out = out.withColumn("extension", found).withColumn("language", language(found))
    return out.withColumn("text", F.decode("content", "UTF-8")).drop("content") if with_text else out


def _quoted(s: str) -> str:
    import re

    return re.escape(s)


def languages_seen(files: DataFrame) -> DataFrame:
    """``language, cnt`` of scanned files."""
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("cnt"))


def changed(files: DataFrame, since: Column | None) -> DataFrame:
    """Files modified after a marker; all without one, and those whose time is unknown."""
    return files if since is None else files.where(F.col("modified").isNull() | (F.col("modified") > since))


def of_language(files: DataFrame, name: str) -> DataFrame:
    """Files with the one extension that stands for a language (``typescript`` keeps ``.ts``, not ``.tsx``)."""
    if name not in FILTER:
        raise ValueError(f"unknown language {name}; known: {', '.join(sorted(FILTER))}")
    return files.where(F.col("extension") == FILTER[name])


def set_attributes(known: DataFrame, updates: DataFrame) -> DataFrame:
    """``path, key, value`` with ``updates`` (same columns, ``seq``) applied, the last of a key winning."""
    if updates.columns.count("key") != 1:
        raise ValueError("updates need a key column")
    both = known.select("path", attribute_key(F.col("key")).alias("key"), "value", F.lit(None).cast("long").alias("seq"))
    both = both.union(updates.where("key <> ''").select("path", attribute_key(F.col("key")), "value", "seq"))
    return both.groupBy("path", "key").agg(F.max_by("value", F.coalesce("seq", F.lit(-(1 << 62)))).alias("value"))


def get_attributes(known: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    out = known.where(F.col("path") == path)
    return out.where(F.regexp_replace("key", r"^user\.vfs\.", "").isin(keys)) if keys else out


def remove_attributes(known: DataFrame, gone: DataFrame) -> DataFrame:
    """``known`` without the (path, key) rows of ``gone``."""
    return known.join(gone.select("path", attribute_key(F.col("key")).alias("key")), ["path", "key"], "left_anti")


def previous_values(updates: DataFrame) -> DataFrame:
    """``updates`` (``path, key, value, seq``) with the value that each one replaced."""
    w = Window.partitionBy("path", "key").orderBy("seq")
    return updates.withColumn("previous", F.lag("value").over(w))


def metadata(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """``path, size, modified, backend, hash, attributes`` (map) for each file; backend ``local`` if unset."""
    short = F.regexp_replace("key", r"^user\.vfs\.", "")
    wide = attributes.withColumn("key", short).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attributes"))
    out = files.join(wide, "path", "left")
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    return out.select("path", "size", iso_time(F.unix_timestamp("modified")).alias("modified"), F.coalesce(at("backend"), F.lit("local")).alias("backend"), at("hash").alias("hash"), "attributes")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash, backend, uploaded_at`` of a JSON-lines blob index; malformed lines are skipped."""
    return spark.read.schema("path string, hash string, backend string, uploaded_at long").json(path).where("path is not null")


def blob_rows(files: DataFrame, backend: str, now: Column) -> DataFrame:
    """Index rows for files with ``path, content``."""
    return files.select("path", digest(F.col("content")).alias("hash"), F.lit(backend).alias("backend"), now.cast("long").alias("uploaded_at"))


def append_blobs(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(f"{folder.rstrip('/')}/blobs/index.jsonl")


def resolve(paths: DataFrame, mounts: list[dict]) -> DataFrame:
    """``path, backend, backing``: the first mount (object stores, then git, then local) whose prefix a path starts with."""
    order = {"s3": 0, "git": 1, "local": 2}
    backend = backing = None
    for m in sorted(mounts, key=lambda m: order.get(m["backend_type"], 3)):
        hit = F.col("path").startswith(m["at"])
        rest = F.concat(F.lit(m["path"].rstrip("/")), F.substring("path", len(m["at"]) + 1, 1 << 20))
        backend = F.when(hit, m["name"]) if backend is None else backend.when(hit, m["name"])
        backing = F.when(hit, rest) if backing is None else backing.when(hit, rest)
    if backend is None:
        return paths.select("path", F.lit("cwd").alias("backend"), F.col("path").alias("backing"))
    return paths.select("path", backend.otherwise("cwd").alias("backend"), backing.otherwise(F.col("path")).alias("backing"))


def mount_entries(mounts: DataFrame, at: str) -> DataFrame:
    """Mounts (``name, at``) visible under a virtual folder."""
    return mounts if at == "/" else mounts.where(F.col("at").startswith(at))


def names_under(files: DataFrame, folder: str) -> DataFrame:
    """``name, is_folder``: the direct children of a folder of ``files`` (``path``)."""
    start = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("path", len(start) + 1, 1 << 20)
    child = files.where(F.col("path").startswith(start)).select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_folder"))
    return child.groupBy("name").agg(F.max("is_folder").alias("is_folder"))




def read_mounts(path: str) -> list[dict]:
    """The mount table of a YAML file (``name, backend_type, path``); none if it is missing or blank."""
    import os

    import yaml

    if not os.path.exists(path):
        return []
    with open(path) as f:
        return yaml.safe_load(f) or []


def write_mounts(path: str, mounts: list[dict]) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(mounts, f, sort_keys=False)


class ObjectStore:
    """Objects under a root that Hadoop's file systems can read (``s3a://``, ``file://``, ...)."""

    def __init__(self, spark: SparkSession, root: str, writable: bool = False):
        self.spark, self.root, self.writable = spark, root.rstrip("/"), writable

    def objects(self, prefix: str = "") -> DataFrame:
        """``key, size, modified`` of all objects whose key starts with ``prefix``; content is not read."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        base = self.root.split("://", 1)[-1].strip("/")
        key = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + _quoted(base) + "/", "")
        return raw.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("key").startswith(prefix))

    def get(self, key: str) -> DataFrame:
        """``key, content, hash`` of one object."""
        raw = self.spark.read.format("binaryFile").load(f"{self.root}/{key}")
        return raw.select(F.lit(key).alias("key"), "content", digest(F.col("content")).alias("hash"))

    def put(self, key: str, content: bytes) -> str:
        """Write one object; its digest."""
        import hashlib

        if not self.writable:
            raise PermissionError(f"{self.root} is read-only")
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        out = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return "sha256:" + hashlib.sha256(content).hexdigest()
