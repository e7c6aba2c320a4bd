"""Readers: a tree of model files, inventories in JSON, requirements, scan logs."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READ_LIMIT = 16 << 20
PARTITION_BYTES = 128 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    """Deals whole files out by size. Names with a leading dot or underscore are files like any other."""

    def __init__(self, options: dict):
        self.root, self.limit = options["path"], int(options.get("limit", READ_LIMIT))

    def partitions(self):
        if os.path.isfile(self.root):
            return [_Files([self.root])]
        if not os.path.isdir(self.root):
            raise ValueError(f"not a file or directory: {self.root}")
        out: list[list[str]] = [[]]
        size = 0
        for folder, folders, names in os.walk(self.root):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not os.path.isfile(path):
                    continue
                n = min(os.path.getsize(path), self.limit)
                if out[-1] and size + n > PARTITION_BYTES:
                    out.append([])
                    size = 0
                out[-1].append(path)
                size += n
        return [_Files(p) for p in out]

    def read(self, partition):
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    data = f.read(self.limit)
                    digest, size = hashlib.sha256(data), len(data)
                    while more := f.read(1 << 20):
                        digest.update(more)
                        size += len(more)
                    yield path, size, data, len(data) < size, digest.hexdigest(), None
            except OSError as problem:
                yield path, None, None, None, None, str(problem)


class ArtifactFiles(DataSource):
    """`spark.read.format("artifact_files").load(dir)`: path, length, content (first `limit` bytes), cut, sha256 (of
    the whole file), error.

    A file that cannot be read is a row with `error`; a missing target fails the plan.
    """

    @classmethod
    def name(cls):
        return "artifact_files"

    def schema(self):
        return "path string, length long, content binary, cut boolean, sha256 string, error string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def artifact_files(spark, path: str) -> DataFrame:
    spark.dataSource.register(ArtifactFiles)
    return spark.read.format("artifact_files").load(path)


def requirement(line: Column) -> Column:
    """STRUCT<name, version> of a requirements line: the first specifier's version, else unknown; null for other lines."""
    bare = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    version = F.regexp_extract(bare, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*\(?\s*(?:===|==|~=|!=|<=|>=|<|>)\s*([^\s,;)]+)", 1)
    return F.when(name != "", F.struct(name.alias("name"), F.when(version == "", "unknown").otherwise(version).alias("version")))


def requirements(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(requirement(F.col("value")).alias("r")).where("r IS NOT NULL").select("r.*")


BOM_SCHEMA = "components array<struct<name:string,version:string,description:string,hashes:array<struct<alg:string,content:string>>>>"


def bom(spark, path: str) -> DataFrame:
    """Components of an inventory file, in order: pos, name, version, description, sha256."""
    rows = spark.read.option("multiLine", True).schema(BOM_SCHEMA).json(path).select(F.posexplode("components").alias("pos", "c"))
    digest = F.try_element_at(F.filter("c.hashes", lambda h: h["alg"] == "SHA-256"), F.lit(1))["content"]
    return rows.select("pos", "c.name", "c.version", "c.description", digest.alias("sha256"))


def first_link(log: Column, pattern: str) -> Column:
    """The first match of the pattern's group in a log, null if there is none."""
    return F.nullif(F.regexp_extract(log, pattern, 1), F.lit(""))
