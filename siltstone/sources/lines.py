"""Zipped JSON Lines as a Python data source, and checks of fetched files."""

from __future__ import annotations

import glob
import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CHUNK = 1 << 20


class Member(InputPartition):
    """One file inside an archive, or a plain file of lines."""

    def __init__(self, path: str, name: str | None):
        self.path, self.name = path, name


class ZippedLines(DataSource):
    """Rows (uid, dataset, member, line, value), a partition per archive member.

    uid is `<dataset>/<member>:<line>` with lines counted from 1; dataset is the option `dataset` or
    the archive's name without its ending. Lines stream; an archive is never unpacked as a whole.
    Empty lines count but give no row; bytes that are no UTF-8 become the replacement character.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "uid string, dataset string, member string, line bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return ZippedLinesReader(self.options)


class ZippedLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in sorted(glob.glob(self.options["path"])):
            if zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as z:
                    out += [Member(path, i.filename) for i in z.infolist() if not i.is_dir()]
            else:
                out.append(Member(path, None))
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        dataset = self.options.get("dataset") or os.path.splitext(os.path.basename(partition.path))[0]
        if partition.name is None:
            with open(partition.path, "rb") as f:
                yield from self._rows(f, dataset, os.path.basename(partition.path))
        else:
            with zipfile.ZipFile(partition.path) as z, z.open(partition.name) as f:
                yield from self._rows(io.BufferedReader(f, _CHUNK), dataset, partition.name)

    @staticmethod
    def _rows(lines, dataset: str, member: str) -> Iterator[tuple]:
        for number, raw in enumerate(lines, 1):
            text = raw.rstrip(b"\r\n")
            if text:
                yield f"{dataset}/{member}:{number}", dataset, member, number, text.decode("utf-8", "replace")


def read_lines(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The lines of archives or files that match a pattern."""
    spark.dataSource.register(ZippedLines)
    reader = spark.read.format("zipped_lines").option("path", path)
    return (reader.option("dataset", dataset) if dataset else reader).load()


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def pinned_file(path: str, digest: str, fetch=None) -> str:
    """The path of a file with a known digest; fetched first where it is missing. ValueError if it differs."""
    if not os.path.exists(path):
        if fetch is None:
            raise FileNotFoundError(path)
        fetch(path)
    found = file_digest(path)
    if found != digest:
        raise ValueError(f"{path}: digest {found}, expected {digest}")
    return path


def checked_files(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """(file, digest, ok) of the files at path against expected digests by file name."""
    want = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv)) if expected else F.create_map().cast("map<string,string>")
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))
    return rows.withColumn("ok", F.coalesce(F.try_element_at(want, F.col("file")) == F.col("digest"), F.lit(False)))
