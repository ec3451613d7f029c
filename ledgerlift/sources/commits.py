"""A log of numbered entries in a folder, each number taken by exactly one writer."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlift.sources.shared import read_if_present

_STORES = ("s3", "s3a", "gs")


class Conflict(Exception):
    """Another writer was first; read again and redo the change."""


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Make a small file, or return False when there is one. Of writers at one time a single one succeeds.

    The file appears with its content: on a mounted folder it is written aside and linked to its name, which
    fails where the name is taken; elsewhere it is renamed, which the name node refuses likewise. Object
    stores have no such renaming and are asked to create without overwriting (a conditional write).
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    scheme = files.getUri().getScheme()
    if scheme == "file":
        place = target.toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        aside = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(aside, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        return True
    written = target if scheme in _STORES else jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    try:
        stream = files.create(written, False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        if written.equals(target) or files.rename(written, target):
            return True
    except Py4JJavaError:
        if not files.exists(target):
            raise
    if not written.equals(target):
        files.delete(written, False)
    return False


class CommitLog:
    """Entries of a folder in the order of their numbers, which start at 1.

    An entry is current from the moment its file exists, for all readers at once. Empty files, which no writer
    leaves, are passed over, and so are their numbers.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> list[tuple[int, str]]:
        """Number and content of each entry, in order."""
        found = read_if_present(self.spark, self.folder, "text", wholetext=True, pathGlobFilter="*.json")
        if found is None:
            return []
        # One small row per entry ever made.
        rows = found.select(F.col("_metadata.file_name").alias("name"), "value").collect()
        return sorted((int(r["name"].removesuffix(".json")), r["value"]) for r in rows if r["value"])

    def last(self) -> tuple[int, str] | None:
        return next(reversed(self.entries()), None)

    def add(self, content: str, after: int | None = None) -> int:
        """Make the next entry and return its number.

        With ``after``, the number of the entry that the new one builds on (0 for none), it is an error
        (``Conflict``) when there is a later one. Without it a number that is taken meanwhile is passed over.
        """
        if not content:
            raise ValueError("an entry needs content")
        last = self.last()
        number = last[0] + 1 if last else 1
        if after is not None and number > after + 1:
            raise Conflict(f"{self.folder} has an entry after number {after}")
        while not create_if_absent(self.spark, f"{self.folder}/{number:012}.json", content):
            if after is not None and any(n >= number for n, _ in self.entries()):
                raise Conflict(f"number {number} of {self.folder} was taken meanwhile")
            number += 1
        return number
