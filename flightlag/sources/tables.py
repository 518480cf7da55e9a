"""Model tables kept as parquet in a folder all executors share.

A table is a folder of versions: ``data-<id>`` holds the rows of one version, and
``manifest/<number>.json`` says where they lie, what they were made from and what was
counted while they were written. A manifest appears under its number in one rename, after
the rows; the highest number counts. A write that is killed leaves rows nothing points to.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.session import scratch_path

#: Versions that stay: the one that counts and those that running readers may still hold.
KEPT_VERSIONS = 2


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, folder = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def read_small(spark: SparkSession, path: str) -> str:
    system, file = _folder(spark, path)
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def place_small(spark: SparkSession, path: str, text: str) -> bool:
    """A short file that is there as a whole or not at all; False if the path is taken."""
    system, file = _folder(spark, path)
    if system.exists(file):
        return False
    _, draft = _folder(spark, f"{file.getParent().toString()}/.draft-{uuid.uuid4().hex[:12]}")
    stream = system.create(draft, False)
    stream.write(text.encode())
    stream.close()
    if system.rename(draft, file):
        return True
    system.delete(draft, False)
    if not system.exists(file):
        raise OSError(f"cannot write {path}")
    return False


def content_id(df: DataFrame) -> str:
    """Rows, order-free hash sums and schema of a table, in one pass without a shuffle of rows."""
    value = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(value.cast("decimal(20,0)")).alias("total"),
        F.bit_xor(F.xxhash64(value)).alias("mixed"),
    ).first()
    return f"{df.schema.simpleString()} {found.rows} {found.total} {found.mixed}"


def files_id(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the parquet files below a folder; none of them is opened."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet")
    return content_id(reader.load(path).select("path", "length", "modificationTime"))


def keep_in_scratch(df: DataFrame, label: str) -> DataFrame:
    """Store a table below the shared folder and read it back: its size is known then."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Version:
    """A stored version of a table; ``filled`` counts the values of each column that are not null."""

    data: str
    inputs: str
    fields: str
    rows: int
    filled: dict[str, int]
    seconds: float

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.fields))


class TableStore:
    """Write a DataFrame once, read it back as a table with known size.

    ``inputs`` names what all tables of the store are made from. Versions with the same
    name, written by any session, are taken as they are; others are replaced. Without a
    name nothing is looked for: only what this store has written is there.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: str = ""):
        self.spark = spark
        self.root = root.rstrip("/")
        self.inputs = inputs
        self._versions: dict[str, Version] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _manifest(self, name: str, number: int) -> str:
        return f"{self.path(name)}/manifest/{number:08d}.json"

    def _numbers(self, name: str) -> list[int]:
        names = _names(self.spark, f"{self.path(name)}/manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _published(self, name: str, number: int) -> Version:
        return Version(**json.loads(read_small(self.spark, self._manifest(name, number))))

    def version(self, name: str) -> Version | None:
        """The version of a table that this store reads."""
        if name not in self._versions and self.inputs:
            numbers = self._numbers(name)
            last = self._published(name, numbers[-1]) if numbers else None
            if last and last.inputs == self.inputs:
                self._versions[name] = last
        return self._versions.get(name)

    def save(self, name: str, df: DataFrame, by: Sequence[str] = (), compact: bool = False) -> DataFrame:
        """Replace the table; ``by`` names the columns its folders are made of.

        ``compact`` shuffles rows to files of Spark's advisory size first, for
        tables whose tasks would each write a sliver of every folder. Rows and filled
        values are counted by the tasks that write, each task's counts taken once.
        """
        start = time.perf_counter()
        if compact:
            df = df.hint("rebalance", *by) if by else df.hint("rebalance")
        data = f"data-{uuid.uuid4().hex[:12]}"
        counted = Observation(f"{name}-{data}")
        filled = [F.count(F.col(f"`{c}`")).alias(f"filled_{i}") for i, c in enumerate(df.columns)]
        writer = df.observe(counted, F.count(F.lit(1)).alias("rows"), *filled).write.option("compression", "zstd")
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(f"{self.path(name)}/{data}")
        figures = counted.get
        version = Version(
            data,
            self.inputs,
            df.schema.json(),
            figures["rows"],
            {c: figures[f"filled_{i}"] for i, c in enumerate(df.columns)},
            time.perf_counter() - start,
        )
        self._publish(name, version)
        return self.load(name)

    def _publish(self, name: str, version: Version) -> None:
        numbers = self._numbers(name)
        number = numbers[-1] + 1 if numbers else 1
        while not place_small(self.spark, self._manifest(name, number), json.dumps(asdict(version))):
            number += 1
        self._versions[name] = version
        for old in numbers[: 1 - KEPT_VERSIONS]:
            delete_folder(self.spark, f"{self.path(name)}/{self._published(name, old).data}")
            delete_folder(self.spark, self._manifest(name, old))

    def load(self, name: str) -> DataFrame:
        version = self.version(name)
        if version is None:
            raise KeyError(f"no table {name} below {self.root}")
        return self.spark.read.schema(version.schema()).parquet(f"{self.path(name)}/{version.data}")

    def clear_remains(self, name: str) -> int:
        """Delete rows that no manifest names, as killed writes leave them; for when nobody writes.

        Returns how many folders went.
        """
        kept = {self._published(name, n).data for n in self._numbers(name)}
        remains = [n for n in _names(self.spark, self.path(name)) if n.startswith("data-") and n not in kept]
        for folder in remains:
            delete_folder(self.spark, f"{self.path(name)}/{folder}")
        return len(remains)

    def remove(self, name: str) -> None:
        """Delete a table that nothing reads any more; one that is not there is none."""
        if self._versions.pop(name, None) is not None:
            delete_folder(self.spark, self.path(name))

    def drop(self) -> None:
        """Remove the folder and forget its tables."""
        delete_folder(self.spark, self.root)
        self._versions.clear()

    def has(self, name: str) -> bool:
        return self.version(name) is not None
