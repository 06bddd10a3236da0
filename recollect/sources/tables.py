"""Snapshots: the store's tables as versioned Parquet, written whole and then named current."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES, migrate


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and there is one machine only, a
    folder of that."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named.rstrip("/")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and go on from there."""
    path = f"{shared_dir(df.sparkSession)}/recollect/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Versions of the store below a folder of any file system that Spark reaches.

    A version is a list of tables' folders, in a numbered file of the folder versions. A write makes folders for the tables
    that it changes, takes the others over, and then moves its finished list to the next number, so readers, who take the
    greatest number, see a whole version, nothing is ever replaced, and what a failed writer leaves is never read. Of two
    writers that began from one version the later fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        P, fs = self._fs()
        folder = P(f"{self.path}/versions")
        if not fs.exists(folder):
            if fs.exists(P(self.path)) and any(x.getPath().getName().startswith("v-") for x in fs.listStatus(P(self.path))):
                raise RuntimeError(f"{self.path} holds tables but no list of versions")
            return []
        return sorted(int(n[:-5]) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit())

    def _current(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"version": None, "number": 0, "tables": {}}
        text = self.spark.read.text(f"{self.path}/versions/{numbers[-1]:012}.json", wholetext=True).first().value
        return json.loads(text) | {"number": numbers[-1]}

    def version(self) -> str | None:
        return self._current()["version"]

    def read(self) -> dict[str, DataFrame]:
        """All tables of the current version, in today's layout; empty ones before the first write."""
        folders, out = self._current()["tables"], {}
        for name, schema in TABLES.items():
            folder = folders.get(name)
            out[name] = migrate(self.spark.read.parquet(f"{self.path}/{folder}"), schema) if folder else self.spark.createDataFrame([], schema)
            out[name]._folder = folder
        return out

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Make a new version; tables that are not given, or are as they were read, are taken over. It gives the version's name."""
        current = self._current()
        folders = current["tables"]
        version = f"v-{uuid.uuid4().hex}"
        P, fs = self._fs()
        fs.mkdirs(P(f"{self.path}/versions"))
        for name, df in tables.items():
            if name in folders and getattr(df, "_folder", None) == folders[name]:
                continue
            migrate(df, TABLES[name]).write.parquet(f"{self.path}/{version}/{name}")
            folders[name] = f"{version}/{name}"
        fresh, final = P(f"{self.path}/versions/{version}.part"), P(f"{self.path}/versions/{current['number'] + 1:012}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": version, "tables": folders}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(fresh, final):
            raise RuntimeError(f"another writer has made version {current['number'] + 1} of {self.path}")
        return version
