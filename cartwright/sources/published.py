"""Tables that change by commits: written aside, audited, then made current by one small file.

A table folder holds data folders and ``_commits``, a log of numbered manifests. A manifest names the data
folders that make up the table and what is known of them. The highest number is current, so a reader sees
a whole version or the one before; a load that fails, or fails its audit, leaves only an unnamed
folder behind. A number can be taken once: of two writers at the same time one is told so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cartwright.operators.quality import QualityError


class CommitConflict(RuntimeError):
    """Another writer has taken the number of this commit."""


class Published:
    """One table folder. ``schema`` is used while nothing is committed."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | None = None) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # The log -------------------------------------------------------------------------------------

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """Committed numbers in ascending order, from one directory listing."""
        files, log = self._path("_commits")
        if not files.exists(log):
            return []
        names = [status.getPath().getName() for status in files.listStatus(log)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """The current manifest, or that of a number: number, parts and facts."""
        known = self.numbers()
        if number is None and not known:
            return {"number": 0, "parts": []}
        number = known[-1] if number is None else number
        files, path = self._path(f"_commits/{number:020d}.json")
        stream = files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, parts: list[dict], number: int | None = None, **facts: object) -> dict:
        """Make ``parts`` the table: the manifest appears under its number by one rename."""
        number = self.manifest()["number"] + 1 if number is None else number
        made = {"number": number, "parts": parts, **facts}
        files, aside = self._path(f"_commits/_{uuid4().hex}")
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        finally:
            stream.close()
        _, final = self._path(f"_commits/{number:020d}.json")
        if files.exists(final) or not files.rename(aside, final):
            files.delete(aside, False)
            raise CommitConflict(f"commit {number} of {self.root} is taken")
        return made

    # Data ----------------------------------------------------------------------------------------

    def read(self, parts: list[dict] | None = None) -> DataFrame:
        parts = self.manifest()["parts"] if parts is None else parts
        if not parts:
            if self.schema is None:
                raise FileNotFoundError(f"Nothing is committed in {self.root}")
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.root}/{part['folder']}" for part in parts]
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*folders)

    def stage(self, df: DataFrame, by: str | None = None) -> dict:
        """Write ``df`` to a folder of its own, split by a column if one is given. Its rows are those in the
        footers of that folder, so another writer's rows are never among them.

        No Observation: a session that has held one can no longer ship fitted models to its executors.
        """
        folder = f"data/{uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.root}/{folder}")
        return {"folder": folder, "rows": self.spark.read.parquet(f"{self.root}/{folder}").count()}

    def _audited(self, df: DataFrame, audit: Callable[[DataFrame], DataFrame] | None) -> dict:
        part = self.stage(df)
        if audit is not None:
            # Check rows: one per check.
            failed = [r["check_name"] for r in audit(self.read([part])).where("status = 'Failed'").collect()]
            if failed:
                raise QualityError(f"{self.root} stays as it is, failed: {', '.join(sorted(failed))}")
        return part

    def replace(self, df: DataFrame, audit: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Make ``df`` the whole table, if its audit (check rows with check_name and status) finds no fault."""
        part = self._audited(df, audit)
        self.commit([part])
        return part["rows"]

    def append(self, df: DataFrame, audit: Callable[[DataFrame], DataFrame] | None = None) -> int:
        part = self._audited(df, audit)
        self.commit([*self.manifest()["parts"], part])
        return part["rows"]

    def append_once(self, df: DataFrame, number: int) -> bool:
        """Append under a number of the caller's, such as that of a stream's batch: a second time does nothing.

        The manifest names its own part only; ``read_all`` puts them together.
        """
        if number in self.numbers():
            return False
        self.commit([self.stage(df)], number)
        return True

    def read_all(self) -> DataFrame:
        """Everything that ``append_once`` has committed."""
        numbers = self.numbers()
        if not numbers:
            return self.read([])
        log = self.spark.read.schema("parts array<struct<folder: string>>").json(f"{self.root}/_commits/*.json")
        return self.read([p.asDict() for r in log.collect() for p in r["parts"]])  # one row per commit

    def remove_unnamed(self) -> int:
        """Delete data folders that no commit names. Not while a writer is at work."""
        named = {p["folder"] for n in self.numbers() for p in self.manifest(n)["parts"]}
        files, data = self._path("data")
        gone = 0
        for status in files.listStatus(data) if files.exists(data) else []:
            if f"data/{status.getPath().getName()}" not in named:
                gone += bool(files.delete(status.getPath(), True))
        return gone
