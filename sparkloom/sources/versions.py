"""Tables in committed versions: staged writes, an atomic switch, and readers that pin what they read.

A table is a folder with `data`, where every write stages its files in a folder of its own, and `versions`, with one
small manifest a version. A manifest names, bucket by bucket, the staged folders that make up the table; rows are dealt
over buckets by a hash of the scope they belong to. A write reads one base version, stages what changes, and commits by
creating the manifest of the next number, which the file system lets only one writer do: the other gets a
`Conflict`, and nothing of its write is visible. A write that breaks off leaves staged files that no manifest
names. Readers read the folders of one manifest, so they see one version however many writes follow; `vacuum` deletes
what no kept version names.

A replaced scope rewrites only the buckets that its rows fall into, so the price of a write follows the scope, not the
table. Conditions on the version that is read (a row count, a note such as the revision it was built of) are checked
on the manifest, before any data is read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: Seconds after which a claim without a manifest is taken to be a lost writer's.
STALE = 600


class Conflict(RuntimeError):
    """Another writer committed a version on the same base first."""


class Unready(RuntimeError):
    """The version does not meet what a reader asked of it."""


@dataclass(frozen=True)
class Version:
    """A manifest: number, schema, the scope's columns, staged folders of each bucket, rows of each bucket, notes."""

    number: int
    schema: str
    scope: tuple[str, ...]
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def count(self) -> int:
        return sum(self.rows.values())


class Versioned:
    """A table of committed versions below a folder that all executors and writers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- manifests ----------------------------------------------------------------------------

    def _files(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        files, at = self._files(f"{self.folder}/versions")
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def version(self, number: int | None = None) -> Version:
        """A version, the last one where none is named."""
        known = self.numbers()
        if number is None:
            number = known[-1] if known else 0
        if number not in known:
            raise Unready(f"there is no version {number} of {self.folder}")
        text = "".join(r.value for r in self.spark.read.option("wholetext", True).text(self._manifest(number)).collect())
        found = json.loads(text)
        number_keys = lambda d: {int(k): v for k, v in d.items()}
        return Version(found["number"], found["schema"], tuple(found["scope"]), found["buckets"], number_keys(found["folders"]), number_keys(found["rows"]), found["notes"])

    def _commit(self, version: Version) -> Version:
        """Make a version visible. Its manifest is written whole under another name first, and then takes the
        version's name only if no other writer holds it; the empty claim file decides between two writers."""
        files, at = self._files(self._manifest(version.number))
        _, claim = self._files(f"{self.folder}/versions/_{version.number:012d}.claim")
        _, draft = self._files(f"{self.folder}/versions/_{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({**version.__dict__, "scope": list(version.scope)}).encode()))
        out.close()
        if files.exists(at) or not (self._claimed(files, claim) or (self._taken_over(files, claim, at) and self._claimed(files, claim))):
            files.delete(draft, False)
            raise Conflict(f"version {version.number} of {self.folder} is another writer's")
        if files.exists(at) or not files.rename(draft, at):
            raise Conflict(f"version {version.number} of {self.folder} could not be committed")
        return version

    def _claimed(self, files, claim) -> bool:  # noqa: ANN001
        """Whether this writer created the claim: the second creation of one name fails."""
        try:
            files.create(claim, False).close()
        except Py4JJavaError:
            return False
        return True

    def _taken_over(self, files, claim, manifest) -> bool:  # noqa: ANN001
        """Whether this writer removed the claim of one that was lost between claim and manifest."""
        if files.exists(manifest) or time.time() * 1000 - files.getFileStatus(claim).getModificationTime() < STALE * 1000:
            return False
        _, aside = self._files(f"{self.folder}/versions/_{uuid.uuid4().hex}.lost")
        return bool(files.rename(claim, aside))  # one of several succeeds

    # --- reading ------------------------------------------------------------------------------

    def read(self, version: Version, least: int = 0, **notes: str) -> DataFrame:
        """The rows of a version, if it has at least so many rows and the notes asked for."""
        if version.count() < least or any(version.notes.get(k) != v for k, v in notes.items()):
            raise Unready(f"version {version.number} of {self.folder} is not what was asked for")
        return self._rows(version, version.folders)

    def _rows(self, version: Version, folders: dict[int, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        paths = sorted(set(folders.values()))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- writing ------------------------------------------------------------------------------

    def _bucket(self, scope: tuple[str, ...], buckets: int):  # noqa: ANN202
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in scope]), F.lit(buckets)).cast("int")

    def _stage(self, rows: DataFrame, scope: tuple[str, ...], buckets: int) -> tuple[dict[int, str], dict[int, int]]:
        """Write rows to folders of their own, one a bucket; returns the folders and their numbers of rows."""
        own = f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(scope, buckets))
        dealt.write.partitionBy("_bucket").parquet(own)
        files, at = self._files(own)
        found = [s.getPath().getName() for s in files.listStatus(at)]
        held = sorted(int(n.split("=")[1]) for n in found if n.startswith("_bucket="))
        if not held:
            return {}, {}
        staged = self.spark.read.option("basePath", own).parquet(own)
        rows_of = {r["_bucket"]: r["n"] for r in staged.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        return {b: f"{own}/_bucket={b}" for b in held}, rows_of

    def create(self, rows: DataFrame, scope: list[str], buckets: int = BUCKETS, **notes: str) -> Version:
        """Version 1 of a table."""
        folders, counts = self._stage(rows, tuple(scope), buckets)
        return self._commit(Version(1, rows.schema.json(), tuple(scope), buckets, folders, counts, notes))

    def replace(self, base: Version, scopes: DataFrame, rows: DataFrame, **notes: str) -> Version:
        """The version after `base` in which the rows of all scopes named in `scopes` and in `rows` are those of
        `rows`. Fails with Conflict if another version was committed on the base."""
        names = list(base.scope)
        rows = rows.select(*StructType.fromJson(json.loads(base.schema)).names)
        named = scopes.select(*names).union(rows.select(*names)).distinct()
        touched = {r["b"] for r in named.select(self._bucket(base.scope, base.buckets).alias("b")).distinct().collect()}  # numbers of buckets
        before = self._rows(base, {b: f for b, f in base.folders.items() if b in touched})
        same = [F.col(f"o.`{n}`").eqNullSafe(F.col(f"s.`{n}`")) for n in names]
        kept = before.alias("o").join(named.alias("s"), same, "left_anti")
        folders, counts = self._stage(kept.unionByName(rows), base.scope, base.buckets)
        folders = {b: f for b, f in base.folders.items() if b not in touched} | folders
        counts = {b: n for b, n in base.rows.items() if b not in touched} | counts
        return self._commit(Version(base.number + 1, base.schema, base.scope, base.buckets, folders, counts, {**base.notes, **notes}))

    def upsert(self, base: Version, rows: DataFrame, **notes: str) -> Version:
        """The version after `base` with rows in place of those of the same scope: for a table whose scope is its key."""
        return self.replace(base, rows, rows, **notes)

    def delete(self, base: Version, scopes: DataFrame, **notes: str) -> Version:
        """The version after `base` without the scopes."""
        return self.replace(base, scopes, self.spark.createDataFrame([], StructType.fromJson(json.loads(base.schema))), **notes)

    def vacuum(self, keep: int) -> int:
        """Drop all but the last `keep` versions, and staged folders that no kept version names: those of writes that
        broke off too, so no write may be under way. Returns how many folders went."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]] if keep else []
        named = {f.split("/data/")[1] for v in kept for f in v.folders.values()}
        for n in numbers[: len(numbers) - len(kept)]:
            files, at = self._files(self._manifest(n))
            files.delete(at, False)
        files, at = self._files(f"{self.folder}/data")
        gone = 0
        for run in files.listStatus(at) if files.exists(at) else []:
            for part in files.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{part.getPath().getName()}"
                if name not in named and part.isDirectory():
                    files.delete(part.getPath(), True)
                    gone += 1
        return gone
