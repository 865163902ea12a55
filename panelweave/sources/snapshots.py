"""Tables of replaceable units (partitions or hash buckets) whose state is one small manifest.

    <base>/data/<write>/_unit=<name>/part-*.parquet     files, written aside and never changed
    <base>/manifests/<version>.json                      which folder holds each unit, and the schema

A commit writes the new folders first and then one manifest, under a temporary name that is renamed. So a reader sees the
state before or the state after, units that a commit does not name keep their files, a writer that dies leaves the former
state, and of two writers from the same state one is refused. The manifest has one line per unit: it is as long as the
number of partitions or buckets, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import as_col

UNIT, BUCKET = "_unit", "_bucket"
KEPT = 2  # states whose files stay, so that a reader of the former one is not disturbed


class ConflictError(RuntimeError):
    """Another writer has committed since the state was read."""


@dataclass(frozen=True)
class State:
    """One committed version: folders by unit, the schema of the rows, and what the writer noted."""

    version: int
    schema: StructType
    units: Mapping[str, str]
    notes: Mapping[str, object]


class _Files:
    """The few file operations that a commit needs, on the file system that the folder belongs to."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def text(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, file: str, text: str) -> None:
        """Write ``text`` whole under ``file``; an error if that exists."""
        aside = f"{file}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(aside), self._path(file), options)  # refuses to replace
        except Exception as error:
            self.remove(aside)
            if self._fs.exists(self._path(file)):
                raise ConflictError(f"{file} was committed by another writer") from error
            raise

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class SnapshotTable:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._files = _Files(spark, self.base)

    def _versions(self) -> list[int]:
        names = self._files.names(f"{self.base}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> State | None:
        """The newest committed state, or the given one; None before the first commit."""
        versions = self._versions()
        if not versions:
            return None
        chosen = versions[-1] if version is None else version
        found = json.loads(self._files.text(f"{self.base}/manifests/{chosen:08d}.json"))
        return State(chosen, StructType.fromJson(found["schema"]), found["units"], found["notes"])

    def read(self, state: State | None = None, units: Iterable[str] | None = None) -> DataFrame | None:
        """Rows of a state, of all units or of those named; None where there is no state or nothing is left of it.

        Only the folders of these units are listed and opened; columns that an older unit lacks are missing values.
        """
        state = state or self.state()
        if state is None:
            return None
        wanted = state.units if units is None else [u for u in units if u in state.units]
        paths = [f"{self.base}/{state.units[u]}" for u in sorted(wanted)]
        return self.spark.read.schema(state.schema).parquet(*paths) if paths else self.spark.createDataFrame([], state.schema)

    def write(self, df: DataFrame, unit: Column, *, dealt: bool = False) -> dict[str, str]:
        """Write rows aside, one folder per value of ``unit``; nothing is visible before a commit. Folders by unit.

        Rows are rebalanced by unit first, so that a small unit is one file and a large one is split over tasks, unless they
        are ``dealt`` by unit already.
        """
        name = f"data/{uuid.uuid4().hex}"
        named = df.withColumn(UNIT, unit)
        placed = named if dealt else named.hint("rebalance", UNIT)
        placed.write.partitionBy(UNIT).parquet(f"{self.base}/{name}")
        folders = [n for n in self._files.names(f"{self.base}/{name}") if n.startswith(f"{UNIT}=")]
        return {n.removeprefix(f"{UNIT}="): f"{name}/{n}" for n in folders}

    def commit(
        self, former: State | None, changed: Mapping[str, str], schema: StructType, *, dropped: Iterable[str] = (), notes: Mapping[str, object] | None = None
    ) -> State:
        """The state after ``former`` in which ``changed`` units have new folders and ``dropped`` ones are gone."""
        gone = set(dropped)
        units = {u: p for u, p in (former.units if former else {}).items() if u not in gone} | dict(changed)
        version = former.version + 1 if former else 0
        body = {"schema": schema.jsonValue(), "units": units, "notes": dict(notes or {})}
        self._files.put(f"{self.base}/manifests/{version:08d}.json", json.dumps(body))
        return State(version, schema, units, dict(notes or {}))

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete manifests but the newest ``keep``, and the data folders that none of these names.

        For the one writer of a table, between its commits: files of a write that was never committed go too.
        """
        versions = self._versions()
        used = {p for v in versions[-keep:] for p in self.state(v).units.values()}
        for v in versions[:-keep]:
            self._files.remove(f"{self.base}/manifests/{v:08d}.json")
        writes = {p.split("/")[1] for p in used}
        for name in self._files.names(f"{self.base}/data"):
            if name not in writes:
                self._files.remove(f"{self.base}/data/{name}")
                continue
            for unit in self._files.names(f"{self.base}/data/{name}"):
                if unit.startswith(f"{UNIT}=") and f"data/{name}/{unit}" not in used:
                    self._files.remove(f"{self.base}/data/{name}/{unit}")


def merged_schema(former: StructType | None, df: DataFrame) -> StructType:
    """The columns of the former state, then the new ones of ``df``; a column that changes its type is an error."""
    if former is None:
        return StructType([f for f in df.schema.fields])
    known = {f.name: f for f in former.fields}
    for f in df.schema.fields:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise TypeError(f"column {f.name} is {known[f.name].dataType.simpleString()} in the table and {f.dataType.simpleString()} in the rows")
    return StructType([*former.fields, *[f for f in df.schema.fields if f.name not in known]])


# --- partitions -----------------------------------------------------------------------------------


def partition_unit(by: Sequence[Column | str]) -> Column:
    """The unit of a partition: a digest of its values, so that any value makes a folder name; missing values are one."""
    return F.md5(F.to_json(F.array(*[as_col(c).cast("string") for c in by]), {"ignoreNullFields": "false"}))


def replace_partitions(table: SnapshotTable, rows: DataFrame, by: Sequence[str], *, also: DataFrame | None = None) -> State:
    """Swap the partitions that ``rows`` hold, and those of ``also`` (a frame of ``by``), for ``rows`` in one commit.

    A partition of ``also`` without new rows is removed. Other partitions are neither read nor written. The table's first
    call creates it.
    """
    former = table.state()
    unit = partition_unit(by)
    changed = table.write(rows, unit)
    dropped = [] if also is None else [r[0] for r in also.select(partition_unit(by)).distinct().collect()]  # one per partition
    return table.commit(former, changed, merged_schema(former.schema if former else None, rows), dropped=[u for u in dropped if u not in changed])


def read_partitions(table: SnapshotTable, by: Sequence[str], wanted: Sequence[Sequence[object]]) -> DataFrame | None:
    """Rows of the named partitions; only their folders are opened."""
    state = table.state()
    if state is None:
        return None
    schema = StructType([state.schema[c] for c in by])
    units = [r[0] for r in table.spark.createDataFrame([tuple(w) for w in wanted], schema).select(partition_unit(by)).collect()]
    return table.read(state, units)


# --- keyed state in hash buckets ------------------------------------------------------------------


def merge_into_buckets(
    table: SnapshotTable, batch: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], *, buckets: int, notes: Mapping[str, object] | None = None
) -> State:
    """Merge a batch into keyed state of which only the buckets that the batch touches are read and written.

    Keys are dealt to ``buckets`` by hash. ``merge`` gets the stored rows of the touched buckets (column ``_age`` 0) with the
    batch's rows (``_age`` 1) and gives the new rows, ``_bucket`` included; it should group by ``_bucket`` and the keys, which
    needs no shuffle beyond the one that deals the rows to their buckets. The number of buckets is fixed by the first commit.
    """
    former = table.state()
    if former is not None and former.notes.get("buckets") != buckets:
        raise ValueError(f"the table has {former.notes.get('buckets')} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
    new = batch.withColumns({"_age": F.lit(1), BUCKET: bucket})
    touched = [str(r[0]) for r in new.select(BUCKET).distinct().collect()]  # at most one row per bucket
    stored = table.read(former, touched) if former else None
    stacked = new if stored is None else stored.withColumns({"_age": F.lit(0), BUCKET: bucket}).unionByName(new, allowMissingColumns=True)
    out = merge(stacked.repartition(max(1, len(touched)), BUCKET)).drop("_age")
    schema = merged_schema(former.schema if former else None, out.drop(BUCKET))
    changed = table.write(out.withColumnRenamed(BUCKET, UNIT), F.col(UNIT), dealt=True)
    return table.commit(former, changed, schema, notes={**(notes or {}), "buckets": buckets})
