"""Several tables that change together: versions as Parquet folders, and one record for each commit that names them all.

A commit writes its rows to new folders and then one small record, by a rename that fails if the record is there already.
Readers see the tables of one record, so all of a commit or nothing of it.  A commit either replaces all rows or adds a
layer: rows for some keys, which hide what earlier layers have for these keys.  So a change of a few documents writes the rows
of these documents only; `compact` turns the layers into one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session; a temporary one only in plain local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cairn-store-"))


def kept_rows(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once in the shared folder and read from there."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Table:
    """keys: columns of which each holds a key, so that a row is hidden by a later layer with any of its keys.

    unique: columns that tell rows apart; a later row hides earlier ones with the same values, and a commit with
    two equal ones, or nulls in them, is refused.
    """

    keys: tuple[str, ...]
    unique: tuple[str, ...] = ()


class ConstraintError(ValueError):
    """Rows that a constraint of a table forbids; nothing was committed."""


class ConflictError(RuntimeError):
    """Another commit came first; nothing was committed."""


@dataclass
class _Record:
    number: int = 0
    layers: list[dict] = field(default_factory=list)
    facts: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)


class Store:
    """Tables under a folder.  `facts` are small figures that a commit keeps beside its tables."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ records

    def records(self) -> list[int]:
        root = self._path(f"{self.folder}/commits")
        names = [PurePosixPath(x.getPath().toString()).name for x in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def record(self, number: int | None = None) -> _Record:
        """The record of a commit, by default of the last; an empty one before the first."""
        numbers = self.records()
        if number is None and not numbers:
            return _Record()
        stream = self.fs.open(self._path(f"{self.folder}/commits/{numbers[-1] if number is None else number:08d}"))
        try:
            return _Record(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.records())

    def _publish(self, new: _Record) -> None:
        part, whole = (self._path(f"{self.folder}/commits/{n}") for n in (f"_{uuid.uuid4().hex}", f"{new.number:08d}"))
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, whole, options)
        except Exception as e:
            self.fs.delete(part, False)
            if self.fs.exists(whole):
                raise ConflictError(f"commit {new.number} is there already") from e
            raise

    # ------------------------------------------------------------ reading

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """The live rows of a table, or those of an earlier commit; None before its first rows."""
        record = self.record(number)
        parts = self.layers(name, record)
        if not parts:
            return None
        columns = parts[-1][1].columns
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._live(name, i, rows, record) for i, rows in parts]).select(*columns)

    def layers(self, name: str, record: _Record | None = None) -> list[tuple[int, DataFrame]]:
        """(number of the layer, its own rows) of a table, oldest first; later ones may hide some of the rows."""
        record = record or self.record()
        found = [(i, x["tables"][name]) for i, x in enumerate(record.layers) if name in x["tables"]]
        return [(i, self.spark.read.schema(record.fields[name]).parquet(path)) for i, path in found]

    def later_keys(self, layer: int, record: _Record | None = None) -> DataFrame | None:
        """(key) of all layers after this one: what they hide."""
        paths = [x["keys"] for x in (record or self.record()).layers[layer + 1 :] if x["keys"]]
        return self.spark.read.schema("key string").parquet(*paths).distinct() if paths else None

    def _live(self, name: str, layer: int, rows: DataFrame, record: _Record) -> DataFrame:
        hidden = self.later_keys(layer, record)
        if hidden is not None:
            for c in self.tables[name].keys:
                rows = rows.join(hidden.withColumnRenamed("key", c), c, "left_anti")
        unique = list(self.tables[name].unique)
        later = [x for i, x in self.layers(name, record) if i > layer]
        if unique and later:
            rows = rows.join(reduce(DataFrame.unionByName, [x.select(*unique) for x in later]).distinct(), unique, "left_anti")
        return rows

    # ------------------------------------------------------------ writing

    def _checked(self, name: str, path: str, schema) -> None:
        unique = list(self.tables[name].unique)
        if not unique:
            return
        rows = self.spark.read.schema(schema).parquet(path)
        bad = rows.groupBy(*unique).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *(f"`{c}` is null" for c in unique)]))
        some = [tuple(r[c] for c in unique) for r in bad.limit(5).collect()]
        if some:
            raise ConstraintError(f"{name} has rows that are not unique or have nulls in {', '.join(unique)}, such as {some}")

    def commit(self, rows: dict[str, DataFrame | Callable], keys: DataFrame | None = None, facts: dict | Callable | None = None, check=None, since: int | None = None) -> int:
        """Write tables as the new state, or as a layer for keys (one column); its number.

        Rows and facts may be functions of the tables (name -> rows) that this commit has written before.  Keys without rows are
        deletions.  check of the written tables may raise to refuse the commit.  If anything fails, what was written
        goes and the old state stays.  since is the number of the commit that the rows were made from: a commit that came
        between is a conflict.
        """
        old = self.record()
        if since is not None and since != old.number:
            raise ConflictError(f"commit {old.number} came after {since}")
        paths: dict[str, str] = {}
        written: dict[str, DataFrame] = {}
        try:
            for name, df in rows.items():
                paths[name] = f"{self.folder}/{name}/{uuid.uuid4().hex}"
                df = df if isinstance(df, DataFrame) else df(written)
                df.write.parquet(paths[name])
                self._checked(name, paths[name], df.schema)
                written[name] = self.spark.read.schema(df.schema).parquet(paths[name])
            if check:
                check(written)
            facts = facts(written) if callable(facts) else facts
            if keys is not None:
                paths["_keys"] = f"{self.folder}/_keys/{uuid.uuid4().hex}"
                keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key is not null").distinct().write.parquet(paths["_keys"])
            layer = {"tables": {n: p for n, p in paths.items() if n != "_keys"}, "keys": paths.get("_keys")}
            fields = old.fields | {n: _ddl(df) for n, df in written.items()}
            self._publish(_Record(old.number + 1, [layer] if keys is None else [*old.layers, layer], old.facts | (facts or {}) if keys is not None else facts or {}, fields))
        except BaseException:
            for p in paths.values():
                self.fs.delete(self._path(p), True)
            raise
        self._vacuum()
        return old.number + 1

    def compact(self) -> int:
        """One layer in place of all; the same rows."""
        old = self.record()
        return self.commit({name: self.read(name) for name in old.fields}, facts=old.facts, since=old.number)

    def rollback(self) -> int:
        """The state before the last commit, as a new commit."""
        numbers = self.records()
        if len(numbers) < 2:
            raise ConflictError("there is no earlier state")
        before = self.record(numbers[-2])
        self._publish(_Record(numbers[-1] + 1, before.layers, before.facts, before.fields))
        self._vacuum()
        return numbers[-1] + 1

    def _vacuum(self) -> None:
        """Remove records before the last two, and folders that neither of these names."""
        numbers = self.records()
        used = {p for n in numbers[-2:] for x in self.record(n).layers for p in [*x["tables"].values(), x["keys"]] if p}
        gone = {p for n in numbers[:-2] for x in self.record(n).layers for p in [*x["tables"].values(), x["keys"]] if p} - used
        for n in numbers[:-2]:
            self.fs.delete(self._path(f"{self.folder}/commits/{n:08d}"), False)
        for p in gone:
            self.fs.delete(self._path(p), True)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
