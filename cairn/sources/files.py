"""Sources and sinks."""

from __future__ import annotations

import json
import os
import urllib.request
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.schemas import JUDGMENTS

try:
    import yaml
except ImportError:
    yaml = None


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; columns gives their names, else the header does."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGMENTS).option("header", True).option("escape", '"').csv(path)


def read_split_json(spark: SparkSession, path: str, lists: list[str], lines: bool = False) -> DataFrame:
    """Tables in the form {columns, index, data}, all cells as text but for list columns; an import format.

    A file is one such object, or with `lines` each of its lines is one, as write_split_json has them.  Objects may have their
    columns in any order.
    """
    text = spark.read.text(path, wholetext=not lines)
    columns = sorted({c for r in text.select(F.from_json("value", "columns array<string>")["columns"].alias("c")).distinct().collect() for c in r["c"]})  # names only
    parsed = text.select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("o"))
    cell = lambda r, c: F.get(r, (F.array_position("o.columns", F.lit(c)) - 1).cast("int")).alias(c)
    # cells get their names inside the object, so that no row carries the object along
    rows = parsed.select(F.explode(F.transform("o.data", lambda r: F.struct(*(cell(r, c) for c in columns)))).alias("r"))
    named = lambda c: F.col("r").getField(c)
    out = rows.select(*((F.from_json(named(c), "array<string>") if c in lists else named(c)).alias(c) for c in columns))
    first = text.select(F.from_json("value", "columns array<string>")["columns"].alias("c")).first()
    return out.select(*first["c"]) if first else out


def as_split_json(rows: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """One column of texts, each an object {columns, index, data} of up to size rows in key order, index counting on from 0."""
    from cairn.operators.ingest import batches

    columns = rows.columns
    inner = lambda c: F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"})
    cells = [F.substring(inner(c), F.lit(2), F.length(inner(c)) - 2) for c in columns]
    line = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    numbered = batches(rows, key, size).select("batch", F.struct(key, line.alias("line")).alias("x"))
    lists = numbered.groupBy("batch").agg(F.sort_array(F.collect_list("x")).alias("x"))  # size rows at most
    index = F.array_join(F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: (F.col("batch") * size + i).cast("string")), ",")
    names = json.dumps(columns, ensure_ascii=False)
    return lists.orderBy("batch").select(F.concat(F.lit(f'{{"columns":{names},"index":['), index, F.lit('],"data":['), F.array_join("x.line", ","), F.lit("]}")).alias("value"))


def write_split_json(rows: DataFrame, path: str, key: str, size: int = 10_000) -> None:
    """Text files whose lines are objects {columns, index, data}; a table of at most size rows is one object."""
    as_split_json(rows, key, size).write.mode("overwrite").text(path)


#: An item of a Python list of texts; a part of an item, which may be escaped.
_ITEM = r"""(?s)'([^'\\]*+(?:\\.[^'\\]*+)*+)'|"([^"\\]*+(?:\\.[^"\\]*+)*+)\""""
_PART = r"(?s)\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\U[0-9a-f]{8}|\\.|[^\\]++"


def _unescaped(item: Column) -> Column:
    """What a text in Python's form stands for."""

    def part(x: Column) -> Column:
        kind, rest = F.substring(x, 2, 1), lambda n: F.substring(x, 3, n)
        wide = lambda code, form: F.decode(F.unhex(code), form)
        return (
            F.when(~x.startswith("\\"), x)
            .when((kind == "x") & (F.length(x) == 4), wide(F.concat(F.lit("00"), rest(2)), "UTF-16BE"))
            .when((kind == "u") & (F.length(x) == 6), wide(rest(4), "UTF-16BE"))
            .when((kind == "U") & (F.length(x) == 10), wide(rest(8), "UTF-32"))
            .when(kind == "n", F.lit("\n"))
            .when(kind == "t", F.lit("\t"))
            .when(kind == "r", F.lit("\r"))
            .otherwise(kind)
        )

    return F.array_join(F.transform(F.regexp_extract_all(item, F.lit(_PART), F.lit(0)), part), "")


def literal_list(cell: Column) -> Column:
    """The texts of a cell that holds a list as Python writes it; a cell that is no list has none, and items that are no texts drop out."""
    of = lambda i: F.regexp_extract_all(cell, F.lit(_ITEM), F.lit(i))
    items = F.transform(F.arrays_zip(of(1).alias("a"), of(2).alias("b")), lambda x: _unescaped(F.concat(x["a"], x["b"])))
    return F.when(cell.rlike(r"(?s)^\s*\[.*\]\s*\z"), items).otherwise(F.array().cast("array<string>"))


def read_literal_lists(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """CSV whose list cells are Python lists of texts, such as ['a', "it's"]."""
    rows = read_csv(spark, path)
    return rows.withColumns({c: literal_list(F.col(c)) for c in lists})


def _file_status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(p) if store.exists(p) else None


def is_fresh(spark: SparkSession, path: str, now: datetime | None = None) -> bool:
    """Whether a file or table is there and was written today (UTC)."""
    status = _file_status(spark, path)
    today = (now or datetime.now(UTC)).date()
    return status is not None and datetime.fromtimestamp(status.getModificationTime() / 1000, UTC).date() == today


def fresh_table(spark: SparkSession, path: str, make, now: datetime | None = None) -> DataFrame:
    """The table at path if it was written today, else what make() gives, written there."""
    if not is_fresh(spark, path, now):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def downloaded(spark: SparkSession, url: str, path: str, now: datetime | None = None, open_url=urllib.request.urlopen) -> str:
    """path, holding what url gives; a file of today is used again.  The driver copies one export, in pieces."""
    if not is_fresh(spark, path, now):
        store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        part, whole = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.part", path))
        with open_url(url) as source:
            out = store.create(part, True)
            while piece := source.read(1 << 20):
                out.write(bytearray(piece))
            out.close()
        store.delete(whole, False)
        store.rename(part, whole)
    return path


class Reloading:
    """A table that is read again once its folder has been written anew; a missing one is an empty one of the schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.at, self.rows = spark, path, schema, None, None

    def read(self) -> DataFrame:
        status = _file_status(self.spark, self.path)
        at = status.getModificationTime() if status else 0
        if at != self.at:
            self.at = at
            self.rows = self.spark.read.parquet(self.path) if at else self.spark.createDataFrame([], self.schema)
        return self.rows


def settings(text: str, prefix: str = "CAIRN_", environment: dict[str, str] | None = None) -> dict:
    """Settings from YAML text, or JSON where no YAML library is installed; a variable PREFIX_A__B in the environment takes the place
    of a's b."""
    found = yaml.safe_load(text) if yaml else json.loads(text)
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(prefix):
            *path, last = name.removeprefix(prefix).lower().split("__")
            inner = found
            for part in path:
                inner = inner.setdefault(part, {})
            try:
                inner[last] = json.loads(value)
            except ValueError:
                inner[last] = value
    return found


def read_texts(spark: SparkSession, folder: str, allowed: list[str]) -> DataFrame:
    """(name, text) of the allowed Markdown files in a folder."""
    paths = [f"{folder}/{name}.md" for name in allowed]
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.select(F.regexp_replace("file", r"\.md$", "").alias("name"), "text")


class VersionedTable:
    """Parquet versions of a table under a folder, with a pointer to the live one.

    A new version is written beside the live one and becomes live by one rename of the pointer, so that
    readers see the old or the new state, and a failed write changes nothing.  One earlier version stays.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self._path(self.folder)
        if not self.fs.exists(root):
            return []
        names = (PurePosixPath(x.getPath().toString()).name for x in self.fs.listStatus(root))
        return sorted(n for n in names if n.startswith("live-v"))

    def live(self) -> str | None:
        found = self.versions()
        return f"{self.folder}/v{found[-1].removeprefix('live-v')}" if found else None

    def read(self) -> DataFrame | None:
        path = self.live()
        return self.spark.read.parquet(path) if path else None

    def write(self, rows: DataFrame) -> str:
        found = self.versions()
        number = int(found[-1].removeprefix("live-v")) + 1 if found else 1
        path = f"{self.folder}/v{number:08d}"
        rows.write.mode("overwrite").parquet(path)
        self.fs.create(self._path(f"{self.folder}/_pointer"), True).close()
        self.fs.rename(self._path(f"{self.folder}/_pointer"), self._path(f"{self.folder}/live-v{number:08d}"))
        for old in found[:-1]:
            self.fs.delete(self._path(f"{self.folder}/{old}"), False)
            self.fs.delete(self._path(f"{self.folder}/v{old.removeprefix('live-v')}"), True)
        return path


def append_missing(rows: DataFrame, stage: str, key: str) -> DataFrame:
    """Append to a staging table what it lacks, so that an interrupted run goes on where it stopped; the whole stage."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stage)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(stage).select(key), key, "left_anti")
    rows.write.mode("append").parquet(stage)
    return spark.read.parquet(stage)
