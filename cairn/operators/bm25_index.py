"""A BM25 index as tables: written once, changed by the documents that change, read by its terms only.

Documents lie in pages of PAGE documents of about the same length, each in a slot.  `postings` has a row for each term and
page: the slots, counts and lengths of its documents there, and the largest count and smallest length among them, from
which follows what the page can add to a score at most.  A top-k first scores the pages with the largest bounds, takes the k-th score
found, and then scores those other pages only whose bound reaches it: the same rows as scoring everything.

A change of documents is a layer: their new postings, and what they take from the numbers of documents of each term, which
come from the terms kept with each document.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import ship
from cairn.functions import text as X
from cairn.sources.store import Store, Table

PAGE = 256
#: Share of documents in layers at which an update turns the layers into one, and layers at most.
MOST_CHANGED, MOST_LAYERS = 0.2, 16
#: Pages from which on a top-k leaves out those whose bound is too small; rows are the same either way.
PRUNED_PAGES = 1000
_TABLES = {"documents": Table(("id",), ("id",)), "postings": Table(()), "terms": Table(())}


def counted(docs: DataFrame) -> DataFrame:
    """(id, length, terms, counts, page, slot) of docs (id, text).

    Words are counted in Arrow batches, and documents get their places where they are read, in the order of their lengths,
    so nothing is shuffled.  Places hold once the rows are written.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("id").cast("string").alias("id"), X.tokens(F.col("text")).alias("w"))
    return _placed(rows.mapInArrow(_counts, "id string, length int, terms array<string>, counts array<int>"))


def _counts(batches):
    """(id, length, terms, counts) of rows (id, words)."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        words = batch.column(1).flatten().dictionary_encode()
        n = max(len(words.dictionary), 1)
        pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + words.indices.to_numpy(), return_counts=True)
        doc, code = np.divmod(pairs, n)
        first = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(first, x) for x in (words.dictionary.take(pa.array(code)), pa.array(counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["id", "length", "terms", "counts"])


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the page and slot of each document."""
    ordered = rows.sortWithinPartitions("length", "id").withColumn("_n", F.monotonically_increasing_id())
    return ordered.withColumn("page", F.floor(F.col("_n") / PAGE)).withColumn("slot", (F.col("_n") % PAGE).cast("int")).drop("_n")


def _inverted(batches):
    """Postings of each page, from rows (page, slot, length, terms, counts) in which a page's documents lie together."""
    for batch in batches:
        page = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(page)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            sizes = pc.fill_null(pc.list_value_length(part.column(3)), 0).to_numpy()
            if not sizes.sum():
                continue
            words = part.column(3).flatten().dictionary_encode()
            order = np.argsort(words.indices.to_numpy(), kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))])
            slots, counts, lengths = (x[order] for x in (np.repeat(part.column(1).to_numpy(), sizes), part.column(4).flatten().to_numpy(), np.repeat(part.column(2).to_numpy(), sizes)))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [words.dictionary, pa.array(np.full(len(words.dictionary), page[lo])), lists(slots.astype(np.int16)), lists(counts), lists(lengths), pa.array(np.maximum.reduceat(counts, first[:-1])), pa.array(np.minimum.reduceat(lengths, first[:-1]))],
                ["term", "page", "slots", "counts", "lengths", "most", "least"],
            )


def _postings(documents: DataFrame) -> DataFrame:
    """(term, page, slots, counts, lengths, most, least), a row for each term and page, or two where the page lies in two files' parts.

    A page is turned over where its documents are read, so that nothing is shuffled.
    """
    ship(documents.sparkSession)
    return documents.select("page", "slot", "length", "terms", "counts").mapInArrow(_inverted, "term string, page long, slots array<smallint>, counts array<int>, lengths array<int>, most int, least int")


def _frequencies(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _figures(documents: DataFrame) -> dict:
    r = documents.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    return {"documents": r["n"], "words": r["total"] or 0, "changed": 0}


class Bm25Index:
    """An index of documents (id, text) in a folder; k1 and b belong to the queries, the tables hold for all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder, _TABLES)
        self.spark = spark

    def exists(self) -> bool:
        return self.store.exists()

    def build(self, docs: DataFrame) -> Bm25Index:
        """Index docs in place of all that was there.  A null text counts as empty; ids are unique and not null."""
        return self._made_of(counted(docs))

    def _made_of(self, documents: DataFrame, since: int | None = None) -> Bm25Index:
        tables = {"documents": documents, "postings": lambda made: _postings(made["documents"]), "terms": lambda made: _frequencies(made["documents"])}
        self.store.commit(tables, facts=lambda made: _figures(made["documents"]), since=since)
        return self

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> Bm25Index:
        """Put in docs (id, text) in place of those with their ids, and take out gone (id).  Writes rows of these documents only."""
        since = self.store.record()
        if not since.layers:
            return self.build(docs)
        keys = docs.select(F.col("id").cast("string"))
        keys = (keys if gone is None else keys.union(gone.select(F.col("id").cast("string")))).distinct()
        before = self.store.read("documents", since.number).join(keys, "id", "left_semi")

        def terms(made: dict) -> DataFrame:
            """How many documents more or fewer each term has."""
            fewer = _frequencies(before).select("term", (-F.col("df")).alias("df"))
            return _frequencies(made["documents"]).unionByName(fewer).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")

        def facts(made: dict) -> dict:
            old, new = _figures(before), _figures(made["documents"])
            known = since.facts
            return {"documents": known["documents"] + new["documents"] - old["documents"], "words": known["words"] + new["words"] - old["words"], "changed": known["changed"] + new["documents"] + old["documents"]}

        self.store.commit({"documents": counted(docs), "postings": lambda made: _postings(made["documents"]), "terms": terms}, keys, facts, since=since.number)
        now = self.store.record()
        if len(now.layers) > MOST_LAYERS or now.facts["changed"] > MOST_CHANGED * max(now.facts["documents"], 1):
            self.compact()
        return self

    def compact(self) -> Bm25Index:
        """One layer in place of all, from the words kept with the documents."""
        record = self.store.record()
        return self._made_of(_placed(self.store.read("documents", record.number).drop("page", "slot")), record.number)

    # ------------------------------------------------------------ queries

    def _of_layers(self, record, name: str) -> DataFrame:
        """All rows of a table with their layer, whether a later one hides them or not."""
        return reduce(DataFrame.unionByName, [rows.withColumn("layer", F.lit(i)) for i, rows in self.store.layers(name, record)])

    def _hidden(self, record) -> DataFrame | None:
        """(layer, page, slot) of documents that a later layer has or took out."""
        parts = []
        for i, rows in self.store.layers("documents", record):
            later = self.store.later_keys(i, record)
            if later is not None:
                parts.append(rows.join(later.withColumnRenamed("key", "id"), "id", "left_semi").select(F.lit(i).alias("layer"), "page", "slot"))
        return reduce(DataFrame.union, parts) if parts else None

    def top_k(self, queries: DataFrame, k: int = 25, k1: float = 1.5, b: float = 0.75, within: DataFrame | None = None, prune: bool | None = None) -> DataFrame:
        """(query, id, score, nth) of the k best documents for each of queries (query, text), ties by id.

        within (id) are the only documents that may be found; numbers of documents and mean lengths are those of the whole index
        all the same.  Without a common term nothing is found.
        """
        record = self.store.record()
        n_docs = record.facts["documents"]
        mean = max(record.facts["words"] / n_docs if n_docs else 0.0, 1e-9)
        asked = queries.select(F.col("query"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
        df = self.store.read("terms", record.number).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        number = F.row_number().over(Window.orderBy("query"))  # of the queries, which are few
        numbers = queries.select("query").distinct().select("query", number.alias("nr"))
        terms = asked.join(df.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "term").join(numbers, "query").select("nr", "term", "idf")
        lists = terms.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_set("nr").alias("asked"))
        shown, hidden = self._of_layers(record, "postings"), self._hidden(record)
        places = self._of_layers(record, "documents").select("layer", "page", "slot", "id")
        allowed = None if within is None else places.join(within.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").drop("id")
        place = ["layer", "page", "slot"]

        def part(count: Column, length: Column) -> Column:
            return F.col("idf") * count * (k1 + 1) / (count + k1 * (1 - b + b * length / F.lit(mean)))

        def best(rows: DataFrame) -> DataFrame:
            """(nr, layer, page, slot, score) of rows of postings with idf and asked: the k best, with all that are level with the last."""
            empty = lambda kind: F.array().cast(f"array<{kind}>")
            parts = [rows.select("layer", "page", F.lit(_POSTINGS).alias("kind"), "idf", "asked", "slots", "counts", "lengths")]
            for kind, some in ((_ALLOWED, allowed), (_HIDDEN, hidden)):
                if some is not None:
                    slots = some.groupBy("layer", "page").agg(F.collect_set(F.col("slot").cast("smallint")).alias("slots"))
                    parts.append(slots.select("layer", "page", F.lit(kind).alias("kind"), F.lit(0.0).alias("idf"), empty("int").alias("asked"), "slots", empty("int").alias("counts"), empty("int").alias("lengths")))
            together = reduce(DataFrame.union, parts).repartition("layer", "page").sortWithinPartitions("layer", "page")
            ship(self.spark)
            scores = together.mapInArrow(_page_scores(k, k1, b, mean, allowed is not None), "nr int, layer int, page long, slot int, score double")
            scores = scores.withColumn("score", F.round("score", 9))
            return scores.withColumn("r", F.rank().over(Window.partitionBy("nr").orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r")

        if not (n_docs > PAGE * PRUNED_PAGES if prune is None else prune):
            found = best(shown.join(lists, "term"))
        else:
            # what each page can have at most, from the small columns
            bounds = shown.select("term", "layer", "page", "most", "least").join(terms, "term").groupBy("nr", "layer", "page").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))
            nth = F.row_number().over(Window.partitionBy("nr").orderBy(F.desc("bound"), "layer", "page"))
            first = bounds.withColumn("place", nth).where(F.col("place") <= max(2, -(-4 * k // PAGE)))
            sure = best(self._of_pages(shown, lists, first.select("layer", "page")))
            least = sure.groupBy("nr").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            rest = bounds.join(least, "nr", "left").where("bound + 1e-6 >= coalesce(least, 0)")
            found = best(self._of_pages(shown, lists, rest.select("layer", "page")))
        named = found.join(places, place).join(numbers, "nr").select("query", "id", "score")
        return named.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k)

    @staticmethod
    def _of_pages(shown: DataFrame, lists: DataFrame, pages: DataFrame) -> DataFrame:
        return shown.join(lists, "term").join(pages.distinct(), ["layer", "page"], "left_semi")


#: Rows of a page: its postings, and the slots that may be found, or not.
_POSTINGS, _ALLOWED, _HIDDEN = 0, 1, 2
#: Rows that a task holds before it drops those that are not among its best, and how far scores may lie apart that are equal once rounded.
HELD, LEVEL = 1 << 18, 4e-9


def _page_scores(k: int, k1: float, b: float, mean: float, only_allowed: bool):
    """A function from rows of pages, each page's together, to (nr, layer, page, slot, score): of each query those that may be among
    the k best of the task, so that what is shuffled after it does not grow with the documents."""

    def run(batches):
        held: list[tuple] = []
        least: dict[int, float] = {}

        def scores_of(key: tuple, rows: list[tuple]):
            postings = [r for r in rows if r[0] == _POSTINGS]
            if not postings:
                return
            width = 1 + max(int(r[3].max()) for r in rows if len(r[3]))
            may = np.full(width, not only_allowed)
            for kind, value in ((_ALLOWED, True), (_HIDDEN, False)):
                for r in rows:
                    if r[0] == kind:
                        may[r[3]] = value
            asked = np.unique(np.concatenate([r[2] for r in postings]))
            sums = np.zeros((len(asked), width))
            for _, idf, numbers, slots, counts, lengths in postings:
                sums[np.ix_(np.searchsorted(asked, numbers), slots)] += idf * counts * (k1 + 1) / (counts + k1 * (1 - b + b * lengths / mean))
            bar = np.array([least.get(n, 0.0) for n in asked.tolist()])
            i, slot = np.nonzero((sums > 0) & (sums >= bar[:, None] - LEVEL) & may[None, :])
            if len(i):
                held.append((asked[i], np.full(len(i), key[0]), np.full(len(i), key[1]), slot, sums[i, slot]))

        def best():
            """The held rows that may be among the best; sets the bar of each query."""
            nr, layer, page, slot, score = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((-score, nr))
            nr, score = nr[order], score[order]
            start = np.flatnonzero(np.concatenate([[True], nr[1:] != nr[:-1]]))
            size = np.diff(np.append(start, len(nr)))
            bar = np.where(size >= k, score[np.minimum(start + k - 1, len(nr) - 1)], 0.0)
            for n, x in zip(nr[start].tolist(), bar.tolist(), strict=True):
                least[n] = max(x, least.get(n, 0.0))
            keep = score >= np.repeat(bar, size) - LEVEL
            return nr[keep], layer[order][keep], page[order][keep], slot[order][keep], score[keep]

        def batch(columns) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["nr", "layer", "page", "slot", "score"])

        def lists(column):
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            return [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]

        now, rows = None, []
        for some in batches:
            layer, page = some.column(0).to_pylist(), some.column(1).to_pylist()
            parts = zip(some.column(2).to_pylist(), some.column(3).to_pylist(), *(lists(some.column(i)) for i in range(4, 8)), strict=True)
            for key, row in zip(zip(layer, page, strict=True), parts, strict=True):
                if key != now:
                    scores_of(now, rows)
                    now, rows = key, []
                    if sum(len(h[0]) for h in held) > HELD:
                        kept = best()
                        held.clear()
                        if len(kept[0]) > HELD // 2:  # so many are level: they are sorted out later
                            yield batch(kept)
                        else:
                            held.append(kept)
                rows.append(row)
        scores_of(now, rows)
        if held:
            yield batch(best())

    return run


def index_of(spark: SparkSession, base: str, path: str, docs: DataFrame) -> Bm25Index:
    """The index of docs, which come from the file or folder at path: built under base once for each state of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status, size = store.getFileStatus(p), store.getContentSummary(p).getLength()
    state = hashlib.md5(f"{path}|{status.getModificationTime()}|{size}".encode()).hexdigest()
    index = Bm25Index(spark, f"{base}/bm25-{state}")
    return index if index.exists() else index.build(docs)
