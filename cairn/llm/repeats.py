"""Repeated spans by compaction of a de Bruijn graph over words.

Windows of `window` words are the edges of a de Bruijn graph.  An edge that starts at two or more places
is repeated, and each word under a repeated edge goes.

1. The edges of a document are cut into chunks, maximal runs whose windows share one minimizer (the
   first of the smallest hashed `anchor`-word runs in the window).  Equal windows have equal minimizers, so
   only chunks under a minimizer that occurs twice can hold a repeated edge: one aggregation and one
   semi-join leave the candidates.
2. Chunks with equal words form a class.  Chunk classes of two or more members are paths of repeated
   edges.  Their members are compacted: a chunk is joined to the next one of its document if that
   step is nonbranching, that is, each member of the one class goes on with the other class and the other way
   round; a path's members are spans of source coordinates.
3. Paths are verified at their source coordinates: each span's words are digested from the source text,
   and a span whose digest no second member of its path has is dropped.
4. Under minimizers with several classes, windows of one member of each class are compared one by
   one, by digests of their words read at their source coordinates, which finds what chunks share in
   part, at the ends of repeated spans.

Nothing is quadratic in the number of copies: classes and windows are counted, never paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import U64, Rolling, WordHashes, as_long, document_groups, mixed, staged, unstage, word_hashes

def _first_least(x: np.ndarray, size: int) -> np.ndarray:
    """Place of the first least value of each run of `size` values."""
    value, place, have = x, np.arange(len(x)), 1
    n = len(x) - size + 1
    while have < size:
        step = min(have, size - have)
        later = value[step:] < value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        value, have = x[place], have + step
    return place[:n]


def _chunker(window: int, anchor: int):
    """Rows (row, start, n_windows, anchor hash, 128-bit hash of the chunk's words)."""

    def chunks(batches):
        seen = WordHashes()
        for rows, texts in document_groups(batches):
            words, at = word_hashes(texts, seen, lower=False)
            if len(words) < window:
                continue
            small = Rolling(words).windows(anchor)
            least = _first_least(small, window - anchor + 1)
            doc = np.repeat(np.arange(len(texts)), np.diff(at))
            starts = np.flatnonzero(np.arange(len(least)) + window <= at[1:][doc[: len(least)]])
            if not len(starts):
                continue
            place = least[starts]
            own = doc[starts]
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
            count = np.diff(np.append(first, len(starts)))
            begin = starts[first]
            end = begin + count + window - 1
            c1 = Rolling(words).spans(begin, end)
            c2 = Rolling(mixed(words, 5)).spans(begin, end)
            which = pa.array(own[first])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(which), pa.array((begin - at[own[first]]).astype(np.int32)), pa.array(count.astype(np.int32)), as_long(small[place[first]]), as_long(c1), as_long(c2)], ["row", "start", "n", "anchor", "c1", "c2"])

    return chunks


def _prober(window: int):
    """From (row, text, chunks: list of (start, n, single), spans: list of (path, start, end)) rows (row, path,
    start, end, single, h1, h2): for each window of a chunk, without a path, and for each span the digest of its
    words as they stand in the text."""

    def probe(batches):
        for rows, texts in document_groups(batches):
            of, path, start, end, single, digest = [], [], [], [], [], []
            for i, (t, chunks, spans) in enumerate(zip(texts, rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                words = t.split()
                asked = [(None, k, k + window, c["single"]) for c in chunks or () for k in range(c["start"], c["start"] + c["n"])]
                asked += [(s["path"], s["start"], s["end"], False) for s in spans or ()]
                of += [i] * len(asked)
                for p, a, b, alone in asked:
                    path.append(p)
                    start.append(a)
                    end.append(b)
                    single.append(alone)
                    digest.append(hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest())
            digests = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            columns = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(path, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(single, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(d)) for d in digests.T)], ["row", "path", "start", "end", "single", "h1", "h2"])

    return probe


def _remover(batches):
    """From (doc_id, text, spans): what is left without the words under the spans."""
    for rows, texts in document_groups(batches):
        total, gone, digest = [], [], []
        for t, spans in zip(texts, rows.column(2).to_pylist(), strict=True):
            words = (t or b"").split()
            total.append(len(words))
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["start"] : s["end"]] = False
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            gone.append(total[-1] - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, *, window: int = 35, anchor: int = 8) -> DataFrame:
    """(row, start, end) of word spans under repeated windows, from docs (row long, text); spans may overlap."""
    chunks = staged(docs.select("row", "text").mapInArrow(_chunker(window, anchor), "row long, start int, n int, anchor long, c1 long, c2 long"), "repeat-chunks")
    twice = staged(chunks.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "repeat-anchors")
    found = staged(chunks.join(twice, "anchor", "left_semi"), "repeat-candidates")
    unstage(chunks, twice)
    key = ["anchor", "c1", "c2"]
    classes = staged(found.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "n")).alias("at")), "repeat-classes")

    # compaction: members of repeated chunk classes and what comes before and after each
    many = staged(classes.where("times > 1").select(*key, F.xxhash64(*key).alias("chunk"), "times"), "repeat-many")
    members = found.join(many, key).select("row", "start", "n", "chunk", "times")
    here = Window.partitionBy("row").orderBy("start")
    after, before = F.lead(F.struct("start", "chunk")).over(here), F.lag(F.struct((F.col("start") + F.col("n")).alias("end"), "chunk")).over(here)
    members = members.select("*", after.alias("a"), before.alias("b"))
    members = members.select("row", "start", "n", "chunk", "times", F.when(F.col("a.start") == F.col("start") + F.col("n"), F.col("a.chunk")).alias("next"), F.when(F.col("b.end") == F.col("start"), F.col("b.chunk")).alias("prev"))
    members = staged(members, "repeat-members")
    one_way = lambda c: (F.count(c) == F.first("times")) & (F.min(c) == F.max(c))
    ways = staged(members.groupBy("chunk").agg(F.when(one_way("next"), F.min("next")).alias("only_next"), F.when(one_way("prev"), F.min("prev")).alias("only_prev")), "repeat-ways")
    linear = staged(ways.select(F.col("chunk").alias("prev"), F.col("only_next").alias("chunk")).join(ways.select("chunk", F.col("only_prev").alias("prev")), ["chunk", "prev"]).select("chunk"), "repeat-linear")
    heads = members.join(linear.withColumn("inner", F.lit(True)), "chunk", "left").withColumn("head", F.col("inner").isNull())
    path = F.last(F.when(F.col("head"), F.col("chunk")), ignorenulls=True).over(here)
    number = F.sum(F.col("head").cast("int")).over(here)
    paths = heads.select("row", "start", "n", path.alias("path"), number.alias("number")).groupBy("row", "number").agg(F.first("path").alias("path"), F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + (window - 1)).alias("end"))
    paths = staged(paths.select("row", "path", "start", "end"), "repeat-paths")
    unstage(members, ways, linear, many, found)

    # windows shared by different classes under one minimizer
    several = staged(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor"), "repeat-several")
    probes = classes.join(several, "anchor", "left_semi").select(F.col("at.row").alias("row"), F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), (F.col("times") == 1).alias("single")).alias("chunk"))
    probes = probes.groupBy("row").agg(F.collect_list("chunk").alias("chunks"))
    spans = paths.groupBy("row").agg(F.collect_list(F.struct("path", "start", "end")).alias("spans"))
    asked = staged(probes.join(spans, "row", "full"), "repeat-asked")
    text = docs.select("row", "text").join(asked, "row").select("row", "text", "chunks", "spans")
    probed = staged(text.mapInArrow(_prober(window), "row long, path long, start int, end int, single boolean, h1 long, h2 long"), "repeat-probed")
    unstage(classes, several, paths, asked)
    windows, read = probed.where("path is null"), probed.where("path is not null")
    shared = staged(windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.max("single").alias("single")).where("times > 1 and single").select("h1", "h2"), "repeat-shared")
    same = staged(read.groupBy("path", "h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("path", "h1", "h2"), "repeat-same")
    edges = windows.where("single").join(shared, ["h1", "h2"], "left_semi").select("row", "start", "end")
    verified = read.join(same, ["path", "h1", "h2"], "left_semi").select("row", "start", "end")
    spans = staged(verified.union(edges), "repeat-spans")
    unstage(probed, shared, same)
    return spans


def remove_repeats(docs: DataFrame, *, window: int = 35, anchor: int = 8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Words are runs of other characters than the six ASCII white-space ones; a null text has none.  Rows
    are told apart by their place in the input, so that repeated rows, or a null or repeated doc_id, are
    ordinary documents that repeat each other.  Texts shorter than a window lose nothing; a text of any length,
    up to 2**31 words, is judged whole.  No row gives no row.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    spans = repeated_spans(docs, window=window, anchor=anchor)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(listed, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remover, "doc_id long, n_words long, n_removed long, kept_sha256 string")
