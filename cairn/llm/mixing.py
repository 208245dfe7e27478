"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents form blocks.  In the fluid mix source i has min(weight_i * v, blocks_i) blocks at
virtual time v, so that a source that runs out leaves its share to the others, and slot t is reached when these
add up to t.  A block is released when the fluid mix begins it and due when it has ended it, both in whole
slots; of the released blocks the one with the earliest deadline takes each slot.  This meets every deadline, so
that at any slot each source is less than one block from its exact share, and every document has its place.

This is one rule for any number of sources and blocks, and all of it is sorted, joined and summed as rows.  The slot at
which the fluid mix has k blocks of a source needs what ran out before: sums over all blocks in the order of k / weight.
Earliest deadline first gives each block, in the order of deadlines, the first slot from its release on that no earlier one
has.  Which slots the earliest blocks take together does not depend on their order, so it follows from how many are
released up to each slot.  A round cuts the order of deadlines into WAYS classes, finds the slots of each, and the next one
does the same inside each class, with its own slots only, until a class is one block.

Weights are whole numbers of 2**-40 of their sum.  A document's rank in its source comes from the MD5 of its id: sources are
cut into bins of that hash, counts of bins give offsets, and only rows of one bin are sorted together, so that a source with a
third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import scanned, staged, unstage

BIN_ROWS = 4096
#: Weights in whole parts of this.
PARTS = 1 << 40
#: Blocks of a source that one row is exploded to.
FRAME = 1024
#: Classes of deadlines in a round, and slots whose sums are taken in one task.
WAYS = 16
CHUNK = 1 << 14


def source_key(column: str = "source"):
    """A string that tells a null source from every other."""
    return F.to_json(F.array(F.col(column).cast("string")))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), source_key().alias("key"), *more)
    return rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def _weighed(sizes: DataFrame, weights: DataFrame | None, exponent: float) -> DataFrame:
    """(key, n, weight) of the sources with a positive weight."""
    if weights is None:
        return sizes.withColumn("weight", F.pow("n", F.lit(exponent)))
    given = weights.select(source_key().alias("key"), F.col("weight").cast("double").alias("weight"))
    return sizes.join(given.groupBy("key").agg(F.sum("weight").alias("weight")), "key").where("weight > 0")


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows with their rank by hash in their source."""
    bits = min(24, max(4, (total // BIN_ROWS).bit_length()))
    rows = rows.withColumn("bin", F.shiftright(F.conv(F.substring("hash", 1, 6), 16, 10).cast("int"), 24 - bits))
    bins = rows.groupBy("key", "bin").agg(F.count("*").alias("in_bin"))
    bins = bins.select("key", "bin", (F.sum("in_bin").over(Window.partitionBy("key").orderBy("bin")) - F.col("in_bin")).alias("before"))
    bins = staged(bins, "mix-bins")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "bin").orderBy("hash", "doc_id")))
    return ranked.join(bins, ["key", "bin"]).withColumn("rank", F.col("before") + F.col("nth") - 1)


def _quotient(a: str, b: str, names: list[str]) -> list[str]:
    """SQL of five whole numbers that sort as a / b does, exactly, for 0 <= a < 2**41 and 0 < b <= 2**40: its parts by powers of 2**22."""
    out, rest = [f"{a} div {b} AS {names[0]}"], f"({a} % {b})"
    for name in names[1:]:  # two different quotients differ by 2**-80 at least
        out.append(f"{rest} * {1 << 22} div {b} AS {name}")
        rest = f"({rest} * {1 << 22} % {b})"
    return out


def _windows(sources: DataFrame, shares: int) -> DataFrame:
    """(key, block, release, deadline, number) of all blocks of sources (key, share, blocks), numbered by deadline; shares is their sum.

    Of equal deadlines that of the source which would run out first comes first, then that of the smaller key.
    """
    marks = sources.selectExpr("*", f"explode(sequence(1L, blocks, {FRAME}L)) AS begin").repartition("key", "begin")
    marks = marks.selectExpr("key", "share", "blocks", f"explode(sequence(begin, least(begin + {FRAME - 1}, blocks))) AS k")
    at = [f"at{i}" for i in range(5)]
    marks = marks.selectExpr("*", *_quotient("k", "share", at), "if(k = blocks, blocks, 0L) AS ended", "if(k = blocks, share, 0L) AS idle")
    marks = scanned(marks, [*at, "key", "k"], ["ended", "idle"], "mix-marks")
    # ended_before + k * active / share in two steps, each within 64 bits for k up to 2**42
    marks = marks.selectExpr("key", "share", "blocks", "k", "ended_before", f"{shares}L - idle_before AS active")
    marks = marks.selectExpr("key", "share", "blocks", "k", "ended_before + k * (active div share) AS whole", "active % share AS more", "shiftright(k, 20) * (active % share) AS high")
    marks = marks.selectExpr("key", "share", "blocks", "k", f"whole + (high div share) * {1 << 20} AS whole", f"high % share * {1 << 20} + k % {1 << 20} * more AS rest")
    begins, ends = "struct(k AS block, whole + rest div share AS release, bigint(null) AS deadline)", "struct(k - 1 AS block, bigint(null) AS release, whole + (rest + share - 1) div share AS deadline)"
    both = marks.selectExpr("key", "share", "blocks", f"inline(array({begins}, {ends}))").where("block < blocks")
    both = both.groupBy("key", "block", "share", "blocks").agg(F.expr("coalesce(max(release), 0L) AS release"), F.expr("max(deadline) AS deadline"))
    both = both.selectExpr("key", "block", "release", "deadline", *_quotient("blocks", "share", at))
    return scanned(both, ["deadline", *at, "key"], [], "mix-due").drop(*at)


def _first_free(jobs: DataFrame, n: int) -> DataFrame:
    """(number, slot) of n jobs (number, release), from 0: in the order of numbers each takes the first slot from its release on that is free.

    All slots below n are taken.  A band of jobs with consecutive numbers has as many slots; `at` counts the slots of the band before
    a job's release, or before a slot.
    """
    size = 1
    while size < n:
        size *= WAYS
    jobs = jobs.selectExpr("number", "release AS at")
    slots = jobs.selectExpr("0L AS band", "number AS at", "number AS slot")
    old: list[DataFrame] = []
    ways = range(WAYS - 1)  # c0, c1, ...: of the first classes, jobs released up to a slot, less the slots of the band before it
    here, chunks = "OVER (PARTITION BY band, chunk ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND {})", "OVER (PARTITION BY band ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto, earlier = here.format("CURRENT ROW"), here.format("1 PRECEDING")
    while size > 1:
        size, unit = size // WAYS, size
        own = jobs.selectExpr("number", "at", f"number div {unit} AS band", f"int(number % {unit} div {size}) AS way")
        counts = own.groupBy("band", "at").agg(*(F.expr(f"count_if(way <= {i}) AS n{i}") for i in ways))
        rows = slots.join(counts, ["band", "at"], "left").selectExpr("band", "at", "slot", f"at div {CHUNK} AS chunk", *(f"coalesce(n{i}, 0L) AS n{i}" for i in ways))
        rows = rows.selectExpr("band", "at", "slot", "chunk", *(f"sum(n{i}) {upto} - at AS c{i}" for i in ways))
        if unit > CHUNK:  # what the chunks before add, a row for each
            sums = rows.groupBy("band", "chunk").agg(*(F.expr(f"max_by(c{i} + at, at) AS n{i}") for i in ways))
            sums = sums.selectExpr("band", "chunk", *(f"coalesce(sum(n{i}) {chunks}, 0L) AS n{i}" for i in ways))
            rows = staged(rows.join(sums, ["band", "chunk"]).selectExpr("band", "at", "slot", "chunk", *(f"c{i} + n{i} AS c{i}" for i in ways)), "mix-sums")
            old.append(rows)
            lows = rows.groupBy("band", "chunk").agg(*(F.expr(f"min(c{i}) AS low{i}") for i in ways))
            rows = rows.join(lows.selectExpr("band", "chunk", *(f"min(low{i}) {chunks} AS low{i}" for i in ways)), ["band", "chunk"])
        # taken: slots of the first classes before this one, which is theirs too if more jobs are released by then
        low = (lambda i: f", low{i}") if unit > CHUNK else (lambda i: "")
        rows = rows.selectExpr("band", "at", "slot", *(f"c{i} + at AS n{i}" for i in ways), *(f"at - 1 + least(1L, min(c{i}) {earlier}{low(i)}) AS taken{i}" for i in ways))
        way = "CASE " + " ".join(f"WHEN n{i} > taken{i} THEN {i}" for i in ways) + f" ELSE {WAYS - 1} END AS way"
        before = f"array(taken0, {', '.join(f'taken{i} - taken{i - 1}' for i in ways[1:])}, at - taken{WAYS - 2}) AS before"
        rows = staged(rows.selectExpr("band", "at", "slot", way, before), "mix-round")
        if size > 1:
            jobs = staged(own.join(rows.select("band", "at", "before"), ["band", "at"]).selectExpr("number", "before[way] AS at"), "mix-jobs")
        unstage(*old)
        old = [rows, jobs] if size > 1 else [rows]
        slots = rows.selectExpr(f"band * {WAYS} + way AS band", "before[way] AS at", "slot")
    return slots.selectExpr("band AS number", "slot")


def schedule(weighed: DataFrame, block_docs: int) -> DataFrame:
    """(key, block, release, deadline, slot) of all blocks from (key, n, weight)."""
    scale = 2.0 ** min(1000, 60 - math.frexp(weighed.agg(F.max("weight")).first()[0] or 1.0)[1])
    # a sum of whole numbers is the same in every run
    total = float(weighed.agg(F.sum(F.floor(F.col("weight") * scale).cast("decimal(38,0)"))).first()[0] or 1)
    share = F.greatest(F.lit(1).cast("long"), F.round(F.col("weight") * scale / total * PARTS).cast("long"))
    sources = staged(weighed.select("key", share.alias("share"), F.expr(f"(n + {block_docs - 1}) div {block_docs} AS blocks")), "mix-sources")
    shares, n = sources.agg(F.sum("share"), F.sum("blocks")).first()
    windows = staged(_windows(sources, shares or 0), "mix-windows")
    return windows.join(_first_free(windows, n or 0), "number").select("key", "block", "release", "deadline", "slot")


def exact_order(docs: DataFrame, weights: DataFrame | None = None, *, exponent: float = 0.9, block_docs: int = 16, most_sources: int | None = None, most_blocks: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source): where the mix places it.

    Columns: doc_id, source, block (its number within the source), release, deadline, slot, place (within
    the block), kept, and row: all columns of docs.  Target weights are given (source, weight) or a power of
    each source's size.  Every document of a source with a positive weight is kept, others get no slot.  Blocks
    have block_docs documents or, if most_blocks is given, what it takes to have no more.  most_sources is left from a
    schedule that had another way for many sources, and changes nothing.  A null source is a source of its own.  A null id
    counts as an empty text; rows that share an id are neighbours in no defined order.  Texts are not read.  No row gives no row.
    """
    rows = _keyed(docs, F.struct(*docs.columns).alias("row"))
    sizes = staged(_keyed(docs).groupBy("key").agg(F.count("*").alias("n")), "mix-sizes")
    weighed = staged(_weighed(sizes, weights, exponent), "mix-weights")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if most_blocks:
        block_docs = max(block_docs, -(-total // most_blocks))
    slots = staged(schedule(weighed, block_docs), "mix-schedule")
    ranked = _ranked(rows, total).withColumn("block", F.floor(F.col("rank") / block_docs))
    unstage(sizes, weighed)
    placed = ranked.join(slots, ["key", "block"], "left")
    return placed.select("doc_id", "source", "block", "release", "deadline", "slot", (F.col("rank") % block_docs).cast("long").alias("place"), F.col("slot").isNotNull().alias("kept"), "row")
