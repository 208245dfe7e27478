"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles, a digest of that set and a MinHash signature of
   `coordinates` values; each value is hashed together with its coordinate into one posting key.
   Texts with equal sets collapse to a class before any join, so copies are never paired.
2. Class representatives are posted under their keys.  A link needs `matches` common keys, so a
   representative with fewer keys that occur twice is skipped, and of the others only a prefix is
   posted: all but the `matches - 1` most frequent of its common keys.  Two signatures with
   `matches` equal values meet in at least one prefix key.
3. Each posting list names its most central member (that with the most popular keys), and lists with one
   centre merge into one group, so that a cluster's many lists become one group and no pair with a common
   prefix key is lost.
4. A group of one block is one unit of work, which counts collisions of signatures, confirms what has
   `matches` of them on the full shingle sets, and returns a spanning forest of its links, not the links.
5. In a larger group every member is first compared with the centre alone, block by block.  Members that
   link with it are one component and need no comparing among themselves.  What is left meets only members
   whose distance from the centre differs by no more than a link's: Jaccard distance is a metric, so others
   cannot link.  These are cut by distance and into blocks, and each pair of blocks is a unit as in 4.

No group is capped.  A cluster around its centre costs each member one send; only members that do not link
with it are sent to several units.

The only loss is that of MinHash itself: with the default 40 coordinates and 20 matches a pair at
exactly the threshold of 0.8 is missed with probability 3e-6, a closer one with less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U64, Rolling, WordHashes, connected_components, document_groups, mixed, staged, unstage, word_hashes


def _shingles(words: np.ndarray, at: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    roll = Rolling(words)
    every = roll.windows(size)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield roll.spans(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, U64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    return int(mixed(found, 1).sum(dtype=U64).view(np.int64)), int(mixed(found, 2).sum(dtype=U64).view(np.int64))


def _sketcher(size: int, coordinates: int):
    def sketch(batches):
        seen = WordHashes()
        seeds = mixed(np.arange(coordinates, dtype=U64), 7)
        odd = mixed(np.arange(coordinates, dtype=U64), 8) | U64(1)
        for rows, texts in document_groups(batches):
            counts, d1, d2, keys = [], [], [], []
            for found in _shingles(*word_hashes(texts, seen, lower=True), size):
                counts.append(len(found))
                a, b = _digest(found)
                d1.append(a)
                d2.append(b)
                if len(found):
                    least = np.min([((part[:, None] ^ seeds) * odd).min(axis=0) for part in np.array_split(found, 1 + len(found) // 20_000)], axis=0)
                    keys.append(mixed(least ^ seeds, 9).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            signature = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), signature], ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return sketch


def _set_maker(size: int):
    def sets(batches):
        seen = WordHashes()
        for rows, texts in document_groups(batches):
            found = list(_shingles(*word_hashes(texts, seen, lower=True), size))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([_digest(x)[0] for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["rep", "d1", "shingles"])

    return sets


def _signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    seeds, odd = mixed(np.arange(coordinates, dtype=U64), 7), mixed(np.arange(coordinates, dtype=U64), 8) | U64(1)
    out = np.zeros((len(sets), coordinates), U64)
    for i, found in enumerate(sets):
        out[i] = np.min([((part[:, None] ^ seeds) * odd).min(axis=0) for part in np.array_split(found, 1 + len(found) // 20_000)], axis=0)
    return out


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, as a matrix, from those shingles that occur twice."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    use = times[column] > 1
    which, column = which[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        dense = np.zeros((len(sets), 2048), np.float32)
        dense[which[a:b], column[a:b] - lo] = 1
        out += dense[x] @ dense[y].T
    return out


def _linker(percent: int, coordinates: int, matches: int):
    def star(center, reps, sets):
        """What each member of a block shares with the centre."""
        at = int(np.searchsorted(reps, center))
        others = [i for i in range(len(reps)) if i != at]
        both = np.array([np.isin(sets[i], sets[at], assume_unique=True).sum() for i in others], np.int64)
        sizes = np.array([len(sets[i]) for i in others], np.int64)
        return pa.table({"x": pa.array([center] * len(others), pa.int64()), "y": pa.array(reps[others], pa.int64()), "star": pa.array([True] * len(others), pa.bool_()), "size": pa.array(sizes), "both": pa.array(both), "either": pa.array(sizes + len(sets[at]) - both)})

    def links(key, table):
        """Spanning forest of the links between the two blocks of a unit (or inside its one block)."""
        low, high = key[1].as_py(), key[2].as_py()
        table = table.sort_by("rep")
        reps = table.column("rep").to_numpy()
        if high == STAR:
            return star(key[0].as_py(), reps, [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()])
        block = table.column("block").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        signatures = _signatures(sets, coordinates)
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = np.zeros((len(x), len(y)), np.int16)
        for k in range(coordinates):
            near += signatures[x, k][:, None] == signatures[y, k][None, :]
        likely = (near >= matches) & (100 * np.minimum(sizes[x][:, None], sizes[y][None, :]) >= percent * np.maximum(sizes[x][:, None], sizes[y][None, :]))
        if low == high:
            likely &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(likely)
        if len(i) * 20e-6 < 2e-3 + 2e-8 * sizes.sum() + len(x) * len(y) * sizes.mean() * 1e-10:
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x[i], y[j], strict=True)], np.int64)
        else:
            both = _shared(sets, x, y)[i, j].astype(np.int64)
        good = 100 * both >= percent * (sizes[x[i]] + sizes[y[j]] - both)
        i, j = x[i[good]], y[j[good]]
        label, out = np.arange(len(sets)), []
        for a, own in zip(*(lambda u, at: (u, np.split(j, at[1:])))(*np.unique(i, return_index=True)), strict=True) if len(i) else ():
            labels, first = np.unique(label[own], return_index=True)
            new = labels != label[a]
            if new.any():
                out += [(a, own[k]) for k in first[new]]
                label[np.isin(label, labels)] = label[a]
        none = pa.nulls(len(out), pa.int64())
        return pa.table({"x": pa.array([int(reps[a]) for a, _ in out], pa.int64()), "y": pa.array([int(reps[b]) for _, b in out], pa.int64()), "star": pa.array([False] * len(out), pa.bool_()), "size": none, "both": none, "either": none})

    return links


#: Members and shingles of a block at most, on average over the blocks of a group.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Stands for the other block in a unit of a block and the centre.
STAR = -1
#: Distances from the centre are cut into so many cells.
CELLS = 20


def _blocks():
    return F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def _first_units(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(center, low, high, rep, block): groups of one block, and each block of a larger one with the centre."""
    placed = members.join(sizes, "center")
    zero = F.lit(0).cast("long")
    small = placed.where("blocks = 1").select("center", zero.alias("low"), zero.alias("high"), "rep", zero.alias("block"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long").alias("block")
    spread = placed.where("blocks > 1 and rep <> center").select("center", "rep", block)
    centers = sizes.where("blocks > 1").select("center", F.col("center").alias("rep"), F.explode(F.sequence(zero, F.col("blocks").cast("long") - 1)).alias("block"))
    star = spread.unionByName(centers).select("center", F.col("block").alias("low"), F.lit(STAR).cast("long").alias("high"), "rep", "block")
    return small.union(star)


def _rest_units(star: DataFrame, percent: int) -> DataFrame:
    """(center, low, high, rep, block) of what does not link with its centre and what may link with that.

    star has (center, rep, n_shingles, both, either).  Members that link with the centre need not meet each other.
    """
    linked = 100 * F.col("both") >= percent * F.col("either")
    cell = F.floor((F.col("either") - F.col("both")) * CELLS / F.col("either")).cast("int")
    rows = star.select("center", "rep", "n_shingles", linked.alias("linked"), F.least(cell, F.lit(CELLS - 1)).alias("cell"))
    reach = lambda a, b: 100 * (F.abs(a - b) - 1) < CELLS * (100 - percent)  # noqa: E731  cells that can hold a link
    parties = staged(rows.groupBy("center", "linked", "cell").agg(_blocks().alias("blocks")), "near-parties")
    one, two = (parties.select("center", *(F.col(c).alias(f"{c}{i}") for c in ("linked", "cell", "blocks"))) for i in (1, 2))
    meet = one.join(two, "center").where(reach(F.col("cell1"), F.col("cell2")) & ~(F.col("linked1") & F.col("linked2")))
    number = lambda linked, cell, block: (F.when(linked, 1).otherwise(0) * CELLS + cell).cast("long") * (1 << 40) + block
    meet = meet.select("center", F.col("linked1").alias("linked"), F.col("cell1").alias("cell"), "blocks1", "linked2", "cell2", "blocks2")
    sent = rows.join(meet, ["center", "linked", "cell"]).withColumn("block", number(F.col("linked"), F.col("cell"), F.pmod(F.xxhash64("rep"), F.col("blocks1"))))
    sent = sent.select("center", "rep", "block", "linked2", "cell2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("k"))
    sent = sent.withColumn("other", number(F.col("linked2"), F.col("cell2"), F.col("k")))
    return sent.select("center", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "block")


def near_duplicate_links(docs: DataFrame, *, shingle: int = 4, percent: int = 80, coordinates: int = 40, matches: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows, classes of equal shingle sets, components of class representatives).

    docs has doc_id long and text.  Rows without an id or without a word are in the sketches only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(docs.mapInArrow(_sketcher(shingle, coordinates), "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>"), "near-sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = staged(usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "near-classes")

    # prefix and skip: of the keys that occur twice all but the matches - 1 most frequent, if there are more
    postings = classes.select("rep", "n_shingles", F.explode("signature").alias("key"))
    common = staged(postings.groupBy("key").agg(F.count("*").alias("freq")).where("freq >= 2"), "near-keys")
    lists = postings.join(common, "key").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("keys")).where(F.size("keys") >= matches)
    popular = F.aggregate("keys", F.lit(0).cast("long"), lambda s, k: s + k["freq"])
    prefix = lists.select("rep", "n_shingles", popular.alias("popular"), F.explode(F.slice("keys", 1, F.size("keys") - (matches - 1))["key"]).alias("key"))
    prefix = staged(prefix, "near-prefix")
    unstage(common)

    # posting lists with one centre are one group; groups are cut into blocks, pairs of blocks are units
    top = prefix.groupBy("key").agg(F.max(F.struct("popular", (-F.col("rep")).alias("minus"))).alias("top"), F.count("*").alias("n")).where("n >= 2")
    centers = staged(top.select("key", (-F.col("top.minus")).alias("center")), "near-centers")
    members = staged(prefix.join(centers, "key").select("center", "rep", "n_shingles").distinct(), "near-members")
    sizes = staged(members.groupBy("center").agg(_blocks().alias("blocks")), "near-groups")

    # full shingle sets of the members; the hash of the smaller side keeps texts from being sorted
    ends = members.select("rep").distinct()
    texts = docs.join(ends.hint("shuffle_hash"), docs["doc_id"] == ends["rep"], "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_set_maker(shingle), "rep long, d1 long, shingles binary")
    sets = staged(sets.join(classes.select("rep", "d1"), ["rep", "d1"]).select("rep", "shingles"), "near-sets")
    unstage(prefix, centers)
    find = _linker(percent, coordinates, matches)
    schema = "x long, y long, star boolean, size long, both long, either long"
    first = staged(_first_units(members, sizes).join(sets, "rep").groupBy("center", "low", "high").applyInArrow(find, schema), "near-first")
    star = first.where("star").select(F.col("x").alias("center"), F.col("y").alias("rep"), F.col("size").alias("n_shingles"), "both", "either")
    good = first.where(~F.col("star") | (100 * F.col("both") >= percent * F.col("either"))).select("x", "y")
    apart = star.where(100 * F.col("both") < percent * F.col("either")).select("center").distinct()
    rest = _rest_units(star.join(apart, "center", "left_semi"), percent).join(sets, "rep").groupBy("center", "low", "high").applyInArrow(find, schema)
    links = staged(good.union(rest.select("x", "y")).distinct(), "near-links")
    unstage(first)
    components = connected_components(links, "x", "y", "near-cc")
    unstage(members, sizes, sets, links)
    return sketches, classes, components


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that can be reached over links (100 * intersection >= percent *
    union of the distinct lower-cased word shingles), itself included; kept says that it is the own one.
    A null or wordless text has n_shingles 0, is linked with nothing and kept.  A row without an id is
    kept, with a null component.  A repeated doc_id is judged row by row.  A text of any length is one set.
    No row gives no row.  Other columns are ignored.
    """
    sketches, classes, components = near_duplicate_links(docs, **options)
    named = components.select(F.col("node").alias("rep"), "component")
    of_class = staged(classes.join(named, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id")), "near-of-class")
    rows = sketches.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
