"""The graph of datasets and their attribute values as edge tables.

`edges` has (url, rel_type, node_label, name), distinct; `similar` has undirected (url_lo, url_hi, score).
Relations whose names begin with HAS_ are those of list columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn import ship
from cairn.functions import text as X
from cairn.sources.store import kept_rows

#: Relation, label of the value's node, column, and whether the column is a list.
RELATIONS = [
    ("HAS_KEYWORD", "Keyword", "keywords", True),
    ("HAS_THEME", "Theme", "themes", True),
    ("HAS_CATEGORY", "Category", "categories", True),
    ("HAS_SPATIAL_COVERAGE", "SpatialCoverage", "spatial_coverage", True),
    ("HAS_TEMPORAL_COVERAGE", "TemporalCoverage", "temporal_coverage", True),
    ("PROVIDED_BY", "Provider", "provider", False),
]
#: Relation of each attribute that similar datasets can be asked for.
ATTRIBUTES = {"themes": "HAS_THEME", "keywords": "HAS_KEYWORD", "spatial_coverage": "HAS_SPATIAL_COVERAGE", "temporal_coverage": "HAS_TEMPORAL_COVERAGE"}


#: Tasks that datasets are dealt to by url before their values become rows; a small file would make one task of all of them.
EDGE_PARTS = 32


def metadata_edges(datasets: DataFrame) -> DataFrame:
    """All edges in one pass over the datasets; names in title case."""
    none = F.array().cast("array<string>")
    kinds = [F.struct(F.lit(r).alias("rel_type"), F.lit(label).alias("node_label"), (F.coalesce(F.col(c), none) if many else F.array(c)).alias("names")) for r, label, c, many in RELATIONS]
    rows = datasets.select("url", F.array(*kinds).alias("kinds")).repartition(EDGE_PARTS, "url").select("url", F.explode("kinds").alias("k")).select("url", "k.rel_type", "k.node_label", F.explode("k.names").alias("name"))
    return rows.where("name is not null").withColumn("name", X.title_case(F.col("name"))).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("node_label", "name").distinct().union(edges.select(F.lit("Dataset"), "url").distinct())


def with_similar(similar: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Similarity edges with pairs (a, b, score) put in, the latter winning over what was there."""
    new = pairs.select(F.least("a", "b").alias("url_lo"), F.greatest("a", "b").alias("url_hi"), "score").groupBy("url_lo", "url_hi").agg(F.max("score").alias("score"))
    return new if similar is None else similar.join(new, ["url_lo", "url_hi"], "left_anti").select("url_lo", "url_hi", "score").unionByName(new)


def to_representative(datasets: DataFrame, urls: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, score): each of urls with the first dataset that has the same values by some columns, the first with the second.

    So all of a class hang together by one link for each, and no copies are paired with each other; nulls are equal to nothing.
    """
    known = datasets.select("url", *by).dropna(subset=by)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("url"))
    first = known.withColumn("nth", nth).where(F.col("nth") <= 2).groupBy(*by).agg(F.min("url").alias("first"), F.max("url").alias("second"))
    own = known.join(urls.select("url").distinct(), "url").join(first.where("first <> second"), by)
    return own.select(F.col("url").alias("a"), F.when(F.col("url") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("b"), F.lit(1.0).alias("score"))


def both_ways(similar: DataFrame) -> DataFrame:
    """(url, other, score) of undirected edges."""
    return similar.select(F.col("url_lo").alias("url"), F.col("url_hi").alias("other"), "score").union(similar.select("url_hi", "url_lo", "score"))


def detached(edges: DataFrame, similar: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both edge tables without the urls of gone (url)."""
    left = edges.join(gone.select("url"), "url", "left_anti")
    lo, hi = gone.select(F.col("url").alias("url_lo")), gone.select(F.col("url").alias("url_hi"))
    return left, similar.join(lo, "url_lo", "left_anti").join(hi, "url_hi", "left_anti").select("url_lo", "url_hi", "score")


def updated(edges: DataFrame, similar: DataFrame, new: DataFrame, removed: DataFrame, nearest) -> tuple[DataFrame, DataFrame]:
    """Edges after an incremental run: removed (url) and new (datasets) replaced, and similarities of the new
    ones and of all that lost a neighbour computed again by nearest(urls) -> (a, b, score)."""
    gone = removed.select("url").union(new.select("url")).distinct()
    bereaved = both_ways(similar).join(gone, "url", "left_semi").select(F.col("other").alias("url")).distinct().join(removed.select("url"), "url", "left_anti")
    edges, similar = detached(edges, similar, gone)
    asked = new.select("url").union(bereaved).distinct()
    return edges.unionByName(metadata_edges(new)), with_similar(similar, nearest(asked))


def best_of(rows: DataFrame, by: list[str], k: int, ties: list[str] | None = None) -> DataFrame:
    """The k best rows of each anchor with their place nth, ties by url or other columns; planned with a limit inside the window."""
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(*(F.desc(c) for c in by), *(ties or ["url"])))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)


def similar_by_description(similar: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    rows = both_ways(similar).where("score is not null").select(F.col("url").alias("anchor"), F.col("other").alias("url"), "score")
    return best_of(rows.join(anchors.select(F.col("url").alias("anchor")), "anchor", "left_semi"), ["score"], k).drop("nth")


def _pairs(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(rel_type, name, anchor, url) of the values that an anchor shares with another dataset."""
    own = anchors.select("url").join(edges, "url").select(F.col("url").alias("anchor"), "rel_type", "name")
    return own.join(edges.select("url", "rel_type", "name"), ["rel_type", "name"]).where("anchor <> url")


def shared_values(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, url, rel_type, shared): number of values of each relation that an anchor shares with another dataset; edges are distinct."""
    return _pairs(edges, anchors).groupBy("anchor", "url", "rel_type").agg(F.count("*").alias("shared"))


def _costs(edges: DataFrame, anchors: DataFrame) -> dict[bool, int]:
    """Numbers of pairs that the HAS_ relations (True) and the providers (False) would make."""
    marked = edges.join(anchors.select("url", F.lit(1).alias("asked")), "url", "left")
    sizes = marked.groupBy(F.col("rel_type").startswith("HAS_").alias("has"), "rel_type", "name").agg(F.count("*").alias("n"), F.coalesce(F.sum("asked"), F.lit(0)).alias("a"))
    return {r["has"]: r["pairs"] for r in sizes.groupBy("has").agg(F.sum(F.col("n") * F.col("a")).alias("pairs")).collect()}


def of_same_provider(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, url, shared): the pairs of one provider with HAS_ values in common, and how many.

    Pairs come from the side that makes fewer of them, providers or values; the other side is compared as an array for
    each of these pairs.
    """
    anchors = anchors.select("url").distinct()
    has, by = edges.where(F.col("rel_type").startswith("HAS_")), edges.where("rel_type = 'PROVIDED_BY'")
    costs = _costs(has.unionByName(by), anchors)
    lists = lambda rows, value: rows.groupBy("url").agg(F.collect_set(value).alias("own"))
    both = lambda pairs, own: pairs.join(own, "url").join(own.withColumnsRenamed({"url": "anchor", "own": "mine"}), "anchor")
    if costs.get(True, 0) <= costs.get(False, 0):
        pairs = _pairs(has, anchors).groupBy("anchor", "url").agg(F.count("*").alias("shared"))
        return both(pairs, lists(by, "name")).where(F.arrays_overlap("own", "mine")).select("anchor", "url", "shared")
    pairs = _pairs(by, anchors).select("anchor", "url").distinct()
    shared = F.size(F.array_intersect("own", "mine")).cast("long")
    return both(pairs, lists(has, F.struct("rel_type", "name"))).select("anchor", "url", shared.alias("shared")).where("shared > 0")


#: Kinds of anchors and of datasets in a block of pairs.
ANCHOR_BLOCK, DATASET_BLOCK = 128, 4096
#: Kinds of datasets that are left out together, if all values of them would not do.
GROUP = 64
#: Tasks that kinds are dealt to; and shares of the blocks of one part, so that a part that most datasets are in makes many tasks.
PAIR_PARTS, SHARES = 64, 8
#: Blocks of anchors whose best a task remembers, to leave out what is below them.
REMEMBERED = 2048
_BLOCK = "part long, ids array<long>, first array<string>, owner binary, value binary, rank binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (part, id, first, own), in order of part, so many of one part to a row, and their values with the number of their owner; rank is their place by first."""

    def pack(batches):
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(start, end, size):
                    block = batch.slice(lo, min(size, end - lo))
                    own = block.column(3)
                    counts = own.value_lengths().to_numpy(zero_copy_only=False)
                    owner, value = np.repeat(np.arange(len(counts), dtype=np.int32), counts), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    rank = np.empty(len(counts), np.int64)
                    rank[pc.sort_indices(block.column(2)).to_numpy()] = np.arange(len(counts))
                    lists = [pa.array([block.column(i).to_pylist()], pa.list_(t)) for i, t in ((1, pa.int64()), (2, pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(parts[lo])]), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (owner, value, rank))], ["part", "ids", "first", "owner", "value", "rank"])

    ship(rows.sparkSession)
    return rows.select("part", "id", "first", "own").mapInArrow(pack, _BLOCK)


def _keys(mine: tuple, others: tuple, shape: tuple[int, int], weights: np.ndarray) -> list[np.ndarray]:
    """For each row of weights, the sum over the values that each pair of two blocks (owner, value) has in common; the weight of a value is at value % n.

    Values that many have are multiplied as columns of 0 and 1; for others each owner meets each.
    """
    (a_owner, a_value), (d_owner, d_value) = mine, others
    known = np.unique(a_value)
    a_at, d_at = np.searchsorted(known, a_value), np.searchsorted(known, d_value)
    d_at[d_at == len(known)] = 0
    same = known[d_at] == d_value
    d_owner, d_at = d_owner[same], d_at[same]
    n_a, n_d = np.bincount(a_at, minlength=len(known)), np.bincount(d_at, minlength=len(known))
    own_weights = weights[:, known % weights.shape[1]]
    columns = np.flatnonzero((n_a * n_d * 128 >= shape[0] * shape[1]) & (n_d > 0))
    place = np.full(len(known), -1)
    place[columns] = np.arange(len(columns))
    sides = []
    for size, owner, at in ((shape[0], a_owner, a_at), (shape[1], d_owner, d_at)):
        side = np.zeros((size, len(columns)), weights.dtype)
        own = place[at] >= 0
        side[owner[own], place[at[own]]] = 1
        sides.append(side)
    out = [(sides[0] * w[columns]) @ sides[1].T for w in own_weights]
    own = place[d_at] < 0
    if own.any():
        order = np.argsort(a_at, kind="stable")
        holders, first = a_owner[order], np.concatenate([[0], np.cumsum(n_a)])
        value, owner = d_at[own], d_owner[own].astype(np.int64)
        times = n_a[value]
        start = np.repeat(first[value] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        cell = holders[start + np.arange(len(start))].astype(np.int64) * shape[1] + np.repeat(owner, times)
        for key, w in zip(out, own_weights, strict=True):
            key += np.bincount(cell, np.repeat(w[value], times), shape[0] * shape[1]).reshape(shape).astype(weights.dtype)
    return out


def _relations(lists: dict[str, str]) -> list[str]:
    """Relations of values by the remainder of their codes: all other HAS_ relations, then those of the lists."""
    return ["HAS_", *sorted(set(lists.values()))]


def best_shared(edges: DataFrame, anchors: DataFrame, lists: dict[str, str], k: int = 5) -> DataFrame:
    """(anchor, list, url, shared, other, nth): for each anchor and list the k best of all other datasets.

    A list has a relation: its datasets are those with values of it in common, the most first, then those with the most values of
    other HAS_ relations in common, then by url.  The list of PROVIDED_BY has the datasets of the anchor's provider by
    the number of all HAS_ values in common.
    """
    return _best_shared(_own_values(edges, anchors, lists)[0], anchors, lists, k)


def _own_values(edges: DataFrame, anchors: DataFrame, lists: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(url, own array<long>): of each dataset the codes of the values that some anchor has too, in order, if any; and (rel_type, name, code)."""
    relations = _relations(lists)
    asked = edges.where(F.col("rel_type").startswith("HAS_") | F.col("rel_type").isin(relations)).select("url", "rel_type", "name")
    known = asked.join(anchors.select("url").distinct(), "url", "left_semi").groupBy("rel_type", "name").agg(F.count("*").alias("n"))
    known = known.orderBy(F.desc("n"), "rel_type", "name").drop("n")  # so that kinds in order have their commonest values in common
    relation = F.greatest(F.array_position(F.array(*(F.lit(r) for r in relations)), F.col("rel_type")) - 1, F.lit(0))
    known = kept_rows(known.withColumn("code", F.monotonically_increasing_id() * len(relations) + relation), "known-values")
    own = asked.join(known, ["rel_type", "name"]).groupBy("url").agg(F.array_sort(F.collect_set("code")).alias("own"))
    return kept_rows(own, "own-values"), known


def _best_shared(own: DataFrame, anchors: DataFrame, lists: dict[str, str], k: int) -> DataFrame:
    """best_shared from the values of the datasets.

    Providers count for their own list only: there they are parts that are searched one by one, and for the other lists all datasets
    are one part.  In a part, datasets with the same other values of those that anchors have are of one kind: they differ by url only, so that
    the k + 1 first ones of a kind stand for it, and anchors of one kind have one list, without themselves.  Kinds of anchors meet
    kinds of datasets in blocks, where shared values are counted for all pairs at once; only the best leave a task.
    """
    relations, most = _relations(lists), k + 1
    n, provider = len(relations), relations.index("PROVIDED_BY") if "PROVIDED_BY" in relations else -1
    of_provider = lambda v: F.pmod(v, F.lit(n)) == provider
    parts = [F.array(F.lit(-1).cast("long"))] if set(lists.values()) != {"PROVIDED_BY"} else []
    rows = own.select("url", F.explode(F.concat(*parts, F.filter("own", of_provider))).alias("part"), F.filter("own", lambda v: ~of_provider(v)).alias("own")).where(F.size("own") > 0)
    asked = rows.join(anchors.select("url").distinct(), "url", "left_semi")
    kinds = kept_rows(asked.select("part", "own").distinct().withColumn("id", F.monotonically_increasing_id()), "anchor-kinds")
    nth = F.row_number().over(Window.partitionBy("part", "own").orderBy("url"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("part", "own").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    first = kept_rows(first.withColumn("id", F.monotonically_increasing_id()), "dataset-kinds")
    in_order = lambda rows, of: rows.select("part", "id", of.alias("first"), "own").repartitionByRange(PAIR_PARTS, "part", "own").sortWithinPartitions("part", "own")
    one = _blocks(in_order(kinds, F.lit("")), ANCHOR_BLOCK).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    two = _blocks(in_order(first, F.col("urls")[0]), DATASET_BLOCK).repartition(PAIR_PARTS).withColumn("share", (F.monotonically_increasing_id() % SHARES).cast("int"))
    has = np.array([r.startswith("HAS_") for r in relations])

    def weights_of(names, scale):
        """Weights of relations in each list, so that sums of them are in its order; pairs of less than scale are not in it."""
        out = np.zeros((len(names), n), np.float32 if scale <= 1 << 12 else np.float64)
        for w, (_, relation) in zip(out, names, strict=True):
            w[has] = scale if relation == "PROVIDED_BY" else 1
            if relation != "PROVIDED_BY":
                w[relations.index(relation)] = scale
        return out

    def best(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, ids, d_ids, d_first, *arrays in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "d_ids", "d_first", "owner", "value", "d_owner", "d_value", "d_rank")), strict=True):
                a_owner, a_value, d_owner, d_value, rank = (np.frombuffer(x, t) for x, t in zip(arrays, (np.int32, np.int64, np.int32, np.int64, np.int64), strict=True))
                names = [x for x in lists.items() if (x[1] == "PROVIDED_BY") == (part >= 0)]
                # sums are exact: below 2**24 in single precision, and below 2**53
                scale = 1 << (12 if np.bincount(a_owner).max() < 1 << 12 else 20)
                weights = weights_of(names, scale)
                if ids[0] not in seen and len(seen) == REMEMBERED:
                    seen.clear()
                bests = seen.setdefault(ids[0], np.zeros((len(names), len(ids), most), weights.dtype))
                least = np.maximum(bests.min(axis=2), scale)
                # anchors that could get as much as they have if one dataset had all values of a group, and groups that could give it
                values, at = np.unique(d_value, return_inverse=True)
                whole = np.unique(d_owner // GROUP * np.int64(len(values)) + at)
                groups = -(-len(d_ids) // GROUP)
                bound = _keys((a_owner, a_value), (whole // len(values), values[whole % len(values)]), (len(ids), groups), weights)
                could = np.zeros((len(ids), groups), bool)
                for key, own in zip(bound, least, strict=True):
                    could |= key >= own[:, None]
                a_open, d_open = could.any(axis=1), np.repeat(could.any(axis=0), GROUP)[: len(d_ids)]
                chosen, others = np.flatnonzero(a_open), np.flatnonzero(d_open)
                if not len(chosen):
                    continue
                a_kept, d_kept = a_open[a_owner], d_open[d_owner]
                mine = (np.cumsum(a_open) - 1)[a_owner[a_kept]], a_value[a_kept]
                keys = _keys(mine, ((np.cumsum(d_open) - 1)[d_owner[d_kept]], d_value[d_kept]), (len(chosen), len(others)), weights)
                a_ids, first_urls, d_numbers, places = np.array(ids)[chosen], pa.array(d_first, pa.string()), np.array(d_ids), rank[others]
                for i, ((name, _), key) in enumerate(zip(names, keys, strict=True)):
                    found = key >= least[i, chosen][:, None]
                    if np.count_nonzero(found) > 16 * most * len(chosen) and len(others) > most:
                        # ties by url
                        full = (key.astype(np.int64) << 20) - places
                        row, column = np.repeat(np.arange(len(chosen)), most), np.argpartition(full, -most, axis=1)[:, -most:].ravel()
                        row, column = (x[found[row, column]] for x in (row, column))
                    else:
                        row, column = np.nonzero(found)
                    order = np.lexsort((places[column], -key[row, column], row))
                    row, column = row[order], column[order]
                    at = np.arange(len(row)) - np.searchsorted(row, row)
                    row, column, at = (x[at < most] for x in (row, column, at))
                    new = np.zeros((len(chosen), most), weights.dtype)
                    new[row, at] = key[row, column]
                    bests[i, chosen] = np.sort(np.concatenate([bests[i, chosen], new], axis=1), axis=1)[:, -most:]
                    value, column = key[row, column].astype(np.int64), others[column]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a_ids[row]), pa.array([name] * len(row), pa.string()), pa.array(d_numbers[column]), first_urls.take(pa.array(column)), pa.array(value // scale), pa.array(value % scale)],
                        ["kind", "list", "id", "first", "shared", "other"],
                    )

    pairs = one.join(two.select("part", "share", *(F.col(c).alias(f"d_{c}") for c in ("ids", "first", "owner", "value", "rank"))), ["part", "share"])  # of blocks
    found = pairs.mapInArrow(best, "kind long, list string, id long, first string, shared long, other long")
    top = lambda rows, by, last: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("shared"), F.desc("other"), last)))
    found = top(found, ("kind", "list"), "first").where(F.col("nth") <= most).join(first.select("id", "urls"), "id")
    found = top(found.select("kind", "list", F.explode("urls").alias("url"), "shared", "other"), ("kind", "list"), "url").where(F.col("nth") <= most).drop("nth")
    of_kind = asked.join(kinds, ["part", "own"]).select(F.col("url").alias("anchor"), F.col("id").alias("kind"))
    each = of_kind.join(found, "kind").where("anchor <> url").select("anchor", "list", "url", "shared", "other")
    # a dataset may be found by several providers
    return top(each.repartition("anchor", "list").distinct(), ("anchor", "list"), "url").where(F.col("nth") <= k)


def _with_names(rows: DataFrame, own: DataFrame, known: DataFrame, wanted, name) -> DataFrame:
    """rows (anchor, url) with the sorted names of the wanted relations' values that both ends have; there is one at least.

    Values come by a merge: the files of all datasets are small for their rows, which a broadcast would put into the driver.
    """
    of = lambda key, values: own.select(F.col("url").alias(key), F.col("own").alias(values)).hint("merge")
    both = rows.join(of("url", "_own"), "url").join(of("anchor", "_mine"), "anchor")
    codes = both.select(*rows.columns, F.explode(F.array_intersect("_own", "_mine")).alias("code"))
    return codes.join(known.where(wanted), "code").groupBy(*rows.columns).agg(F.array_sort(F.collect_set(name)).alias("names"))


def similar_by_attribute(edges: DataFrame, anchors: DataFrame, rel_type: str, k: int = 5) -> DataFrame:
    """(anchor, url, shared, other, names): datasets with the most values of a relation in common with an anchor,
    then with the most values of other HAS_ relations."""
    lists = {"one": rel_type}
    own, known = _own_values(edges, anchors, lists)
    best = _best_shared(own, anchors, lists, k).drop("nth", "list")
    return _with_names(best, own, known, F.col("rel_type") == rel_type, F.col("name")).select("anchor", "url", "shared", "other", "names")


def similar_by_provider(edges: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """(anchor, url, shared, names): datasets of an anchor's provider by the number of HAS_ values in common."""
    lists = {"provider": "PROVIDED_BY"}
    own, known = _own_values(edges, anchors, lists)
    best = _best_shared(own, anchors, lists, k).drop("nth", "list", "other")
    return _with_names(best, own, known, F.col("rel_type").startswith("HAS_"), F.concat_ws(":", "rel_type", "name")).select("anchor", "url", "shared", "names")


#: Places of the lists of similar datasets; the first is that of descriptions.
LISTS = {"themes": 1, "keywords": 2, "provider": 3, "spatial_coverage": 4, "temporal_coverage": 5}


def all_similar(edges: DataFrame, similar: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """(anchor, place, list, url) of the six lists: description, themes, keywords, provider, spatial and temporal coverage."""
    best = best_shared(edges, anchors, ATTRIBUTES | {"provider": "PROVIDED_BY"}, k)
    places = F.create_map(*(F.lit(x) for kv in LISTS.items() for x in kv))
    five = best.select("anchor", F.element_at(places, F.col("list")).alias("place"), "list", "url")
    return similar_by_description(similar, anchors, k).select("anchor", F.lit(0).alias("place"), F.lit("description").alias("list"), "url").unionByName(five)


def common_metadata(datasets: DataFrame, by: list[str], column: str) -> DataFrame:
    """(a, b, common): pairs of datasets, a < b, with equal values by some columns and at least one item of a list column in common.

    An array counts as equal by its first item; nulls are equal to nothing.
    """
    kinds = {f.name: f.dataType.typeName() for f in datasets.schema}
    keys = [(F.get(c, F.lit(0)) if kinds[c] == "array" else F.col(c)).alias(f"_{c}") for c in by]
    one, two = (datasets.select(*keys, F.col("url").alias(n), F.col(column).alias(f"list_{n}")) for n in ("a", "b"))
    pairs = one.join(two, [f"_{c}" for c in by]).where("a < b")
    return pairs.select("a", "b", X.common_to(F.col("list_a"), F.col("list_b")).alias("common")).where(F.size("common") > 0)


def with_previews(similar: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows of all_similar with title, preview and the values in common with the anchor: of the list's own attribute,
    of all list attributes for the provider's list, none for the description's."""
    lists = [c for _, _, c, many in RELATIONS if many]
    one = datasets.select(F.col("url").alias("anchor"), *(F.col(c).alias(f"a_{c}") for c in lists))
    two = datasets.select("url", "title", X.preview(F.col("description")).alias("preview"), *lists)
    both = similar.join(two.hint("merge"), "url").join(one.hint("merge"), "anchor")  # not whole catalogues in the driver
    common = {c: X.common_to(F.col(c), F.col(f"a_{c}")) for c in lists}
    shown = F.concat(*(F.when((F.col("list") == c) | (F.col("list") == "provider"), common[c]).otherwise(F.array().cast("array<string>")) for c in lists))
    return both.select("anchor", "place", "list", "url", "title", "preview", shown.alias("common"))
