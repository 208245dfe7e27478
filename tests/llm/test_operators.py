"""Each operator against plain Python on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn import ship

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, rep long, component string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


def corpus():
    base = words(300, 1)
    shared = words(60, 2)
    texts = [" ".join(base), " ".join(base), " ".join(base[:290] + ["x"] * 10), " ".join(base[:150] + shared), " ".join(shared) + " " + " ".join(shared), " ".join(words(80, 3) + shared[5:50] + words(80, 4))]
    texts += [None, "", "   \n", "one", "one two", "Zwölf Ärzte", "one two three four", "ONE two three four", "a b c d " * 200, "long " + " ".join(words(30_000, 5, 20_000))]
    for i in range(30):  # near copies of one text
        own = list(base)
        for k in random.Random(i).sample(range(300), i % 9):
            own[k] = f"edit{i}-{k}"
        texts.append(" ".join(own))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 0, True, 7, 7, "x") for i, t in enumerate(corpus())]
    rows += [(3, corpus()[3], "en", "s1", 0, True, 7, 7, "x"), (None, corpus()[0], "en", None, 0, True, 7, 7, "x")]  # a repeated row and one without an id
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def items(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def sets_of(rows):
    out = []
    for d, t in rows:
        w = SPACES.findall((t or "").encode().lower().decode())
        out.append((d, frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    return out


# ---------------------------------------------------------------- 10


def test_near_duplicates(spark, docs, rows):
    from cairn.llm.near_dup import near_duplicates

    sets = sets_of(rows)
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    want = collections.Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)
    assert items(near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 4])
def test_blocks_of_a_group(spark, docs, monkeypatch, block):
    """Groups larger than a block give the same components."""
    from cairn.llm import near_dup

    whole = items(near_dup.near_duplicates(docs), "doc_id", "component_id")
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    assert items(near_dup.near_duplicates(docs), "doc_id", "component_id") == whole


def test_links_off_the_centre(spark, monkeypatch):
    """A chain of texts, each near the next only, two clusters that do not link, and many copies sent a few times each."""
    from cairn.llm import near_dup

    base = words(400, 21, 10**6)
    rows = []
    for i in range(40):  # neighbours share 4 in 5 shingles, others fewer
        rows.append(base[: 400 - 9 * i] + [f"c{k}" for k in range(9 * i)])
    other = base[:300] + words(100, 23, 10**6)
    for i in range(300):
        own = list(base if i % 2 else other)
        own[7 * i % 390] = f"e{i}"
        rows.append(own)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = [s for _, s in sets_of([(i, " ".join(w)) for i, w in enumerate(rows)])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    sends = []
    for name in ("_first_units", "_rest_units"):
        plain = getattr(near_dup, name)
        monkeypatch.setattr(near_dup, name, lambda *a, plain=plain: sends.append(units := plain(*a)) or units)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 16)
    counted = []
    monkeypatch.setattr(near_dup, "unstage", lambda *t: counted or counted.extend(u.count() for u in sends) if len(sends) == 2 else None)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and 1 < len(set(got.values()))
    assert counted[0] < 8 * len(rows)  # a member is in a few groups; pairs of blocks would be 22 sends for each


def test_exact_matrix():
    from cairn.llm.near_dup import _shared

    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 5000, 3000).astype(np.uint64)) for _ in range(12)]
    x, y = np.arange(5), np.arange(5, 12)
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in y] for a in x]
    assert _shared(sets, x, y).astype(int).tolist() == want


def test_components(spark):
    from cairn.llm.common import connected_components

    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, r.randint(2, 40)) for _ in range(20)] + [(500, 500), (None, 3), (7, None)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- 3


def test_repeats(spark, tmp_path, docs, rows):
    from cairn.llm.repeats import remove_repeats

    docs.write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    every = [(d, SPACES.findall(t or "")) for d, t in ((r["doc_id"], r["text"]) for r in stored.collect())]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in every for i in range(len(w) - 34))
    want = collections.Counter()
    for d, w in every:
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert items(remove_repeats(stored), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert remove_repeats(empty(spark)).count() == 0


def test_first_least():
    from cairn.llm.repeats import _first_least

    r = np.random.default_rng(0)
    for n in (28, 29, 50, 400):
        for size in (1, 2, 3, 8, 28):
            x = r.integers(0, 20, n).astype(np.uint64)
            assert _first_least(x, size).tolist() == [i + int(np.argmin(x[i : i + size])) for i in range(n - size + 1)]


def test_repeat_at_the_end_of_a_very_long_text(spark):
    """Places beyond 2**24 words: the last 300 words of one text are another document."""
    from cairn.llm.repeats import _chunker

    n = (1 << 24) + 2000
    small = np.random.default_rng(3).permutation(n).astype("S8")
    tail = b" ".join(small[-300:].tolist())
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([b" ".join(small.tolist()), tail], pa.binary())], ["row", "text"])
    chunks = pa.Table.from_batches(list(_chunker(35, 8)([batch]))).to_pandas()
    key = ["anchor", "c1", "c2"]
    twice = chunks[chunks.duplicated(key, keep=False)]
    inner = chunks[(chunks["row"] == 1)].sort_values("start").iloc[1:-1]  # all but what reaches over the ends of the passage
    assert len(inner) > 5 and (inner.merge(twice[twice["row"] == 0], on=key)["start_y"] - inner["start"].to_numpy() == n - 300).sum() == len(inner)
    assert chunks.groupby("row")["n"].sum().tolist() == [n - 34, 300 - 34]


# ---------------------------------------------------------------- 7


def test_contamination(spark, docs, rows):
    from cairn.llm.decontaminate import contamination

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: pattern.findall((t or "").translate(low))
    bench = [(1, " ".join(words(300, 1)[20:45])), (2, "ONE, two!"), (3, "zwölf Ärzte"), (10, "zwölf Ärzte"), (4, None), (5, "..."), (6, "a b c d a b c d a b c d"), (7, "not in any document at all my dear reader of these lines"), (None, "one"), (9, "one")]
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = find(t)
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows[tuple(w[k : k + 10])].add(i)
    want = collections.Counter()
    for d, t in rows:
        w, hit, found = find(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    table = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, row int")
    assert items(contamination(docs, table), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert contamination(docs, table.limit(0)).where("contaminated").count() == 0
    assert contamination(empty(spark), table).count() == 0


# ---------------------------------------------------------------- 2


def test_quality_counts(spark, docs, rows):
    from cairn.llm.quality import quality_rules

    want = collections.Counter()
    for d, t in rows:
        t = t or ""
        w = SPACES.findall(t)
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if SPACES.search(x):
                dup += x in lines
                lines.add(x)
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    got = quality_rules(docs)
    assert items(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules(empty(spark)).count() == 0


def test_outliers(spark):
    """Symbol-ridden documents go, also where they are a fifth of a source; ordinary ones stay."""
    from cairn.llm.quality import quality_rules

    ship(spark)
    rows = []
    for i in range(400):
        w = words(60 + i % 200, i, 5000)
        bad = i % 5 == 0
        rows.append((i, " ".join(x + "%%%" if bad else x for x in w), "en", "a" if i % 4 else "b"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, kept in got.items() if kept == (i % 5 == 0)] == []


def test_minimum_covariance_determinant(spark):
    """kept of 2,000 rows in two groups against numpy, with exact h-subsets instead of distance bins."""
    from cairn.llm import quality as q

    r = np.random.default_rng(12)
    rows = []
    for kind, n, share in (("a", 1400, 0.2), ("b", 600, 0.05)):
        x = r.multivariate_normal([1.6, 0.4, 0.05, 0.1], np.array([[0.04, 0.03, 0, 0], [0.03, 0.25, 0.01, 0], [0, 0.01, 0.004, 0.002], [0, 0, 0.002, 0.01]]), n)
        bad = r.random(n) < share
        x[bad] = r.multivariate_normal([0.9, 2.9, 0.5, 0.6], np.eye(4) * 0.01, bad.sum())
        rows += [("source", kind, *map(int, v)) for v in np.rint(x * q.SCALE)]
    table = spark.createDataFrame(rows, "level string, kind string, x0 long, x1 long, x2 long, x3 long")
    got = collections.defaultdict(dict)
    for v in q.robust_outliers(table).collect():
        got[v["kind"]][tuple(v[f"x{i}"] for i in range(4))] = (v["distance2"], v["outlier"])

    floor = np.diag(np.square(q.FLOOR))
    quantile = lambda p: q._chi2_quantile(p, 4)
    scale = lambda p: p / q._chi2_cdf(quantile(p), 6)
    for kind in "ab":
        x = np.array([v[2:] for v in rows if v[1] == kind]) / q.SCALE
        distance = lambda m, c, x=x: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c + floor), x - m)
        mean = np.median(x, axis=0)
        spread = 1.4826 * np.median(np.abs(x - mean), axis=0)
        wide = np.sqrt(spread**2 + np.square(q.FLOOR))
        z = (x - mean) / wide
        found = []
        for y in (None, z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None], np.tanh(z)):
            m, c = mean, np.diag(spread**2)
            if y is not None:
                c = (y.T @ y) / np.sqrt(np.outer(np.diag(y.T @ y), np.diag(y.T @ y))) * np.outer(wide, wide)
            for _ in range(5):
                near = np.argsort(distance(m, c), kind="stable")[: math.ceil(0.75 * len(x))]
                m, c = x[near].mean(axis=0), scale(0.75) * np.cov(x[near].T, bias=True)
            found.append((np.linalg.det(c + floor), m, c))
        _, m, c = min(found, key=lambda f: f[0])
        near = distance(m, c) <= quantile(0.975)
        m, c = x[near].mean(axis=0), scale(0.975) * np.cov(x[near].T, bias=True)
        d2 = distance(m, c)
        mine = np.array([got[kind][tuple(int(a) for a in np.rint(v * q.SCALE))][0] for v in x])
        out = np.array([got[kind][tuple(int(a) for a in np.rint(v * q.SCALE))][1] for v in x])
        edge = np.abs(d2 / quantile(0.99999) - 1) < 0.05  # what bins may decide otherwise
        assert (np.abs(mine / np.maximum(d2, 0.05) - 1) < 0.05).mean() > 0.97
        assert (out == (d2 > quantile(0.99999)))[~edge].all() and edge.sum() < 5 and out.sum() > 20


# ---------------------------------------------------------------- 8


def placed_blocks(got):
    """(source, release, deadline) of each slot; checks that slots, blocks and places are all used once."""
    slots = {}
    for r in got:
        if r["kept"]:
            assert slots.setdefault(r["slot"], (r["source"], r["block"], r["release"], r["deadline"])) == (r["source"], r["block"], r["release"], r["deadline"])
    assert sorted(slots) == list(range(len(slots)))
    assert len({(r["slot"], r["place"]) for r in got if r["kept"]}) == sum(r["kept"] for r in got)
    seen = collections.Counter()
    for s in range(len(slots)):
        assert slots[s][1] == seen[slots[s][0]]
        seen[slots[s][0]] += 1
    return [(slots[s][0], *slots[s][2:]) for s in range(len(slots))]


def check_deviation(order, weights, blocks):
    """Less than one block from the given weights, and from what they leave to the others once a source has run out."""
    from fractions import Fraction

    exact, have, v = {k: Fraction(w) for k, w in weights.items()}, collections.Counter(), Fraction(0)
    for source, *_ in order:
        have[source] += 1
        left = Fraction(1)
        while left and (active := [k for k in exact if exact[k] * v < blocks[k]]):
            rate = sum(exact[k] for k in active)
            step = min(left / rate, *(blocks[k] / exact[k] - v for k in active))
            v, left = v + step, left - step * rate
        assert all(abs(have[k] - min(w * v, blocks[k])) < 1 + Fraction(len(order), 1 << 39) for k, w in exact.items())


@pytest.mark.parametrize("n", [3, 20, 200])
def test_mix_deviation(spark, n):
    """At each slot, until the last: less than one block from the weights that were given."""
    from cairn.llm.mixing import FRAME, exact_order

    r = random.Random(n)
    names = [None, *(f"s{i}" for i in range(1, n))]
    weights = {k: r.choice([0.5, 0.3, 0.2, 0.0625, 1.0, 7.0, 0.01]) for k in names}
    sizes = {k: r.randint(1, 6000 // n) for k in names} | {"s1": 2500}
    table = spark.createDataFrame([(i, k, 1) for i, k in enumerate(k for k, m in sizes.items() for _ in range(m))], "doc_id long, source string, slot int")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = exact_order(table, given, block_docs=2).collect()
    order = placed_blocks(got)
    blocks = {k: -(-m // 2) for k, m in sizes.items()}
    assert len(got) == sum(sizes.values()) and len(order) == sum(blocks.values()) > FRAME
    assert all(release <= s < deadline for s, (_, release, deadline) in enumerate(order))
    check_deviation(order, weights, blocks)


def test_mixing(spark, docs):
    from cairn.llm.mixing import exact_order

    rows = [(i, ["big", "mid", None, "small"][0 if i % 3 == 0 else 1 + i % 7 % 3], i) for i in range(3000)] + [(None, "mid", 1), (None, "mid", 1), (5, "big", 2)]
    table = spark.createDataFrame(rows, "doc_id long, source string, block long")
    given = spark.createDataFrame([("big", 0.5), ("mid", 0.3), (None, 0.2), ("absent", 9.0)], "source string, weight double")
    got = exact_order(table, given, block_docs=1).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["row"]["block"]) for r in got) == collections.Counter(rows)
    assert {r["source"] for r in got if not r["kept"]} == {"small"}
    sizes = collections.Counter(s for _, s, _ in rows)
    check_deviation(placed_blocks(got), {"big": 0.5, "mid": 0.3, None: 0.2}, sizes)
    got = exact_order(table, most_blocks=100).collect()  # larger blocks instead of more
    order = placed_blocks(got)
    assert all(r["kept"] for r in got) and 90 < len(order) <= 104 and max(r["place"] for r in got) == 30
    check_deviation(order, {k: m**0.9 for k, m in sizes.items()}, {k: -(-m // 31) for k, m in sizes.items()})
    assert exact_order(docs).where("kept").count() == docs.count()
    assert exact_order(empty(spark)).count() == 0 and exact_order(table, given.limit(0)).where("kept").count() == 0


def test_mix_keeps_all(spark):
    """A source of one row and one without a name do not end the mix."""
    import corpus_pipeline

    rows = [(i, f"text {i}", "large" if i % 3 else "mid") for i in range(10_000)] + [(50_000, "alone", "tiny"), (50_001, "no source", None), (50_001, "again", None), (None, "no id", "mid")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert items(corpus_pipeline.mix(spark, table, ""), "doc_id", "text", "source") == collections.Counter(rows)


def test_mix_of_many_sources(spark):
    """Beyond most_sources every row has its place too; no source is ever a block behind its weight."""
    from cairn.llm.mixing import exact_order

    sizes = {f"s{i}": 1 + 40 * i % 97 for i in range(300)} | {"hot": 3000, None: 5}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    got = exact_order(table, most_sources=256).collect()
    assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter(rows) and all(r["kept"] for r in got)
    blocks = sorted((r["slot"], r["source"], r["block"]) for r in got if r["place"] == 0)
    assert [s for s, *_ in blocks] == list(range(len(blocks)))
    total, seen = sum(n**0.9 for n in sizes.values()), collections.Counter()
    first = min(-(-n // 16) / n**0.9 for n in sizes.values())
    for slot, source, block in blocks:
        assert block == seen[source]
        seen[source] += 1
        if (slot + 1) / total < first:  # until a source runs out
            assert all(n**0.9 / total * (slot + 1) - seen[s] < 1 for s, n in sizes.items())
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 0.5), ("s2", 0.0)], "source string, weight double")
    assert {r["source"] for r in exact_order(table, weights, most_sources=1).where("kept").collect()} == {"hot", "s1"}


def earliest_deadline_first(order, blocks, weights):
    """Sources by slot, from the windows that order has: a heap of the released blocks, slot by slot."""
    import heapq
    from fractions import Fraction

    total = sum(weights.values())
    first = {k: (Fraction(blocks[k], max(1, round(w / total * (1 << 40)))), k is None, k or "") for k, w in weights.items()}
    released, heap, out = collections.defaultdict(list), [], []
    for source, release, deadline in order:
        released[release].append((deadline, first[source], source))
    for slot in range(len(order)):
        for x in released[slot]:
            heapq.heappush(heap, x[:2] + ((x[2],),))
        out.append(heapq.heappop(heap)[2][0])
    return out


@pytest.mark.parametrize("sources", [3, 1500])
def test_mix_has_one_rule_for_all_numbers_of_sources(spark, monkeypatch, sources):
    """Earliest deadline first slot by slot, less than a block from the weights, also where chunks are many and sources beyond a thousand."""
    from cairn.llm import mixing

    r = random.Random(sources)
    names = [None, *(f"s{i}" for i in range(1, sources))]
    weights = {k: r.choice([0.5, 0.25, 0.125, 1.0, 8.0]) for k in names}
    sizes = {k: r.randint(1, 6000 // sources) for k in names} | {"s1": 900}
    table = spark.createDataFrame([(i, k) for i, k in enumerate(k for k, m in sizes.items() for _ in range(m))], "doc_id long, source string")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    monkeypatch.setattr(mixing, "CHUNK", 100)
    got = mixing.exact_order(table, given, block_docs=2).collect()
    order = placed_blocks(got)
    blocks = {k: -(-m // 2) for k, m in sizes.items()}
    assert len(got) == sum(sizes.values()) and len(order) == sum(blocks.values())
    assert all(release is not None and release <= s < deadline for s, (_, release, deadline) in enumerate(order))
    assert [k for k, *_ in order] == earliest_deadline_first(order, blocks, weights)
    few = mixing.exact_order(table, given, block_docs=2, most_sources=2).collect()
    assert collections.Counter(map(str, few)) == collections.Counter(map(str, got))


def test_mix_blocks_do_not_grow(spark):
    """A corpus of more than 2**18 blocks has blocks as small as any other."""
    from cairn.llm.mixing import exact_order

    table = spark.range((1 << 18) + 1000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    got = exact_order(table, block_docs=1).agg(F.max("place"), F.countDistinct("slot"), F.min(F.col("slot") - F.col("release")), F.min(F.col("deadline") - F.col("slot"))).first()
    assert tuple(got)[:2] == (0, (1 << 18) + 1000) and got[2] >= 0 and got[3] > 0


# ---------------------------------------------------------------- 9


def test_token_shards(spark, docs, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from cairn.llm.tokens import Shard, read_shards, write_shards

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # the rows that share an id are equal
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = write_shards(docs, path, shard_size=10_000, shard_tokens=5_000)
    assert manifest.count() > 3
    got = [tuple(r) for r in read_shards(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    folder = manifest.first()["path"].rsplit("/", 1)[0]  # the manifest is committed beside the files
    assert items(spark.read.parquet(f"{folder}/manifest"), "path", "start") == items(manifest, "path", "start")
    shard = Shard.open(manifest.orderBy("start").first()["path"])
    ids = shard.matrix.decode(np.uint32)
    for i in (0, 1, len(ids) // 2, len(ids) - 1):
        assert shard.matrix.access(i) == ids[i]
        where = np.flatnonzero(ids == ids[i])
        assert shard.matrix.count(int(ids[i])) == len(where)
        assert shard.matrix.count(int(ids[i]), 5, len(ids) - 5) == int(((where >= 5) & (where < len(ids) - 5)).sum())
        assert [shard.matrix.select(int(ids[i]), k) for k in (0, len(where) - 1, len(where))] == [where[0], where[-1], -1]
    assert write_shards(empty(spark), path).count() == 0


def test_pieces_equal_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from cairn.llm.tokens import Encoder

    enc, plain = Encoder(public.path("byte_bpe_50k.json"), most=200), Encoder(public.path("byte_bpe_50k.json"))
    plain.pieces = False
    r = random.Random(3)
    parts = ["a", "É", "ß", " ", "  ", "\n", "\t", " ", "'s", "'", "1", "23", "!", "..", "<|endoftext|>", "日本", " ", "\r\n", "%%%", "\x1c", "\x85", "é", "_", "word", "’", " the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, ""] + words(900, 8)
    texts += ["".join(r.choice(["word", "été", "12", "end.", "«x»", "n't"]) + r.choice(" \n") for _ in range(30)).strip() for _ in range(500)]
    want = [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    for own in (enc, plain):
        for size in (1, 333, 6000):
            got = []
            for i in range(0, len(texts), size):
                ids, counts = own.encode(pa.array(texts[i : i + size], pa.string()), 7)
                got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == want
            if size == 1:
                texts, want = texts[3000:], want[3000:]
    assert len(enc.encode(pa.array([], pa.string()), 7)[1]) == 0


@pytest.mark.parametrize("ids", ["outlier", "null", "one", "negative"])
def test_ranges(spark, ids):
    """Ranges hold about as many bytes each, whatever the ids are and however the rows are dealt."""
    from cairn.llm.common import range_bounds, range_key, range_of

    r = random.Random(2)
    of = {"outlier": lambda i: 1 << 60 if i == 77 else i, "null": lambda i: None if i % 3 else i, "one": lambda i: 5, "negative": lambda i: (i - 1000) << 50}[ids]
    rows = [(of(i), r.getrandbits(60) - (1 << 59), r.randint(1, 2000)) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, tie long, bytes long")
    keyed = table.select("id", "tie", "bytes", range_key(F.col("id"), F.col("tie")).alias("key"))
    bounds = range_bounds(keyed, 50_000)
    assert bounds == range_bounds(keyed.repartition(7), 50_000) and abs(len(bounds) + 1 - sum(b for *_, b in rows) / 50_000) < 2
    got = keyed.select("id", "tie", "bytes", range_of(F.col("key"), bounds).alias("range")).collect()
    size = collections.Counter()
    for x in got:
        size[x["range"]] += x["bytes"]
    assert set(size) == set(range(len(bounds) + 1)) and max(size.values()) < 54_000
    order = sorted(got, key=lambda x: (x["id"] is not None, x["id"] or 0, x["tie"]))
    assert [x["range"] for x in order] == sorted(x["range"] for x in order)
    assert len(range_bounds(keyed, 50_000, most=3)) <= 3 and range_bounds(keyed.limit(0), 1) == []


def test_wavelet_matrix():
    from cairn.llm import tokens

    r = np.random.default_rng(1)
    for n in (0, 1, 9, 3000):
        ids = r.integers(0, 300, n).astype(np.uint16)
        data = tokens.shard_bytes([1], [n], ids, 9)
        own = tokens.Shard(lambda a, size, data=data: data[a : a + size]).matrix
        assert (own.decode(np.uint16) == ids).all()
        assert all(own.access(i) == ids[i] for i in range(0, n, 97))
        assert own.count(5) == int((ids == 5).sum()) and own.count(700) == 0


# ---------------------------------------------------------------- 6


def test_hashes_of_lower_cased_words():
    """op6: equal words, and no others, have equal hashes, wherever they lie and however long they are."""
    from cairn.llm.common import WordHashes, lower_hashes, word_hashes

    r = random.Random(8)
    long = "Ab" * 200_000
    texts = [" ".join(r.choice(["a", "A", "é", "É", "aa", "b\x0ba", "x-1", "\u00a0", "zz\t"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts = [None, "", " \n ", long, *texts, f" {long.lower()} x ", "y" * 300_000]
    encoded = [t.encode() if t else None for t in texts]
    (one, at), (two, where) = word_hashes(encoded, WordHashes(), lower=True), lower_hashes(encoded)
    assert at.tolist() == where.tolist() and len(one) == len(two)
    assert len(set(zip(one.tolist(), two.tolist()))) == len(set(one.tolist())) == len(set(two.tolist()))
    assert lower_hashes([])[1].tolist() == [0] and lower_hashes([None])[1].tolist() == [0, 0]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney(spark, docs, rows, order):
    from cairn.llm.kneser_ney import discounts, score_texts

    find = lambda t: [*SPACES.findall((t or "").encode().lower().decode()), "\n"]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    train = [find(t) for d, t in rows if not out(d)]
    uni = collections.Counter(w for s in train for w in s)

    def grams(s):
        padded = (None,) * (order - 1) + tuple(s)
        return [padded[i : i + order] for i in range(len(s))]

    counts = {order: collections.Counter(g for s in train for g in grams(s))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {k: (0, *discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))) for k, c in counts.items()}
    total, taken = collections.Counter(), collections.Counter()
    for k, c in counts.items():
        for g, v in c.items():
            total[g[:-1]] += v
            taken[g[:-1]] += d[k][min(v, 3)]
    n, v = sum(uni.values()), len(uni)

    def p(gram):
        x = p(gram[1:]) if len(gram) > 1 else 1 / (v + 1)
        c, context = counts[len(gram)][gram], gram[:-1]
        if total[context]:
            x = max(c - d[len(gram)][min(c, 3)], 0) / total[context] + taken[context] / total[context] * x
        return x

    context = max((g for g in counts[order] if None not in g), key=counts[order].get)[:-1]
    assert abs(sum(p((*context, w)) for w in [*uni, "never seen"]) - 1) < 1e-9
    want = sorted((d is None, d or 0, out(d), len(s), sum(w in uni for w in s), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s), 3), round(sum(math.log10(p(g)) for g in grams(s)), 3)) for d, s in ((d, find(t)) for d, t in rows))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 3)) for r in score_texts(docs, order).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) < 0.01 and abs(a[7] - b[7]) < 0.01
    assert score_texts(empty(spark), order).count() == 0


# ---------------------------------------------------------------- 5


def test_warc(spark):
    from cairn.llm.warc import read_warc, write_warc

    ship(spark)
    html = ["<p>" + "x" * 200, None, "", "short", "short", "é" * 60]
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, html[i % 6], 1, "y") for i in range(60)] + [(3, "http://h/3", html[3], 1, "y"), (None, "http://h/n", html[0], 1, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard int, digest string")
    first = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    want = collections.Counter()
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > first[b]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    options = {"shard_bytes": 500, "file_bytes": 2000}
    manifest = write_warc(pages, **options)
    assert manifest.count() > 3
    assert items(read_warc(manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    again = write_warc(pages.repartition(5), **options)  # the same bytes whatever the partitions
    assert items(again, "shard", "part", "sha256") == items(manifest, "shard", "part", "sha256")
    assert write_warc(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 1


def test_urls(spark):
    from cairn.llm.url_filter import RULES, judge_urls, rule_table

    rows = [
        (1, "http://a.example.net/x", '<link rel="canonical" href="https://b.example.org/es/1">'),
        (2, "http://c.net/y", "<meta http-equiv='refresh' content='0; url=http://A.example.net/x#frag'>"),
        (3, "http://A.org/en", '<link href="/z" rel=canonical>'),
        (4, "http://a.org/z", '<link rel=canonical href="//c.net/y">'),
        (5, None, None),
        (6, "nothing", "x"),
        (7, "https://free.net/?q=1#f", '<link rel="stylesheet" href="http://q.com/de/">'),
        (8, "http://m.example.org/en/12", ""),
        (9, "http://q.com/de/", None),
        (9, "http://q.com/de/", None),
        (10, "http://x.net/a/b?q", '<link rel="canonical" href="c">'),
        (11, "http://x.net/a/c", '<link rel="canonical" href="http://q.com/de/">'),
        (12, "http://notexample.org/es/", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    got = sorted(tuple(r)[:5] for r in judge_urls(pages, rule_table(spark, RULES)).collect())
    assert got == [
        (1, "a.example.net", "/x", None, "block"),
        (2, "c.net", "/y", None, "block"),
        (3, "a.org", "/en", "org/", "allow"),
        (4, "a.org", "/z", "org/", "allow"),
        (5, "", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "free.net", "/", None, "allow"),
        (8, "m.example.org", "/en/12", "example.org/en/1", "block"),
        (9, "q.com", "/de/", "com/de/", "block"),
        (9, "q.com", "/de/", "com/de/", "block"),
        (10, "x.net", "/a/b", None, "block"),
        (11, "x.net", "/a/c", None, "block"),
        (12, "notexample.org", "/es/", "org/", "allow"),
    ]
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0


def test_links(spark):
    """Which tags are links, and where they lead."""
    from cairn.llm.url_filter import links

    at = "http://h.net/a/b/c.html?q"
    cases = [
        ('<link rel=stylesheet title=canonical href="/css">', None),
        ('<link rel="nofollow CANONICAL" data-href="/no" href="/yes">', "http://h.net/yes"),
        ("<link rel=canonical data-href=/no>", None),
        ('<!-- <link rel=canonical href="/no"> -->', None),
        ('<script>"<link rel=canonical href=/no>"</script><link rel=canonical href=/yes>', "http://h.net/yes"),
        ('<link rel="canonicals" href="/no">', None),
        ('<LINK HREF="../d/./e/../f" REL="canonical"/>', "http://h.net/a/d/f"),
        ("<link rel='canonical' href='../../../..'>", "http://h.net/"),
        ('<base href="/x/y"><link rel=canonical href="z?a=1&amp;b=2#c">', "http://h.net/x/z?a=1&b=2"),
        ('<base href="//o.org/q/"><link rel=canonical href="z">', "http://o.org/q/z"),
        ("<link rel=canonical href=mailto:x@y.z>", None),
        ('<meta http-equiv="refresh" content="0; URL=\'/r\'">', "http://h.net/r"),
        ('<meta http-equiv="refresh" content="5, https://E.com">', "https://e.com/"),
        ('<meta http-equiv="refresh" content="30">', None),
        ('<meta name="refresh" content="0; url=/no">', None),
        ("<p>" + "x<link> " * 300_000 + "<link rel=canonical href=/late>", "http://h.net/late"),
        ("<link rel=canonical href=" + "'\"" * 20_000, None),
    ]
    table = spark.createDataFrame([(f"{at}{i}", h) for i, (h, _) in enumerate(cases)], "url string, html string")
    got = {r["url"]: r["target"] for r in links(table).collect()}
    assert {i: got.get(f"{at}{i}") for i in range(len(cases))} == dict(enumerate(t for _, t in cases))


def test_blocks_reach_all_aliases(spark):
    """100,000 links in chains, cycles, a hub and pairs, against a union-find."""
    from cairn.llm.url_filter import RULES, judge_urls, rule_table

    r = random.Random(9)
    url = lambda i: f"http://h{i}.net/p{i}"
    special = {i: f"http://x{i}.com/de/{i}" for i in range(17, 100_000, 9973)} | {i: f"http://a{i}.org/{i}" for i in range(20, 100_000, 501)}
    name = lambda i: special.get(i, url(i))
    goal = {}
    for i in range(100_000):
        if i < 20_000:
            goal[i] = 5 if i != 5 else 19_999  # a hub, in a cycle of two
        elif i < 60_000:
            goal[i] = i + 1 if i % 40 else i - 1  # chains that meet in a pair
        elif i < 80_000:
            goal[i] = i + 1 if i % 10 < 9 else i - 9  # cycles
        else:
            goal[i] = r.randint(80_000, 99_999)
    rows = [(i, name(i), f'<link rel="canonical" href="{name(g)}">' if i % 2 else f"<meta http-equiv=refresh content='0;url={name(g)}'>") for i, g in goal.items()]
    parent = list(range(100_000))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, g in goal.items():
        parent[find(i)] = find(g)
    bad = {find(i) for i in special if "/de/" in special[i]}
    got = {r["page_id"]: (r["verdict"], r["alias_blocked"]) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rule_table(spark, RULES)).collect()}
    want = {i: ("allow" if ".org/" in name(i) else "block" if find(i) in bad else "allow", find(i) in bad) for i in goal}
    assert got == want and {v for v, _ in want.values()} == {"allow", "block"} and sum(v == "allow" and b for v, b in want.values()) > 20


# ---------------------------------------------------------------- 4


def test_feistel():
    from cairn.llm.pseudonyms import Feistel

    for size in (1, 2, 7, 1000, 73049):
        net = Feistel(b"k", "t", size)
        seen = [net.forward(x) for x in range(min(size, 3000))]
        assert len(set(seen)) == len(seen) and [net.backward(y) for y in seen] == list(range(len(seen)))
        assert all(0 <= y < size for y in seen)


def test_iban_before_other_tokens():
    """An IBAN of each country's length is found whatever follows, and nothing else changes."""
    from cairn.llm.pseudonyms import IBAN_LENGTHS, Pseudonymizer

    own, back = Pseudonymizer(b"key"), Pseudonymizer(b"key", undo=True)
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    whole = {}
    for i, (country, n) in enumerate(IBAN_LENGTHS.items()):
        body = "".join(str((i * 7 + k * k) % 10) for k in range(n - 4))
        whole[country] = f"{country}{98 - number(body + country + '00') % 97:02d}{body}"
    assert len(whole) == 89 and all(number(x[4:] + x[:4]) % 97 == 1 for x in whole.values())
    known = ["ES9121000418450200051332", "BE68539007547034", "AT611904300234573201", "DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    assert all(len(x) == IBAN_LENGTHS[x[:2]] for x in known)
    for iban in [*whole.values(), *known]:
        for shown in (iban, " ".join(iban[k : k + 4] for k in range(0, len(iban), 4))):
            for after in ("", " EUR 100", " 12 euros", " PAID", " A note", " EUROS", " 1234 5678 9", " paid", ". ", " AB12 3456 7890", f" {known[0]} X"):
                new, found = own.text(f"to {shown}{after}")
                assert found["iban"] == 1 + (known[0] in after), shown + after
                assert shown not in new
                assert new[len(shown) + 3 :] == after or known[0] in after
                assert back.text(new)[0] == f"to {shown}{after}"
    assert own.text(f"ref AB12 3456 7890 {known[3]}")[1] == {"iban": 1}


def test_pseudonyms(spark):
    from cairn.llm.pseudonyms import Pseudonymizer, luhn_digit, pseudonymize

    own, back = Pseudonymizer(b"key"), Pseudonymizer(b"key", undo=True)
    text = "card 4111 1111 1111 1111 or 4111111111111111, phone +1 (017) 555-7713 and (017) 555-7713, ip 10.0.0.255!! born 1980-02-29 or 29.2.1980, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, mail Jo.e90@mail4.example.com"
    new, found = own.text(text)
    assert found == {"card": 2, "phone": 2, "ipv4": 1, "date": 2, "ssn": 1, "iban": 1, "email": 1}
    assert back.text(new)[0] == text
    cards = re.findall(r"card ([\d ]+) or (\d+)", new)[0]
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn_digit(cards[1][:-1]) == int(cards[1][-1])
    phones = re.findall(r"\+1 (\(\d{3}\) \d{3}-\d{4}) and (\(\d{3}\) \d{3}-\d{4})", new)[0]
    assert phones[0] == phones[1] != "(017) 555-7713"
    iso, dotted = re.findall(r"born ([\d-]+) or ([\d.]+),", new)[0]
    assert datetime.date.fromisoformat(iso) == datetime.date(*reversed([int(x) for x in dotted.split(".")]))
    same = "4111 1111 1111 1112, 1.2.3.400, 2021-02-30, 31.2.2020, version 1.2.3.4.5, 04dbebab91ab85687d33, 12345, CC BY-NC 4.0."
    assert own.text(same) == (same, {})
    ship(spark)
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (None, "", 5), (1, text, 5)], "doc_id long, text string, n_card int")
    rows = sorted((r["doc_id"] or 0, r["text"], r["n_card"]) for r in pseudonymize(docs, b"key").where("text is not null").collect())
    assert rows == [(0, "", 0), (1, new, 2), (1, new, 2)]
    assert pseudonymize(docs.limit(0), b"key").count() == 0


def test_pseudonyms_of_many_values():
    """Each value has one pseudonym in all layouts, no two values have the same, it is valid, and can be undone."""
    from cairn.llm.pseudonyms import Pseudonymizer, luhn_digit

    r = random.Random(6)
    own, back = Pseudonymizer(b"key"), Pseudonymizer(b"key", undo=True)
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    fours = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    bare = lambda s: re.sub(r"\W", "", s)
    values = {"card": {}, "iban": {}, "ssn": {}, "phone": {}, "ipv4": {}, "date": {}, "email": {}}
    for _ in range(700):
        x = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
        values["card"][x + str(luhn_digit(x))] = [lambda v: v, fours, lambda v: fours(v).replace(" ", "-")]
        x = "".join(str(r.randint(0, 9)) for _ in range(18))
        values["iban"][f"DE{98 - number(x + 'DE00') % 97:02d}{x}"] = [lambda v: v, fours]
        values["ssn"][f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"] = [lambda v: v]
        values["ipv4"][".".join(str(r.randint(0, 255)) for _ in range(4))] = [lambda v: v]
        values["email"][f"{r.choice('abcd')}{r.choice('efgh')}n.{r.randint(100, 9999)}"] = [lambda v: f"{v}@x.org", lambda v: f"{v}@mail.y.net"]
        area, rest = f"{r.randint(2, 9)}{r.randint(0, 99):02d}", f"{r.randint(0, 9999999):07d}"
        values["phone"][area + rest] = [lambda v: f"+1{v}", lambda v: f"+1 {v[:3]} {v[3:6]} {v[6:]}", lambda v: f"({v[:3]}) {v[3:6]}-{v[6:]}", lambda v: f"+1-{v[:3]}-{v[3:6]}-{v[6:]}", lambda v: f"{v[:3]}.{v[3:6]}.{v[6:]}"]
    for i in range(0, 73049, 24):
        values["date"][datetime.date(1900, 1, 1) + datetime.timedelta(i)] = []
    for kind, own_values in values.items():
        seen = {}
        for value, layouts in own_values.items():
            if kind == "date":
                layouts = [str, lambda v: f"{v.day:02d}.{v.month:02d}.{v.year}", lambda v: f"{v.month:02d}/{v.day:02d}/{v.year}", lambda v: f"{v.day:02d}/{v.month:02d}/{v.year}"][: 3 + (value.day > 12)]
            news = set()
            for layout in layouts:
                text = f"see {layout(value)} here"
                new, found = own.text(text)
                assert found == {kind: 1} and back.text(new)[0] == text, (kind, text, new)
                got = new[4:-5]
                if kind == "date":
                    parts = [int(x) for x in re.findall(r"\d+", got)]
                    if "/" in got:
                        parts = [parts[2], *(parts[:2] if parts[0] <= 12 else parts[1::-1])]
                    elif "." in got:
                        parts = parts[::-1]
                    news.add(datetime.date(*parts))
                elif kind == "phone":
                    news.add(bare(got)[-10:])
                elif kind == "email":
                    assert got.split("@")[1] == layout(value).split("@")[1]
                    news.add(got.split("@")[0])
                else:
                    news.add(bare(got) if kind != "ipv4" else got)
            assert len(news) == 1, (kind, value, news)
            new = news.pop()
            assert seen.setdefault(new, value) == value
            if kind == "card":
                assert luhn_digit(new[:-1]) == int(new[-1])
            if kind == "iban":
                assert number(new[4:] + new[:4]) % 97 == 1
            if kind == "phone":
                assert (new[0] > "1" and new[3] > "1") == (value[3] > "1")
            if kind == "date":
                assert (new.day > 12) == (value.day > 12)
    assert len(set(bare(own.text(f"tel {t}.")[0]) for t in ("+44 20 7946 0018", "+442079460018", "+44-20-7946-0018"))) == 1
    long = "x " * 3_000_000 + "ssn 123-45-6789"
    assert own.text(long)[1] == {"ssn": 1} and own.text(long)[0][: len(long) - 11] == long[:-11]


# ---------------------------------------------------------------- pipeline


def test_shards_follow_the_mix(spark, tmp_path):
    """The files of the last stage have documents in the mix's order, and start still counts in the order of ids."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from cairn.llm.mixing import exact_order

    table = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7), f"s{i * i % 5 % 3}") for i in range(400)] + [(None, None, None)], "doc_id long, text string, source string")
    corpus_pipeline.mix(spark, table, "").write.option("maxRecordsPerFile", 70).parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.token_output(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    want = [r["doc_id"] for r in sorted(exact_order(table).collect(), key=lambda r: (r["slot"], r["place"]))]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["mix_start"])] == want != sorted(want, key=lambda d: (d is not None, d))
    for column, order in (("mix_start", lambda r: r["mix_start"]), ("start", lambda r: (r["doc_id"] is not None, r["doc_id"]))):
        at = 0
        for r in sorted(got, key=order):
            assert r[column] == at
            at += r["n_tokens"]


def plain_pipeline(rows, bench, outliers):
    """Ids and crc32 of the ids' bytes of what run() leaves, from (doc_id, text, source) rows; outliers are those of MCD."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    gone = set()
    for d, t, _ in rows:
        w = SPACES.findall(t or "")
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            gone.add(d)
    rows = [r for r in rows if r[0] is None or r[0] not in gone | outliers]
    sets = [(d, s) for d, s in sets_of([(d, t) for d, t, _ in rows]) if d is not None and s]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    rows = [r for r in rows if r[0] not in parent or find(r[0]) == r[0]]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: pattern.findall((t or "").translate(low))
    windows = {tuple(w[k : k + 10]) for t in bench if (w := cut(t)) for k in range(max(1, len(w) - 9))}
    dirty = {d for d, t, _ in rows for n in {len(x) for x in windows} for w in [cut(t)] for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows}
    rows = [r for r in rows if r[0] is None or r[0] not in dirty]
    plain, want, start = Tokenizer.from_file(path("byte_bpe_50k.json")), [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_pipeline(spark, tmp_path):
    """run() on 500 documents against plain Python, and each stage's columns."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from cairn.llm.quality import quality_rules

    base = [words(60 + 7 * i % 200, i, 5000) for i in range(430)]
    passage = words(40, 999, 5000)
    texts = [" ".join(w) for w in base]
    texts += [" ".join(base[i]) for i in range(20)] + [" ".join([*base[i][:-2], "x"]) for i in range(20, 40)]
    texts += ["too short", " ".join(base[2] + passage), None, "", " ".join(words(20_000, 77, 5000)), " ".join(f"{w}%%%###" for w in words(80, 5, 5000)), "a b c " * 60]
    texts += [" ".join(words(100, 2000 + i, 5000) + passage[i : i + 12]) for i in range(12)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(7, texts[7], "s1"), (None, texts[9], None), (1000, texts[3] + " tail", None)]
    table = spark.createDataFrame([(d, t, "en", s, len(t or ""), "clash", True) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage[:25])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outliers = {r["doc_id"] for r in quality_rules(docs).where("not base_failed and not kept and doc_id is not null").collect()}
    assert texts.index(next(t for t in texts if t and "###" in t)) in outliers and len(outliers) < 5
    want = plain_pipeline(rows, [" ".join(passage[:25])], outliers)
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect())
    assert got == sorted(x for x in want if x[0] is not None) and 350 < len(got) < 480
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    weights = spark.createDataFrame([("s0", 1.0)], "source string, weight double")
    assert {r["source"] for r in corpus_pipeline.mix(spark, docs, "", weights).collect()} == {"s0"}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
