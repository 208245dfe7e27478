"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

The windows of each benchmark item (10 consecutive words; a shorter item is one window) are sets of
positioned shingles of 3 words.  A window occurs only where all of its shingles do, so one shingle is
the necessary prefix, and the rarest in the corpus is the cheapest.

1. One pass over the documents keeps the occurrences of benchmark shingles; nothing else is shuffled.
2. Their counts order each window's shingles by rarity; a window with a shingle that never occurs is out.
3. Occurrences of a window's rarest shingle become candidates if the window fits the document there
   (positional and length bound).
4. A candidate is verified when each of its shingles occurs, word for word, at its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import is_small, staged, unstage

#: Fixed pattern of the contract: what a word consists of.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of shingles up to this many rows is broadcast, 64 MB or less.
BROADCAST_ROWS = 1_000_000


def words_of(text):
    """Words of a text column after A-Z are lower-cased; lower() does that alone if all is ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows: window, length, item; shingles of distinct windows: window, length, offset, w0.., size)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))).alias("at"))
    windows = starts.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("words")).select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("length"), "words").distinct()
    one = windows.select("window", "length", "words").distinct().withColumn("size", F.least("length", F.lit(shingle)))
    parts = one.select("window", "length", "size", "words", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    word = lambda i: F.when(F.col("size") > i, F.get("words", F.col("offset") + i))
    return windows.select("item", "window"), parts.select("window", "length", "size", "offset", *(word(i).alias(f"w{i}") for i in range(shingle)))


def _key(size: int):
    return F.xxhash64(F.lit(size), *(F.col(f"w{i}") for i in range(size)))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits; items without words or without an id are in no
    document.  Repeated rows and repeated or null doc_ids are judged row by row.  Equal windows of
    several items count for each of them.  Other columns are ignored.  Shingles that are equally rare go by their words, which
    changes no result; texts of any length are searched whole; an empty table gives no row, and without items nothing is hit.
    """
    windows, parts = item_windows(benchmark.select("item_id", "text"), window, shingle)
    windows, parts = staged(windows, "bench-windows"), staged(parts, "bench-shingles")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most `shingle` rows
    names = [f"w{i}" for i in range(shingle)]
    keyed = None
    for size in sizes or [shingle]:
        own = parts.where(F.col("size") == size).select(_key(size).alias("key"), F.lit(size).alias("size"), *(F.col(n).alias(f"b{n}") for n in names)).distinct()
        keyed = own if keyed is None else keyed.union(own)
    keyed = staged(keyed, "bench-keys")
    hint = F.broadcast if is_small(keyed, BROADCAST_ROWS) else (lambda x: x)

    # words with their two successors; the first word's row, or that without a word, also stands for the document
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row"))
    shifted = [F.when(F.size("words") > i, F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias(f"s{i}") for i in range(shingle)]
    source = source.select("row", "doc_id", F.size("words").alias("n_words"), *shifted)
    each = source.select("row", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(*(f"s{i}" for i in range(shingle)))).alias("pos", "w"))
    each = each.select("row", "doc_id", "n_words", "pos", *(F.col(f"w.s{i}").alias(f"w{i}") for i in range(shingle)))
    found = None
    for k, size in enumerate(sizes or [shingle]):
        own = hint(keyed.where(F.col("size") == size).select("key", *(f"b{n}" for n in names[:size])))
        fits = [F.col(f"w{i}") == F.col(f"bw{i}") for i in range(size)]
        keys = each.withColumn("k", F.when(F.col(f"w{size - 1}").isNotNull(), _key(size)))
        joined = keys.join(own, [F.col("k") == F.col("key"), *fits], "left" if k == 0 else "inner")
        joined = joined.where(F.col("key").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)) if k == 0 else joined
        joined = joined.select("row", "doc_id", "n_words", "pos", "key")
        found = joined if found is None else found.union(joined)
    found = staged(found, "bench-found")

    rarity = staged(found.where("key is not null").groupBy("key").agg(F.count("*").alias("freq")), "bench-rarity")
    sized = None
    for size in sizes or [shingle]:
        own = parts.where(F.col("size") == size).select("window", "length", "size", "offset", _key(size).alias("key"))
        sized = own if sized is None else sized.union(own)
    ranked = staged(sized.join(rarity, "key", "left"), "bench-ranked")
    best = ranked.groupBy("window", "length", "size").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "key")).alias("best")).where("best.freq > 0")
    best = staged(best.select("window", "length", F.col("best.key").alias("key"), F.col("best.offset").alias("offset"), (F.col("length") - F.col("size") + 1).alias("needed")), "bench-prefix")
    candidates = found.where("key is not null").join(best, "key").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 and start + length <= n_words").select("row", "start", "window", "length", "needed")
    candidates = staged(candidates, "bench-candidates")
    places = candidates.join(ranked.select("window", "offset", "key"), "window").select("row", "start", "window", "length", "needed", (F.col("start") + F.col("offset")).alias("pos"), "key")
    here = found.where("key is not null").select("row", "pos", "key")
    hits = places.join(here, ["row", "pos", "key"]).groupBy("row", "start", "window", "length", "needed").agg(F.count("*").alias("n")).where("n = needed")
    hits = staged(hits.select("row", "start", "window", "length"), "bench-hits")

    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = hits.select("row", "window").distinct().join(windows, "window").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = covered.join(items, "row")
    every = found.where("pos is null or pos = 0").select("row", "doc_id", "n_words").distinct()
    result = every.join(both, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    unstage(parts, keyed, rarity, ranked, best, candidates)
    return result
