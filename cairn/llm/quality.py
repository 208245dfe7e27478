"""Quality rules with robust multivariate outliers.

Every document gets counts and, from them, a vector of four transformed statistics: log mean word
length, log share of symbols, share of repeated lines and share of words in repeated windows.  For each
language and source the minimum covariance determinant estimate gives a centre and scatter that outliers
cannot move, and documents beyond a Mahalanobis distance are rejected.

The estimate is deterministic FAST-MCD: concentration steps from three robust starts (median and MAD of each
statistic; the same with the covariance of spatial signs; the same with that of hyperbolic tangents), of which
the h-subset with the smallest determinant wins, then one reweighting step.  A fixed spread (FLOOR) is added
to each variance, as in the regularized estimate, since most statistics are constant in many sources.

A concentration step is one aggregation for all starts: rows fall into bins of their current distance (32 for
each doubling), each bin keeps the count and the sums of first and second moments, and the bins up to the
h-th smallest distance give the next estimate, the last one in the part that is needed for h rows.  Statistics
are fixed-point integers, so that sums are exact and do not depend on partitioning or on retries.  No group's
rows ever meet in one task: a group of any size arrives at the estimating task as at most a few hundred bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Rolling, WordHashes, document_groups, is_small, staged, unstage, word_hashes

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
SCALE = 1024
P = 4
#: Spread below which a statistic counts as unremarkable, in the units of the transformed statistics.
FLOOR = (0.08, 0.35, 0.06, 0.08)
#: Estimates of up to this many groups are broadcast: three rows of 28 numbers for each, 90 MB at most.
BROADCAST_GROUPS = 100_000
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _counts(batches):
    seen = WordHashes()
    for rows, texts in document_groups(batches, 3):
        words, at = word_hashes(texts, seen, lower=False)
        every = Rolling(words).windows(3)
        out = np.zeros((len(texts), 5), np.int64)
        lines_with_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            n = at[i + 1] - at[i]
            if not n:
                continue
            raw = np.frombuffer(t, np.uint8)
            chars = len(t) - int(np.count_nonzero((raw & 0xC0) == 0x80))
            lines = [x for x in t.split(b"\n") if x.strip()]
            repeated = 0
            if n > 3:
                _, which, times = np.unique(every[at[i] : at[i + 1] - 2], return_inverse=True, return_counts=True)
                again = np.zeros(n, bool)
                for shift in range(3):
                    again[shift : n - 2 + shift] |= times[which] > 1
                repeated = int(again.sum())
            out[i] = n, chars - (len(t) - len(t.translate(None, _SPACE))), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated
            lines_with_words[i] = len(lines)
        n_words, word_chars, symbols, dup_lines, repeat = out.T
        many = np.maximum(n_words, 1)
        stats = np.stack([np.log(np.maximum(word_chars, 1) / many), np.log1p(100 * symbols / many), dup_lines / np.maximum(lines_with_words, 1), repeat / many], axis=1)
        fixed = np.rint(stats * SCALE).astype(np.int64)
        cols = [rows.column(0), rows.column(1), rows.column(2), *(pa.array(c) for c in out.T), *(pa.array(np.ascontiguousarray(c)) for c in fixed.T)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"x{i}" for i in range(P))])


def _chi2_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def _chi2_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, degrees) < q else (low, mid)
    return high


STARTS = ("mad", "sign", "tanh")
_COLUMNS = ["level", "kind", "start", "determinant", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in _PAIRS), *(f"v{i}{j}" for i, j in _PAIRS)]
_PARAMETERS = "level string, kind string, start string, " + ", ".join(f"{c} double" for c in _COLUMNS[3:])
_CENTERS = "level string, kind string, " + ", ".join(f"m{i} double, w{i} double" for i in range(P))


def _estimate(key, start: str, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Row of an estimate: regularized determinant, centre, covariance and inverse."""
    full = cov + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(full)
    return pd.DataFrame([[*key[:2], start, float(np.linalg.det(full)), *mean, *(cov[i, j] for i, j in _PAIRS), *(inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS)]], columns=_COLUMNS)


def _square(row, prefix: str) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = row[f"{prefix}{i}{j}"]
    return out


def _center(key, bins):
    """Median and MAD of each statistic from its histogram."""
    mean, spread = np.zeros(P), np.zeros(P)
    for i, own in bins.groupby("i"):
        own = own.sort_values("value")
        at = own["value"].to_numpy() / SCALE
        n = own["n"].to_numpy()
        mean[i] = at[np.searchsorted(np.cumsum(n), (n.sum() + 1) // 2)]
        off = np.abs(at - mean[i])
        order = np.argsort(off, kind="stable")
        spread[i] = 1.4826 * off[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)]
    return pd.DataFrame([[*key, *np.stack([mean, spread], axis=1).reshape(-1)]])


def _starts(key, moments):
    """The three starts of a group from its medians, MADs and the moments of signs and tangents."""
    row = moments.iloc[0]
    mean, spread = np.array([row[f"m{i}"] for i in range(P)]), np.array([row[f"w{i}"] for i in range(P)])
    wide = np.sqrt(np.square(spread) + np.square(FLOOR))
    out = [_estimate(key, "mad", mean, np.diag(np.square(spread)))]
    for start, prefix in (("sign", "g"), ("tanh", "t")):
        q = _square(row, prefix) / float(row["n"]) / SCALE**2
        scale = np.sqrt(np.maximum(np.diag(q), 1e-9))
        r = q / np.outer(scale, scale)
        np.fill_diagonal(r, 1)
        out.append(_estimate(key, start, mean, r * np.outer(wide, wide)))
    return pd.concat(out)


def _stepper(part: float, limit_bin: int | None):
    """Next estimate from the moments of distance bins: those of the h nearest rows, or up to limit_bin."""
    inside = part if limit_bin is None else 0.975
    factor = inside / _chi2_cdf(_chi2_quantile(inside, P), P + 2)

    def step(key, bins):
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy().astype(float)
        upto = np.cumsum(n)
        if limit_bin is None or bins["bin"].iloc[0] > limit_bin:
            h = math.ceil((part if limit_bin is None else 0.5) * upto[-1])
            weight = np.clip((h - (upto - n)) / n, 0, 1)
        else:
            weight = (bins["bin"].to_numpy() <= limit_bin).astype(float)
        total = float((weight * n).sum())
        sums = lambda c: float((weight * bins[c].to_numpy().astype(float)).sum()) / total
        mean = np.array([sums(f"s{i}") for i in range(P)])
        cov = np.zeros((P, P))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = sums(f"q{i}{j}") - mean[i] * mean[j]
        return _estimate(key, key[2], mean / SCALE, factor * cov / SCALE**2)

    return step


def _distance():
    """Squared Mahalanobis distance of x0.. from the estimate that has been joined."""
    off = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(P)]
    return sum((off[i] * off[j] * F.col(f"v{i}{j}") for i, j in _PAIRS), F.lit(0.0))


def robust_outliers(stats: DataFrame, *, part: float = 0.75, steps: int = 5, confidence: float = 0.99999, least_rows: int = 40) -> DataFrame:
    """stats (level, kind, x0..) plus distance2 and outlier, by MCD within each (level, kind).

    Groups of fewer than least_rows rows have no outliers.  No row gives no row.
    """
    group = ["level", "kind"]
    histogram = stats.select(*group, F.posexplode(F.array(*(F.col(f"x{i}") for i in range(P)))).alias("i", "value")).withColumn("value", F.floor(F.col("value") / 16) * 16)
    # staged, or else Spark would bring the tasks' partial counts of a whole group to one task
    histogram = staged(histogram.groupBy(*group, "i", "value").agg(F.count("*").alias("n")), "mcd-histogram")
    center = staged(histogram.groupBy(*group).applyInPandas(_center, _CENTERS), "mcd-center")
    unstage(histogram)
    # one row for each group: broadcast up to a bound, so that the rows are not dealt by group
    hint = F.broadcast if is_small(center, BROADCAST_GROUPS) else (lambda x: x)
    z = [(F.col(f"x{i}") / SCALE - F.col(f"m{i}")) / F.sqrt(F.col(f"w{i}") * F.col(f"w{i}") + FLOOR[i] ** 2) for i in range(P)]
    norm = F.greatest(F.sqrt(sum((x * x for x in z), F.lit(0.0))), F.lit(1e-9))
    fixed = lambda x: F.round(x * SCALE).cast("long")
    scaled = stats.join(hint(center), group).select(*group, *(fixed(x / norm).alias(f"g{i}") for i, x in enumerate(z)), *(fixed(F.tanh(x)).alias(f"t{i}") for i, x in enumerate(z)), F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(64)).alias("salt"))
    products = [F.sum(F.col(f"{p}{i}") * F.col(f"{p}{j}")).alias(f"{p}{i}{j}") for p in "gt" for i, j in _PAIRS]
    moments = staged(scaled.groupBy(*group, "salt").agg(F.count("*").alias("n"), *products), "mcd-moments")
    moments = moments.groupBy(*group).agg(*(F.sum(c).alias(c) for c in moments.columns[3:])).join(center, group)
    now = staged(moments.groupBy(*group).applyInPandas(_starts, _PARAMETERS), "mcd-estimate")
    cut = _chi2_quantile(0.975, P)
    for k in range(steps + 1):
        if k == steps:  # of the starts the one with the smallest determinant goes on
            best = F.row_number().over(Window.partitionBy(*group).orderBy("determinant", "start"))
            now, before = staged(now.withColumn("nth", best).where("nth = 1").drop("nth"), "mcd-best"), now
            unstage(before)
        bins = stats.join(hint(now), group).withColumn("bin", F.floor(32 * F.log2(1 + F.least(_distance(), F.lit(1e12)))).cast("int"))
        sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]
        bins = staged(bins.groupBy(*group, "start", "bin").agg(F.count("*").alias("n"), *sums), "mcd-bins")
        step = _stepper(part, int(32 * math.log2(1 + cut)) if k == steps else None)
        after = staged(bins.groupBy(*group, "start").applyInPandas(step, _PARAMETERS), "mcd-estimate")
        unstage(now, bins)
        now = after
    unstage(center)
    enough = staged(stats.groupBy(*group).agg((F.count("*") >= least_rows).alias("enough")), "mcd-sizes")
    d2 = stats.join(hint(now.join(enough, group)), group, "left").withColumn("distance2", _distance())
    return d2.withColumn("outlier", F.coalesce(F.col("enough") & (F.col("distance2") > _chi2_quantile(confidence, P)), F.lit(False)))


def quality_rules(docs: DataFrame, *, least_rows: int = 40, confidence: float = 0.99999) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): counts, base_failed, distance2 and kept.

    Words are runs of other characters than the six ASCII white-space ones.  A null or empty text has no
    words and fails the base rules.  The estimates come from all rows that pass the base rules.  Languages
    and sources with fewer than least_rows of them are pooled by language, then all together; what is
    still too few to estimate is kept.  A null language or source is a value of its own.  Repeated rows
    are judged alike.  A text of any length is judged whole.  No row gives no row.  Columns other than the
    four are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"x{i} long" for i in range(P))
    counted = docs.mapInArrow(_counts, schema)
    counted = staged(counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality-counts")
    good = counted.where("not base_failed")

    # which estimate judges a (lang, source): its own, that of the language's small sources, that of all small ones
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < least_rows)
    pooled = sizes.where("small").groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "lang2")
    levels = sizes.join(pooled, F.col("lang").eqNullSafe(F.col("lang2")), "left").select(
        F.col("lang").alias("of_lang"),
        F.col("source").alias("of_source"),
        F.when(~F.col("small"), "source").when(F.col("n_lang") >= least_rows, "lang").otherwise("all").alias("level"),
        F.when(~F.col("small"), F.to_json(F.array("lang", "source"))).when(F.col("n_lang") >= least_rows, F.to_json(F.array("lang"))).otherwise("").alias("kind"),
    )
    levels = staged(levels, "quality-levels")
    placed = good.join(levels, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    placed = staged(placed.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "level", "kind", *(f"x{i}" for i in range(P))), "quality-placed")
    judged = robust_outliers(placed, least_rows=least_rows, confidence=confidence)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, (~F.col("outlier")).alias("kept"), "distance2").unionByName(counted.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")))
