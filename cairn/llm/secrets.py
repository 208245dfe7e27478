"""Secret scans with DataFrame functions alone: fixed patterns, and windows of high entropy in candidate strings.

All work on a text is array functions on its own row, so that nothing is shuffled, no text meets another and a text that every
source repeats weighs no more than any other.

Places: the matches of a pattern and what lies between them alternate, so that their lengths add up to the places.
The sums are taken in blocks, as adding up all that came before would take time with the square of the matches.

Entropy: a window slides over each maximal run of a class of characters.  Its counts are bytes of one binary value; a step
takes the character that leaves from its count and adds the one that enters to its own, and only what these two
add to the sum of c log2(c) changes.  The window's entropy is log2(w) - sum / w, so a sum of at most w (log2(w) - bits) marks it; sums are
whole numbers, from a table.  Marked windows that touch are one span.  Long runs are cut into
segments that overlap by a window less one character, which has the same windows and bounds the memory.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Class(NamedTuple):
    """Characters of a class, as inside brackets of a pattern, its window and the least entropy in bits of a character."""

    kind: str
    characters: str
    window: int
    bits: float


#: From the narrowest class to the widest; a run of one class is left to a narrower one that has all its characters.
CLASSES = [Class("entropy_hex", "0-9A-Fa-f", 20, 3.0), Class("entropy_alnum", "A-Za-z0-9", 20, 3.7), Class("entropy_base64", "A-Za-z0-9+/_-", 20, 3.9)]
#: What may stand around a candidate: declared digests are no secrets.
DECLARED = r"(?:sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|md5|digest|checksum|integrity|commit|etag|fingerprint)[\x22\x27]?[\x20:=@-]*[\x22\x27]?\z"
BEFORE = 24
#: Runs that are no secrets: a UUID, one that is marked as an example, and parts of these sequences.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"
EXAMPLE = "example"
SEQUENCES = ["0123456789abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz0123456789+/", "qwertyuiopasdfghjklzxcvbnm1234567890"]
#: Letters and digits touch in a secret, but not in numbers, words, slugs and paths.
TOUCHING = "[A-Za-z][0-9]|[0-9][A-Za-z]"

#: The base patterns, and the lengths that their matches need.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)\z"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
BASE_KINDS = ["assign", "access", "hex"]
_RUN = "A-Za-z0-9+/_-"
#: Shortest run that may hold a match of ACCESS or HEX; classes have longer windows.
LEAST_RUN = 16

#: Windows that a segment begins, and matches whose lengths are added up at once.
SEGMENT, SUMMED = 4096, 64
#: Parts of a bit.
_PARTS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(window: int) -> list[int]:
    """c log2(c) for counts up to the window, in whole parts."""
    return [round(c * math.log2(c) * _PARTS) if c else 0 for c in range(window + 1)]


def most_sum(window: int, bits: float) -> int:
    """The largest sum of terms at which a window has at least so many bits."""
    return math.floor(window * (math.log2(window) - bits) * _PARTS)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(characters: str, least: int) -> str:
    """Pattern of the maximal runs of characters of at least this length."""
    return f"(?<![{characters}])[{characters}]{{{least},}}+"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, value, before>> of all matches: their places in code points and the last characters before.

    What stands before is taken from two matches back on, which is all that is asked of if matches have half of it at least.
    """

    def place(values: Column, gaps: Column, sizes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SUMMED).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * SUMMED + 1, SUMMED), F.lit(0), lambda a, x: a + x))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

        def one(starts: Column):
            def at(value: Column, i: Column) -> Column:
                block = F.floor(i / SUMMED).cast("int")
                gap = F.get(gaps, i)
                inner = F.aggregate(F.slice(sizes, block * SUMMED + 1, i % SUMMED), F.lit(0), lambda a, x: a + x)
                return F.struct((F.get(starts, block) + inner + F.length(gap)).alias("start"), value.alias("value"), F.right(F.concat_ws("", F.get(values, i - 2), F.get(gaps, i - 1), F.get(values, i - 1), gap), F.lit(BEFORE)).alias("before"))

            return F.transform(values, at)

        return _let(starts, one)

    def found(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        whole = _let(gaps, lambda g: _let(F.transform(values, lambda v, i: F.length(v) + F.length(F.get(g, i))), lambda s: place(values, g, s)))
        return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<struct<start:int,value:string,before:string>>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _span(kind: str, order: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("nth"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _code(bytes_: Column, at: Column) -> Column:
    """The byte at a place from 1; all are below 128."""
    return F.ascii(F.substring(bytes_, at, F.lit(1)).cast("string"))


def _marked(segment: Column, c: Class) -> Column:
    """array<struct<from, to>> of the windows of a binary segment that have the class's entropy, those that touch being one."""
    w = c.window
    table = terms(w)
    more = F.array(*(F.lit(b - a) for a, b in zip(table, table[1:], strict=False)))  # what one more adds
    steps = F.transform(F.sequence(F.lit(1), F.length(segment)), lambda j: F.struct(j.alias("j"), _code(segment, j).alias("enters"), F.when(j > w, _code(segment, j - w)).alias("leaves")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    count = lambda counts, code: _code(counts, code + 1)
    put = lambda counts, code, n: F.overlay(counts, F.char(n).cast("binary"), code + 1, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, counts = x["enters"], x["leaves"], acc["counts"]
        here = F.when(leaves == enters, F.struct(acc["sum"].alias("sum"), counts.alias("counts"))).otherwise(
            _let(
                F.struct(count(counts, enters).alias("a"), F.coalesce(count(counts, leaves), F.lit(0)).alias("b")),
                lambda n: F.struct(
                    (acc["sum"] + F.get(more, n["a"]) - F.coalesce(F.get(more, n["b"] - 1), F.lit(0))).alias("sum"),
                    F.when(leaves.isNull(), put(counts, enters, n["a"] + 1)).otherwise(put(put(counts, enters, n["a"] + 1), leaves, n["b"] - 1)).alias("counts"),
                ),
            )
        )

        def spans(now: Column) -> Column:
            j, start = x["j"], x["j"] - w
            mark = (start >= 0) & (now["sum"] <= most_sum(w, c.bits))
            goes_on = mark & (acc["to"] >= start)
            begins = mark & (acc["to"] < start)
            done = F.when(begins & (acc["to"] > 0), F.array_append(acc["done"], F.struct(acc["from"].alias("from"), acc["to"].alias("to")))).otherwise(acc["done"])
            return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), F.when(begins, start).otherwise(acc["from"]).alias("from"), F.when(goes_on | begins, j).otherwise(acc["to"]).alias("to"), done.alias("done"))

        return _let(here, spans)

    zero = F.struct(F.unhex(F.lit("00" * 128)).alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), none.alias("done"))
    last = lambda acc: F.when(acc["to"] > 0, F.array_append(acc["done"], F.struct(acc["from"].alias("from"), acc["to"].alias("to")))).otherwise(acc["done"])
    return F.aggregate(steps, zero, step, last)


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch being one."""

    def ends(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | F.coalesce(F.get(s, i - 1)["to"] < x["from"], F.lit(True)))
        last = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["from"] > x["to"], F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a["from"].alias("from"), b["to"].alias("to")))

    return _let(spans, ends)


def entropy_spans(run: Column, c: Class) -> Column:
    """array<struct<from, to>>: where the windows of a run of one-byte characters have the class's entropy, and touch."""

    def cut(data: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.length(data) - c.window, F.lit(0)), F.lit(SEGMENT))
        of = lambda b: F.transform(_marked(F.substring(data, b + 1, F.lit(SEGMENT + c.window - 1)), c), lambda s: F.struct((s["from"] + b).alias("from"), (s["to"] + b).alias("to")))
        return _joined(F.flatten(F.transform(begins, of)))

    return _let(run.cast("binary"), cut)


def _is_allowed(run: Column, before: Column, allowed: list[str]) -> Column:
    """Whether a run is no secret: by what it is, by what stands before it, or by a pattern of the caller."""
    low = F.translate(run, _UPPER, _LOWER)
    rules = [~run.rlike(TOUCHING), run.rlike(UUID), F.contains(low, F.lit(EXAMPLE)), F.translate(before, _UPPER, _LOWER).rlike(DECLARED)]
    rules += [F.contains(F.lit(s), low) for s in SEQUENCES] + [run.rlike(p) for p in allowed]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def _added(candidate: Column, k: int, classes: list[Class], allowed: list[str]) -> Column:
    """Spans of one class in a candidate."""
    c = classes[k]

    def of(run: Column) -> Column:
        ahead = F.substring(candidate["value"].cast("binary"), F.greatest(run["start"] - BEFORE, F.lit(0)) + 1, F.least(run["start"], F.lit(BEFORE))).cast("string")
        before = F.right(F.concat(candidate["before"], ahead), F.lit(BEFORE))
        left = _is_allowed(run["value"], before, allowed)
        if k:
            left = left | run["value"].rlike(f"^[{classes[k - 1].characters}]+\\z")
        at = candidate["start"] + run["start"]
        spans = F.transform(entropy_spans(run["value"], c), lambda s: _span(c.kind, len(BASE_KINDS) + k, at + s["from"], at + s["to"]))
        return F.when(left, _no_spans()).otherwise(spans)

    return F.flatten(F.transform(located(candidate["value"], _runs(c.characters, c.window)), of))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,nth:int,kind:string,end:int>>")


def find_secrets(docs: DataFrame, classes: list[Class] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, base and added, arrays of (start, nth, kind, end) in that order.

    base are the matches of the fixed patterns, added the spans of high entropy; both are places in code points of the
    whole text, ends exclusive, and spans of different kinds may overlap.  allowed are patterns of runs that are
    no secrets, beside numbers, words, slugs, paths, UUIDs, examples, sequences and declared digests; base spans stay whatever
    they are.  A null text counts as an empty one and has none.  Rows that share an id, or have none, keep their own
    spans; other columns are ignored, and an empty table gives none.
    """
    classes, allowed = CLASSES if classes is None else classes, allowed or []
    if any(not 1 < c.window < 128 for c in classes):
        raise ValueError("a window has from 2 to 127 characters, as its counts are bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", located(F.col("text"), ASSIGN).alias("assigns"), located(F.col("text"), _runs(_RUN, LEAST_RUN)).alias("runs"))
    assigns = F.filter("assigns", lambda m: F.length(F.regexp_extract(m["value"], ASSIGNED, 1)) >= LEAST_ASSIGNED)
    inside = lambda kind, k, pattern: F.flatten(F.transform("runs", lambda c: F.transform(located(c["value"], pattern), lambda m: _span(kind, k, c["start"] + m["start"], c["start"] + m["start"] + F.length(m["value"])))))
    base = F.concat(F.transform(assigns, lambda m: _span("assign", 0, m["start"], m["start"] + F.length(m["value"]))), inside("access", 1, ACCESS), inside("hex", 2, HEX))
    added = F.flatten(F.transform("runs", lambda c: F.concat(_no_spans(), *(_added(c, k, classes, allowed) for k in range(len(classes))))))
    return rows.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(added).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_digest(found: DataFrame) -> DataFrame:
    """Rows of find_secrets with counts of the base kinds, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base", "added"))).alias("spans")
    )
