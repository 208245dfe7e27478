"""Interpolated modified Kneser-Ney model of any order, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting passes packed blocks of rows between tasks, one block for each task and bucket, so that a
row of the shuffle stands for thousands of n-grams:

1. words: 64-bit word hashes with their counts, in buckets of the hash's leading bits.  A bucket becomes one
   file; a word's id is its rank by count in the bucket and then the bucket, so that frequent words have small ids,
   which pack well.
2. grams of the full order: runs of ids, each text after order - 1 begin ids, with their counts.  The key of a gram is a
   64-bit hash of its ids; buckets of the key are even however frequent a word or a context is.
3. shorter grams, one order at a time down to single words: each bucket adds up what its grams tell of the grams one word shorter.
   A gram's last words have one more word before them, which is the count of a lower order; its first words are a context
   with the gram's count and with one more word seen once, twice or more often after it.

A bucket's file holds 48 bits of each sorted key behind those of the bucket, and a byte for each that stands for one of the bucket's
usual sets of (count) or (count, total, seen once, twice, more often after it); other rows follow in full.  A lookup meets the row of
another gram with a probability of the bucket's rows in 2^48.

The passes over grams are one job, without tables between them: figures of the files travel along with the blocks.

Scoring maps all files in every Python worker; queries are sorted and searched bucket by bucket.  The
files live in the shared folder; from a store without local paths each is copied to the worker's disk first.
A task that runs again writes the same bytes to the same name.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U64, document_groups, file_system, fresh_path, lower_hashes, mixed, release, staged, unstage

#: Stands for the end of a text; no word contains a line feed.
END = U64(xxhash.xxh3_64_intdigest(b"\n</s>"))
#: Words of the longest grams.
ORDER = 3
#: Text bytes for each bucket of words and of grams, and the bound of their number.
BUCKET_BYTES, MOST_BUCKETS = 12 << 20, 1 << 16
#: Distinct keys that a map task holds before it emits them.
HELD_KEYS = 4_000_000
_ODD = U64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- packed blocks


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(keys, prepend=keys.dtype.type(0))) + b"".join(_planes(v) for v in values))


def _unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, out, at = len(raw) // sum(np.dtype(t).itemsize for t in dtypes), [], 0
    for t in map(np.dtype, dtypes):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += n * t.itemsize
    return [np.cumsum(out[0], dtype=out[0].dtype), *out[1:]]


def _merged(keys: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with a column of ids and the sums of the columns of values for each."""
    if not len(keys):
        return keys, ids, values
    order = np.argsort(keys)  # rows of one key have the same ids, so any order of them does
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], ids[:, order[first]], np.add.reduceat(values[:, order], first, axis=1)


def _split(keys: np.ndarray, bits: int):
    """(bucket, slice) of sorted keys by their leading bits."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(0, int)
    for b, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)):
        if hi > lo:
            yield b, slice(lo, hi)


def _packed(ids: np.ndarray, values: np.ndarray) -> bytes:
    """Rows of ids and values, in the order of the first ids, which leaves least to store."""
    order = np.argsort(ids[0].astype(U64) << U64(32) | ids[min(1, len(ids) - 1)].astype(U64))
    return _pack(*ids[:, order], *values[:, order])


class _Held:
    """Keys with ids and counts, put together until there are many of them, and then emitted by bucket."""

    def __init__(self, bits: int, pack):
        self.bits, self.pack, self.parts, self.n = bits, pack, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(first, append=len(keys))
        keys = keys[first]
        self.parts.append((keys, ids[:, order[first]], counts[None]))
        self.n += len(keys)
        if self.n > HELD_KEYS:
            yield from self.emit()

    def emit(self):
        if not self.parts:
            return
        keys, ids, counts = (np.concatenate([p[i] for p in self.parts], axis=-1) for i in range(3))
        self.parts, self.n = [], 0
        keys, ids, counts = _merged(keys, ids, counts)
        rows = [(b, self.pack(keys[own], ids[:, own], counts[:, own])) for b, own in _split(keys, self.bits)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "block"])


# ---------------------------------------------------------------- files


def _save(folder: str, name: str, data: bytes) -> None:
    store, top = file_system(folder)
    temporary = f"{top}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    store.move(temporary, f"{top}/{name}")


def _mapped(folder: str, name: str) -> np.ndarray:
    """Bytes of a file, memory-mapped."""
    from pyarrow import fs

    store, top = file_system(folder)
    path = f"{top}/{name}"
    if not isinstance(store, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), hashlib.sha1(folder.encode()).hexdigest() + "-" + name)
        if not os.path.exists(local):
            with store.open_input_stream(path, compression=None) as f, open(f"{local}.{uuid.uuid4().hex}", "wb") as g:
                g.write(f.read())
            os.replace(g.name, local)
        path = local
    return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class _Words:
    def __init__(self, folder: str, bits: int, sizes: list[tuple[int, int]]):
        self.folder, self.bits, self.sizes, self.files = folder, bits, dict(sizes), {}
        #: Ids of the begin of a text and of all words that are not known.
        self.begin = max(self.sizes.values(), default=0) << bits
        self.unknown = self.begin + 1
        self.dtype = np.uint32 if self.unknown < 1 << 32 else U64

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, training counts) of sorted hashes."""
        ids, counts = np.full(len(hashes), self.unknown, self.dtype), np.zeros(len(hashes), np.int64)
        for b, own in _split(hashes, self.bits):
            if b in self.sizes:
                n = self.sizes[b]
                if b not in self.files:
                    self.files[b] = _mapped(self.folder, f"words-{b:05d}")
                at, hit = _find(self.files[b][: 8 * n].view(U64), hashes[own])
                numbers = self.files[b][8 * n :].view(np.int64).reshape(2, n)[:, at]
                counts[own] = np.where(hit, numbers[0], 0)
                ids[own] = np.where(hit, numbers[1] << self.bits | b, self.unknown)
        return ids, counts


#: Sets of numbers that a file names with one byte; this byte itself stands for a row that is given in full.
_SETS = 255


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32 bits of keys behind those of the bucket, and the next 16."""
    rest = keys << U64(bits)
    return (rest >> U64(32)).astype(np.uint32), (rest >> U64(16)).astype(np.uint16)


def _save_level(folder: str, level: int, bucket: int, bits: int, keys: np.ndarray, values: np.ndarray) -> int:
    """Write one bucket's file of a level; the number of rows that it gives in full."""
    shifts = 8 * np.arange(len(values))[:, None]
    sets, own, times = np.unique((np.minimum(values, 255) << shifts).sum(axis=0), return_inverse=True, return_counts=True)
    numbers = sets >> shifts & 255
    fits = (numbers < 255).all(axis=0)
    best = np.argsort(-times * fits, kind="stable")[:_SETS]
    best = best[fits[best]]
    codes = np.full(len(sets), _SETS, np.uint8)
    codes[best] = np.arange(len(best))
    table = np.zeros((len(values), _SETS + 1), np.int64)
    table[:, : len(best)] = numbers[:, best]
    codes = codes[own]
    full = np.flatnonzero(codes == _SETS)
    high, low = _cut(keys, bits)
    _save(folder, f"level{level}-{bucket:05d}", b"".join(x.tobytes() for x in (table, values[:, full], full.astype(np.uint32), high, low, codes)))
    return len(full)


class _Level:
    """Numbers of the grams of one length, from the files of their buckets; sizes has (rows, rows in full)."""

    def __init__(self, folder: str, level: int, columns: int, bits: int, sizes: dict[int, tuple[int, int]]):
        self.folder, self.level, self.columns, self.bits, self.sizes, self.files = folder, level, columns, bits, sizes, {}

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """One column of numbers for each of the keys, sorted; zeros for a gram that is not there."""
        out = np.zeros((self.columns, len(keys)), np.int64)
        for b, own in _split(keys, self.bits):
            if b not in self.sizes:
                continue
            if b not in self.files:
                self.files[b] = _mapped(self.folder, f"level{self.level}-{b:05d}")
            n, full = self.sizes[b]
            sizes = [8 * self.columns * (_SETS + 1), 8 * self.columns * full, 4 * full, 4 * n, 2 * n, n]
            table, values, rows, high, low, codes = (x.view(t) for x, t in zip(np.split(self.files[b], np.cumsum(sizes)[:-1]), (np.int64, np.int64, np.uint32, np.uint32, np.uint16, np.uint8), strict=True))
            first, second = _cut(keys[own], self.bits)
            at = np.searchsorted(high, first)
            while True:  # a few rows share their first 32 bits
                here = np.minimum(at, n - 1)
                same = (high[here] == first) & (at < n)
                hit = same & (low[here] == second)
                if (hit == same).all():
                    break
                at += same & ~hit
            code = codes[here]
            part = table.reshape(self.columns, -1)[:, code] * hit
            big = np.flatnonzero(hit & (code == _SETS))
            if len(big):
                part[:, big] = values.reshape(self.columns, full)[:, np.searchsorted(rows, here[big])]
            out[:, own] = part
        return out


# ---------------------------------------------------------------- grams


def _longer(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of the grams that go on with ids."""
    return mixed(keys * _ODD + ids.astype(U64))


def _key(ids: np.ndarray) -> np.ndarray:
    """Keys of grams, one in each column of ids."""
    keys = np.zeros(ids.shape[1], U64)
    for row in ids:
        keys = _longer(keys, row)
    return keys


class _Sequences:
    """Tokens of a group of texts, and the same with order - 1 begins before each text."""

    def __init__(self, texts, words: _Words, order: int):
        hashes, at = lower_hashes(texts)
        hashes = np.insert(hashes, at[1:], END)
        #: Where each text begins among the tokens, and how many it has.
        self.first = at[:-1] + np.arange(len(texts))
        self.sizes = np.diff(np.append(self.first, len(hashes)))
        distinct, inverse = np.unique(hashes, return_inverse=True)
        ids, counts = words.ids(distinct)
        self.counts = counts[inverse]
        #: Places of the tokens among all, distinct ids, and which of them is at each place.
        self.place = np.arange(len(hashes)) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), self.sizes)
        self.distinct = np.append(ids, words.dtype(words.begin))
        self.which = np.full(len(hashes) + len(texts) * (order - 1), len(ids))
        self.which[self.place] = inverse
        self.ids = self.distinct[self.which]


# ---------------------------------------------------------------- tasks


def _word_counter(bits: int):
    def count(batches):
        held = _Held(bits, lambda keys, _, counts: _pack(keys, *counts))
        for _, texts in document_groups(batches):
            hashes = np.concatenate([lower_hashes(texts)[0], np.full(len(texts), END)])
            yield from held.add(hashes, np.zeros((0, len(hashes)), np.uint32))
        yield from held.emit()

    return count


def _gathered(batches, *dtypes, figures: list | None = None):
    """For each bucket of a partition: its number and the columns of all its blocks; rows without a block go to figures."""
    held: dict[int, list] = {}
    for batch in batches:
        for i, (bucket, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if block is None:
                figures.append((bucket, batch.column(2)[i].as_py()))
            else:
                held.setdefault(bucket, []).append(_unpack(block, *dtypes))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        yield bucket, [np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))]


def _word_writer(folder: str):
    def write(batches):
        out = []
        for bucket, (keys, counts) in _gathered(batches, U64, np.int64):
            keys, _, (counts,) = _merged(keys, np.zeros((0, len(keys)), np.uint32), counts[None])
            ranks = np.empty_like(counts)
            ranks[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
            _save(folder, f"words-{bucket:05d}", keys.tobytes() + counts.tobytes() + ranks.tobytes())
            out.append((bucket, len(keys), int(counts.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["bucket", "n", "total"])

    return write


def _gram_counter(folder: str, order: int, word_bits: int, sizes: list, bits: int):
    def count(batches):
        words, held = _Words(folder, word_bits, sizes), _Held(bits, lambda _, ids, counts: _packed(ids, counts))
        for _, texts in document_groups(batches):
            own = _Sequences(texts, words, order)
            grams = np.stack([own.ids[own.place - k] for k in range(order - 1, -1, -1)])
            yield from held.add(_key(grams), grams)
        yield from held.emit()

    return count


def _level_writer(folder: str, level: int, columns: int, bits: int, dtype):
    """Write the files of a level; rows (bucket, block, figures) for the next one.

    The blocks are for its buckets; a row of figures (level, bucket, n, full, n1..n4, more, total) has no block and is passed on.
    """

    def write(batches):
        figures: list = []
        for bucket, parts in _gathered(batches, *[dtype] * level, *[np.int64] * columns, figures=figures):
            ids = np.stack(parts[:level])
            keys, ids, values = _merged(_key(ids), ids, np.stack(parts[level:]))
            del parts
            full = _save_level(folder, level, bucket, bits, keys, values)
            count = values[0]
            figures.append((bucket, [level, bucket, len(keys), full, *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count >= 3).sum()), int(count.sum())]))
            if level > 1:
                seen = np.flatnonzero(count)  # others are contexts only
                ids, count = ids[:, seen], count[seen]
                none, one = np.zeros(len(seen), np.int64), np.ones(len(seen), np.int64)
                last, first = [one, none, none, none, none], [none, count, count == 1, count == 2, count >= 3]
                short = np.concatenate([ids[1:], ids[:-1]], axis=1)
                keys, short, values = _merged(_key(short), short, np.stack([np.concatenate([x, y]) for x, y in zip(last, first, strict=True)]))
                rows = [(b, _packed(short[:, own], values[:, own])) for b, own in _split(keys, bits)]
                yield _stream([b for b, _ in rows], [x for _, x in rows], [None] * len(rows))
        yield _stream([b for b, _ in figures], [None] * len(figures), [x for _, x in figures])

    return write


def _stream(buckets: list, blocks: list, figures: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary()), pa.array(figures, pa.list_(pa.int64()))], ["bucket", "block", "figures"])


# ---------------------------------------------------------------- model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; 0.5, 1 and 1.5 where a number of counts is 0.

    They are kept above 0, where odd counts would take all mass from what was not seen.
    """
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.01), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """What the tasks need to know of the files: sizes of buckets, discounts and a few totals."""

    def __init__(self, folder: str, order: int, bits: int, words: list, tokens: int):
        self.folder, self.order, self.bits, self.words, self.tokens = folder, order, bits, words, tokens
        self.vocabulary = sum(n for _, n in words)
        #: For each length of grams: sizes of its buckets, and discounts.
        self.sizes: dict[int, dict[int, tuple[int, int]]] = {}
        self.discounts: dict[int, tuple[float, float, float]] = {}
        #: Sum of the counts of single words, and what the discounts take from it.
        self.pairs, self.low_mass = 0, 0.0

    def columns(self, level: int) -> int:
        return 1 if level == self.order else 5


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count docs (text) and write the model's files; the driver gets some figures for each bucket only."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    docs = docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BUCKETS, max(1, size // BUCKET_BYTES)).bit_length()
    folder = fresh_path(spark, "kneser-ney")
    store, top = file_system(folder)
    store.create_dir(top)

    blocks = docs.mapInArrow(_word_counter(bits), "bucket int, block binary")
    made = staged(blocks.repartitionById(1 << bits, F.col("bucket")).mapInArrow(_word_writer(folder), "bucket long, n long, total long"), "kn-words")
    found = made.collect()  # one row for each bucket
    model = Model(folder, order, bits, sorted((r["bucket"], r["n"]) for r in found), sum(r["total"] for r in found))
    unstage(made)

    release(spark)
    dtype = _Words(folder, bits, model.words).dtype
    stream = docs.mapInArrow(_gram_counter(folder, order, bits, model.words, bits), "bucket int, block binary")
    for level in range(order, 0, -1):
        write = _level_writer(folder, level, model.columns(level), bits, dtype)
        stream = stream.repartitionById(1 << bits, F.col("bucket")).mapInArrow(write, "bucket int, block binary, figures array<long>")
    made = staged(stream.select("figures"), "kn-figures")
    figures = [r["figures"] for r in made.collect()]  # one row for each bucket and level
    unstage(made)
    release(spark)
    total = {}
    for level in range(order, 0, -1):
        own = [x[1:] for x in figures if x[0] == level]
        model.sizes[level] = {x[0]: (x[1], x[2]) for x in own}
        total = {k: sum(x[i] for x in own) for i, k in enumerate(("n1", "n2", "n3", "n4", "more", "total"), 3)}
        model.discounts[level] = discounts(total["n1"], total["n2"], total["n3"], total["n4"])
    d = model.discounts[1]
    model.pairs, model.low_mass = total["total"], d[0] * total["n1"] + d[1] * total["n2"] + d[2] * total["more"]
    return model


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = _Words(model.folder, model.bits, model.words)
        self.levels = {k: _Level(model.folder, k, model.columns(k), model.bits, model.sizes[k]) for k in range(1, model.order + 1)}

    def score(self, texts: list) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        own = _Sequences(texts, self.words, m.order)
        single = _key(own.distinct[None])
        order = np.argsort(single)
        distinct, which = np.empty((5, len(single)), np.int64), own.which
        distinct[:, order] = self.levels[1].rows(single[order])
        keys = single[which]
        outside = 1 / (m.vocabulary + 1)
        p = np.full(len(own.place), outside)
        if m.pairs:
            count = distinct[0][which[own.place]]
            p = np.maximum(count - np.array([0.0, *m.discounts[1]])[np.minimum(count, 3)], 0) / m.pairs + m.low_mass / m.pairs * outside
        for level in range(2, m.order + 1):
            d = np.array([0.0, *m.discounts[level]])
            # of each context once: its total, and what is left for shorter grams
            total = np.maximum(distinct[1], 1)
            rest = (d[1] * distinct[2] + d[2] * distinct[3] + d[3] * distinct[4]) / total
            total = np.where(distinct[1] > 0, total, 0).astype(np.float64)
            before = which[own.place - 1]
            total, rest = total[before], rest[before]
            keys = np.append(keys[:1], _longer(keys[:-1], own.ids[1:]))  # a key across two texts is at no token
            at = own.place if level == m.order else np.arange(len(keys))
            longer, which = np.unique(keys[at], return_inverse=True)
            distinct = self.levels[level].rows(longer)
            count = distinct[0][which if level == m.order else which[own.place]]
            seen = total > 0
            p = np.where(seen, np.maximum(count - d[np.minimum(count, 3)], 0) / np.where(seen, total, 1.0) + rest * p, p)
        base = np.log10((own.counts + 1) / (m.tokens + m.vocabulary + 1))
        add = lambda x: np.add.reduceat(x, own.first)
        return own.sizes, add((own.counts > 0).astype(np.int64)), add(base), add(np.log10(p))


_LAST: dict[str, _Scorer] = {}


def _scorer(model: Model):
    def score(batches):
        if model.folder not in _LAST:
            _LAST.clear()
            _LAST[model.folder] = _Scorer(model)
        own = _LAST[model.folder]
        for rows, texts in document_groups(batches):
            tokens, known, base, full = own.score(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows that are not held out, repeated ones as often as they occur.  A null or
    empty text is its end token alone.  Without training rows every probability is uniform over
    the unknown word.  Other columns are ignored.  A very long text is scored whole, in one task.
    An empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs.where(~held_out(F.col("doc_id"))), order)
    scored = docs.mapInArrow(_scorer(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
