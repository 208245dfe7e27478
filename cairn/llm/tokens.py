"""Token ids in wavelet-matrix shards.

A shard holds the ids of a run of documents in ascending doc_id order, or another that is given, as a wavelet matrix: one bit-plane
for each bit of an id, most significant first, each plane stably sorted by the planes above it.  Planes
are compressed in blocks with the number of ones before each block, so that a token, the count of an id
in a range, or its k-th occurrence is read from a few blocks of one compressed file.

Shards are cut at exact quantiles of the text sizes in that order and rolled after a number of tokens,
written under temporary names in the shared folder and renamed; the manifest, committed beside them at the
end, lists them.  A task that runs again writes the same bytes to the same name.

A lookup inflates one block of 2**18 bits (32 KB) for each plane and counts ones inside it; blocks are remembered.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import committed, file_system, fresh_path, range_bounds, range_key, range_of, staged, unstage

BLOCK = 1 << 18  # bits
END_ID = 0
SHARD_BYTES = 8 << 20
SHARD_TOKENS = 4 << 20
_MAGIC = b"WMSHARD1"


class WaveletMatrix:
    """Bit-planes of a sequence of ids with access, rank (count) and select (occurrence) over them."""

    def __init__(self, n: int, zeros: list[int], before: list[np.ndarray], load):
        self.n, self.zeros, self.before, self._load, self._blocks = n, zeros, before, load, {}

    @staticmethod
    def planes(ids: np.ndarray, bits: int):
        """(zeros, packed bits) of each plane."""
        at = ids
        for level in range(bits - 1, -1, -1):
            mask = (at & at.dtype.type(1 << level)) != 0
            low = at[~mask]
            yield len(low), np.packbits(mask, bitorder="little")
            at = np.concatenate([low, at[mask]])

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._blocks:
            if len(self._blocks) > 64:
                self._blocks.clear()
            self._blocks[level, k] = np.frombuffer(self._load(level, k), np.uint8)
        return self._blocks[level, k]

    def _bit(self, level: int, i: int) -> int:
        block = self._block(level, i // BLOCK)
        return int(block[(i % BLOCK) >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        k, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.before[level][k])
        block = self._block(level, k)
        part = int(np.bitwise_count(block[: rest >> 3]).sum(dtype=np.int64))
        if rest & 7:
            part += int(np.bitwise_count(block[rest >> 3] & ((1 << (rest & 7)) - 1)))
        return int(self.before[level][k]) + part

    def _step(self, level: int, i: int, bit: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.zeros)):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self._step(level, i, bit)
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level in range(len(self.zeros)):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            a, b = self._step(level, a, bit), self._step(level, b, bit)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id in positions a up to b."""
        if value < 0 or value >> len(self.zeros):
            return 0
        a, b = self._range(value, a, self.n if b is None else b)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0; -1 if there are not so many."""
        if not 0 <= k < self.count(value):
            return -1
        i = self._range(value, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select_bit(level, i - self.zeros[level] if bit else i, bit)
        return i

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        j = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, j), bitorder="little")[: min(BLOCK, self.n - j * BLOCK)]
        return j * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[j])])

    def decode(self, dtype) -> np.ndarray:
        """All ids: undo the stable partitions from the last plane to the first."""
        dtype = np.dtype(dtype).type
        masks = []
        for level in range(len(self.zeros)):
            raw = b"".join(self._load(level, k) for k in range(-(-self.n // BLOCK)))
            masks.append(np.frombuffer(raw, np.uint8))
        at = np.zeros(self.n, dtype)
        for level in range(len(self.zeros) - 1, -1, -1):
            mask = np.unpackbits(masks.pop(), bitorder="little", count=self.n).view(bool)
            out = np.empty(self.n, dtype)
            out[~mask] = at[: self.zeros[level]]
            out[mask] = at[self.zeros[level] :] | dtype(1 << (len(self.zeros) - 1 - level))
            at = out
        return at


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """File: magic, header length, JSON header, compressed document table, compressed plane blocks."""
    squeeze = zstandard.ZstdCompressor(level=1)
    table = squeeze.compress(np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + np.array(lengths, np.int64).tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes())
    body, sizes, zeros, before = [], [], [], []
    for z, packed in WaveletMatrix.planes(ids, bits):
        zeros.append(z)
        ones = [0]
        own = []
        for a in range(0, len(packed), BLOCK // 8):
            part = packed[a : a + BLOCK // 8]
            own.append(squeeze.compress(part.tobytes()))
            ones.append(ones[-1] + int(np.bitwise_count(part).sum(dtype=np.int64)))
        body += own
        sizes.append([len(x) for x in own])
        before.append(ones)
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "table": len(table), "zeros": zeros, "sizes": sizes, "before": before}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, table, *body])


class Shard:
    """A shard file; read(offset, size) gives its bytes, so that only the blocks asked for are fetched."""

    def __init__(self, read):
        first = read(0, 12)
        if first[:8] != _MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack("<I", first[8:])[0]
        self.head = json.loads(read(12, size))
        expand = zstandard.ZstdDecompressor()
        at = 12 + size
        table = expand.decompress(read(at, self.head["table"])) if self.head["table"] else b""
        n = self.head["docs"]
        null = np.frombuffer(table, np.uint8, n, 16 * n)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(table, np.int64, n), null, strict=True)]
        self.lengths = np.frombuffer(table, np.int64, n, 8 * n)
        at += self.head["table"]
        where = []
        for own in self.head["sizes"]:
            where.append([])
            for s in own:
                where[-1].append((at, s))
                at += s
        self.matrix = WaveletMatrix(self.head["n"], self.head["zeros"], [np.array(x) for x in self.head["before"]], lambda level, k: expand.decompress(read(*where[level][k])))

    @classmethod
    def open(cls, uri: str) -> Shard:
        store, path = file_system(uri)
        source = store.open_input_file(path)
        return cls(lambda offset, size: source.read_at(size, offset))

    @classmethod
    def loaded(cls, uri: str) -> Shard:
        """With the whole file in memory, for reading all of it."""
        store, path = file_system(uri)
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        return cls(lambda offset, size: data[offset : offset + size])


# ---------------------------------------------------------------- encoding

_ENCODERS: dict[str, Encoder] = {}
#: All white space but space and line feed, as a class for RE2.
_OTHER = r"\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Texts that cannot be cut at spaces and line feeds, and those that cannot be cut at spaces.
_NO_LINES = rf"[ \n][ \n]| $|[{_OTHER}]"
_NO_PIECES = rf"[ \n{_OTHER}] | [ \n{_OTHER}]| $"
_SPACES = re.compile(r"\s")
#: A word of these letters is one pre-token, and a run of these marks behind it another.
_CUT = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!#$%&*+,\-./:;<=>?@^_|~()\[\]{}]+)$"


class _Kept:
    """Words with their ids, as arrays."""

    def __init__(self, dtype):
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)


class Encoder:
    """Ids of whole texts from the tokenizers library, remembering the ids of recent pieces.

    For a byte-level tokenizer without prefix space, a space between other characters than white space always
    begins a new pre-token and nothing before it matters for what follows, and such a line feed is a pre-token of
    its own.  So a text's ids are those of its pieces between single spaces and line feeds, each with its leading
    space; letters and a run of marks behind them are pre-tokens of their own.  Texts with other white space, and
    other kinds of tokenizers, are encoded whole.  Pieces are held in Arrow arrays, and ids are gathered by numpy.
    """

    def __init__(self, path: str, most: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        step = kind.get("pre_tokenizer") or {}
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or _SPACES.search(x["content"]) for x in kind.get("added_tokens", []))
        self.pieces = plain and kind.get("normalizer") is None and kind["model"]["type"] == "BPE" and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.bits = max(1, int(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.most, self.kept = most, {}
        self.feed = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, kept: _Kept, words: pa.Array, lead: str) -> None:
        """Add words.  Those without white space share calls: a line feed between two is a token of its own."""
        odd = pc.or_(pc.match_substring_regex(words, rf"[ \n{_OTHER}]"), pc.equal(pc.binary_length(words), 0))
        if len(self.feed) != 1:
            odd = pa.array([True] * len(words))
        plain, single = words.filter(pc.invert(odd)), words.filter(odd).to_pylist()
        own, ids, sizes = plain.to_pylist(), [], []
        groups = [own[i : i + 200] for i in range(0, len(own), 200)]
        for group, found in zip(groups, self._whole([lead + f"\n{lead}".join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(found == self.feed[0])
            if len(cut) + 1 == len(group):
                ids.append(np.delete(found, cut))
                sizes.append(np.diff(cut, prepend=-1, append=len(found)) - 1)
            else:  # not a tokenizer for which this holds
                each = self._whole([lead + x for x in group])
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        each = self._whole([lead + x for x in single])
        kept.add(pa.concat_arrays([plain, words.filter(odd)]), np.concatenate([*ids, *each, np.zeros(0, self.dtype)]), np.concatenate([*sizes, np.array([len(x) for x in each], np.int64)]))

    def _known(self, words: pa.Array, lead: str) -> tuple[_Kept, np.ndarray]:
        """The words of a lead that are kept, and which of them these are."""
        kept = self.kept.get(lead)
        if kept is None or len(kept.words) > self.most:
            kept = self.kept[lead] = _Kept(self.dtype)
        at = kept.find(words)
        missing = at < 0
        if missing.any():
            new = words.filter(pa.array(missing))
            self._learn(kept, new, lead)
            at[missing] = kept.find(new)
        return kept, at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, end_id after each, and the number of ids of each text with its end."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.pieces:
            whole = pc.match_substring_regex(texts, _NO_PIECES)
            lines = pc.invert(pc.match_substring_regex(texts, _NO_LINES))
            cut = pc.if_else(lines, pc.replace_substring(texts, "\n", " \n "), pc.if_else(whole, "", texts))
            slow = np.flatnonzero(pc.and_not(whole, lines).to_numpy(zero_copy_only=False))
        else:
            cut, slow = pa.array([""] * n, pa.large_string()), np.arange(n)
        lists = pc.split_pattern(cut, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        words, codes = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
        # numbers: pieces behind a space, pieces at the beginning of a line, whole texts, the end, the line feed, marks
        m, feed = len(words), pc.index(words, "\n").as_py()
        head = np.zeros(len(codes), bool)
        head[at[:-1]] = True
        head[np.flatnonzero(codes == feed) + 1] = True
        codes += m * head
        codes[codes == feed] = 2 * m + len(slow) + 1
        codes[at[slow]] = 2 * m + np.arange(len(slow))
        codes = np.insert(codes, at[1:], 2 * m + len(slow))
        used = np.zeros(2 * m + len(slow) + 2, bool)
        used[codes] = True

        both = pc.extract_regex(words, _CUT)
        core = pc.if_else(both.is_valid(), both.field("core"), words).dictionary_encode()
        mark = pc.if_else(both.is_valid(), both.field("mark"), pa.scalar(None, pa.large_string())).dictionary_encode()
        of_core, cores = core.indices.to_numpy().astype(np.int64), core.dictionary
        of_mark = pc.fill_null(mark.indices, -1).to_numpy()
        pools, sizes, begins, base = [], [], [], 0
        for lead, own in ((" ", used[:m]), ("", used[m : 2 * m])):
            mine = np.zeros(len(cores), bool)
            mine[of_core[own]] = True
            kept, number = self._known(cores.filter(pa.array(mine)), lead)
            entry = np.zeros(len(cores), np.int64)
            entry[mine] = number
            entry = np.where(own, entry[of_core], 0)
            pools.append(kept.ids)
            ends = kept.ends if len(kept.ends) > 1 else np.zeros(2, np.int64)
            sizes.append(np.where(own, ends[entry + 1] - ends[entry], 0))
            begins.append(ends[entry] + base)
            base += len(kept.ids)
        others = [*self._whole([texts[int(i)].as_py() for i in slow]), np.array([end_id], self.dtype), self.feed, *self._whole(mark.dictionary.to_pylist())]
        lengths = np.array([len(x) for x in others], np.int64)
        sizes, begins = np.concatenate([*sizes, lengths]), np.concatenate([*begins, base + np.cumsum(lengths) - lengths])

        marked = np.full(2 * m + len(slow) + 2, -1, np.int64)
        marked[:m] = marked[m : 2 * m] = of_mark
        behind = marked[codes]
        times = 1 + (behind >= 0)
        first = np.cumsum(times) - times
        codes = np.repeat(codes, times)
        codes[first[behind >= 0] + 1] = len(marked) + behind[behind >= 0]
        counts = sizes[codes]
        place = np.repeat(begins[codes] - (np.cumsum(counts) - counts), counts)
        place += np.arange(len(place))
        return np.concatenate([*pools, *others])[place], np.add.reduceat(counts, first[at[:-1] + np.arange(n)])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(texts: pa.Array, most: int = 16_000_000):
    """Bounds of runs of texts that have about `most` bytes in all, or are one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most)) + 1
        yield start, min(end, len(sizes))
        start = end


def _writer(folder: str, tokenizer: str, end_id: int, most_tokens: int):
    def write(batches):
        store, top = file_system(folder)
        enc = encoder(tokenizer)
        now, part, docs, lengths, parts, tokens = None, 0, [], [], [], 0

        def flush():
            nonlocal part, docs, lengths, parts, tokens
            if not docs:
                return None
            name = f"shard-{now:08d}-{part:05d}.wm"
            data = shard_bytes(docs, lengths, np.concatenate(parts), enc.bits)
            temporary = f"{top}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            store.move(temporary, f"{top}/{name}")
            row = (now, part, f"{folder}/{name}", len(docs), tokens, len(data))
            part, docs, lengths, parts, tokens = part + 1, [], [], [], 0
            return row

        out = []
        for batch in batches:
            shards, doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in _groups(texts):
                ids, sizes = enc.encode(texts.slice(a, b - a), end_id)
                taken = at = 0
                for shard, doc, size in zip(shards[a:b], doc_ids[a:b], sizes.tolist(), strict=True):
                    if shard != now or tokens >= most_tokens:
                        parts.append(ids[taken:at])
                        out.append(flush())
                        taken, part, parts = at, 0 if shard != now else part, []
                        now = shard
                    docs.append(doc)
                    lengths.append(size)
                    tokens += size
                    at += size
                parts.append(ids[taken:at])
        out.append(flush())
        done = [x for x in out if x]
        names = ["shard", "part", "path", "n_docs", "n_tokens", "n_bytes"]
        yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in done], pa.string() if n == "path" else pa.int64()) for i, n in enumerate(names)})

    return write


def write_shards(docs: DataFrame, tokenizer: str, *, order: tuple[Column, Column] | None = None, end_id: int = END_ID, shard_size: int = SHARD_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs (doc_id, text) as shards; the manifest: shard, part, path, n_docs, n_tokens, n_bytes, start.

    Documents are in ascending doc_id order, those without an id first, equal ids by a hash of the text; or in the order
    of two numbers that are given for them.  A null or
    empty text is the end id alone, and a text of any length is one document of one file.  No row gives no shard and
    an empty manifest.  Rows that agree in id and text are written each.  tokenizer is the path of a tokenizers
    file on every worker.  Other columns are ignored.
    """
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    if order is None:
        first, docs = "doc_id", docs.select(*own).withColumn("tie", F.xxhash64("text"))
    else:
        first, docs = "first", docs.select(*own, *(c.cast("long").alias(n) for c, n in zip(order, ["first", "tie"], strict=True)))
    key = range_key(F.col(first), F.col("tie"))
    bounds = range_bounds(docs.select(key.alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes")), shard_size)
    folder = fresh_path(spark, "token-shards")
    store, top = file_system(folder)
    store.create_dir(top)
    placed = docs.select(range_of(key, bounds).cast("int").alias("shard"), *docs.columns).repartitionById(len(bounds) + 1, F.col("shard"))
    placed = placed.sortWithinPartitions("shard", F.asc_nulls_first(first), "tie", "text").select("shard", "doc_id", "text")
    written = staged(placed.mapInArrow(_writer(folder, tokenizer, end_id, shard_tokens), "shard long, part long, path string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")
    # ids before a range, for at most MOST_RANGES ranges, and before a file within its range
    before = written.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    before = before.select("shard", (F.sum("own").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("own")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_tokens")
    manifest = written.withColumn("inside", inside).join(F.broadcast(before), "shard").select("shard", "part", "path", "n_docs", "n_tokens", "n_bytes", (F.col("inside") + F.col("before")).alias("start"))
    manifest = committed(manifest, folder)
    unstage(written)
    return manifest


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard.loaded(uri)
            ids = shard.matrix.decode(np.uint16 if shard.head["bits"] <= 16 else np.uint32).astype("<u4")
            ends = np.cumsum(shard.lengths)
            begins = ends - shard.lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shard files: doc_id, start, n_tokens, ids_crc32."""
    files = max(1, min(manifest.count(), 1 << 16))
    paths = manifest.select("path", "start").repartition(files)
    return paths.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs as shards and return what is read back from them."""
    return read_shards(write_shards(docs, tokenizer, **options))
