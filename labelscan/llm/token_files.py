"""Token ids in files of patched frame-of-reference blocks.

A file is one row of a Parquet folder: `payload` holds blocks of up to BLOCK ids one after the other, `block_starts`
the byte at which each begins and `block_ids` how many ids come before it, so that a reader can seek to any id. A block
is a header (ids, exceptions: uint16 each; minimum: uint32; width: uint8), the ids less the minimum packed at `width`
bits, and the exceptions: positions (uint16) and the high bits (uint32) that did not fit. The width is that of a
percentile of the block's values, raised or lowered to where the block becomes smallest.

Files hold consecutive documents in ascending id order, `part` numbering them; `doc_ids` and `doc_tokens` say which.
Parquet gives checked, atomic commits on any file system that Spark writes to.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.llm.shared import LOWER, SPACES, Words, pieces, scratch

BLOCK = 4096
#: Percentiles of the block's values whose widths are tried, ids of a payload at least, parts that a worker remembers, and those of them that are merged at a time.
PERCENTILES, FILE_IDS, REMEMBERED, RECENT = (90, 95, 98, 100), 1 << 20, 2_000_000, 1 << 16
#: Payloads up to which the table of their places is broadcast (three numbers each).
BROADCAST_FILES = 100_000
END = 2
_HEADER = struct.Struct("<HHIB")


def pack(ids: np.ndarray) -> bytes:
    """One block of at most 65,535 ids below 2**32."""
    low = int(ids.min()) if len(ids) else 0
    rest = ids.astype(np.int64) - low
    widths = sorted({int(np.percentile(rest, p, method="higher")).bit_length() for p in PERCENTILES}) if len(ids) else [0]
    sizes = {w: (len(ids) * w + 7) // 8 + 6 * int((rest >> w > 0).sum()) for w in widths}
    width = min(widths, key=lambda w: (sizes[w], w))
    large = np.flatnonzero(rest >> width > 0)
    bits = ((rest[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    body = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEADER.pack(len(ids), len(large), low, width) + body + large.astype("<u2").tobytes() + (rest[large] >> width).astype("<u4").tobytes()


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at a byte, and the byte after it."""
    n, n_large, low, width = _HEADER.unpack_from(data, at)
    at += _HEADER.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    rest = bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) if width else np.zeros(n, np.int64)
    at += size
    where = np.frombuffer(data, "<u2", n_large, at)
    rest[where] |= np.frombuffer(data, "<u4", n_large, at + 2 * n_large).astype(np.int64) << width
    return rest + low, at + 6 * n_large


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself if it can be seen, and else one from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(others)}


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACES] = _SPACE
_KIND[48:58] = _NUMBER
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
#: Bytes that send a text the slow way: control characters, and first bytes of others than Latin letters up to U+017F.
_ODD = np.zeros(256, bool)
_ODD[[i for i in range(32) if not SPACES[i]]] = _ODD[127] = _ODD[0xC0:0xC3] = _ODD[0xC6:] = True


#: What a tokenizer's own file has to say for its texts to be cut here (fixed values of that format).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def known(config: dict) -> bool:
    """Whether a tokenizer cuts texts as Encoder.cuts() does, and names no token that could stand in a text but one that begins with <|."""
    cuts = config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER
    names = all(t["content"].startswith("<|") for t in config.get("added_tokens") or [])
    return cuts and names and config.get("post_processor") is None and config["model"].get("type") == "BPE"


class Encoder:
    """Ids of whole texts by way of distinct parts, as the tokenizer's own pattern cuts them; it drops white space.

    Texts of ASCII and Latin letters are cut for a whole batch at once: into runs of letters, single digits, runs of
    other characters, and the pattern's contractions. Parts are looked up by a 64-bit hash in a sorted table, and only
    new ones go to the tokenizer's BPE model. A part's length, first and last bytes have to agree as well: a text with
    one that doesn't is encoded by the tokenizer as it is, and so are other texts, and all texts of a tokenizer that
    cuts in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = known(json.loads(self.tokenizer.to_str()))
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64)
        self.tables = [(empty, np.zeros(0, np.int64)), (empty, np.zeros(0, np.int64))]  # known parts, and recent ones: sorted hashes, entries
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.marks = np.zeros((0, 3), np.uint64)  # of each entry

    def _entries(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 without one."""
        out = np.full(len(hashes), -1)
        for keys, entries in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, entries[at], out)
        return out

    @staticmethod
    def _marks(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length, first eight and last eight bytes of each part."""
        data = np.concatenate((np.zeros(8, np.uint8), words.data, np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        size = ends - starts
        short = np.uint64(8) * np.maximum(8 - size, 0).astype(np.uint64)
        take = lambda at: np.ascontiguousarray(eight[at]).view("<u8").ravel()
        first, last = take(starts + 8), take(ends)
        return np.column_stack((size.astype(np.uint64), (first << short) >> short, (last >> short) << short))

    def _learn(self, hashes: np.ndarray, parts: list[bytes], marks: np.ndarray) -> None:
        ids = []
        self.marks = np.concatenate((self.marks, marks))
        gc.disable()  # else its passes over all these small objects take as long as the work
        try:
            for p in parts:
                t = p.decode().lower()
                ids.append([x.id for x in self.tokenize(t if t.isascii() else t.encode().decode("latin-1").translate(self.letters))])
        finally:
            gc.enable()
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        entries = np.arange(len(self.length), len(self.length) + len(ids))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.pool = np.concatenate((self.pool, np.array([i for x in ids for i in x], np.uint32)))
        for level in (1, 0):
            keys, old = self.tables[level]
            keys, entries = np.concatenate((keys, hashes)), np.concatenate((old, entries))
            by = np.argsort(keys, kind="stable")
            self.tables[level] = keys[by], entries[by]
            if len(keys) < RECENT or not level:
                break
            hashes, entries = self.tables[1]
            self.tables[1] = keys[:0], old[:0]

    @staticmethod
    def cuts(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each part of the texts."""
        data = words.data
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[words.offsets] = True
        new = (kind == _NUMBER) | edge[:-1]
        new[1:] |= kind[1:] != kind[:-1]
        # an apostrophe that begins a run of others, and s, t, re, ve, m, ll or d after it (fixed values), in lower case
        quote = np.flatnonzero((data == 39) & new)
        low = LOWER[np.concatenate((data, np.zeros(3, np.uint8)))]
        room = words.offsets[np.searchsorted(words.offsets, quote, "right")] - quote
        one = np.isin(low[quote + 1], list(b"stmd")) & (room > 1)
        pair = low[quote + 1].astype(np.int64) * 256 + low[quote + 2]
        two = np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & (room > 2)
        hit, size = quote[one | two], np.where(one, 2, 3)[one | two]
        new[hit + 1] = False
        after = hit + size
        after = after[(after < len(data)) & ~edge[np.minimum(after, len(data))]]
        new[after] = True
        inside = kind != _SPACE
        starts = np.flatnonzero(new & inside)
        last = np.ones(len(data), bool)
        last[:-1] = new[1:] | ~inside[1:]
        return starts, np.flatnonzero(last & inside) + 1

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(texts, hashes=False)
        starts, ends = self.cuts(words) if len(words.data) else (np.zeros(0, np.int64),) * 2
        if not self.known:
            each = (t or "" for t in texts.to_pylist())
            return [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END], np.uint32) for t in each]
        distinct, first, inverse = np.unique(words.spans(starts, ends), return_index=True, return_inverse=True)
        marks = self._marks(words, starts, ends)
        entries = self._entries(distinct)
        odd = _ODD[words.data]
        twins = np.flatnonzero(words.data[:-1] == 0xC3) if len(words.data) else np.zeros(0, np.int64)
        odd[twins[np.isin(words.data[twins + 1], (0x97, 0xB7))]] = True  # the signs of multiplication and division
        dotted = np.flatnonzero((words.data[:-1] == 0xC4) & (words.data[1:] == 0xB0)) if len(words.data) else twins
        odd[dotted] = True
        brackets = np.flatnonzero((words.data[:-1] == 60) & (words.data[1:] == 124)) if len(words.data) else twins
        odd[brackets] = True
        cuts = np.searchsorted(starts, words.offsets)
        own = np.where((entries >= 0)[:, None], self.marks[entries], marks[first]) if len(self.marks) else marks[first]
        other = np.concatenate(([0], np.cumsum((marks != own[inverse]).any(axis=1))))[cuts]  # parts that only share a hash
        slow = np.flatnonzero((words.per_doc(odd) > 0) | (np.diff(other) > 0))
        usable = np.ones(len(distinct), bool)
        if len(slow):
            fast_part = np.ones(len(starts), bool)
            for d in slow.tolist():
                fast_part[cuts[d] : cuts[d + 1]] = False
            usable = np.bincount(inverse, weights=fast_part, minlength=len(distinct)) > 0
        new = np.flatnonzero((entries < 0) & usable)
        if len(self.length) + len(new) > REMEMBERED:
            self.clear()
            new = np.flatnonzero(usable)
        if len(new):
            raw = words.data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)], marks[first[new]])
            entries = self._entries(distinct)
        index = entries[inverse]
        length = np.where(index >= 0, self.length[index], 0) if len(index) else index
        stop = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[index] - stop + length, length) + np.arange(int(stop[-1]))] if len(stop) else np.zeros(0, np.uint32)
        bounds = np.concatenate(([0], stop))[cuts]
        end = np.array([END], np.uint32)
        out = [np.concatenate((ids[a:b], end)) for a, b in zip(bounds, bounds[1:], strict=False)]
        for d in slow.tolist():
            out[d] = np.array([*self.tokenizer.encode(texts[d].as_py(), add_special_tokens=False).ids, END], np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer and worker process, which keeps what it knows from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, doc_tokens array<long>, block_starts array<long>, block_ids array<long>, payload binary"


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Encode whole texts (null: empty), append END to each, and write the files; returns their folder.

    Rows without an id come first. Rows that repeat an id follow each other in no particular order. An empty text is
    END alone, an empty table a folder without rows. The order needs one shuffle of the texts by ranges of the id.
    """
    path = path or scratch(docs.sparkSession, "token_files")
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer)
        held: list[tuple[int | None, np.ndarray]] = []
        total, seq = 0, 0

        def flush(part: int) -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            starts = range(0, len(ids), BLOCK)
            blocks = [pack(ids[a : a + BLOCK]) for a in starts]
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1]
            row = [part, seq, len(ids), [d for d, _ in held], [len(x) for _, x in held], offsets.tolist(), list(starts), b"".join(blocks)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        long = pa.list_(pa.int64())
        types, names = [pa.int32(), pa.int32(), pa.int64(), long, long, long, long, pa.binary()], [x.split()[0] for x in SCHEMA.split(", ")]
        part = 0
        for batch in batches:
            for piece in pieces(batch):
                part = piece.column("part")[0].as_py()
                for d, ids in zip(piece.column("doc_id").to_pylist(), encode_texts(piece.column("text")), strict=True):
                    held.append((d, ids))
                    total += len(ids)
                    if total >= FILE_IDS:
                        yield flush(part)
                        held, total, seq = [], 0, seq + 1
        if held:
            yield flush(part)

    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids; decoded from the payload.

    Where a payload starts follows from the sizes of the parts before its own and of the payloads before it in that: what
    meets in one task is a row for each part (as many as the writing job had partitions), or for each payload of one.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("_part_start"))
    inside = files.select("part", "seq", before(W.partitionBy("part").orderBy("seq")).alias("_start"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("_part_start") + F.col("_start")).alias("file_start"))
    placed = files.join(F.broadcast(starts) if files.count() <= BROADCAST_FILES else starts, ["part", "seq"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                ids = np.concatenate([unpack(r["payload"], a)[0] for a in r["block_starts"]]).astype("<u4")
                if len(ids) != r["n_ids"]:
                    raise ValueError("a payload doesn't hold the ids that its index names")
                tokens = np.array(r["doc_tokens"])
                ends = np.cumsum(tokens)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - tokens).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["file_start"] + ends - tokens), pa.array(tokens), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return placed.mapInArrow(decode, schema)
