"""Media columns: baseline JPEG in, DC-only luminance thumbnails and their hashes out.

Writing: a payload of bytes becomes a grey picture in which every byte is one flat block of 8 x 8 samples, 64 blocks
to a row. With a DC quantiser of 8 a block's DC coefficient is exactly the byte less 128, so the picture is lossless for
the payload. Rows are restart intervals, and a long payload is a sequence of pictures.

Reading: markers are parsed, and the restart intervals of all pictures with the same tables are Huffman-decoded in
step, one block of each at a time, as numpy vectors. AC coefficients are skipped; the DC ones give a thumbnail of one
sample for each block. This reads any baseline picture (grey or colour, sampled or not, with or without restarts).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.shared import pieces, plus

ROW = 64  # payload bytes, and blocks, of a row
STRIP = 8128  # rows of a picture at most; its height in samples must stay below 65,536
#: Code length of each DC size category 0 to 8: letters differ from each other by up to 31 and from a space by 64 to 127.
DC_LENGTHS = (5, 4, 3, 3, 2, 3, 6, 2, 7)


def _canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Canonical Huffman code: counts of each length, symbols in order, and (code, length) of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return [sum(v == k for v in lengths.values()) for k in range(1, 17)], symbols, codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = _canonical(dict(enumerate(DC_LENGTHS)))
_TABLES = _segment(0xDB, bytes([0, 8] + [1] * 63)) + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
_CODE, _LENGTH = np.zeros(511, np.int64), np.zeros(511, np.int64)
for _d in range(-255, 256):
    _size = abs(_d).bit_length()
    _c, _n = _DC_CODES[_size]
    # category, then the difference's low bits (less one if negative), then the one-bit end of block
    _CODE[_d + 255] = (((_c << _size) | ((_d if _d >= 0 else _d - 1) & ((1 << _size) - 1))) << 1)
    _LENGTH[_d + 255] = _n + _size + 1


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ROW."""
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")


def write(datas: list[bytes]) -> list[bytes]:
    """One media value for each payload; a picture of each STRIP rows, with the unpadded length as its comment."""
    if not datas:
        return []
    payloads = [padded(d) for d in datas]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    lengths = _LENGTH[diff]
    bits = np.cumsum(lengths, axis=1)
    row_bytes = (bits[:, -1] + 7) // 8
    row_start = np.cumsum(row_bytes) - row_bytes
    at = (bits - lengths) + row_start[:, None] * 8
    value = (_CODE[diff] << (24 - lengths - (at & 7))).ravel()
    where = (at >> 3).ravel()
    total = int(row_bytes.sum())
    out = sum(np.bincount(where + k, weights=(value >> (16 - 8 * k)) & 255, minlength=total + 3) for k in range(3))[:total].astype(np.int64)
    out[row_start + row_bytes - 1] += (1 << (row_bytes * 8 - bits[:, -1])) - 1  # padded with ones
    stuffed = (out == 255).astype(np.int64)
    # rows of each picture, and the marker after each row: a restart or the end
    counts = np.array([len(p) // ROW for p in payloads])
    first = np.cumsum(counts) - counts
    in_doc = np.arange(len(rows)) - np.repeat(first, counts)
    in_strip = in_doc % STRIP
    ends = (in_doc == np.repeat(counts, counts) - 1) | (in_strip == STRIP - 1)
    of_row = np.repeat(np.arange(len(rows)), row_bytes)
    place = np.cumsum(stuffed) - stuffed + np.arange(total) + 2 * of_row
    flat = np.zeros(total + int(stuffed.sum()) + 2 * len(rows), np.uint8)
    flat[place] = out
    row_end = place[row_start + row_bytes - 1] + 1 + stuffed[row_start + row_bytes - 1]
    flat[row_end] = 255
    flat[row_end + 1] = np.where(ends, 0xD9, 0xD0 + in_strip % 8)
    begin = np.concatenate(([0], row_end[:-1] + 2))
    result = []
    for d, n, f in zip(datas, counts.tolist(), first.tolist(), strict=True):
        parts = []
        for a in range(0, n, STRIP):
            b = min(n, a + STRIP)
            parts += [b"\xff\xd8", _segment(0xFE, b"%d" % len(d)), _TABLES, _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * (b - a), 8 * ROW, 1, 1, 0x11, 0)), _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), flat[begin[f + a] : row_end[f + b - 1] + 2].tobytes()]
        result.append(b"".join(parts))
    return result


@dataclass
class Picture:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantiser
    comment: bytes = b""
    restart: int = 0
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    data: tuple[int, int] = (0, 0)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return (-(-self.width // (8 * h)), -(-self.height // (8 * v))) if len(self.components) > 1 else (-(-self.width // 8), -(-self.height // 8))

    @property
    def blocks(self) -> list[tuple[int, int, int]]:
        """(component index, DC table, AC table) of each block of a minimum coded unit."""
        index = {c[0]: i for i, c in enumerate(self.components)}
        return [(index[c], dc, ac) for c, dc, ac in self.scan for _ in range(self.components[index[c]][1] * self.components[index[c]][2] if len(self.components) > 1 else 1)]


def parse(media: bytes) -> list[Picture]:
    """The pictures of a media value; what is no baseline picture with one interleaved scan is an error."""
    found, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no picture starts here")
        picture, at = Picture(0, 0, []), at + 2
        while True:
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            if media[at] != 255 or not size:
                raise ValueError("no marker where one is due")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC0:
                picture.height, picture.width = struct.unpack(">HH", body[1:5])
                picture.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
                raise ValueError("not a baseline picture")
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    picture.quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    i += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = 17 + sum(body[i + 1 : i + 17])
                    picture.tables[body[i]] = body[i + 1 : i + n]
                    i += n
            elif marker == 0xDD:
                picture.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                picture.comment = body
            elif marker == 0xDA:
                picture.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                break
        if len(picture.scan) != len(picture.components) or not picture.components:
            raise ValueError("not a single interleaved scan")
        end = at
        while True:  # the next marker that is neither a stuffed byte nor a restart
            end = media.find(b"\xff", end)
            if end < 0 or end + 1 >= len(media):
                raise ValueError("the scan doesn't end")
            if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                end += 2
                continue
            break
        if media[end + 1] != 0xD9:
            raise ValueError("more than one scan")
        picture.data, at = (at, end), end + 2
        found.append(picture)
    return found


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """Symbol and code length (256 * symbol + length) for each 16 bits that may come next; length 0 is no code."""
    if table not in _lookups:
        out, code, i = np.zeros(65536, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[code << (16 - length) : (code + 1) << (16 - length)] = 256 * table[i] + length
                code, i = code + 1, i + 1
            code <<= 1
        _lookups[table] = out
    return _lookups[table]


def _decode(pictures: list[Picture], scans: list[np.ndarray]) -> list[np.ndarray]:
    """DC coefficients of the first component, in coding order, of pictures with the same tables and blocks."""
    one = pictures[0]
    raw = np.concatenate([x for s in scans for x in (s, np.array([255, 0xD0], np.uint8))])  # each scan ends in a restart here
    marker = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    keep = np.ones(len(raw), bool)
    keep[1:] &= ~((raw[:-1] == 255) & (raw[1:] == 0))
    kept = np.concatenate(([0], np.cumsum(keep)))
    data = np.concatenate((raw[keep], np.zeros(4, np.uint8))).astype(np.int64)
    bit = 8 * np.concatenate(([0], kept[marker[:-1] + 2]))
    total = [p.mcus[0] * p.mcus[1] for p in pictures]
    per = [[min(p.restart or t, t - a) for a in range(0, t, p.restart or t)] for p, t in zip(pictures, total, strict=True)]
    units = np.array([n for x in per for n in x])
    if len(units) != len(bit):
        raise ValueError("restarts don't match the picture's size")
    blocks = one.blocks
    own = sum(b[0] == 0 for b in blocks)
    out = np.zeros((len(units), int(units.max()) * own), np.int32)
    level = np.zeros((len(one.components), len(units)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        i = np.minimum(p >> 3, len(data) - 4)
        return (((data[i] << 16) | (data[i + 1] << 8) | data[i + 2]) >> (8 - (p & 7))) & 0xFFFF

    all_same = bool((units == units[0]).all())
    for unit in range(int(units.max())):
        live = slice(None) if all_same else np.flatnonzero(units > unit)
        p, j = bit[live], 0
        for component, dc, ac in blocks:
            code = _lookup(one.tables[dc])[peek(p)]
            size = code >> 8
            p = p + (code & 255)
            extra = peek(p) >> (16 - size)
            p = p + size
            level[component, live] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            table = _lookup(one.tables[16 + ac])
            code = table[peek(p)]  # the first AC code; an end of block almost everywhere
            k = 1 + np.where(code >> 8 == 0, 63, (code >> 12) + 1)
            p = p + (code & 255) + (code >> 8 & 15)
            while (rest := np.flatnonzero(k < 64)).size:
                code = table[peek(p[rest])]
                k[rest] += np.where(code >> 8 == 0, 63, (code >> 12) + 1)
                p[rest] += (code & 255) + (code >> 8 & 15)
            if component == 0:
                out[live, unit * own + j] = level[0, live]
                j += 1
        bit[live] = p
    cuts = np.cumsum([0, *map(len, per)])
    return [np.concatenate([out[i, : units[i] * own] for i in range(a, b)]) if not all_same else out[a:b].ravel() for a, b in zip(cuts, cuts[1:], strict=False)]


def thumbnails(medias: list[bytes]) -> list[tuple[list[Picture], list[np.ndarray]]]:
    """Pictures of each media value and their luminance thumbnails, one 8-bit sample for each block."""
    parsed = [parse(m) for m in medias]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, pictures in enumerate(parsed):
        for k, p in enumerate(pictures):
            groups.setdefault((tuple(sorted(p.tables.items())), tuple(p.blocks), len(p.components)), []).append((i, k))
    found: dict[tuple[int, int], np.ndarray] = {}
    for members in groups.values():
        scans = [np.frombuffer(medias[i], np.uint8)[slice(*parsed[i][k].data)] for i, k in members]
        for (i, k), dc in zip(members, _decode([parsed[i][k] for i, k in members], scans), strict=True):
            p = parsed[i][k]
            _, h, v, q = p.components[0]
            h, v = (h, v) if len(p.components) > 1 else (1, 1)
            x, y = p.mcus
            grid = dc.reshape(y, x, v, h).transpose(0, 2, 1, 3).reshape(y * v, x * h)
            width, height = (-(-p.width // 8), -(-p.height // 8)) if (h, v) == (max(c[1] for c in p.components), max(c[2] for c in p.components)) or len(p.components) == 1 else grid.shape[::-1]
            found[i, k] = np.clip((grid[:height, :width] * p.quantisers[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return [(pictures, [found[i, k] for k in range(len(pictures))]) for i, pictures in enumerate(parsed)]


def average_hash(grid: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 8 reduction lies above the mean of all."""
    rows = np.array_split(np.arange(grid.shape[0]), 8) if grid.shape[0] >= 8 else [np.array([i * grid.shape[0] // 8]) for i in range(8)]
    cols = np.array_split(np.arange(grid.shape[1]), 8) if grid.shape[1] >= 8 else [np.array([i * grid.shape[1] // 8]) for i in range(8)]
    by_rows = np.stack([grid[r].mean(axis=0, dtype=float) for r in rows])
    cells = np.stack([by_rows[:, c].mean(axis=1) for c in cols], axis=1)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with `media` (binary) in place of `text`: the text's UTF-8 bytes as pictures. Null texts count as empty."""
    docs = docs.drop(media)
    rest = docs.drop(text)
    schema, others = plus(rest, f"`{media}` binary"), rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                column = part.column(text).cast(pa.binary()).to_pylist()
                medias = write([x or b"" for x in column])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(medias, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


RESULTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, pictures long, thumbnail_hash string"


def read(medias: DataFrame, media: str = "media") -> DataFrame:
    """Replace `media` by what its stored bytes hold: dimensions, payload digests, thumbnail hash and feature.

    A null value or one that is no baseline picture gives nulls. Payload and feature come from the decoded thumbnails
    alone. The feature joins dimensions, mean, deviation and the average hash of the whole thumbnail.
    """
    rest = medias.drop(media, *[x.split()[0] for x in RESULTS.split(", ")])
    schema, others = plus(rest, RESULTS), rest.columns

    def one(value: bytes, pictures: list[Picture], grids: list[np.ndarray]) -> tuple:
        grid = np.concatenate(grids) if len({g.shape[1] for g in grids}) == 1 else grids[0]
        payload = grid.tobytes()
        mark = average_hash(grid)
        width, height = pictures[0].width, sum(p.height for p in pictures)
        n = int(pictures[0].comment) if pictures[0].comment.isdigit() else len(payload)
        feature = f"{width}x{height}:{grid.mean(dtype=float):.4f}:{grid.std(dtype=float):.4f}:{mark}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(value), hashlib.sha256(value).hexdigest(), feature, width, height, len(pictures), mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, media):
                values = part.column(media).to_pylist()
                try:
                    found = thumbnails([v for v in values if v is not None])
                except ValueError:  # some value is no picture: find out which
                    found = []
                    for v in values:
                        if v is not None:
                            try:
                                found += thumbnails([v])
                            except (ValueError, IndexError, KeyError, struct.error):
                                found.append(None)
                each = iter(found)
                rows = [None if v is None else (lambda x, v=v: x and one(v, *x))(next(each)) for v in values]
                columns = list(zip(*[r or (None,) * 11 for r in rows], strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(pa.array(list(c), schema_type(f)) for c, f in zip(columns, schema.fields[-11:], strict=True))], schema.names)

    def schema_type(f) -> pa.DataType:
        return pa.string() if f.dataType.typeName() == "string" else pa.int64()

    return medias.mapInArrow(run, schema)
