"""Media columns of baseline JPEG: bytes kept losslessly as quantised coefficients, and thumbnails read back.

A JPEG's unit is the quantised coefficient. ``encode`` writes 192 payload bytes as one unit of three 8 x 8
blocks (Y, Cb, Cr), the byte at zigzag place k as a coefficient that is the smaller the more frequent the byte is in
texts, Huffman-coded, with a restart marker after each unit. ``decode`` parses any baseline Huffman JPEG whose restart interval is a
number of units, or that has none: markers, tables, entropy-coded scan. Media are stored as files of their
bytes below a folder, each once per row, and read back from there. Restart intervals are independent,
so those of many images are decoded side by side in numpy. The direct-current luminance coefficients make
a thumbnail, whose mean-threshold bits are the hash that is stored with the dimensions.

Defined results: null and empty payloads are padded as any other; equal payloads give equal media; repeated
rows repeat their result; an empty table gives an empty result; media that is no baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Tables, binary_column, runs, text_bytes, trimmed

#: Bytes of a unit, of its blocks; the byte that becomes coefficient 0; units of a row of the image at most.
UNIT, BLOCK, ORIGIN, MOST_COLUMNS = 192, 64, 96, 1024
#: Payload bytes that are coded or decoded at once, unless one text is longer.
BATCH = 1 << 20
THUMB = 8


def byte_table() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, and the byte of each coefficient from -128 on: a bijection.

    Frequent bytes of texts get small coefficients, of both signs, which have few bits; ORIGIN gets 0, as runs of it
    are coded together. Two bytes have one bit, the next four two, and so on.
    """
    first = b" etaoinhsrdlucmfgpywbvk.,\nTAISxjqzEONHRCDLMPWBUFG0123456789\"'-" + bytes([0xC3, 0xC2, 0xE2, *range(0x21, 0x7F), *range(0x80, 0xC0), *range(256)])
    order = [b for b in dict.fromkeys(first) if b != ORIGIN]
    coefficient, byte = np.zeros(256, np.int16), np.full(257, ORIGIN, np.uint8)
    for i, b in enumerate(order, 2):
        coefficient[b] = i // 2 if i % 2 == 0 else -(i // 2)
    byte[coefficient + 128] = np.arange(256)
    return coefficient, byte


_COEFFICIENT, _BYTE = byte_table()


def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each zigzag place."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in places])


#: Bits of the twelve most frequent codes of a table, in its order.
SIZE_LENGTHS = [2, 2, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12]


def code_table() -> tuple[bytes, bytes]:
    """A Huffman table for these coefficients: (codes of each length 1 to 16, symbols by length).

    Frequent bytes are small coefficients, so single coefficients come first, by size; all symbols that a
    baseline scan can hold follow, so that any payload can be coded.
    """
    order = [0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x00, 0x08, 0x09, 0x0A, 0xF0]
    order += [r << 4 | s for r in range(1, 16) for s in range(1, 11)]
    lengths = list(SIZE_LENGTHS)
    lengths += [16] * (len(order) - len(lengths))
    return bytes(lengths.count(n) for n in range(1, 17)), bytes(s for _, s in sorted(zip(lengths, order, strict=True), key=lambda x: x[0]))


def codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol, 0 where a symbol has none."""
    code, at = 0, 0
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n in range(1, 17):
        for s in symbols[at : at + counts[n - 1]]:
            value[s], length[s] = code, n
            code += 1
        at += counts[n - 1]
        code <<= 1
    return value, length


_COUNTS, _SYMBOLS = code_table()
_CODE, _LENGTH = codes(_COUNTS, _SYMBOLS)


def direct_table() -> tuple[bytes, bytes]:
    """The table of direct-current coefficients: the twelve sizes that baseline allows, small ones first."""
    order, lengths = [1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 10, 11], SIZE_LENGTHS
    return bytes(lengths.count(n) for n in range(1, 17)), bytes(s for _, s in sorted(zip(lengths, order, strict=True), key=lambda x: x[0]))


_DIRECT = direct_table()
_DIRECT_CODE, _DIRECT_LENGTH = codes(*_DIRECT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(units: int, size: int) -> bytes:
    columns = min(MOST_COLUMNS, units)
    rows = -(-units // columns)
    tables = _segment(0xC4, b"\x00" + b"".join(_DIRECT)) + _segment(0xC4, b"\x10" + _COUNTS + _SYMBOLS)
    frame = struct.pack(">BHHB", 8, rows * 8, columns * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xFE, struct.pack(">Q", size)) + _segment(0xC0, frame) + tables + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, scan)


def _units_of(size: int) -> int:
    """Units of the image for so many payload bytes: whole rows."""
    units = size // UNIT
    columns = min(MOST_COLUMNS, units)
    return -(-units // columns) * columns


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """JPEGs of some payloads, whose sizes are positive multiples of UNIT."""
    sizes = np.diff(offsets)
    total = np.array([_units_of(int(n)) for n in sizes])
    value = np.zeros((int(total.sum()), UNIT), np.int16)  # units that only fill the last row are 0
    first = np.concatenate([[0], np.cumsum(total)])
    if np.array_equal(total * UNIT, sizes):
        value[:] = _COEFFICIENT[data].reshape(-1, UNIT)
    else:
        for i, n in enumerate(sizes // UNIT):
            value[first[i] : first[i] + n] = _COEFFICIENT[data[offsets[i] : offsets[i + 1]]].reshape(-1, UNIT)
    flat = value.reshape(-1)
    place = np.arange(len(flat)) % BLOCK
    on = np.flatnonzero((flat != 0) | (place == 0))  # a direct-current coefficient is always coded
    v, k = flat[on].astype(np.int64), place[on]
    run = np.zeros(len(on), np.int64)
    run[1:] = np.where(k[1:] > 0, on[1:] - on[:-1] - 1, 0)
    size = _BITS[np.abs(v)]
    extra = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    last = np.ones(len(on), bool)
    last[:-1] = on[1:] // BLOCK != on[:-1] // BLOCK
    ended = last & (k < BLOCK - 1)  # an end of block follows
    long = run // 16
    symbol = (run % 16) << 4 | size
    code, length = np.where(k == 0, _DIRECT_CODE[size], _CODE[symbol]), np.where(k == 0, _DIRECT_LENGTH[size], _LENGTH[symbol])
    if ended.any() or long.any():
        reps = 1 + long + ended
        at = np.cumsum(reps) - reps
        n = int(reps.sum())
        bits, width, owner = np.full(n, _CODE[0xF0]), np.full(n, _LENGTH[0xF0]), np.repeat(on // UNIT, reps)
        own = at + long
        bits[own], width[own] = code << size.astype(np.uint64) | extra, length + size
        bits[own[ended] + 1], width[own[ended] + 1] = _CODE[0], _LENGTH[0]
    else:
        bits, width, owner = code << size.astype(np.uint64) | extra, length + size, on // UNIT
    return _assemble(bits, width, owner, first, sizes)


_BITS = np.array([int(x).bit_length() for x in range(2048)], np.int64)


def _assemble(bits: np.ndarray, width: np.ndarray, owner: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Packs the codes of each unit into bytes, stuffs them, and joins units with restart markers."""
    units = int(first[-1])
    begin = np.searchsorted(owner, np.arange(units))
    ends = np.cumsum(width)
    before = np.concatenate([[0], ends])[begin]
    used = np.concatenate([before[1:], ends[-1:]]) - before
    n_bytes = (used + 7) // 8
    byte_at = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends - width - before[owner] + byte_at[owner] * 8
    packed = np.zeros(int(byte_at[-1]) + 8, np.uint8)
    word = bits << (np.uint64(40) - width.astype(np.uint64) - (at & 7).astype(np.uint64))
    place = at >> 3
    for j in range(5):
        part = (word >> np.uint64(32 - 8 * j)) & np.uint64(255)
        if j > 1:
            some = np.flatnonzero(part)
            packed[: len(packed)] |= np.bincount(place[some] + j, weights=part[some].astype(np.float64), minlength=len(packed))[: len(packed)].astype(np.uint8) if len(some) else 0
        else:
            packed |= np.bincount(place + j, weights=part.astype(np.float64), minlength=len(packed))[: len(packed)].astype(np.uint8)
    packed = packed[: byte_at[-1]]
    fill = (8 - used % 8) % 8  # the last byte of a unit is filled with ones
    packed[byte_at[1:] - 1] |= ((1 << fill) - 1).astype(np.uint8)
    full = np.flatnonzero(packed == 0xFF)
    shift = np.searchsorted(full, byte_at)  # stuffed zeros before each unit
    stuffed = np.insert(packed, full + 1, 0)
    unit_at = byte_at + shift
    markers = np.arange(units) - np.repeat(first[:-1], np.diff(first))  # number within the image
    out = np.zeros(len(stuffed) + 2 * units, np.uint8)
    room = np.ones(len(stuffed), np.int64)
    to = np.cumsum(room) - 1 + 2 * (np.repeat(np.arange(units), np.diff(unit_at)))
    out[to] = stuffed
    mark = unit_at[1:] + 2 * np.arange(units)
    out[mark], out[mark + 1] = 0xFF, 0xD0 + markers % 8
    final = first[1:] - 1
    out[mark[final] + 1] = 0xD9  # the last one ends the image
    body = out.tobytes()
    cut = np.concatenate([[0], mark[final] + 2])
    return [_header(int(n // UNIT), int(n)) + body[cut[i] : cut[i + 1]] for i, n in enumerate(sizes)]


class Image:
    """The parsed markers of a baseline JPEG."""

    def __init__(self, media: bytes):
        if media[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.quantisation: dict[int, np.ndarray] = {}
        self.comment, self.interval, at = b"", 0, 2
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
            elif marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("baseline tables have 8 bits")
                    self.quantisation[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8), body[65:]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                break
        self.data = at
        h, v = max(c[0] for c in self.components.values()), max(c[1] for c in self.components.values())
        self.columns, self.rows = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        #: Component, direct-current and alternating-current table of each block of a unit.
        self.blocks = [(i, t >> 4, t & 15) for i, (c, t) in enumerate(self.scan) for _ in range(self.components[c][0] * self.components[c][1])]
        self.units = self.columns * self.rows
        self.key = (tuple(self.blocks), tuple(sorted(self.huffman.items())), self.interval)


_luts: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lut(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits: code length << 8 | symbol; 0 where no code begins so."""
    if table not in _luts:
        value, length = codes(*table)
        out = np.zeros(1 << 16, np.int32)
        for s in np.flatnonzero(length):
            a = int(value[s]) << (16 - int(length[s]))
            out[a : a + (1 << (16 - int(length[s])))] = int(length[s]) << 8 | s
        _luts[table] = out
    return _luts[table]


def decode(media: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(markers, quantised coefficients in zigzag order as units x blocks x 64) of each JPEG."""
    images = [Image(m) for m in media]
    out: list = [None] * len(media)
    for key in dict.fromkeys(i.key for i in images):
        chosen = [i for i, image in enumerate(images) if image.key == key]
        for i, coefficients in zip(chosen, _decode_alike([images[i] for i in chosen], [media[i] for i in chosen]), strict=True):
            out[i] = images[i], coefficients
    return out


def _decode_alike(images: list[Image], media: list[bytes]) -> list[np.ndarray]:
    """Decodes images with the same tables: a lane for each restart interval, a symbol of every lane at a time."""
    some = images[0]
    raw = np.frombuffer(b"".join(m[i.data :] for i, m in zip(images, media, strict=True)), np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    keep = np.ones(len(raw), bool)
    keep[marks[after == 0] + 1] = False  # stuffed zeros
    ends = marks[(after & 0xF8 == 0xD0) | (after == 0xD9)]
    clean = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
    moved = np.cumsum(keep) - 1
    start = np.concatenate([[0], moved[ends[:-1] + 1] + 1])
    per = some.interval or None
    lanes, todo = [], []
    for image in images:
        n = 1 if per is None else -(-image.units // per)
        lanes.append(n)
        todo += [image.units] if per is None else [per] * (n - 1) + [image.units - per * (n - 1)]
    todo, n_blocks = np.array(todo, np.int64), len(some.blocks)
    if len(todo) != len(start):
        raise ValueError("restart markers are missing")
    window = np.zeros(len(clean) - 8, np.uint64)
    for j in range(5):
        window |= clean[j : j + len(window)].astype(np.uint64) << np.uint64(32 - 8 * j)
    component = np.array([b[0] for b in some.blocks])
    tables = list(dict.fromkeys([t for _, d, a in some.blocks for t in (d, 0x10 | a)]))
    lut = np.concatenate([_lut(some.huffman[t]) for t in tables])
    direct = np.array([tables.index(d) << 16 for _, d, _ in some.blocks])
    other = np.array([tables.index(0x10 | a) << 16 for _, _, a in some.blocks])
    n_lanes, most = len(start), int(todo.max(initial=0)) * n_blocks
    value = np.zeros((n_lanes, most * BLOCK), np.int16)
    total = todo * n_blocks * BLOCK
    at, lane = start * 8, np.arange(n_lanes)
    place = np.zeros(n_lanes, np.int64)  # of the next coefficient within the lane
    predicted = np.zeros((n_lanes, int(component.max(initial=0)) + 1), np.int64)
    while len(lane):
        k, block = place & 63, (place >> 6) % n_blocks
        bits = window[at >> 3] << (at & 7).astype(np.uint64)
        found = lut[np.where(k == 0, direct[block], other[block]) + ((bits >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)]
        length, run, size = (found >> 8).astype(np.int64), (found >> 4) & 15, (found & 15).astype(np.int64)
        if not length.all():
            raise ValueError("no such code")
        extra = ((bits >> (40 - length - size).astype(np.uint64)) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        v = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        at += length + size
        head = k == 0
        place += np.where(head, 0, run)
        if head.any():
            c = component[block[head]]
            predicted[lane[head], c] += v[head]
            v[head] = predicted[lane[head], c]
        whole = ~head & (size == 0) & (run == 0)  # end of block
        value[lane, np.minimum(place, value.shape[1] - 1)] += np.where((size > 0) | head, v, 0).astype(np.int16)
        place = np.where(whole, (place | 63) + 1, place + 1)
        left = place < total[lane]
        if not left.all():
            lane, at, place = lane[left], at[left], place[left]
    first, out = 0, []
    for image, n in zip(images, lanes, strict=True):
        own = np.concatenate([value[first + j, : total[first + j]] for j in range(n)]) if n > 1 and total[first] != total[first + n - 1] else value[first : first + n, : total[first]].reshape(-1)
        out.append(own.reshape(image.units, n_blocks, BLOCK))
        first += n
    return out


def payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` was given."""
    size = struct.unpack(">Q", image.comment)[0]
    return _BYTE[coefficients.reshape(-1)[:size].astype(np.int64) + 128].tobytes()


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, a pixel a block: an eighth of each dequantised direct-current coefficient, plus 128, in 0 to 255."""
    component = image.scan[0][0]
    h, v, table = image.components[component]
    y = coefficients[:, : h * v, 0].astype(np.int64) * int(image.quantisation[table][0])
    y = y.reshape(image.rows, image.columns, v, h).transpose(0, 2, 1, 3).reshape(image.rows * v, image.columns * h)
    return np.clip(y // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: cells of an 8 x 8 grid whose mean is above the mean of all cells."""
    rows, columns = (np.arange(THUMB) * pixels.shape[i] // THUMB for i in (0, 1))
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    bottom, right = np.maximum(rows + 1, np.append(rows[1:], pixels.shape[0])), np.maximum(columns + 1, np.append(columns[1:], pixels.shape[1]))
    area = (bottom - rows)[:, None] * (right - columns)[None]
    cells = (sums[np.ix_(bottom, right)] - sums[np.ix_(rows, right)] - sums[np.ix_(bottom, columns)] + sums[np.ix_(rows, columns)]) / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as UTF-8, filled with spaces to a positive multiple of 192, as a JPEG."""

    @trimmed
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column(1))
            for lo, hi in runs(offsets, BATCH):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                filled = [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT) for t in texts]
                media = encode(np.frombuffer(b"".join(filled), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in filled])]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def stored(documents: DataFrame) -> DataFrame:
    """The media of ``documents``, written to files below the shared folder and read from them again."""
    return Tables(documents.sparkSession, "media").keep("media", to_media(documents))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored media back: payload digests, dimensions and thumbnail hashes."""

    @trimmed
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column(2))
            for lo, hi in runs(offsets, BATCH):
                media = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                rows = []
                for doc_id, n_bytes, m, (image, coefficients) in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), media, decode(media), strict=True):
                    p, h = payload(image, coefficients), thumbnail_hash(thumbnail(image, coefficients))
                    rows.append((doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{image.width}x{image.height}:{h}", image.width, image.height, h))
                names = [x.split()[0] for x in FEATURES.split(", ")]
                kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(load, FEATURES)
