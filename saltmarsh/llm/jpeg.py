"""Media columns: bytes kept losslessly as baseline JPEG, and a reader of baseline JPEG for thumbnails.

The writer makes each payload byte the DC coefficient of one 8x8 block of a greyscale image, with a restart
marker after each row of blocks. The reader takes baseline JPEGs of one scan: it parses markers, decodes the Huffman
scans of all restart intervals of a batch in step with each other, and rebuilds the luminance at an eighth of
the size from the DC coefficients.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cached, pieces, shared_dir

#: Blocks in a row of the images written, and bytes of a square of blocks.
SIDE, TILE = 24, 576
#: Squares in one image: no side may exceed 65535 pixels. Longer payloads take several images.
TILES = 65535 // (8 * SIDE)
#: Payload bytes that are coded at once.
CHUNK = 2 << 20
BLOCK_BITS = 12


class Huffman(NamedTuple):
    length: np.ndarray
    symbol: np.ndarray


@cached(256, entry=False)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    """Code length and symbol of every 16-bit window; length 0 where no code begins so."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            at, span = code << (16 - n), 1 << (16 - n)
            length[at : at + span], symbol[at : at + span] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return Huffman(length, symbol)


#: A difference of category s takes 11 - s bits of code and s bits of value, and the end of the block one
#: bit: every block is 12 bits, so rows of 24 blocks end on a byte.
DC_COUNTS = bytes([0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(8, -1, -1))
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), b"\x00"


def _codes() -> np.ndarray:
    """The 12 bits of every difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    codes, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(DC_COUNTS[n - 1]):
            codes[DC_SYMBOLS[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value = d if d >= 0 else d + (1 << s) - 1
        code, n = codes[s]
        assert n + s + 1 == BLOCK_BITS
        out[d + 255] = ((code << s) | value) << 1
    return out


CODES = _codes()


def _head(tiles: int) -> bytes:
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", part(0xDB, b"\x00" + b"\x08" * 64), part(0xC0, struct.pack(">BHHB", 8, 8 * SIDE * tiles, 8 * SIDE, 1) + b"\x01\x11\x00"),
        part(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS), part(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS), part(0xDD, struct.pack(">H", SIDE)), part(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


HEADS = {}


def _encode_images(images: list[bytes]) -> list[bytes]:
    """One JPEG for each payload (whole squares, at most TILES of them)."""
    values = np.frombuffer(b"".join(images), np.uint8).reshape(-1, SIDE).astype(np.int16)
    diff = values.copy()
    diff[:, 1:] -= values[:, :-1]
    diff[:, 0] -= 128
    bits = CODES[diff + 255]
    a, b = bits[:, ::2], bits[:, 1::2]
    raw = np.empty((len(values), SIDE // 2, 3), np.uint8)
    raw[:, :, 0], raw[:, :, 1], raw[:, :, 2] = a >> 4, (a & 15) << 4 | b >> 8, b & 255
    raw = raw.reshape(len(values), -1)
    stuffed = raw == 255
    width = stuffed + np.uint8(1)
    width[:, -1] += 2
    ends = np.cumsum(width.reshape(-1), dtype=np.int64)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - width.reshape(-1)] = raw.reshape(-1)
    rows = np.array([len(x) // SIDE for x in images])
    last = np.cumsum(rows)
    number = np.arange(len(values)) - np.repeat(last - rows, rows)
    row_ends = ends.reshape(raw.shape)[:, -1]
    out[row_ends - 2] = 255
    out[row_ends - 1] = 0xD0 + number % 8
    out[row_ends[last - 1] - 1] = 0xD9
    cuts, done, at = row_ends[last - 1].tolist(), [], 0
    for x, end in zip(images, cuts):
        n = len(x) // TILE
        if n not in HEADS:
            HEADS[n] = _head(n)
        done.append(HEADS[n] + out[at:end].tobytes())
        at = end
    return done


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (its length a positive multiple of 576): one JPEG after another."""
    parts, images, size, done = [], [], 0, []
    for x in payloads:
        step = TILES * TILE
        own = [x[i : i + step] for i in range(0, len(x), step)]
        parts.append(len(own))
        for image in own:
            images.append(image)
            size += len(image)
            if size >= CHUNK:
                done += _encode_images(images)
                images, size = [], 0
    if images:
        done += _encode_images(images)
    out, at = [], 0
    for n in parts:
        out.append(done[at] if n == 1 else b"".join(done[at : at + n]))
        at += n
    return out


class Layout(NamedTuple):
    """What two images must share to be decoded together: for each component its sampling, tables and quantizer."""

    components: tuple[tuple[int, int, bytes, bytes, bytes, bytes, int], ...]


class Image(NamedTuple):
    width: int
    height: int
    restart: int
    layout: Layout
    scan: bytes


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The baseline JPEG that starts at ``at``, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG begins here")
    at, quant, tables, restart, frame = at + 2, {}, {}, 0, None
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            frame = body
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            break
    height, width, n = struct.unpack(">HHB", frame[1:6])
    kind = {frame[6 + 3 * i]: (frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(n)}
    if body[0] != n:
        raise ValueError("a scan of some components only")
    own = []
    for i in range(n):
        h, v, q = kind[body[1 + 2 * i]]
        dc, ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
        own.append((h, v, *tables[dc], *tables[16 + ac], quant[q]))
    if n == 1:
        own[0] = (1, 1, *own[0][2:])
    end = data.find(b"\xff\xd9", at)
    if end < 0:
        raise ValueError("a JPEG without an end")
    return Image(width, height, restart, Layout(tuple(own)), data[at:end]), end + 2


def _in_step(layout: Layout, window: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    most, top = int(counts.max()), len(window) - 1
    first = layout.components[0]
    out = np.zeros((len(at), most, first[0] * first[1]), np.int32)
    before = [np.zeros(len(at), np.int32) for _ in layout.components]
    tables = [(huffman(c[2], c[3]), huffman(c[4], c[5])) for c in layout.components]
    even = bool((counts == most).all())

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, top)] << (p & 7).astype(np.uint32)

    for mcu in range(most):
        live = slice(None) if even else np.flatnonzero(counts > mcu)
        p = at[live]
        for c, (h, v, *_rest) in enumerate(layout.components):
            dc, ac = tables[c]
            for block in range(h * v):
                word = peek(p) >> np.uint32(16)
                n, s = dc.length[word], dc.symbol[word].astype(np.int64)
                if not n.all():
                    raise ValueError("a scan that can't be decoded")
                p = p + n
                # s bits of value: the upper half of their range is positive
                value = ((peek(p) >> np.uint32(1)) >> (31 - s).astype(np.uint32)).astype(np.int32)
                one = np.int32(1) << s.astype(np.int32)
                value += np.where(value < one >> 1, 1 - one, 0).astype(np.int32)
                p = p + s
                before[c][live] += value
                if c == 0:
                    out[live, mcu, block] = before[0][live]
                k = np.ones(len(p), np.int64)
                open_ = None  # all
                while True:
                    q = p if open_ is None else p[open_]
                    word = peek(q) >> np.uint32(16)
                    n, s = ac.length[word].astype(np.int64), ac.symbol[word].astype(np.int64)
                    if not n.all():
                        raise ValueError("a scan that can't be decoded")
                    q = q + n + (s & 15)
                    more = (k if open_ is None else k[open_]) + (s >> 4) + 1
                    more[s == 0] = 64
                    if open_ is None:
                        p, k = q, more
                        left = np.flatnonzero(k < 64)
                    else:
                        p[open_], k[open_] = q, more
                        left = open_[more < 64]
                    if not len(left):
                        break
                    open_ = left
        at[live] = p
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The luminance of each image at an eighth of its size, rounded up, from its DC coefficients."""
    done: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        alike.setdefault((x.layout, x.restart), []).append(i)
    for (layout, restart), members in alike.items():
        h, v = (max(c[i] for c in layout.components) for i in (0, 1))
        wide = [-(-images[i].width // (8 * h)) for i in members]
        high = [-(-images[i].height // (8 * v)) for i in members]
        total = np.array(wide, np.int64) * np.array(high)
        step = np.full(len(members), restart) if restart else total
        parts = -(-total // step)
        first = np.cumsum(parts) - parts
        counts = np.repeat(step, parts)
        counts[first + parts - 1] = total - (parts - 1) * step
        # Intervals end at restart markers; zeros after 255 are stuffing.
        raw = np.frombuffer(b"".join(images[i].scan + b"\xff\xd0" for i in members), np.uint8)
        full = np.flatnonzero(raw[:-1] == 255)
        after = raw[full + 1]
        keep = np.ones(len(raw), bool)
        keep[full[after == 0] + 1] = False
        marks = full[(after >= 0xD0) & (after <= 0xD7)]
        if len(marks) != parts.sum():
            raise ValueError("restart markers don't fit the size")
        keep[marks], keep[marks + 1] = False, False
        ends = np.cumsum(keep)[marks]
        data = np.concatenate([raw[keep], np.full(4, 255, np.uint8)]).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) * 8
        found = _in_step(layout, window, starts, counts)
        y_h, y_v, quant = layout.components[0][0], layout.components[0][1], layout.components[0][6]
        light = np.clip((found * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
        light = light.reshape(len(counts), -1, y_v, y_h)
        valid = np.arange(light.shape[1])[None, :] < counts[:, None]
        flat = light[valid] if not valid.all() else light.reshape(-1, y_v, y_h)
        at = 0
        for i, w, t in zip(members, wide, high):
            grid = flat[at : at + w * t].reshape(t, w, y_v, y_h).transpose(0, 2, 1, 3).reshape(t * y_v, w * y_h)
            x = images[i]
            done[i] = grid[: -(-x.height * y_v // (8 * v)), : -(-x.width * y_h // (8 * h))]
            at += w * t
    return done


def read(media: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(media):
        image, at = parse(media, at)
        out.append(image)
    return out


def hashes(thumb: np.ndarray) -> str:
    """Average and difference hash of a thumbnail, each over 64 cells (a thumbnail of fewer rows or columns repeats them)."""
    h, w = thumb.shape
    rows, cols = (np.arange(8) * h) // 8, (np.arange(9) * w) // 9
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
    area = np.diff(np.append(rows, h)).clip(1)[:, None] * np.diff(np.append(cols, w)).clip(1)
    mean = sums * 1024 // area
    return np.packbits(mean[:, :8] > thumb.mean() * 1024).tobytes().hex() + ":" + np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def describe(media: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """(payload, feature) of each stored value; the feature has dimensions and thumbnail hashes of its images."""
    held: list[list[Image]] = []
    size = 0

    def flush() -> Iterator[tuple[bytes, str]]:
        images = [x for own in held for x in own]
        found = iter(list(zip(images, thumbnails(images))))
        for own in held:
            pairs = [next(found) for _ in own]
            yield b"".join(t.tobytes() for _, t in pairs), "+".join(f"{x.width}x{x.height}:{hashes(t)}" for x, t in pairs)

    for x in media:
        held.append(read(x))
        size += len(x)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % TILE or (0 if data else TILE))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): every whole text as JPEG. Null and empty texts are one square of 255; an empty
    table gives no rows; rows of null or repeated id stay; other columns are not read."""
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=CHUNK):
            media = encode([padded(x.as_py()) for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, media binary")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _features(ids: pa.Array, media: list[bytes]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for stored, (payload, feature) in zip(media, describe(media)):
        n = len(payload.rstrip(b"\xff"))
        row = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature
        for c, v in zip(columns, row):
            c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """What a media column (doc_id, media) holds, read back from its bytes; null media are refused."""
    shared_dir(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=CHUNK):
            yield _features(b.column(0), b.column(1).to_pylist())

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and reads back in one pass, so that the stored column needn't move between processes."""
    shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=CHUNK):
            yield _features(b.column(0), encode([padded(x.as_py()) for x in b.column(1)]))

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").mapInArrow(run, FEATURES)
