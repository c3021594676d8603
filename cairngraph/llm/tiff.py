"""Media columns: TIFF files held in a binary column.

A file is an image directory chain; every directory is one page, stored as strips
or tiles that may be PackBits, LZW or deflate packed and may carry a horizontal
predictor.  ``pages`` walks the chain and emits one row per page.

Defined results: a null or unreadable file gives one row with ``page`` null and the
reason in ``error``; an empty table gives no rows; the key column is carried through
under its own name, every other input column is left out so names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

# Fixed values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
LZW_CLEAR, LZW_END, LZW_FIRST = 256, 257, 258


class BadImage(ValueError):
    """The file breaks the format or uses a part of it that isn't covered."""


# ---- packers -------------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            if i >= n:
                raise BadImage("PackBits run without a byte")
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out, table = bytearray(), []
    width, have, bits, last = 9, 0, 0, b""
    for byte in data:
        bits = (bits << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == LZW_CLEAR:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == LZW_END:
            return bytes(out)
        if not table:
            raise BadImage("LZW data don't start with a clear code")
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise BadImage("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table, width, size = {bytes((i,)): i for i in range(256)}, 9, LZW_FIRST

    def put(code: int) -> None:
        nonlocal bits, have
        bits = (bits << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(LZW_CLEAR)
    held = b""
    for byte in data:
        longer = held + bytes((byte,))
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = size
        size += 1
        if size >= 4094:
            put(LZW_CLEAR)
            table, width, size = {bytes((i,)): i for i in range(256)}, 9, LZW_FIRST
        elif size >= 1 << width:
            width += 1
        held = bytes((byte,))
    if held:
        put(table[held])
        if size + 1 >= 1 << width and width < 12:
            width += 1
    put(LZW_END)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        raw = data
    elif how in (DEFLATE, DEFLATE_OLD):
        try:
            raw = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadImage(str(e)) from e
    elif how == LZW:
        raw = lzw_decode(data)
    elif how == PACKBITS:
        raw = packbits_decode(data)
    else:
        raise BadImage(f"compression {how}")
    if len(raw) < size:
        raise BadImage(f"{len(raw)} of {size} bytes in a block")
    return raw[:size]


def _pack(data: bytes, how: int) -> bytes:
    return {NONE: lambda x: x, DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: packbits_encode}[how](data)


# ---- reading -------------------------------------------------------------------------------------


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes  #: samples row by row, without padding


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = TYPE_BYTES.get(kind, 0) * count
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            code = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
            if code == "s":
                tags[tag] = struct.unpack_from(f"{order}{count}s", data, where)
            elif code:
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise BadImage("directory outside the file") from e
    return tags, following


def _block(data: bytes, tags: dict, i: int, at: int, sizes: int, rows: int, columns: int, samples: int) -> np.ndarray:
    how, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    begin, size = tags[at][i], tags[sizes][i]
    if begin + size > len(data):
        raise BadImage("block outside the file")
    raw = np.frombuffer(_unpack(data[begin : begin + size], how, rows * columns * samples), np.uint8).reshape(rows, columns, samples)
    if predictor == 2:
        raw = np.add.accumulate(raw, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise BadImage(f"predictor {predictor}")
    return raw


def read(data: bytes) -> Iterator[Page]:
    """All pages of a file with 8-bit samples in one plane, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadImage("no TIFF header")
    (at,), seen, number = struct.unpack_from(order + "I", data, 4), set(), 0
    while at:
        if at in seen:
            raise BadImage("directories form a ring")
        seen.add(at)
        tags, following = _directory(data, order, at)
        try:
            width, height = tags[WIDTH][0], tags[LENGTH][0]
            samples = tags.get(SAMPLES, (1,))[0]
            if set(tags.get(BITS, (1,))) != {8} or samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
                raise BadImage("only 8-bit samples in one plane are read")
            tiled = TILE_AT in tags
            if tiled:
                tw, tl = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
                across = -(-width // tw)
                rows = []
                for y in range(-(-height // tl)):
                    row = [_block(data, tags, y * across + x, TILE_AT, TILE_BYTES, tl, tw, samples) for x in range(across)]
                    rows.append(np.concatenate(row, axis=1)[: height - y * tl, :width])
            else:
                per = min(tags.get(STRIP_ROWS, (height,))[0], height) or 1
                rows = [_block(data, tags, k, STRIP_AT, STRIP_BYTES, min(per, height - k * per), width, samples) for k in range(-(-height // per))]
            pixels = b"".join(x.tobytes() for x in rows)
        except (KeyError, IndexError) as e:
            raise BadImage(f"directory lacks {e}") from e
        yield Page(number, width, height, samples, tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0], tiled, pixels)
        at, number = following, number + 1


# ---- writing -------------------------------------------------------------------------------------


def write(pages: list[tuple[bytes, int]], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 1024, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of one-sample 8-bit pages, each given as (samples, width)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for data, width in pages:
        height = len(data) // width
        image = np.frombuffer(data, np.uint8).reshape(height, width)
        if tile:
            tw, tl = tile
            image = np.pad(image, ((0, -height % tl), (0, -width % tw)))
            blocks = [image[y : y + tl, x : x + tw] for y in range(0, image.shape[0], tl) for x in range(0, image.shape[1], tw)]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        starts, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            packed = _pack(np.ascontiguousarray(block).tobytes(), compression)
            starts.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_LENGTH, 4, [tile[1]]), (TILE_AT, 4, starts), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, starts), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        out += b"\0" * (len(out) % 2)
        entries = []
        for tag, kind, values in sorted(tags):
            code, size = ("H", 2) if kind == 3 else ("I", 4)
            raw = struct.pack(f"<{len(values)}{code}", *values)
            if size * len(values) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", where)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


# ---- operators -----------------------------------------------------------------------------------

PAGE_COLUMNS = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, media_bytes long, media_sha256 string, data binary, error string"


def pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each file in the binary column ``media``: see the module's docstring."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    if data is None:
                        raise BadImage("no file")
                    found = [(k, p.page, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, size, digest, p.data, None) for p in read(data)]
                except BadImage as e:
                    found = [(k, *[None] * 7, size, digest, None, str(e))]
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    kind = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("key"), F.col(media).alias("media"))
    types = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [key, "page", "width", "height", "samples", "compression", "predictor", "tiled", "media_bytes", "media_sha256", "data", "error"]
    if kind not in ("bigint", "int", "string"):
        source, kind = source.withColumn("key", F.col("key").cast("string")), "string"
    return source.mapInArrow(run, f"`{key}` {kind}, {PAGE_COLUMNS}")


def from_text(df: DataFrame, key: str, text: str, width: int = 64, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Stores each text (null: empty) as a one-page file: UTF-8, then bytes 0 up to a positive multiple of ``width``."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, files = [], []
            for value in batch.column(1).to_pylist():
                data = b"" if value is None else value
                sizes.append(len(data))
                files.append(write([(data + b"\0" * (-len(data) % width or (0 if data else width)), width)], compression, predictor))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [key, "n_bytes", "media"])

    return df.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, media binary")


def features(df: DataFrame, carried: list[str]) -> DataFrame:
    """Digests and a feature line of the decoded samples of each page, and the columns ``carried``."""

    def run(batches):
        for batch in batches:
            shas, tails, lines, sizes = [], [], [], []
            for data in batch.column("data").to_pylist():
                data = data or b""
                x = np.frombuffer(data, np.uint8)
                counts = np.bincount(x, minlength=256)
                p = counts[counts > 0] / max(1, len(x))
                entropy = float(-(p * np.log2(p)).sum()) if len(x) else 0.0
                edges = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
                tails.append(zlib.crc32(data[-64:]))
                lines.append(f"mean={x.mean() if len(x) else 0:.6f};entropy={entropy:.6f};edge={edges:.6f};high={int(counts[128:].sum())}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(tails, pa.int64()), pa.array(lines, pa.string())], [*carried, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    kept = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in carried)
    return df.mapInArrow(run, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
