"""Media columns: Netpbm and BMP images to numpy, area-resized, as NPY tiles with difference hashes.

Images are decoded to arrays of 8-bit samples. Any area's sum is a difference of
four entries of the integral image (interpolated where an edge falls inside a
sample), so a resize to any shape takes one pass over the samples and then work
in proportion to the output. The integral image is carried over strips of rows
and kept only at the output's edges, so memory stays bounded for any height.
A tile is the resized image in NPY form; the difference hash compares each
cell of a 9 by 8 resize with its right neighbour.

The query stores every text's bytes as a PGM image 64 samples wide, decodes the
stored bytes again and takes all else from what was read back; its tiles are
written as NPY columns and read again.

Scale: two maps over the rows, no shuffle; memory is one Arrow batch and one
image. Defined results: null counts as empty; an empty text is one row of zero
bytes; repeated rows give equal values; bytes that are no image, among them images that are
cut short or have samples above their maximum, give null columns in ``tiles``. Extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from .tables import Scratch, map_arrow, read

WIDTH = 64
TILE = (16, 16)
STRIP_ROWS = 4096
#: Images that go from and to Arrow at once; bytes of the payload whose checksum is shown.
BATCH_IMAGES, TAIL = 512, 64

#: White space of Netpbm headers.
_BLANK = b" \t\n\r\v\f"
_MOST_DIGITS = 10


class NotAnImage(ValueError):
    """The bytes are no image of a supported form."""


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8, copy=False).tobytes()


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """So many decimal numbers from a place on, each after blanks and comments, and the place after the blank that ends the last."""
    found = []
    for _ in range(count):
        begin = at
        while at < len(data) and (data[at] in _BLANK or data[at] == 0x23):
            if data[at] == 0x23:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        digits = at
        while at < len(data) and at - digits <= _MOST_DIGITS and 0x30 <= data[at] <= 0x39:
            at += 1
        if digits == begin or not 0 < at - digits <= _MOST_DIGITS:
            raise NotAnImage("a header without its numbers")
        found.append(int(data[digits:at]))
    if at >= len(data) or data[at] not in _BLANK:
        raise NotAnImage("a header that doesn't end")
    return found, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind, bits = data[:2], data[:2] in (b"P1", b"P4")
    (width, height, *rest), at = _numbers(data, 2, 2 if bits else 3)
    most = 1 if bits else rest[0]
    if not 0 < most < 65536 or not width or not height:
        raise NotAnImage("an empty image or a wrong maximum")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n, room = width * height * depth, len(data) - at
    if kind == b"P4":
        row = (width + 7) // 8
        if room < row * height:
            raise NotAnImage("too short")
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return (1 - flat) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        wide = 2 if most > 255 else 1
        if room < n * wide:
            raise NotAnImage("too short")
        flat = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, n, at)
    else:
        if room < n:  # a sample takes a byte at least
            raise NotAnImage("too short")
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        found = list(text.translate(None, _BLANK)[:n]) if kind == b"P1" else text.split(None, n)[:n]
        if len(found) < n:
            raise NotAnImage("too short")
        if kind == b"P1":
            flat = 0x31 - np.array(found, np.int64)
        elif all(x.isdigit() and len(x) <= _MOST_DIGITS for x in found):
            flat = np.array([int(x) for x in found])
        else:
            raise NotAnImage("a sample that is no number")
        if flat.min() < 0:
            raise NotAnImage("a bit that is neither 0 nor 1")
    if flat.max() > most:
        raise NotAnImage("a sample above the maximum")
    if most != 255:
        flat = (flat.astype(np.float64) * 255 / most + 0.5).astype(np.uint8)
    flat = flat.astype(np.uint8, copy=False)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def _run_lengths(data: bytes, at: int, width: int, rows: int, depth: int) -> np.ndarray:
    """Colour numbers of a run-length coded BMP (8 or 4 bits), first row first; what no run covers is 0."""
    out, x, y = np.zeros((rows, width), np.uint8), 0, 0
    while at + 1 < len(data) and y < rows:
        count, value = data[at], data[at + 1]
        at += 2
        if count or value > 2:  # a run, or so many samples as they are
            n = count or value
            if count:
                pair = (value >> 4, value & 15) if depth == 4 else (value, value)
                samples = np.tile(np.array(pair, np.uint8), (n + 1) // 2)[:n]
            else:
                held = (n + 1) // 2 if depth == 4 else n
                own = np.frombuffer(data[at : at + held].ljust(held, b"\0"), np.uint8)
                samples = np.stack([own >> 4, own & 15], 1).ravel()[:n] if depth == 4 else own
                at += held + held % 2
            room = max(0, min(n, width - x))
            out[y, x : x + room] = samples[:room]
            x += n
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        else:  # move right and on
            if at + 1 >= len(data):
                break
            x, y, at = x + data[at], y + data[at + 1], at + 2
    return out


def _field(words: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask, as samples of 0 to 255."""
    if not mask:
        return np.zeros(words.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((words & np.uint32(mask)) >> np.uint32(low)).astype(np.float64)) * 255 / most + 0.5).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed forms of 1, 4, 8, 16, 24 and 32 bits, bit fields, 8 and 4 bit run lengths, and OS/2 headers of 12 bytes."""
    if len(data) < 26:
        raise NotAnImage("too short")
    offset, size = struct.unpack_from("<II", data, 10)
    packing = colours = 0
    if size == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
    elif size >= 40 and len(data) >= 54:
        width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
        colours = struct.unpack_from("<I", data, 46)[0]
    else:
        raise NotAnImage("a header of unknown length")
    coded = {1: 8, 2: 4}.get(packing) == depth and height > 0
    if depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or not (packing == 0 or coded or packing in (3, 6) and depth in (16, 32)):
        raise NotAnImage("a form of BMP that is not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if coded:
        # a run of two bytes covers 255 samples at most, and a row's end or a move takes two more
        if offset > len(data) or rows * width > 255 * len(data):
            raise NotAnImage("too short")
        body = _run_lengths(data, offset, width, rows, depth)
    else:
        if len(data) < offset + rows * stride:
            raise NotAnImage("too short")
        body = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if height > 0:  # stored from the bottom up
        body = body[::-1]
    if depth <= 8:
        if not coded and depth < 8:
            bits = np.unpackbits(body, axis=1).reshape(rows, -1, depth)
            body = bits @ (1 << np.arange(depth - 1, -1, -1))
        body = body[:, :width]
        each = 3 if size == 12 else 4
        table = np.zeros((256, 3), np.uint8)
        held = max(0, min(colours or 1 << depth, 256, (len(data) - 14 - size) // each))
        table[:held] = np.frombuffer(data[14 + size : 14 + size + each * held], np.uint8).reshape(held, each)[:, 2::-1]
        out = table[body]
        return out[..., 0].copy() if (out[..., 0] == out[..., 1]).all() and (out[..., 1] == out[..., 2]).all() else out
    if depth == 24:
        return body[:, : width * 3].reshape(rows, width, 3)[..., ::-1].copy()
    words = np.ascontiguousarray(body[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4").astype(np.uint32)
    masks = (0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF)
    if packing:  # the masks follow a header of 40 bytes, or are part of a longer one
        if len(data) < 66:
            raise NotAnImage("too short")
        masks = struct.unpack_from("<III", data, 54)
    return np.stack([_field(words, m) for m in masks], -1)


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, from the bottom up."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = samples[::-1]
    table = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    table[:, 3] = 0
    offset = 54 + 1024
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", offset + body.size, 0, 0, offset, 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0) + table.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples as (rows, columns), or (rows, columns, 3) in RGB order."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    raise NotAnImage("neither Netpbm nor BMP")


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else (samples.astype(np.float64) @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def area_resize(samples: np.ndarray, *shapes: tuple[int, int]) -> list[np.ndarray]:
    """The mean of the area under each output cell, for each (rows, columns) asked for, from one integral image."""
    height, width = samples.shape
    edges = [(np.linspace(0, height, rows + 1), np.linspace(0, width, columns + 1)) for rows, columns in shapes]
    wanted = np.unique(np.concatenate([np.concatenate((np.floor(y), np.ceil(y))) for y, _ in edges])).astype(np.int64)
    kept = np.zeros((len(wanted), width + 1))  # of the integral image, the rows at or beside an edge
    carry = np.zeros(width + 1)
    for top in range(0, height, STRIP_ROWS):
        strip = np.cumsum(samples[top : top + STRIP_ROWS], axis=0, dtype=np.int64)
        at = np.flatnonzero((wanted > top) & (wanted <= top + len(strip)))
        kept[at, 1:] = carry[1:] + np.cumsum(strip[wanted[at] - top - 1], axis=1)
        carry[1:] += np.cumsum(strip[-1])
    out = []
    for y, x in edges:
        low, high = np.floor(y).astype(np.int64), np.ceil(y).astype(np.int64)
        share = (y - low)[:, None]
        rows = kept[np.searchsorted(wanted, low)] * (1 - share) + kept[np.searchsorted(wanted, high)] * share
        left, right = np.floor(x).astype(np.int64), np.ceil(x).astype(np.int64)
        share = x - left
        corner = rows[:, left] * (1 - share) + rows[:, right] * share
        area = np.diff(y)[:, None] * np.diff(x)[None, :]
        out.append(np.diff(np.diff(corner, axis=0), axis=1) / area)
    return out


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(samples), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def features(samples: np.ndarray, tile: tuple[int, int] = TILE) -> tuple[bytes, str]:
    """(NPY tile, difference hash in 16 hex digits)."""
    small, cells = area_resize(grey(samples), tile, (8, 9))
    cells = cells.round(6)  # so that equal areas compare as equal
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel())
    return npy((small + 0.5).astype(np.uint8)), bits.tobytes().hex()


def tiles(images: DataFrame, image_col: str = "image", tile: tuple[int, int] = TILE, samples: bool = False) -> DataFrame:
    """The images' other columns, and height, width, npy and dhash, and with ``samples`` their bytes, row by row;
    those are null where the bytes are null or no image."""
    others = [c for c in images.columns if c != image_col]
    added = {"height": IntegerType(), "width": IntegerType(), "npy": BinaryType(), "dhash": StringType()} | ({"samples": BinaryType()} if samples else {})
    if clash := set(added) & set(others):
        raise ValueError(f"columns that the result needs are taken: {sorted(clash)}")

    def one(data):
        try:
            found = decode(data)
        except NotAnImage:
            return (None,) * 5
        return (*found.shape[:2], *features(found, tile), found.tobytes())

    types = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary())[: len(added)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_IMAGES):
                part = batch.slice(at, BATCH_IMAGES)
                rows = [(None,) * 5 if data is None else one(data) for data in part.column(len(others)).to_pylist()]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *made], [*others, *added])

    schema = StructType([*images.select(*others).schema.fields, *(StructField(c, t) for c, t in added.items())])
    return map_arrow(images.select(*others, image_col), make, schema)


def store(data: bytes, width: int = WIDTH) -> bytes:
    """The bytes as a PGM image, zeros appended to fill its rows (one at least)."""
    rows = max(1, -(-len(data) // width))
    return encode_pgm(np.frombuffer(data.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the text's bytes as a PGM image) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_IMAGES):
                part = batch.slice(at, BATCH_IMAGES)
                data = [d or b"" for d in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([store(d) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return map_arrow(rows, make, "doc_id bigint, n_bytes bigint, media binary")


def stored_texts(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text stored as an image, and digests of what is read back from it: the payload
    of its samples, and the NPY tiles, which are written and read again."""
    media = stored(docs, id_col, text_col)
    read_back = tiles(media.withColumn("image", F.col("media")), samples=True)
    sha = lambda c: F.sha2(c, 256)
    payload = F.col("samples")
    written = scratch.cut(read_back.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), sha(payload).alias("payload_sha256"),
        F.crc32(F.substring(payload, -TAIL, TAIL)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), sha(F.col("media")).alias("media_sha256"), "npy", "dhash",
    ), "tiles")
    tile = F.lpad(F.lower(F.hex(F.crc32("npy"))), 8, "0")
    return written.select(*(c for c in written.columns if c not in ("npy", "dhash")), F.concat_ws(":", "dhash", tile).alias("feature"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(read(spark, sf_dir, "documents"), Scratch(spark, "op8"))
