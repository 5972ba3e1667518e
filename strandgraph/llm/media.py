"""Media columns: lossless grey PNG in a binary column and a cosine-transform hash of it.

The codec writes and reads the published format itself: signature, length-tagged chunks
with CRC-32, zlib stream, one filter byte per scan line. Reading tests every checksum and
undoes all five line filters with numpy.
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

from strandgraph.llm.common import col

WIDTH, LEVEL, CHUNK, GRID, LOW = 64, 1, 1 << 16, 32, 8
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey PNG of ``samples``, a positive multiple of ``width`` bytes.

    The line filter (none, left or up) with the least sum of distances to zero is used.
    """
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole scan lines")
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    cost = [int(np.minimum(x, 0 - x).sum(dtype=np.int64)) for x in (image, left, up)]
    kind = cost.index(min(cost))
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = (image, left, up)[kind]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))
    body = b"".join(_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK))
    return _SIGNATURE + head + body + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the filter of each line; runs of lines with none, left or up are undone at once."""
    out = np.empty_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind, part = int(kinds[s]), lines[s:e]
        if kind == 0:
            out[s:e] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[s:e])
        elif kind == 2:
            out[s:e] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(s, e):
                prior, row, was = above.astype(int).tolist(), lines[y].tolist(), 0
                corner, line = 0, []
                for x, (v, b) in enumerate(zip(row, prior, strict=True)):
                    if kind == 3:
                        guess = (was + b) // 2
                    else:
                        pa_, pb, pc = abs(b - corner), abs(was - corner), abs(was + b - 2 * corner)
                        guess = was if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
                    was, corner = (v + guess) & 255, b
                    line.append(was)
                out[y] = line
                above = out[y]
        else:
            raise ValueError(f"unknown line filter {kind}")
        above = out[e - 1]
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG, height x width; any damage raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, size, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r} fails")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlace")
            size = height, width
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("no header or no end")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise ValueError("broken zlib stream") from error
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None])


_DCT = _cosines(GRID, LOW)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: the low 8 x 8 cosine coefficients of the image's 32 x 32 means against their median."""
    small = image.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        total = np.concatenate([np.zeros_like(small.take([0], axis)), np.cumsum(small, axis)], axis)
        edge = np.linspace(0, n, GRID + 1)
        whole = np.minimum(edge.astype(np.int64), n - 1)
        at = total.take(whole, axis) + small.take(whole, axis) * (edge - whole).reshape((-1, 1) if axis == 0 else (1, -1))
        small = np.diff(at, axis=axis) * (GRID / n)
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros appended up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 if data else 64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media binary, feature binary, payload_*, ...)`` per row of ``docs``.

    The stored bytes are read back, and everything but n_bytes and the media itself is
    computed from what was read. Null and empty texts store 64 zero bytes.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    data = payload(text)
                    media = encode_png(data)
                    image = decode_png(media)
                    back = image.tobytes()
                    rows.append((len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), media, cosine_hash(image)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows, strict=True))], names=names)

    thin = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, feature binary")


def media_digest(media: DataFrame) -> DataFrame:
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )
