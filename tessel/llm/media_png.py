"""PNG images in binary columns: reader, writer and a cosine-transform hash.

The reader walks the chunks, tests every checksum, inflates the image data and
takes the row filters back with numpy.  Rows filtered by None, Sub and Up are
sums modulo 256 along an axis; Average and Paeth depend on the pixel just
rebuilt and go pixel by pixel.  The hash compares the low frequencies of a
32 x 32 grey picture with their median.

The format is that of the public PNG specification (ISO/IEC 15948).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm.textbytes import chunks

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type of the specification, for 8-bit samples.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Bytes in one row of a stored payload: 64 pixels of three 8-bit samples.
ROW = 192


class PngError(ValueError):
    """The bytes are not a PNG that this reader accepts."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """A PNG of ``pixels`` (height, width, channels).

    Each row takes the filter of None, Sub and Up whose signed bytes are
    smallest in sum, as the specification advises; ties go to the first.
    """
    height, width, channels = pixels.shape
    colour = {n: t for t, n in CHANNELS.items()}[channels]
    flat = pixels.reshape(height, width * channels)
    sub, up = flat.copy(), flat.copy()
    sub[:, channels:] -= flat[:, :-channels]
    up[1:] -= flat[:-1]
    forms = np.stack([flat, sub, up])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((height, 1 + flat.shape[1]), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = np.take_along_axis(forms, best[None, :, None].astype(np.int64), axis=0)[0]
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Samples from filtered rows; ``rows[:, 0]`` names each row's filter."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    height, width = out.shape
    if kinds.max(initial=0) > 4:
        raise PngError("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        out[sub] = np.cumsum(out[sub].reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), width)
    hard = np.flatnonzero(kinds >= 2)
    # Runs of Up rows are sums down the columns, from the row above the run.
    r = 0
    while r < len(hard):
        y = hard[r]
        above = out[y - 1] if y else np.zeros(width, np.uint8)
        if kinds[y] == 2:
            end = r
            while end + 1 < len(hard) and hard[end + 1] == hard[end] + 1 and kinds[hard[end + 1]] == 2:
                end += 1
            run = slice(y, hard[end] + 1)
            out[run] = np.cumsum(out[run], axis=0, dtype=np.uint8) + above
            r = end + 1
            continue
        line, b = out[y].reshape(-1, bpp).astype(np.int16), above.reshape(-1, bpp).astype(np.int16)
        left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
        for x in range(len(line)):
            if kinds[y] == 3:
                guess = (left + b[x]) // 2
            else:
                pa_, pb, pc = np.abs(b[x] - corner), np.abs(left - corner), np.abs(left + b[x] - 2 * corner)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b[x], corner))
            left, corner = (line[x] + guess) & 255, b[x]
            line[x] = left
        out[y] = line.reshape(-1).astype(np.uint8)
        r += 1
    return out


def decode(png: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit, not interlaced PNG; a palette beside true colours is passed over.

    Whatever else is wrong raises ``PngError``; no more is inflated than the
    header announces.
    """
    if png[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, header, data, ended, kinds = 8, None, [], False, []
    while at + 12 <= len(png) and not ended:
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) != n or len(png) < at + 12 + n:
            raise PngError("a chunk is cut short")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise PngError(f"checksum of {kind!r}")
        if (kind == b"IHDR") == bool(kinds):
            raise PngError("the header isn't the first chunk, and the only one")
        if kind == b"IHDR":
            if n != 13:
                raise PngError("a header of another length")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            if data and kinds[-1] != kind:
                raise PngError("image data in several places")
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif kind == b"PLTE":
            if data or kind in kinds or n % 3 or not 3 <= n <= 768 or header[3] not in (2, 6):
                raise PngError("a palette that can't be there")
        elif not kind[0] & 32:
            raise PngError(f"unknown critical chunk {kind!r}")
        kinds.append(kind)
        at += 12 + n
    if header is None or not ended:
        raise PngError("no header or end")
    width, height, depth, colour, packing, filters, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise PngError("only plain 8-bit images are read")
    if packing or filters:
        raise PngError("unknown compression or filter method")
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31:
        raise PngError("no pixels")
    bpp = CHANNELS[colour]
    size = height * (1 + width * bpp)
    inflater = zlib.decompressobj()
    try:
        raw = inflater.decompress(b"".join(data), size + 1)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != size or not inflater.eof:
        raise PngError("image data of another size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * bpp)
    return _unfilter(rows, bpp).reshape(height, width, bpp)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_DCT = _cosines(32, 8)


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal stretches of the first axis; a short axis is repeated first."""
    if len(a) < n:
        return a[np.arange(n) * len(a) // n]
    cuts = np.arange(n + 1) * len(a) // n
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
    return (total[cuts[1:]] - total[cuts[:-1]]) / (cuts[1:] - cuts[:-1]).reshape(-1, *[1] * (a.ndim - 1))


def dct_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median."""
    grey = pixels.astype(np.float64).mean(axis=2)
    small = _means(_means(grey, 32).T, 32).T
    low = np.round(_DCT @ small @ _DCT.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def pixels_of(payload: bytes) -> np.ndarray:
    """Bytes as rows of 64 RGB pixels, filled up with blanks to a positive multiple of a row."""
    padded = payload + b" " * (max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))
    return np.frombuffer(padded, np.uint8).reshape(-1, ROW // 3, 3)


def media_columns(docs: DataFrame, text: str = "text", row_id: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """Store each whole text as a PNG and read it back.

    Returns ``row_id, png, hash, n_bytes`` and, read back from the PNG, the
    ``payload`` (or, without it, ``payload_bytes, payload_sha256,
    tail_crc32, media_sha256`` in place of the two long binaries).  A null
    text is empty and gives one row of blanks, repeated rows give repeated
    results, an empty table gives no rows, and other columns are ignored.
    Images are made one by one, so memory is bounded by the longest text.
    """
    if with_payload:
        extra = "png binary, hash binary, n_bytes long, payload binary"
    else:
        extra = "hash binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    kind = docs.schema[row_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", *(x.split()[0] for x in extra.split(", "))]
        for whole in batches:
            for batch in chunks(whole, "__text"):
                rows = []
                for value in batch.column(1).cast(pa.binary()):
                    body = value.as_py() or b""
                    png = encode(pixels_of(body))
                    pixels = decode(png)
                    back, mark = pixels.tobytes(), dct_hash(pixels)
                    if with_payload:
                        rows.append((png, mark, len(body), back))
                    else:
                        rows.append((mark, len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return docs.selectExpr(f"`{row_id}` AS __id", f"`{text}` AS __text").mapInArrow(work, f"__id {kind}, {extra}").withColumnRenamed("__id", row_id)
