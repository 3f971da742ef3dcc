"""PNG files as grey rasters, with zlib and numpy alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import small_batches

# Fixed values of the format: its first bytes, samples of a pixel by colour type, and the first column, first row and steps of its seven interlaced passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
# Shares of red, green and blue in grey, in thousandths.
GREY = np.array([299, 587, 114], np.uint32)
#: Pixels of the largest raster that is decoded; what a file unpacks to is bounded by its own header before it is unpacked.
MOST_PIXELS = 100_000_000
#: Bytes of rasters that leave a task at once.
BATCH_BYTES = 16 << 20


class Broken(ValueError):
    """A file that is no PNG, is damaged, or is too large."""


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and contents up to the end chunk; sums are checked."""
    if data[:8] != SIGNATURE:
        raise Broken("no PNG")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Broken("a damaged chunk")
        if name == b"IEND":
            return
        yield name, body
        at += 12 + size
    raise Broken("no end")


def _undone(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes without its filter; ``above`` is the row before it, ``step`` the bytes from a pixel to the next."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:  # sums along each of a pixel's bytes; bytes wrap
        wide = -(-len(row) // step) * step
        return np.cumsum(np.pad(row, (0, wide - len(row))).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    out, up = bytearray(row.tobytes()), above.tobytes()
    if kind == 3:
        for i, value in enumerate(out):
            out[i] = (value + ((out[i - step] if i >= step else 0) + up[i]) // 2) & 255
    elif kind == 4:
        for i, value in enumerate(out):
            left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
            to_left, to_up, to_corner = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
            out[i] = (value + (left if to_left <= to_up and to_left <= to_corner else up[i] if to_up <= to_corner else corner)) & 255
    else:
        raise Broken("an unknown filter")
    return np.frombuffer(bytes(out), np.uint8)


def _plane(raw: np.ndarray, wide: int, high: int, bits: int, samples: int) -> np.ndarray:
    """high x wide x samples of filtered rows, a byte or the larger byte of two for each sample."""
    length, step = (wide * samples * bits + 7) // 8, max(samples * bits // 8, 1)
    rows, above = np.empty((high, length), np.uint8), np.zeros(length, np.uint8)
    for y in range(high):
        begin = y * (length + 1)
        rows[y] = above = _undone(int(raw[begin]), raw[begin + 1 : begin + 1 + length], above, step)
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(high, -1, bits)
        rows = (parts * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : wide * samples]
    return rows.reshape(high, wide, samples)


def decode(data: bytes) -> np.ndarray:
    """The grey bytes (rows of columns) of a PNG of any colour type, depth and interlacing; transparent parts are over white."""
    header, palette, clear, packed = None, None, b"", []
    for name, body in chunks(data):
        if name == b"IHDR" and len(body) == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed.append(body)
    if header is None:
        raise Broken("no header")
    wide, high, bits, colour, _, _, interlaced = header
    if not wide or not high or wide * high > MOST_PIXELS or colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or (bits < 8 and SAMPLES[colour] > 1) or (colour == 3 and (palette is None or bits == 16)):
        raise Broken("a size, colour or depth that is not decoded")
    samples = SAMPLES[colour]
    grids = [(x, y, dx, dy, -(-(wide - x) // dx), -(-(high - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)) if x < wide and y < high]
    sizes = [h * ((w * samples * bits + 7) // 8 + 1) for *_, w, h in grids]
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), sum(sizes)), np.uint8)
    except zlib.error as error:
        raise Broken("damaged data") from error
    if len(raw) < sum(sizes):
        raise Broken("missing data")
    pixels, begin = np.empty((high, wide, samples), np.uint8), 0
    for (x, y, dx, dy, w, h), size in zip(grids, sizes):
        pixels[y::dy, x::dx] = _plane(raw[begin : begin + size], w, h, bits, samples)
        begin += size
    return _grey(pixels, bits, colour, palette, clear)


def _grey(pixels: np.ndarray, bits: int, colour: int, palette: np.ndarray | None, clear: bytes) -> np.ndarray:
    """Grey over white; one transparent colour of a file without an alpha is compared by its larger bytes."""
    shade = lambda rgb: ((rgb.astype(np.uint32) @ GREY + 500) // 1000).astype(np.uint32)
    alpha = None
    if colour == 3:
        index = pixels[:, :, 0]
        if index.max() >= len(palette):
            raise Broken("a colour that the palette lacks")
        opaque = np.full(len(palette), 255, np.uint32)
        known = np.frombuffer(clear[: len(palette)], np.uint8)
        opaque[: len(known)] = known
        grey, alpha = shade(palette)[index], opaque[index]
    elif colour in (0, 4):
        grey = pixels[:, :, 0].astype(np.uint32)
        if bits < 8:
            grey = grey * (255 // ((1 << bits) - 1))
    else:
        grey = shade(pixels[:, :, :3])
    if colour in (4, 6):
        alpha = pixels[:, :, -1].astype(np.uint32)
    elif colour in (0, 2) and len(clear) >= 2 * pixels.shape[2]:
        one = np.frombuffer(clear, np.uint8)[: 2 * pixels.shape[2]]
        alpha = np.where((pixels == (one[::2] if bits == 16 else one[1::2])).all(axis=2), 0, 255).astype(np.uint32)
    return (grey if alpha is None else (grey * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def encode(grey: np.ndarray) -> bytes:
    """A PNG of rows of grey bytes, each row less the one above it."""
    high, wide = grey.shape
    rows = np.full((high, wide + 1), 2, np.uint8)
    rows[:, 1:] = grey
    rows[1:, 1:] -= grey[:-1]
    parts = [(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes())), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in parts)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = []
        for pixels, width in zip(batch.column(1), batch.column(2).to_pylist()):
            flat = np.frombuffer(pixels.as_buffer(), np.uint8) if pixels.is_valid else np.empty(0, np.uint8)
            files.append(encode(flat.reshape(-1, width)) if len(flat) and width and width > 0 and len(flat) % width == 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [batch.schema.names[0], "content"])


def written(images: DataFrame, key: str = "path") -> DataFrame:
    """``key`` and content, a PNG, of ``images(key, pixels, width)``; null for what is no raster of whole rows."""
    small_batches(images.sparkSession)
    return images.select(key, "pixels", "width").mapInArrow(_written, f"`{key}` {images.schema[key].dataType.simpleString()}, content binary")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, held, begin, size = batch.column(0), [], 0, 0
        for i, content in enumerate(batch.column(1)):
            try:
                grey = decode(content.as_buffer().to_pybytes()) if content.is_valid else None
                held.append((None, 0, "empty") if grey is None else (grey.tobytes(), grey.shape[1], None))
            except Broken as error:
                held.append((None, 0, str(error)))
            size += len(held[-1][0] or b"")
            if i + 1 == len(keys) or size >= BATCH_BYTES:
                pixels, width, bad = zip(*held)
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(held)), pa.array(pixels, pa.binary()), pa.array(width, pa.int32()), pa.array(bad, pa.string())], [batch.schema.names[0], "pixels", "width", "error"])
                held, begin, size = [], i + 1, 0


def rasters(files: DataFrame, key: str = "path") -> DataFrame:
    """``key``, pixels, width and error of ``files(key, content)``: rows of grey bytes, as ``raster.judged`` takes them.

    A file that cannot be decoded has no pixels, width 0 and says why; a null is 'empty'.
    """
    small_batches(files.sparkSession)
    return files.select(key, "content").mapInArrow(_batches, f"`{key}` {files.schema[key].dataType.simpleString()}, pixels binary, width int, error string")
