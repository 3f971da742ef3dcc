"""PNG files of every colour type, depth, filter and interlacing against the pixels they were made of."""

import struct
import zlib

import numpy as np
import pytest

from ashlar.operators import png, raster


def filtered(row, above, kind, step):
    left = np.concatenate([np.zeros(step, int), row[:-step]])[: len(row)] if len(row) > step else np.zeros(len(row), int)
    corner = np.concatenate([np.zeros(step, int), above[:-step]])[: len(row)] if len(row) > step else np.zeros(len(row), int)
    guess = left + above - corner
    far = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
    paeth = np.choose(far.argmin(axis=0), [left, above, corner])
    return bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()


def encode(samples, bits, colour, filters=(0, 1, 2, 3, 4), interlaced=False, extra=()):
    high, wide, n = samples.shape
    body = b""
    for x, y, dx, dy in png.PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        flat = part.reshape(len(part), -1)
        if bits == 16:
            rows = flat.astype(">u2").view(np.uint8).reshape(len(part), -1)
        else:
            rows = np.packbits(np.unpackbits(flat.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(part), -1), axis=1)
        above = np.zeros(rows.shape[1], int)
        for i, row in enumerate(rows.astype(int)):
            body += filtered(row, above, filters[i % len(filters)], max(n * bits // 8, 1))
            above = row
    packed = zlib.compress(body)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", wide, high, bits, colour, 0, 0, int(interlaced))), *extra, (b"IDAT", packed[:7]), (b"IDAT", packed[7:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, bits", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_file(colour, bits, interlaced):
    rng = np.random.default_rng(bits * 10 + colour)
    for high, wide in ((13, 21), (1, 1), (5, 2)):
        samples = rng.integers(0, 1 << bits, (high, wide, png.SAMPLES[colour]))
        palette = rng.integers(0, 256, (1 << min(bits, 8), 3))
        extra = [(b"PLTE", palette.astype(np.uint8).tobytes()), (b"tRNS", bytes([0, 128]))] if colour == 3 else []
        got = png.decode(encode(samples, bits, colour, interlaced=interlaced, extra=extra))
        eight = samples >> 8 if bits == 16 else samples
        alpha = np.full((high, wide), 255)
        if colour == 3:
            rgb = palette[samples[:, :, 0]]
            alpha = np.array([0, 128, *[255] * 254])[samples[:, :, 0]]
        else:
            rgb = eight[:, :, :3] if colour in (2, 6) else np.repeat(eight[:, :, :1] * (255 // ((1 << min(bits, 8)) - 1)), 3, axis=2)
            alpha = eight[:, :, -1] if colour in (4, 6) else alpha
        grey = (299 * rgb[:, :, 0] + 587 * rgb[:, :, 1] + 114 * rgb[:, :, 2] + 500) // 1000
        assert got.shape == (high, wide) and (got == (grey * alpha + 255 * (255 - alpha) + 127) // 255).all()


def test_one_transparent_colour():
    samples = np.array([[[0], [7], [9]]])
    assert png.decode(encode(samples, 8, 0, extra=[(b"tRNS", b"\0\x07")])).tolist() == [[0, 255, 9]]


def test_broken_files_say_why_and_rasters_are_judged(spark):
    fine = encode(np.random.default_rng(1).integers(0, 256, (120, 130, 1)), 8, 0)
    short = encode(np.zeros((4, 4, 1), int), 8, 0).replace(struct.pack(">II", 4, 4), struct.pack(">II", 4, 9))
    short = short[:29] + struct.pack(">I", zlib.crc32(short[12:29])) + short[33:]
    huge = png.SIGNATURE + struct.pack(">I", 13) + (b := b"IHDR" + struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)) + struct.pack(">I", zlib.crc32(b)) + struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    index = encode(np.full((1, 1, 1), 5), 8, 3, extra=[(b"PLTE", bytes(6))])
    files = {"fine": fine, "null": None, "void": b"", "text": b"not a picture", "cut": fine[:-20], "flip": fine[:60] + bytes([fine[60] ^ 1]) + fine[61:], "short": short, "huge": huge, "index": index, "kind": encode(np.zeros((2, 2, 1), int), 8, 0, filters=(0,))}
    found = png.rasters(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")).persist()
    rows = {r.path: r for r in found.collect()}
    assert len(rows) == len(files) and rows["fine"].width == 130 and len(rows["fine"].pixels) == 120 * 130
    assert {k: r.error for k, r in rows.items() if r.error} == {"null": "empty", "void": "no PNG", "text": "no PNG", "cut": "a damaged chunk", "flip": "a damaged chunk", "short": "missing data", "huge": "a size, colour or depth that is not decoded", "index": "a colour that the palette lacks"}
    assert raster.judged(found.where("error is null").selectExpr("xxhash64(path) as doc_id", "pixels", "width")).count() == 2
    assert png.rasters(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_written_files_are_read_back(spark):
    rng = np.random.default_rng(3)
    for high, wide in ((1, 1), (7, 160), (300, 2)):
        grey = rng.integers(0, 256, (high, wide)).astype(np.uint8)
        assert (png.decode(png.encode(grey)) == grey).all()
    held = spark.createDataFrame([(1, bytearray(range(6)), 3), (2, bytearray(b""), 3), (3, None, 3), (4, bytearray(b"abc"), 0), (5, bytearray(b"abc"), 2)], "path long, pixels binary, width int")
    rows = {r.path: r.content for r in png.written(held).collect()}
    assert png.decode(bytes(rows[1])).tolist() == [[0, 1, 2], [3, 4, 5]] and [rows[k] for k in (2, 3, 4, 5)] == [None] * 4


def test_rasters_pass_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    png.rasters(spark.createDataFrame([(1, b"x")], "id long, content binary"), "id")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
