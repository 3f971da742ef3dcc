"""Raster numerics on grey-scale images: ink by Otsu's threshold, masks of text, verdicts and crops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import small_batches

# What counts as a drawing, and as a glyph beside it (height, width to height, area in pixels).
MIN_INK = 200
MIN_SIDE = 80
MIN_DENSITY = 0.004
GLYPH_HEIGHT = 5
TALL_FOR_VERDICTS, TALL_FOR_CROPS = 60, 38
GLYPH_SHAPE = (0.15, 12.0)
GLYPH_AREA = 4500
GLYPH_MARGIN = 4
PHOTO_INK = 0.35
CROP_SHARES = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65)
CROP_RATIO = 2.5
CROP_SIDE = 40
CROP_MARGIN = 8
TRIM_SHARE = 0.12
TRIM_INK = 3
TRIM_MARGIN = 6


def otsu(pixels: np.ndarray) -> int:
    """The grey level that best separates two classes."""
    counts = np.bincount(pixels.ravel(), minlength=256).astype(float)
    weight = np.cumsum(counts)
    mean = np.cumsum(counts * np.arange(256))
    total = weight[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight / total - mean) ** 2 / (weight * (total - weight))
    return int(np.nan_to_num(between).argmax())


def ink(pixels: np.ndarray) -> np.ndarray:
    """Dark pixels; a plain image has none."""
    if not pixels.size or pixels.min() == pixels.max():
        return np.zeros(pixels.shape, bool)
    return pixels <= otsu(pixels)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and behind-last column of every horizontal run."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def components(mask: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The runs of a mask and the number of the 8-connected component of each.

    Runs of neighbouring rows that touch are links; the least number of a component
    spreads over its links and is then looked up from itself, until nothing moves.
    """
    row, first, end = runs = _runs(mask)
    label = np.arange(len(row))
    head = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    a, b = [], []
    for y in range(1, mask.shape[0]):
        above, here = slice(head[y - 1], head[y]), slice(head[y], head[y + 1])
        lo = np.searchsorted(end[above], first[here], side="left") + head[y - 1]
        hi = np.searchsorted(first[above], end[here], side="right") + head[y - 1]
        n = np.maximum(hi - lo, 0)
        a.append(np.repeat(np.arange(head[y], head[y + 1]), n))
        b.append(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            return runs, label
        label = new


def dilated(mask: np.ndarray, margin: int) -> np.ndarray:
    """Every pixel within ``margin`` rows and columns of a set one."""
    for axis in (0, 1):
        wide = mask.copy()
        for step in range(1, margin + 1):
            to, at = [slice(None)] * 2, [slice(None)] * 2
            to[axis], at[axis] = slice(step, None), slice(None, -step)
            if mask.shape[axis] > step:
                wide[tuple(to)] |= mask[tuple(at)]
                wide[tuple(at)] |= mask[tuple(to)]
        mask = wide
    return mask


def text_masks(dark: np.ndarray, *tallest: int) -> list[np.ndarray]:
    """Pixels of and around components that are sized and shaped like glyphs, for each height of the tallest; components are found once."""
    (row, first, end), label = components(dark)
    if not len(row):
        return [np.zeros(dark.shape, bool) for _ in tallest]
    names, place = np.unique(label, return_inverse=True)
    n = len(names)
    area = np.bincount(place, weights=end - first, minlength=n)
    box = [np.full(n, fill) for fill in (dark.shape[0], -1, dark.shape[1], -1)]
    for at, values, f in ((0, row, np.minimum), (1, row, np.maximum), (2, first, np.minimum), (3, end - 1, np.maximum)):
        f.at(box[at], place, values)
    height, width = box[1] - box[0] + 1, box[3] - box[2] + 1
    shape = width / height
    sized = (height >= GLYPH_HEIGHT) & (shape >= GLYPH_SHAPE[0]) & (shape <= GLYPH_SHAPE[1]) & (area <= GLYPH_AREA)
    out = []
    for most in tallest:
        held = (sized & (height <= most))[place]
        edge = np.zeros((dark.shape[0], dark.shape[1] + 1), np.int8)
        edge[row[held], first[held]] = 1  # runs of a row do not touch
        edge[row[held], end[held]] = -1
        out.append(dilated(np.cumsum(edge, axis=1, dtype=np.int8)[:, :-1] > 0, GLYPH_MARGIN))
    return out


def text_mask(dark: np.ndarray, tallest: int) -> np.ndarray:
    return text_masks(dark, tallest)[0]


def measure(pixels: np.ndarray, dark: np.ndarray | None = None, text: np.ndarray | None = None) -> tuple[int, int, int, float]:
    """Ink pixels that are no text, width and height of their box, and their density in it."""
    dark = ink(pixels) if dark is None else dark
    graphic = dark & ~(text_mask(dark, TALL_FOR_VERDICTS) if text is None else text)
    n = int(graphic.sum())
    if not n:
        return 0, 0, 0, 0.0
    rows, columns = np.flatnonzero(graphic.any(axis=1)), np.flatnonzero(graphic.any(axis=0))
    width, height = int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)
    return n, width, height, n / (width * height)


def is_drawing(n: int, width: int, height: int, density: float) -> bool:
    return n >= MIN_INK and width >= MIN_SIDE and height >= MIN_SIDE and density >= MIN_DENSITY


def crop_box(pixels: np.ndarray, dark: np.ndarray | None = None, text: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 of the half that holds the drawing, if one side of a cut is much denser; else of the whole. Photographs stay whole."""
    h, w = pixels.shape
    whole = (0, 0, w, h)
    dark = ink(pixels) if dark is None else dark
    if not dark.size or dark.mean() > PHOTO_INK:
        return whole
    text = text_mask(dark, TALL_FOR_CROPS) if text is None else text
    best, ratio = whole, CROP_RATIO
    for axis, side in ((1, w), (0, h)):
        for share in CROP_SHARES:
            cut = int(side * share)
            if not CROP_SIDE <= cut <= side - CROP_SIDE:
                continue
            # each part has a threshold of its own
            low, high = ((ink(p) & ~t).mean() for p, t in zip(np.split(pixels, [cut], axis=axis), np.split(text, [cut], axis=axis)))
            if low <= 0 or high <= 0 or max(low / high, high / low) < ratio:
                continue
            ratio = max(low / high, high / low)
            first = low > high
            if axis:
                best = (0, 0, cut, h) if first else (cut, 0, w, h)
            else:
                best = (0, 0, w, cut) if first else (0, cut, w, h)
    if best == whole:
        return whole
    return max(0, best[0] - CROP_MARGIN), max(0, best[1] - CROP_MARGIN), min(w, best[2] + CROP_MARGIN), min(h, best[3] + CROP_MARGIN)


def trim_rows(pixels: np.ndarray, dark: np.ndarray | None = None, text: np.ndarray | None = None) -> tuple[int, int]:
    """First and behind-last row without the lines of text above and below a drawing."""
    h = pixels.shape[0]
    dark = ink(pixels) if dark is None else dark
    drawn = (dark & ~(text_mask(dark, TALL_FOR_CROPS) if text is None else text)).sum(axis=1)
    inked = dark.sum(axis=1)
    rows = np.flatnonzero((inked >= TRIM_INK) & (drawn > TRIM_SHARE * inked))
    low, high = rows[rows < h * 2 // 3], rows[rows > h // 3]
    top = max(0, int(low[0]) - 4) if len(low) else 0
    bottom = int(high[-1]) + 1 if len(high) else h
    if top == 0 and bottom == h:
        return 0, h
    return max(0, top - TRIM_MARGIN), min(h, bottom + TRIM_MARGIN)


def judged(images: DataFrame) -> DataFrame:
    """Statistics, verdict, crop box and trimmed rows of ``images(doc_id, pixels binary, width int)``: whole rows of pixels, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pixels, width in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                image = np.frombuffer(pixels or b"", np.uint8).reshape(-1, width)
                dark = ink(image)
                glyphs, small = text_masks(dark, TALL_FOR_VERDICTS, TALL_FOR_CROPS)
                found = measure(image, dark, glyphs)
                rows.append((*found, is_drawing(*found), *crop_box(image, dark, small), *trim_rows(image, dark, small)))
            columns = list(zip(*rows)) or [()] * 11
            kinds = [pa.int64()] * 3 + [pa.float64(), pa.bool_()] + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    small_batches(images.sparkSession)
    names = ["doc_id", "ink", "box_width", "box_height", "density", "keep", "x0", "y0", "x1", "y1", "top", "bottom"]
    return images.select("doc_id", "pixels", "width").mapInArrow(run, "doc_id long, ink long, box_width long, box_height long, density double, keep boolean, x0 long, y0 long, x1 long, y1 long, top long, bottom long")


# The least share of ink above or below the lines' middle that tells up from down, and of a line's ink that is its middle.
UPRIGHT_SHARE = 0.02
MIDDLE_INK = 0.5


def _lines(pixels: np.ndarray) -> tuple[float, float]:
    """How much the ink of rows varies (against its mean), and the ink above less that below the middles of lines, as a share of all."""
    profile = pixels.sum(axis=1).astype(float)
    if not profile.any():
        return 0.0, 0.0
    uneven = float(profile.var() / max(profile.mean(), 1e-9) ** 2)
    edge = np.diff(np.append(np.append(0, profile > 0), 0).astype(np.int8))
    balance = 0.0
    for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        band = profile[first:last]
        middle = np.flatnonzero(band >= MIDDLE_INK * band.max())
        balance += band[: middle[0]].sum() - band[middle[-1] + 1 :].sum()
    return uneven, balance / profile.sum()


def rotation(pixels: np.ndarray) -> int:
    """The clockwise turn (0, 90, 180 or 270) that sets a page of text upright, without recognising letters.

    Lines of text make the ink of rows vary more than that of columns. Latin letters
    rise above the middle of a line more often than they fall below it. A blank page,
    and one whose ink does not tell, gives 0 of its direction.
    """
    dark = ink(pixels)
    across, up = _lines(dark)
    along, side = _lines(np.rot90(dark, -1))
    if along > across:
        return 270 if side < -UPRIGHT_SHARE else 90
    return 180 if up < -UPRIGHT_SHARE else 0


def _rotation_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for raw, width in zip(batch.column(1), batch.column(2).to_pylist()):
            flat = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else np.zeros(0, np.uint8)
            whole = len(flat) // width if width and width > 0 else 0
            found.append(rotation(flat[: whole * width].reshape(whole, width)) if whole else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["page", "rotation"])


def _turned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pixels, widths = [], []
        for raw, width, turn in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(1).to_pylist()):
            flat = np.frombuffer(raw.as_buffer(), np.uint8)
            page = np.rot90(flat.reshape(-1, width), -turn)
            pixels.append(page.tobytes())
            widths.append(page.shape[1] if turn % 2 else width)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pixels, pa.binary()), pa.array(widths, pa.int32())], ["page", "turn", "pixels", "width"])


def turned(pages: DataFrame) -> DataFrame:
    """``pages(page, turn, pixels, width)`` with each raster (no null, whole rows) turned by so many quarters clockwise."""
    small_batches(pages.sparkSession)
    return pages.select("page", "turn", "pixels", "width").mapInArrow(_turned_batches, f"page {pages.schema['page'].dataType.simpleString()}, turn int, pixels binary, width int")


def rotations(pages: DataFrame) -> DataFrame:
    """page and rotation of ``pages(page, pixels, width)``, rasters in rows of ``width`` grey bytes; 0 for null and empty ones."""
    small_batches(pages.sparkSession)
    return pages.select("page", "pixels", "width").mapInArrow(_rotation_batches, f"page {pages.schema['page'].dataType.simpleString()}, rotation int")
