"""Feature jobs over decoded pixels: hashes, crops, palettes, quality and compressed frame lists."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SIDE = 32


# Digests ---------------------------------------------------------------------------------------------------


_SEGMENT = re.compile(rb"\xff[\xda\xe1-\xef]")


def jpeg_payload(data: bytes) -> bytes:
    """From the first scan marker on, so that edits of the metadata do not matter; the whole file if there is none.

    Application segments other than the first are passed over by their length: a thumbnail in them has scans of its own.
    """
    at = 0
    while m := _SEGMENT.search(data, at):
        if m[0] == b"\xff\xda":
            return data[m.start() :]
        at = m.end() + max(2, int.from_bytes(data[m.end() : m.end() + 2], "big"))
    return data


def digests(files: DataFrame) -> DataFrame:
    """``(path, md5, error)`` of ``files(path, content)``; JPEG files, told by their first bytes, by their payload.

    The error is ``truncated`` if a JPEG file does not end in its end marker. Other files are hashed by Spark itself;
    only JPEG contents go to Python. A null content has a null digest.
    """
    jpeg = F.coalesce((F.length("content") > 3) & (F.hex(F.substr("content", F.lit(1), F.lit(2))) == "FFD8"), F.lit(False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            md5 = [hashlib.md5(jpeg_payload(d)).hexdigest() for d in f["content"]]
            yield pd.DataFrame({"path": f["path"], "md5": md5, "error": [None if d.endswith(b"\xff\xd9") else "truncated" for d in f["content"]]})

    schema = "path string, md5 string, error string"
    own = files.where(jpeg).select("path", "content").mapInPandas(run, schema)
    rest = files.where(~jpeg).select("path", F.md5("content").alias("md5"), F.lit(None).cast("string").alias("error"))
    return rest.unionByName(own)


# Pixels ----------------------------------------------------------------------------------------------------


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    if image.shape[2] < 3:
        return image[:, :, 0].astype(float)
    return image[:, :, :3] @ np.array([0.114, 0.587, 0.299])


@lru_cache(256)
def area_weights(n: int, m: int) -> np.ndarray:
    """Matrix that averages n samples to m by overlap."""
    edges = np.linspace(0, n, m + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    cells = np.arange(n)[None, :]
    overlap = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
    return overlap / overlap.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_weights(image.shape[0], height) @ image @ area_weights(image.shape[1], width).T


@lru_cache(256)
def _padded(n: int, k: int, mode: str) -> np.ndarray:
    return np.pad(np.arange(n), k, mode=mode)


def mean_blur(image: np.ndarray, k: int) -> np.ndarray:
    h, w = image.shape
    mode = "reflect" if min(h, w) > k // 2 else "edge"
    sums = np.zeros((h + k // 2 * 2 + 1, w + k // 2 * 2 + 1))
    sums[1:, 1:] = image[_padded(h, k // 2, mode)[:, None], _padded(w, k // 2, mode)]
    sums = np.cumsum(np.cumsum(sums, 0), 1)
    return (sums[k : k + h, k : k + w] - sums[:h, k : k + w] - sums[k : k + h, :w] + sums[:h, :w]) / k**2


def _cosines() -> np.ndarray:
    k, x = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
    out = np.sqrt(2 / SIDE) * np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))
    out[0] /= np.sqrt(2)
    return out


def _zigzag(n: int) -> list[tuple[int, int]]:
    return sorted(((y, x) for y in range(n) for x in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


COSINES, ORDER = _cosines(), _zigzag(9)
LOW = tuple(np.array(ORDER[6:69]).T)


def dct_hash(image: np.ndarray) -> int:
    """Signed 64-bit hash of a gray image: low frequencies above their mean; bit 0 unused, nothing set becomes 1."""
    area = image.shape[0] * image.shape[1]
    k = 0 if area <= 32 * 32 else 3 if area <= 64 * 64 else 5 if area <= 128 * 128 else 7
    small = resize(mean_blur(image, k) if k else image, SIDE, SIDE)
    values = (COSINES @ small @ COSINES.T)[LOW]
    bits = int.from_bytes(np.packbits(values > values.mean(), bitorder="little").tobytes(), "little") << 1
    bits = bits or 1
    return bits - (1 << 64) if bits >> 63 else bits


def average_hash(image: np.ndarray) -> int:
    """Signed 64-bit hash of a gray image: cells above the mean; one that equals it but for rounding is not."""
    small = resize(image, 8, 8).ravel()
    bits = sum(1 << i for i, v in enumerate(small - small.mean()) if v > 1e-7)
    return bits - (1 << 64) if bits >> 63 else bits


def crop_borders(image: np.ndarray, tolerance: float = 20, cover: float = 0.66, keep: float = 0.65) -> np.ndarray:
    """Cuts even borders in the colour of the top left pixel, found from the centre outwards.

    A row or column is border if runs within the tolerance from both of its ends cover most of it, so what stands in
    the middle, like a subtitle, does not matter, and a plain stripe inside the picture is none. Unequal margins are
    evened to the smaller one. The cut is taken only if enough of each side remains.
    """
    g = gray(image)
    plain = np.abs(g - g[0, 0]) <= tolerance

    def margins(lines: np.ndarray) -> tuple[int, int]:
        n, wide = lines.shape
        ends = np.minimum.accumulate(lines, 1).sum(1), np.minimum.accumulate(lines[:, ::-1], 1).sum(1)
        border = (ends[0] > 0) & (ends[1] > 0) & (ends[0] + ends[1] > int(wide * cover))
        upper, lower = np.flatnonzero(border[: n // 2]), np.flatnonzero(border[n // 2 :])
        a = int(upper[-1]) + 1 if len(upper) else 0
        b = n - (n // 2 + int(lower[0])) if len(lower) else 0
        return (min(a, b), min(a, b)) if abs(a - b) > 0.05 * n else (a, b)

    (top, bottom), (left, right) = margins(plain), margins(plain.T)
    h, w = image.shape[:2]
    if h - top - bottom <= keep * h or w - left - right <= keep * w:
        return image
    return image[top : h - bottom, left : w - right]


def luv(rgb: np.ndarray) -> np.ndarray:
    """CIE Luv of 8-bit sRGB triples under D65."""
    c = rgb / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.4124, 0.2126, 0.0193], [0.3576, 0.7152, 0.1192], [0.1805, 0.0722, 0.9505]])
    x, y, z = xyz[:, 0], xyz[:, 1], xyz[:, 2]
    d = np.maximum(x + 15 * y + 3 * z, 1e-12)
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.stack([light, 13 * light * (4 * x / d - 0.19783), 13 * light * (9 * y / d - 0.46834)], 1)


@lru_cache(64)
def _ellipse(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels inside an inscribed ellipse, and their closeness to the centre."""
    y, x = (np.arange(h)[:, None] + 0.5) / h * 2 - 1, (np.arange(w)[None, :] + 0.5) / w * 2 - 1
    far = np.sqrt(x**2 + y**2)
    inside = far.ravel() <= 0.9
    return inside, 1 - np.minimum(far / 0.9, 1).ravel()[inside]


def palette(image: np.ndarray, colours: int = 32, seed: int = 1, rounds: int = 12) -> list[tuple[float, float, float, float]]:
    """Up to ``colours`` Luv colours with weights by closeness to the centre, heaviest first.

    Pixels outside an inscribed ellipse and dark ones are left out. The clustering is seeded, so equal images
    have equal palettes, and all colours found are kept.
    """
    step = max(1, -(-max(image.shape[:2]) // 256))
    small = image[::step, ::step, 2::-1] if image.shape[2] >= 3 else np.repeat(image[::step, ::step, :1], 3, 2)
    h, w = small.shape[:2]
    inside, close = _ellipse(h, w)
    # A colour is placed once, for all its pixels.
    packed = small.reshape(-1, 3)[inside].astype(np.int32) @ np.array([1 << 16, 1 << 8, 1], np.int32)
    keys, which = np.unique(packed, return_inverse=True)
    seen = np.stack([keys >> 16, keys >> 8 & 255, keys & 255], 1)
    weight = np.bincount(which, close, len(seen))
    many, points = np.bincount(which, minlength=len(seen)), luv(seen.astype(float))
    ok = points[:, 0] > 4
    points, weight, many = points[ok], weight[ok], many[ok]
    if not len(points):
        return []
    start = np.unique(points.round(1), axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:colours]]
    for _ in range(rounds):
        near = np.argmin(((points[:, None, :] - centres[None]) ** 2).sum(2), 1)
        _, near = np.unique(near, return_inverse=True)
        before, centres = centres, np.stack([np.bincount(near, points[:, c] * many) for c in range(3)], 1) / np.bincount(near, many)[:, None]
        if np.array_equal(before, centres):
            break
    near = np.argmin(((points[:, None, :] - centres[None]) ** 2).sum(2), 1)
    mass = np.bincount(near, weight, len(centres))
    return [(*map(float, centres[k]), float(mass[k])) for k in np.argsort(-mass, kind="stable")]


def _ridges(g: np.ndarray) -> np.ndarray:
    """Pixels whose left and right neighbours differ by more than the mean, and by more than those beside them do."""
    gap = np.zeros_like(g)
    gap[:, 1:-1] = np.abs(g[:, 2:] - g[:, :-2])
    gap[gap <= gap.sum() / ((g.shape[0] - 1) * (g.shape[1] - 1))] = 0
    edge = np.zeros(g.shape, bool)
    edge[:, 1:-1] = gap[:, 1:-1] > np.maximum(gap[:, :-2], gap[:, 2:])
    return edge


def _long_runs(edge: np.ndarray) -> int:
    """Runs of two and more edge pixels down the columns; the first and last line do not count, nor what reaches them below."""
    inner = edge[1:-1]
    return int((inner[:-2] & inner[1:-1] & ~inner[2:]).sum())


def quality_score(image: np.ndarray) -> int:
    """Sharpness without a reference, inside a tenth's crop: share of edge pixels, and long edges per edge pixel, in percent.

    Edges are found across and down the picture; a long one has at least two pixels. Even pictures and those of
    less than 3 pixels a side have 0.
    """
    g = image[:, :, :3].astype(float).sum(2)
    (h, w), (dy, dx) = g.shape, (g.shape[0] // 10, g.shape[1] // 10)
    g = g[dy : h - dy + 1, dx : w - dx + 1]
    if min(g.shape) < 3:
        return 0
    across, down = _ridges(g), _ridges(g.T)
    inner = (across | down.T)[1:-1, 1:-1]
    n = int(inner.sum())
    return int(100 * n / inner.size + 100 * (_long_runs(across) + _long_runs(down)) / n) if n else 0


def _map_pixels(pixels: DataFrame, schema: str, make) -> DataFrame:
    """Runs ``make(path, image)``, which yields rows, over ``pixels(path, width, height, channels, data)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for f in frames:
            rows = [row for r in f.itertuples(index=False) for row in make(r.path, to_array(r.height, r.width, r.channels, r.data))]
            yield pd.DataFrame(rows, columns=names)

    return pixels.select("path", "width", "height", "channels", "data").mapInPandas(run, schema)


def image_hashes(pixels: DataFrame, crop: bool = False) -> DataFrame:
    """``(path, phash, ahash, quality)`` per image."""

    def make(path, image):
        g = gray(crop_borders(image) if crop else image)
        yield path, dct_hash(g), average_hash(g), quality_score(image)

    return _map_pixels(pixels, "path string, phash long, ahash long, quality int", make)


def mirrored_hashes(pixels: DataFrame) -> DataFrame:
    """``(path, flip, hash)`` of each image as it is and mirrored across, upside down, and both."""

    def make(path, image):
        g = gray(image)
        for flip, x in (("none", g), ("h", g[:, ::-1]), ("v", g[::-1]), ("both", g[::-1, ::-1])):
            yield path, flip, dct_hash(np.ascontiguousarray(x))

    return _map_pixels(pixels, "path string, flip string, hash long", make)


def grid_patches(height: int, width: int, sizes: tuple[int, ...] = (2, 3, 4)) -> list[tuple[int, int, int, int]]:
    """``(x, y, w, h)`` of a fixed grid at several scales."""
    return [(i * width // n, j * height // n, width // n, height // n) for n in sizes for j in range(n) for i in range(n)]


def patch_hashes(pixels: DataFrame, rectangles: DataFrame | None = None, least: int = 31) -> DataFrame:
    """``(path, feat_no, hash)`` of patches; those smaller than ``least`` or not inside the picture are skipped.

    ``rectangles(path, x, y, w, h)`` names the patches, numbered by place; without it they are a fixed grid.
    """
    at = F.array_sort(F.collect_list(F.struct("y", "x", "h", "w")))
    if rectangles is None:
        rows = pixels.withColumn("_boxes", F.lit(None).cast("array<struct<y:int,x:int,h:int,w:int>>"))
    else:
        boxes = rectangles.select("path", *(F.col(c).cast("int").alias(c) for c in "yxhw")).groupBy("path").agg(at.alias("_boxes"))
        rows = pixels.join(boxes, "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for r in f.itertuples(index=False):
                g = gray(to_array(r.height, r.width, r.channels, r.data))
                boxes = grid_patches(*g.shape) if r.boxes is None else [(b["x"], b["y"], b["w"], b["h"]) for b in r.boxes]
                kept = [(x, y, w, h) for x, y, w, h in boxes if min(w, h) >= least and min(x, y) >= 0 and x + w <= g.shape[1] and y + h <= g.shape[0]]
                found += [(r.path, n, dct_hash(g[y : y + h, x : x + w])) for n, (x, y, w, h) in enumerate(kept)]
            yield pd.DataFrame(found, columns=["path", "feat_no", "hash"])

    rows = rows.select("path", "width", "height", "channels", "data", F.col("_boxes").alias("boxes"))
    return rows.mapInPandas(run, "path string, feat_no int, hash long")


def palettes(pixels: DataFrame) -> DataFrame:
    """``(path, num_colors, colors)`` per image."""
    schema = "path string, num_colors int, colors array<struct<l:double,u:double,v:double,w:double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [palette(to_array(r.height, r.width, r.channels, r.data)) for r in f.itertuples(index=False)]
            colours = [[dict(zip("luvw", c)) for c in p] for p in found]
            yield pd.DataFrame({"path": f["path"], "num_colors": [len(p) for p in found], "colors": colours})

    return pixels.select("path", "width", "height", "channels", "data").mapInPandas(run, schema)


@F.pandas_udf(LongType())
def dct_hash_udf(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Column form of the image hash."""
    return pd.Series([dct_hash(gray(to_array(*row))) for row in zip(height, width, channels, data)])


# Frames ----------------------------------------------------------------------------------------------------


class FrameWindow:
    """Keeps a frame if it is not close to all frames since the last kept one; an empty window counts as close.

    So the second frame of a video is never kept, as in the data that existing indexes hold.
    """

    def __init__(self, threshold: int = 8, window: list[int] | None = None, started: bool = False):
        self.threshold, self.window, self.started = threshold, window or [], started

    def keep(self, value: int) -> bool:
        if not self.started:
            self.started = True
            return True
        near = all(((value ^ w) & (2**64 - 1)).bit_count() < self.threshold for w in self.window)
        if not near:
            self.window = []
        if value not in self.window:  # a still scene is one hash
            self.window.append(value)
        return not near


def compress_frames(frames: DataFrame, threshold: int = 8, kept_until: DataFrame | None = None) -> DataFrame:
    """``(media_id, frame, hash)`` of the frames to store: the first, those that changed, and the last.

    With ``kept_until(media_id, last_frame, last_hash)`` a list is resumed after its last frame, whose hash seeds
    the window.
    """
    rows = frames.select("media_id", "frame", "hash")
    if kept_until is not None:
        rows = rows.join(kept_until, "media_id", "left").where("last_frame is null or frame > last_frame")
    else:
        rows = rows.withColumns({"last_frame": F.lit(None).cast("int"), "last_hash": F.lit(None).cast("long")})
    rows = rows.withColumn("last_hash", F.col("last_hash").cast("string"))  # a null would turn 64-bit integers into floats

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        seed = pdf["last_hash"].iloc[0]
        state = FrameWindow(threshold) if seed is None else FrameWindow(threshold, [int(seed)], True)
        kept = [state.keep(int(h)) for h in pdf["hash"]]
        kept[-1] = True
        return pdf.loc[kept, ["media_id", "frame", "hash"]]

    return rows.groupBy("media_id").applyInPandas(run, "media_id long, frame int, hash long")


def last_kept(frames: DataFrame) -> DataFrame:
    """``(media_id, last_frame, last_hash)`` of stored frame lists, to resume from."""
    return frames.groupBy("media_id").agg(F.max("frame").alias("last_frame"), F.max_by("hash", "frame").alias("last_hash"))
