"""From gray images to strokes: padding, thresholds, cleaning, thinning, tracing, timing.

A row is an image (image_id, height, width, pixels), its pixels a byte each.  The steps are procedures on one small image, so
they run on Arrow batches of images; images are spread by rows and need no shuffle.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.pixels import _thin
from quillspark.state import dealt

TARGET, BLOCK, OFFSET = 128, 11, 2
#: Shares of ink between which a threshold is believed, and the likeliest one.
INK = (0.05, 0.3, 0.15)
SPEED, GAP = 100.0, 0.1
Path = list[tuple[int, int]]


#: First column and row, and their distances, of the seven passes of an interlaced file (fixed values of the format).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """Gray levels of a PNG file: colours by luminance, of 16 bits the upper eight, fewer ones brought to 0 to 255; transparency
    counts for nothing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None:
        raise ValueError("no image header")
    width, height, depth, colour, _, _, laced = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if samples is None or depth not in (1, 2, 4, 8, 16) or laced > 1 or (colour == 3 and palette is None):
        raise ValueError("unknown kind of PNG file")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    pixels, start = np.zeros((height, width, samples), np.uint8), 0
    for x, y, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        part = pixels[y::dy, x::dx]
        if part.size:
            wide = -(-part.shape[1] * samples * depth // 8)
            rows = raw[start : start + part.shape[0] * (1 + wide)].reshape(part.shape[0], 1 + wide)
            start += rows.size
            pixels[y::dy, x::dx] = _samples(_plain_rows(rows, max(1, samples * depth // 8)), depth, part.shape)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    elif depth < 8:
        pixels = pixels * (255 // ((1 << depth) - 1))
    return luminance(pixels)


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Gray levels of pixels of one or two samples (gray first), or of three or four (red, green, blue first)."""
    if pixels.shape[2] >= 3:
        return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return pixels[:, :, 0].astype(np.uint8)


def _samples(rows: np.ndarray, depth: int, shape: tuple[int, ...]) -> np.ndarray:
    """Rows of bytes as samples of at most eight bits."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)
        bits = bits.reshape(len(rows), -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : shape[1] * shape[2]]
    return rows.reshape(shape)


def _plain_rows(rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    before = np.zeros(rows.shape[1] - 1, np.int32)
    for y, row in enumerate(rows):
        before = _unfiltered(int(row[0]), row[1:].astype(np.int32), before, step)
        out[y] = before
    return out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) & 255
    out = np.zeros_like(row)
    for k in range(len(row)):
        left, corner = (int(out[k - step]), int(above[k - step])) if k >= step else (0, 0)
        up = int(above[k])
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up) // 2
        else:
            near = [(abs(left + up - corner - v), n, v) for n, v in enumerate((left, up, corner))]
            guess = min(near)[2]
        out[k] = (row[k] + guess) & 255
    return out


# ---- one image ----------------------------------------------------------------------------------------------------------


def _cover(old: int, new: int) -> np.ndarray:
    """How much of each old cell a new one of the same line covers, as shares of the new one."""
    ends = np.arange(new + 1) * old / new
    low, high = np.maximum(ends[:-1, None], np.arange(old)), np.minimum(ends[1:, None], np.arange(old) + 1)
    return np.maximum(high - low, 0) / (old / new)


def padded(image: np.ndarray, target: int = TARGET) -> np.ndarray:
    """The image brought to the target's size by areas, its sides in proportion, white around it."""
    h, w = image.shape
    scale = min(target / w, target / h)
    new_h, new_w = max(1, int(h * scale)), max(1, int(w * scale))
    small = np.rint(_cover(h, new_h) @ image.astype(float) @ _cover(w, new_w).T).clip(0, 255).astype(np.uint8)
    out = np.full((target, target), 255, np.uint8)
    y, x = (target - new_h) // 2, (target - new_w) // 2
    out[y : y + new_h, x : x + new_w] = small
    return out


def stretched(image: np.ndarray) -> np.ndarray:
    low, high = int(image.min()), int(image.max())
    return ((image.astype(float) - low) / (high - low) * 255).astype(np.uint8) if high > low else image


def _smooth(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    wide = np.pad(image.astype(float), half, mode="edge")
    rows = sum(k * wide[n : n + image.shape[0]] for n, k in enumerate(kernel))
    return np.rint(sum(k * rows[:, n : n + image.shape[1]] for n, k in enumerate(kernel)))


def otsu_level(image: np.ndarray) -> int:
    """The level that parts the histogram with the largest variance between its sides."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    low, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return int(np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax())


def ink_of(image: np.ndarray) -> np.ndarray:
    """Dark pixels by the threshold, local Gaussian, local mean or Otsu's, whose share of ink is the most likely."""
    sigma = 0.3 * ((BLOCK - 1) * 0.5 - 1) + 0.8
    bell = np.exp(-((np.arange(BLOCK) - BLOCK // 2) ** 2) / (2 * sigma * sigma))
    found = [image <= _smooth(image, kernel) - OFFSET for kernel in (bell / bell.sum(), np.full(BLOCK, 1 / BLOCK))]
    found.append(image <= otsu_level(image))
    low, high, likely = INK
    best = found[0]
    for other in found[1:]:
        share, own = other.mean(), best.mean()
        if low <= share <= high and (not low <= own <= high or abs(share - likely) < abs(own - likely)):
            best = other
    return best


def pieces(ink: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the connected pieces, eight neighbours each; 0 outside."""
    out, last = np.zeros(ink.shape, np.int32), 0
    for y, x in zip(*np.nonzero(ink)):
        if out[y, x]:
            continue
        last += 1
        out[y, x] = last
        ahead = deque([(y, x)])
        while ahead:
            for near in neighbours(ink, *ahead.popleft()):
                if not out[near]:
                    out[near] = last
                    ahead.append(near)
    return out


def neighbours(ink: np.ndarray, y: int, x: int) -> Path:
    h, w = ink.shape
    return [(b, a) for b in range(max(0, y - 1), min(h, y + 2)) for a in range(max(0, x - 1), min(w, x + 2)) if (b, a) != (y, x) and ink[b, a]]


def _around(ink: np.ndarray, outside: bool) -> np.ndarray:
    wide = np.pad(ink, 1, constant_values=outside)
    return np.stack([wide[a : a + ink.shape[0], b : b + ink.shape[1]] for a in range(3) for b in range(3)])


def grown(ink: np.ndarray) -> np.ndarray:
    return _around(ink, False).any(axis=0)


def shrunk(ink: np.ndarray) -> np.ndarray:
    return _around(ink, True).all(axis=0)


def denoised(ink: np.ndarray) -> np.ndarray:
    """Without pieces of under ten pixels or a thousandth of the image; closed, then opened, by 3 x 3."""
    number = pieces(ink)
    sizes = np.bincount(number.ravel())
    large = sizes >= max(10, ink.size * 0.001)
    large[0] = False
    kept = large[number]
    return grown(shrunk(shrunk(grown(kept))))


def dark_ground(ink: np.ndarray) -> np.ndarray:
    """Turned over if most of the border is ink."""
    border = np.concatenate([ink[0], ink[-1], ink[:, 0], ink[:, -1]])
    return ~ink if border.sum() * 2 > len(border) else ink


def prepared(image: np.ndarray, target: int = TARGET) -> np.ndarray:
    return dark_ground(denoised(ink_of(stretched(padded(image, target)))))


def without_twigs(skeleton: np.ndarray, least: int = 5) -> np.ndarray:
    """Without lines from an inner end that reach nothing, or a fork, in under ``least`` pixels."""
    out = skeleton.copy()
    h, w = skeleton.shape
    ends = [(y, x) for y, x in zip(*np.nonzero(skeleton)) if 0 < y < h - 1 and 0 < x < w - 1 and len(neighbours(skeleton, y, x)) == 1]
    for end in ends:
        if not out[end]:
            continue
        path, seen = [end], {end}
        while len(near := [p for p in neighbours(out, *path[-1]) if p not in seen]) == 1:
            path.append(near[0])
            seen.add(near[0])
        if len(path) < least:
            for p in path:
                out[p] = False
    return out


def skeleton_of(ink: np.ndarray, opened: bool = False) -> np.ndarray:
    """The thinned ink.  ``opened`` opens it by 3 x 3 as well, which leaves next to nothing of lines one pixel wide."""
    thin = _thin(ink).astype(bool)
    return without_twigs(grown(shrunk(thin)) if opened else thin)


def shortest(ink: np.ndarray, start: tuple[int, int], goals: set[tuple[int, int]]) -> dict[tuple[int, int], Path]:
    """A shortest path from ``start`` to each goal, of equal ones that which the order of rows and columns meets first."""
    came, ahead = {start: start}, deque([start])
    while ahead:
        at = ahead.popleft()
        for near in neighbours(ink, *at):
            if near not in came:
                came[near] = at
                ahead.append(near)
    found = {}
    for goal in goals & came.keys():
        path = [goal]
        while path[-1] != start:
            path.append(came[path[-1]])
        found[goal] = path[::-1]
    return found


def traced(skeleton: np.ndarray) -> list[Path]:
    """Paths of each piece: between all pairs of ends; from a single end to all forks; else a walk through the whole piece."""
    number, out = pieces(skeleton), []
    for piece in range(1, number.max(initial=0) + 1):
        pixels = list(zip(*(c.tolist() for c in np.nonzero(number == piece))))
        degree = {p: len(neighbours(skeleton, *p)) for p in pixels}
        ends, forks = [p for p in pixels if degree[p] == 1], [p for p in pixels if degree[p] > 2]
        if len(ends) >= 2:
            for k, start in enumerate(ends):
                found = shortest(skeleton, start, set(ends[k + 1 :]))
                out += [found[e] for e in ends[k + 1 :] if e in found]
        elif ends and forks:
            found = shortest(skeleton, ends[0], set(forks))
            out += [found[f] for f in forks if f in found]
        else:
            walk, seen, ahead = [], set(), [pixels[0]]
            while ahead:
                at = ahead.pop()
                if at not in seen:
                    seen.add(at)
                    walk.append(at)
                    ahead += [p for p in reversed(neighbours(skeleton, *at)) if p not in seen]
            out.append(walk)
    return out


def timed(paths: list[Path], speed: float = SPEED) -> list[list[tuple[float, float, float, float]]]:
    """(x, y, time, pressure) along each path of two pixels or more: slower in turns, a gap between paths."""
    strokes, now = [], 0.0
    for path in paths:
        if len(path) < 2:
            continue
        stroke = []
        for k, (y, x) in enumerate(path):
            if k:
                dy, dx = y - path[k - 1][0], x - path[k - 1][1]
                bend = 0.0
                if k + 1 < len(path):
                    ndy, ndx = path[k + 1][0] - y, path[k + 1][1] - x
                    size = math.hypot(dx, dy) * math.hypot(ndx, ndy)
                    bend = math.acos(max(-1.0, min(1.0, (dx * ndx + dy * ndy) / size))) / math.pi if size else 0.0
                now += math.hypot(dx, dy) / (speed * (1 - 0.5 * bend))
            t = k / (len(path) - 1)
            stroke.append((float(x), float(y), now, max(0.1, min(1.0, 0.5 + 0.4 * math.exp(-4 * (t - 0.5) ** 2)))))
        strokes.append(stroke)
        now += GAP
    return strokes


def quality(strokes: list, n_pixels: int) -> float:
    if not strokes:
        return 0.0
    points = sum(map(len, strokes))
    return 0.4 * min(1, points / max(1, n_pixels)) + 0.3 * min(1, 5 / len(strokes)) + 0.3 * min(1, points / len(strokes) / 20)


# ---- tables of images ---------------------------------------------------------------------------------------------------

POINT = "struct<x: double, y: double, time: double, pressure: double>"
CONVERTED = f"error string, skeleton_points int, branches int, quality double, strokes array<array<{POINT}>>"


def convert(image: np.ndarray, target: int = TARGET, opened: bool = False) -> tuple[int, int, float, list]:
    skeleton = skeleton_of(prepared(image, target), opened)
    paths = traced(skeleton)
    strokes = timed(paths)
    return int(skeleton.sum()), len(paths), quality(strokes, int(skeleton.sum())), strokes


def from_decoder(rows: DataFrame) -> DataFrame:
    """Rows of Spark's image source (a struct ``image``) as ``image_id, height, width, pixels``: gray levels, null where the file
    could not be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grays = []
            for row in batch.select(["height", "width", "channels", "data"]).to_pylist():
                if row["height"] is None or row["height"] <= 0 or row["channels"] <= 0:
                    grays.append(None)
                    continue
                pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                grays.append(luminance(pixels[:, :, [2, 1, 0]] if row["channels"] >= 3 else pixels).tobytes())  # blue comes first there
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("height"), batch.column("width"), pa.array(grays, pa.binary())], names=["image_id", "height", "width", "pixels"])

    # this source spells addresses in their encoded form
    place = F.regexp_replace(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    flat = rows.select(place.alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return flat.mapInArrow(run, "image_id string, height int, width int, pixels binary")


def converted(images: DataFrame, target: int = TARGET, opened: bool = False) -> DataFrame:
    """``image_id`` and what became of each image: an error, or its strokes and their measures.

    Images come as (image_id, height, width, pixels), or as (image_id, content) with the bytes of a PNG file.  An image that
    cannot be read has its error in the row and stops nothing.
    """
    files = "content" in images.columns
    rows = images.select("image_id", "content") if files else images.select("image_id", "height", "width", "pixels")
    kind = dict(rows.dtypes)["image_id"]
    point = pa.struct([(n, pa.float64()) for n in ("x", "y", "time", "pressure")])
    types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.list_(point))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                try:
                    if not files and row["pixels"] is None:
                        raise ValueError("the image cannot be read")
                    image = decode_png(row["content"]) if files else np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                    pixels, branches, score, strokes = convert(image, target, opened)
                    listed = [[dict(zip(("x", "y", "time", "pressure"), p)) for p in stroke] for stroke in strokes]
                    done.append((None, pixels, branches, score, listed))
                except (ValueError, TypeError, IndexError, zlib.error, struct.error) as error:
                    done.append((str(error), None, None, None, None))
            columns = zip(*done) if done else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["image_id", "error", "skeleton_points", "branches", "quality", "strokes"])

    return rows.mapInArrow(run, f"image_id {kind}, {CONVERTED}")


def accepted(found: DataFrame, least: float) -> DataFrame:
    """Images under the least quality become errors; ``status`` says which are through."""
    low = F.col("error").isNull() & (F.col("quality") < least)
    out = found.withColumn("error", F.when(low, "Quality below threshold").otherwise(F.col("error")))
    return out.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed"))


def progress(found: DataFrame) -> DataFrame:
    """Counts of processed and failed images, and the share of the former in per cent."""
    done = F.count_if(F.col("status") == "processed")
    return found.agg(F.count("*").alias("total"), done.alias("processed"), (F.count("*") - done).alias("failed"), F.when(F.count("*") > 0, done / F.count("*") * 100).alias("success_rate"))


def points_of(found: DataFrame) -> DataFrame:
    """Converted images as points in long form: ``image_id, path, i, x, y, time, pressure``."""
    paths = found.where("error is null").select("image_id", F.posexplode("strokes").alias("path", "stroke"))
    return paths.select("image_id", "path", F.posexplode("stroke").alias("i", "p")).select("image_id", "path", "i", "p.*")


def drawn(ink: DataFrame, size: int, thick: bool = True) -> DataFrame:
    """Images (image_id, height, width, pixels) with black ink pixels (image_id, y, x), grown by one, on white."""

    def run(rows: pa.Table) -> pa.Table:
        image = np.zeros((size, size), bool)
        image[rows.column("y").to_numpy(), rows.column("x").to_numpy()] = True
        image = grown(image) if thick else image
        return pa.table({"image_id": rows.column("image_id").slice(0, 1), "height": pa.array([size], pa.int32()), "width": pa.array([size], pa.int32()), "pixels": pa.array([np.where(image, 0, 255).astype(np.uint8).tobytes()], pa.binary())})

    return dealt(ink, "image_id").groupBy("image_id").applyInArrow(run, f"image_id {dict(ink.dtypes)['image_id']}, height int, width int, pixels binary")
