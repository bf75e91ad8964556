"""Conversion of images, and loops of points, against plain versions on small inputs."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from quillspark.operators import homology as H
from quillspark.operators import images as I
from quillspark.operators import triangulation as T
from quillspark.sources import files


def png(pixels: np.ndarray, filters: list[int]) -> bytes:
    """A PNG file of gray or colour pixels, each row by the next of the filters."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    height, width, samples = pixels.shape
    rows, above = [], np.zeros(width * samples, int)
    for y in range(height):
        row, kind, out = pixels[y].ravel().astype(int), filters[y % len(filters)], []
        for k, v in enumerate(row):
            left, corner = (row[k - samples], above[k - samples]) if k >= samples else (0, 0)
            up = above[k]
            guess = left + up - corner
            paeth = left if abs(guess - left) <= abs(guess - up) and abs(guess - left) <= abs(guess - corner) else up if abs(guess - up) <= abs(guess - corner) else corner
            out.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows.append(bytes([kind, *out]))
        above = row
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[samples], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_files_are_read():
    rng = np.random.default_rng(1)
    gray = rng.integers(0, 256, (9, 7))
    assert (I.decode_png(png(gray, [0, 1, 2, 3, 4])) == gray).all()
    colour = rng.integers(0, 256, (5, 4, 3))
    assert (I.decode_png(png(colour, [4, 3])) == np.rint(colour @ [0.299, 0.587, 0.114])).all()
    with pytest.raises(ValueError):
        I.decode_png(b"GIF89a")


def packed_png(pixels, depth, colour, laced=0, palette=b""):
    """A PNG file without filters, its samples of ``depth`` bits, in the order of the passes if interlaced."""
    body = b""
    for x, y, dx, dy in I.PASSES if laced else ((0, 0, 1, 1),):
        for row in pixels[y::dy, x::dx]:
            if row.size:
                bits = "".join(f"{int(v):0{depth}b}" for v in row.ravel())
                bits += "0" * (-len(bits) % 8)
                body += b"\0" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    chunk = lambda kind, data: struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], depth, colour, 0, 0, laced)
    middle = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + middle + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [0, 1])
def test_png_of_all_depths(laced):
    rng = np.random.default_rng(2)
    for depth in (1, 2, 4, 8, 16):
        gray = rng.integers(0, 1 << depth, (11, 13))
        expected = gray >> 8 if depth == 16 else gray * 255 // ((1 << depth) - 1)
        assert (I.decode_png(packed_png(gray, depth, 0, laced)) == expected).all()
        if depth < 16:
            colours = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
            assert (I.decode_png(packed_png(gray, depth, 3, laced, colours.tobytes())) == np.rint(colours[gray] @ [0.299, 0.587, 0.114])).all()
    wide = rng.integers(0, 65536, (3, 2, 4))
    assert (I.decode_png(packed_png(wide, 16, 6, laced)) == np.rint((wide[:, :, :3] >> 8) @ [0.299, 0.587, 0.114])).all()
    with pytest.raises(ValueError):
        I.decode_png(packed_png(gray, 8, 3))


def test_jpeg_and_bmp_files_become_strokes(spark, tmp_path):
    """The files are written by the virtual machine's own encoder; a bitmap loses nothing, a JPEG of a drawing little."""
    from quillspark.sources import files

    image = np.full((48, 48), 255, np.uint8)
    image[10:38, 22:26] = 0
    awt, io = spark._jvm.java.awt.image.BufferedImage, spark._jvm.javax.imageio.ImageIO
    for name, kind, number in (("a.bmp", "bmp", awt.TYPE_INT_RGB), ("b.jpg", "jpg", awt.TYPE_INT_RGB), ("c d%+[1].jpeg", "jpg", awt.TYPE_BYTE_GRAY)):
        canvas = awt(48, 48, number)
        for y in range(48):
            for x in range(48):
                canvas.setRGB(x, y, int(image[y, x]) * 0x10101)
        assert io.write(canvas, kind, spark._jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "d.png").write_bytes(png(image, [0] * 48))
    (tmp_path / "e.jpg").write_bytes(b"no image")
    (tmp_path / "f.tiff").write_bytes(b"II*\0")
    decoded = {r["image_id"].rsplit("/", 1)[1]: r for r in files.decoded_images(spark, f"file://{tmp_path}").collect()}
    assert sorted(decoded) == ["a.bmp", "b.jpg", "c d%+[1].jpeg", "e.jpg"] and decoded["e.jpg"]["pixels"] is None
    level = lambda name: np.frombuffer(decoded[name]["pixels"], np.uint8).reshape(48, 48).astype(int)
    assert (level("a.bmp") == image).all()
    assert all(np.abs(level(name) - image).max() < 60 and np.abs(level(name) - image).mean() < 3 for name in ("b.jpg", "c d%+[1].jpeg"))
    found = {r["image_id"].rsplit("/", 1)[1]: r for r in files.convert_files(spark, f"file://{tmp_path}").collect()}
    assert {n for n, r in found.items() if r["status"] == "processed"} == {"a.bmp", "b.jpg", "c d%+[1].jpeg", "d.png"}
    assert found["e.jpg"]["error"] and found["f.tiff"]["error"] and found["a.bmp"]["label"] == "A"
    from quillspark.streaming import imports

    target = f"file://{tmp_path}/out"
    assert imports.import_files(spark, f"file://{tmp_path}", target, "all").first()["processed_files"] == 4
    assert len(found["a.bmp"]["strokes"]) == len(found["d.png"]["strokes"]) > 0


def test_padding_keeps_proportions_and_means():
    image = np.zeros((40, 80), np.uint8)
    image[:, :40] = 200
    out = I.padded(image, 20)
    assert out.shape == (20, 20) and (out[:5] == 255).all() and (out[15:] == 255).all()
    assert (out[5:15, :10] == 200).all() and (out[5:15, 10:] == 0).all()


def test_otsu_equals_all_levels():
    rng = np.random.default_rng(2)
    image = np.r_[rng.integers(10, 60, 300), rng.integers(150, 250, 200)].astype(np.uint8).reshape(20, 25)

    def between(t):
        a, b = image[image <= t].astype(float), image[image > t].astype(float)
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1

    assert between(I.otsu_level(image)) == pytest.approx(max(map(between, range(256))))


def test_small_pieces_go_and_ground_is_dark():
    ink = np.zeros((64, 64), bool)
    ink[10:30, 10:16] = True
    ink[50, 50] = True
    clean = I.denoised(ink)
    assert clean[10:30, 10:16].all() and clean.sum() == 120
    assert (I.dark_ground(~ink) == ink).all() and (I.dark_ground(ink) == ink).all()


def test_tracing_of_a_line_a_fork_and_a_ring():
    line = np.zeros((20, 20), bool)
    line[5, 3:15] = True
    assert I.traced(line) == [[(5, x) for x in range(3, 15)]]
    fork = line.copy()
    fork[6:12, 9] = True
    paths = I.traced(fork)
    assert len(paths) == 3 and sorted((p[0], p[-1]) for p in paths) == [((5, 3), (5, 14)), ((5, 3), (11, 9)), ((5, 14), (11, 9))]
    ring = np.zeros((20, 20), bool)
    ring[4, 4:10] = ring[9, 4:10] = True
    ring[4:10, 4] = ring[4:10, 9] = True
    (walk,) = I.traced(ring)
    assert len(walk) == ring.sum() and len(set(walk)) == len(walk)
    twig = line.copy()
    twig[6:8, 9] = True
    assert not I.without_twigs(twig)[7, 9] and I.without_twigs(twig)[5, 3]


def test_times_grow_and_strokes_are_apart():
    strokes = I.timed([[(0, 0), (0, 1), (1, 1)], [(5, 5)], [(3, 3), (3, 4)]])
    assert len(strokes) == 2 and [p[:2] for p in strokes[0]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    assert strokes[0][1][2] == pytest.approx(1 / 75) and strokes[0][2][2] == pytest.approx(1 / 75 + 0.01)
    assert strokes[1][0][2] == pytest.approx(strokes[0][-1][2] + 0.1)


def test_files_are_converted(spark, tmp_path):
    image = np.full((90, 60), 255, np.uint8)
    image[20:70, 25:33] = 0
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "one.png").write_bytes(png(image, [0]))
    (tmp_path / "b2.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no image")
    found = {r.label: r for r in files.convert_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"A", "B"} and found["B"].status == "failed" and found["B"].strokes is None
    assert found["A"].status == "processed" and len(found["A"].strokes) >= 1 and found["A"].error is None
    assert files.convert_files(spark, str(tmp_path), ["a"], least=2.0).first().error == "Quality below threshold"


def plain_loops(x, y, steps=20, most=0.5):
    n = len(x)
    far = [[((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) ** 0.5 for b in range(n)] for a in range(n)]
    values = [0.0, *sorted(far[a][b] for a in range(n) for b in range(a + 1, n) if far[a][b] <= most)[:steps]]
    out = []
    for k in range(1, len(values)):
        near = [[b for b in range(n) if b != a and far[a][b] <= values[k]] for a in range(n)]
        visited, parent = set(), {}

        def walk(v):
            visited.add(v)
            for b in near[v]:
                if b not in visited:
                    parent[b] = v
                    if walk(b):
                        return True
                elif parent.get(v) != b:
                    return True
            return False

        death = values[min(k + 1, len(values) - 1)]
        out += [(values[k], death) for v in range(n) if v not in visited and walk(v) and death - values[k] > 1e-10]
    return out


def test_loops_equal_a_plain_walk():
    rng = random.Random(3)
    for n in (0, 2, 3, 12, 25):
        x, y = ([round(rng.random() * 0.6, 2) for _ in range(n)] for _ in "xy")
        found = H.loops(np.array(x), np.array(y))
        assert [(pytest.approx(a), pytest.approx(b)) for a, b in plain_loops(x, y)] == found


def test_triangles_equal_all_triples():
    rng = np.random.default_rng(5)
    grid = np.array([(a, b) for a in range(4) for b in range(4)], float) / 3
    sets = [rng.random((n, 2)) for n in (1, 2, 3, 4, 9, 30)] + [grid, np.r_[grid[:6], grid[:3]], np.c_[np.arange(6) / 5, np.zeros(6)]]
    for points in sets:
        x, y = points.T
        n, expected = len(x), []
        for a in range(n):
            for b in range(a + 1, n):
                for c in range(b + 1, n):
                    if abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2 > 1e-10:
                        cx, cy, r = T.circle(x, y, a, b, c)
                        if all(np.sqrt((x[o] - cx) ** 2 + (y[o] - cy) ** 2) >= r - 1e-10 for o in range(n) if o not in (a, b, c)):
                            expected.append((a, b, c))
        assert T.empty_triangles(x, y) == expected


def test_holes_and_shape_features():
    ring, long = [(0, 1), (1, 2), (2, 3), (0, 3)], [(k, k + 1) for k in range(10, 19)] + [(10, 19)]
    assert T.holes(ring + long, 20) == [[0, 3, 2, 1]] and T.holes(ring, 11) == [] and T.holes([(0, 1)], 20) == []
    x, y = np.array([0.0, 1, 1, 0]), np.array([0.0, 0, 1, 1])
    area, around, points, edges, triangles, compact, n_holes, hollow, share, alpha = T.alpha_features(x, y, 0.8)
    # of the square's four corners on one circle every triple counts
    assert (points, edges, triangles, n_holes, alpha) == (4, 0, 4, 0, 0.8) and area == pytest.approx(2)
    assert T.alpha_features(x[:3], y[:3], 0.8)[:5] == pytest.approx([0.5, 2 + 2**0.5, 3, 3, 1])
    assert T.alpha_features(np.zeros(2), np.zeros(2), 0.1)[:6] == [0, 0, 2, 0, 0, 0]
