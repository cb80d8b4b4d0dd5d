"""Copies among images by local descriptors.

Corners of an image pyramid are described by binary intensity tests in a patch turned to the patch's orientation.
Pieces of the descriptors are the keys of several Hamming tables: descriptors that differ in fewer bits than there are
tables share a key. Images that share keys with a bucket's smallest or largest image are compared with it, and then all
that share keys and that no links join yet: the matches of their descriptors must agree on one turn, scale and shift,
as those of cropped, resized or edited copies do.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, small_batches

#: A pyramid level's size to that of the one before, and the half width of a patch. Levels go on until no patch fits.
STEP = 2 / 3
#: Strongest corners kept of each tile of a level, and a tile's side at most, in pixels of the image.
CORNERS = 16
TILE = 96
RADIUS = 8
BITS = 128
TABLES = 4
#: Keys that two images must share, bits by which matching descriptors may differ, and matches that must agree.
VOTES = 2
MOST_BITS = 16
INLIERS = 8
_BATCH = 256
#: Bytes of corners of each side of a cell, and sides at least: a cell's images are sent to it once for all of its pairs.
CELL_BYTES = 16 << 20
LEAST_SIDES = 4
#: Bytes of corners of a side where every image meets every other one, and sides at least.
REST_BYTES = 16 << 20
REST_SIDES = 6
#: Corners of images that are compared with many others at once, at most, and corners of a side of such a product, about.
MOST_AT_ONCE = 256
PRODUCT = 1024
_CHUNK = 1 << 22

_RNG = np.random.default_rng(7)
_TESTS = np.clip(np.round(_RNG.normal(0, RADIUS / 2.5, (BITS, 2, 2))), -RADIUS + 2, RADIUS - 2)
_GRID = np.array([(y, x) for y in range(-RADIUS + 1, RADIUS) for x in range(-RADIUS + 1, RADIUS) if y * y + x * x < RADIUS * RADIUS])


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary netpbm (P5, P6) or 8-bit PNG image; None if it is neither or is damaged."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            width, height, top = head
            channels = 3 if data[1:2] == b"6" else 1
            pixels = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
            return pixels.astype(np.float32).mean(2) * (255.0 / top)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, KeyError, ZeroDivisionError, zlib.error):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed = 8, b""
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            depth, colour, laced = body[8], body[9], body[12]
        packed += body if kind == b"IDAT" else b""
        at += size + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or laced:
        return None
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), np.int64)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), 0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for i in range(len(line)):
                left = line[i - channels] if i >= channels else 0
                corner = above[i - channels] if i >= channels else 0
                if kind == 3:
                    line[i] = (line[i] + (left + above[i]) // 2) & 255
                else:
                    # the nearest of the three to left + above - corner; ties in this order
                    guess = left + above[i] - corner
                    line[i] = (line[i] + min((left, above[i], corner), key=lambda v: abs(guess - v))) & 255
        above = out[y] = line & 255
    colours = out.reshape(height, width, channels)
    return colours[:, :, : 3 if channels >= 3 else 1].astype(np.float32).mean(2)


def _smooth(x: np.ndarray) -> np.ndarray:
    """A 3 x 3 binomial filter of a stack of images, edges repeated."""
    p = np.pad(x, ((0, 0), (1, 1), (0, 0)), mode="edge")
    x = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    p = np.pad(x, ((0, 0), (0, 0), (1, 1)), mode="edge")
    return (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return x
    h, w = max(1, int(x.shape[1] * scale)), max(1, int(x.shape[2] * scale))
    y, z = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, z0 = np.clip(np.floor(y), 0, x.shape[1] - 1).astype(int), np.clip(np.floor(z), 0, x.shape[2] - 1).astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(z0 + 1, x.shape[2] - 1)
    fy, fz = np.clip(y - y0, 0, 1)[None, :, None].astype(np.float32), np.clip(z - z0, 0, 1)[None, None, :].astype(np.float32)
    rows = x[:, y0] * (1 - fy) + x[:, y1] * fy
    return rows[:, :, z0] * (1 - fz) + rows[:, :, z1] * fz


def _tiles(size: int, scale: float, edge: int) -> list[tuple[int, int]]:
    """Spans of a level's inner pixels, counted from its edge, that equal tiles of it have."""
    ends = np.linspace(0, size, max(1, int(np.ceil(size / scale / TILE - 0.05))) + 1).round().astype(int)
    ends = np.clip(ends - edge, 0, size - 2 * edge)
    return [(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b]


def features(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, (x, y, angle, scale), packed descriptor) of the corners of a stack of images of one size."""
    images, places, codes = [], [], []
    edge = int(RADIUS * 1.42) + 1
    base, scale = stack, 1.0
    while min(base.shape[1:]) > 2 * edge:
        level = _smooth(base)
        n, h, w = level.shape
        dy, dx = np.zeros_like(level), np.zeros_like(level)
        dy[:, 1:-1], dx[:, :, 1:-1] = level[:, 2:] - level[:, :-2], level[:, :, 2:] - level[:, :, :-2]
        a, b, c = _smooth(_smooth(dx * dx)), _smooth(_smooth(dy * dy)), _smooth(_smooth(dx * dy))
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        inner = strength[:, edge:-edge, edge:-edge]
        peak = np.ones(inner.shape, bool)
        for y in range(-2, 3):
            for x in range(-2, 3):
                if y or x:
                    other = strength[:, edge + y : h - edge + y, edge + x : w - edge + x]
                    # of equal neighbours, the first in reading order is the peak
                    peak &= inner > other if (y, x) < (0, 0) else inner >= other
        strong = np.where(peak & (inner > 100.0), inner, 0)
        found = [np.zeros((3, 0), np.int64)]
        for y0, y1 in _tiles(h, scale, edge):
            for x0, x1 in _tiles(w, scale, edge):
                flat = strong[:, y0:y1, x0:x1].reshape(n, -1)
                k = min(CORNERS, flat.shape[1])
                top = np.argpartition(-flat, k - 1, axis=1)[:, :k]
                keep = (np.take_along_axis(flat, top, 1) > 0).ravel()
                spot = top.ravel()[keep]
                found.append(np.stack([np.repeat(np.arange(n), k)[keep], spot // (x1 - x0) + y0 + edge, spot % (x1 - x0) + x0 + edge]))
        image, y, x = np.concatenate(found, 1)
        patch = level[image[:, None], y[:, None] + _GRID[:, 0], x[:, None] + _GRID[:, 1]]
        angle = np.arctan2(patch @ _GRID[:, 0].astype(np.float32), patch @ _GRID[:, 1].astype(np.float32))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        values = []
        for end in range(2):
            ty, tx = _TESTS[:, end, 0], _TESTS[:, end, 1]
            values.append(level[image[:, None], y[:, None] + np.rint(sin * tx + cos * ty).astype(int), x[:, None] + np.rint(cos * tx - sin * ty).astype(int)])
        images.append(image)
        places.append(np.column_stack([(x + 0.5) / scale, (y + 0.5) / scale, angle, np.full(len(x), 1 / scale)]).astype(np.float32))
        codes.append(np.packbits(values[0] < values[1], axis=1))
        base, scale = _resize(level, STEP), scale * STEP
    if not images:
        return np.zeros(0, int), np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    image, place, code = np.concatenate(images), np.concatenate(places), np.concatenate(codes)
    order = np.lexsort((place[:, 0], place[:, 1], place[:, 3], image))
    return image[order], place[order], code[order]


_FEATURES = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("codes", T.BinaryType())])


@F.arrow_udf(_FEATURES)
def describe(images: pa.Array) -> pa.Array:
    """Corners of each image and their descriptors; an image that can't be decoded has none."""
    count, places, codes = np.zeros(len(images), np.int32), [b""] * len(images), [b""] * len(images)
    waiting: dict[tuple, list] = {}

    def work(group):
        image, place, code = features(np.stack([g for _, g in group]).astype(np.float32))
        ends = np.searchsorted(image, np.arange(len(group) + 1))
        for k, (i, _) in enumerate(group):
            part = slice(ends[k], ends[k + 1])
            count[i], places[i], codes[i] = ends[k + 1] - ends[k], place[part].tobytes(), code[part].tobytes()

    for i, value in enumerate(images):
        grey = decode_image(value.as_py())
        if grey is not None and grey.size:
            group = waiting.setdefault(grey.shape, [])
            group.append((i, grey))
            if len(group) * grey.size >= _BATCH * 96 * 96:
                work(waiting.pop(grey.shape))
    for group in waiting.values():
        work(group)
    return pa.StructArray.from_arrays([pa.array(count), pa.array(places, pa.binary()), pa.array(codes, pa.binary())], ["n", "places", "codes"])


def _keys(codes: np.ndarray) -> np.ndarray:
    """Distinct keys of the tables that descriptors have, in order."""
    pieces = codes.reshape(-1, TABLES, BITS // 8 // TABLES).astype(np.int64)
    key = np.zeros(pieces.shape[:2], np.int64)
    for j in range(pieces.shape[2]):
        key = (key << 8) | pieces[:, :, j]
    return np.unique(key * TABLES + np.arange(TABLES))


@F.arrow_udf(T.ArrayType(T.LongType()))
def table_keys(codes: pa.Array) -> pa.Array:
    """Keys of the tables that each image's descriptors have: a table's number and its piece of the bits."""
    out = []
    for value in codes:
        out.append(_keys(np.frombuffer(value.as_py() or b"", np.uint8)))
    return pa.array(out, pa.list_(pa.int64()))


def _nearest(code_a: np.ndarray, code_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each descriptor of a, the first nearest of b and the bits between them; of each of b, the first nearest of a."""
    a, b = np.ascontiguousarray(code_a).view(np.uint64), np.ascontiguousarray(code_b).view(np.uint64)
    to, least = np.zeros(len(a), np.int64), np.zeros(len(a), np.uint8)
    back, best = np.zeros(len(b), np.int64), np.full(len(b), 255, np.uint8)
    step = max(1, _CHUNK // len(b))
    for i in range(0, len(a), step):
        apart = np.bitwise_count(a[i : i + step, None, 0] ^ b[None, :, 0])
        for k in range(1, a.shape[1]):
            apart += np.bitwise_count(a[i : i + step, None, k] ^ b[None, :, k])
        to[i : i + step] = near = apart.argmin(1)
        least[i : i + step] = apart[np.arange(len(near)), near]
        first = apart.argmin(0)
        low = apart[first, np.arange(len(b))]
        closer = low < best
        back[closer], best[closer] = first[closer] + i, low[closer]
    return to, least, back


def agreeing(place_a: np.ndarray, code_a: np.ndarray, place_b: np.ndarray, code_b: np.ndarray) -> int:
    """Most matches of descriptors that agree with one turn, scale and shift from a to b; 0 if there are not INLIERS matches."""
    if not len(code_a) or not len(code_b):
        return 0
    to, least, back = _nearest(code_a, code_b)
    good = (least <= MOST_BITS) & (back[to] == np.arange(len(to)))
    if good.sum() < INLIERS:
        return 0
    a, b = place_a[good].astype(np.float64), place_b[to[good]].astype(np.float64)
    # every match proposes a transform: its turn, its scale, and the shift that they leave
    turn, scale = b[:, 2] - a[:, 2], b[:, 3] / a[:, 3]
    cos, sin = np.cos(turn) * scale, np.sin(turn) * scale
    shift_x, shift_y = b[:, 0] - cos * a[:, 0] + sin * a[:, 1], b[:, 1] - sin * a[:, 0] - cos * a[:, 1]
    most, step = 0, max(1, _CHUNK // 16 // len(a))
    for i in range(0, len(a), step):
        c, d = cos[i : i + step, None], sin[i : i + step, None]
        off_x = c * a[:, 0] - d * a[:, 1] + shift_x[i : i + step, None] - b[:, 0]
        off_y = d * a[:, 0] + c * a[:, 1] + shift_y[i : i + step, None] - b[:, 1]
        near = np.hypot(off_x, off_y) <= 6 * np.maximum(1, b[None, :, 3])
        most = max(most, int(near.sum(1).max()))
    return most


def _compare_cell(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a cell's pairs whose corners agree. members: short, node, places, codes of every image of the pairs."""
    at: dict[int, list] = {}
    for short, node, places, codes in zip(members["short"], members["node"], members["places"], members["codes"], strict=True):
        at.setdefault(short, []).append((node, np.frombuffer(places, np.float32).reshape(-1, 4), np.frombuffer(codes, np.uint8).reshape(-1, BITS // 8)))
    found = [(x[0], y[0]) for a, b in zip(pairs["a"], pairs["b"], strict=True) for x in at[a] for y in at[b] if agreeing(*x[1:], *y[1:]) >= INLIERS]
    return pd.DataFrame(found, columns=["a", "b"])


def _agreeing_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): nodes of the pairs of short numbers whose corners agree.

    Images are dealt into blocks, and a pair of blocks is a cell; an image goes once to each cell that has pairs of it,
    however many they are.
    """
    held = found.agg(F.sum(F.length("places") + F.length("codes"))).first()[0] or 0
    sides = max(LEAST_SIDES, -(-held // CELL_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    pairs = cut(pairs.select("a", "b", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j")))
    wanted = pairs.select("i", "j", F.explode(F.array("a", "b")).alias("short")).distinct()
    members = wanted.join(found.select("short", "node", "places", "codes"), "short").select(F.col("i").alias("mi"), F.col("j").alias("mj"), "short", "node", "places", "codes")
    return pairs.groupBy("i", "j").cogroup(members.groupBy("mi", "mj")).applyInPandas(_compare_cell, "a binary, b binary")


def _parts(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of images of such sizes in order, in parts of about `most` corners."""
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1) if len(size) else []


def _might_agree(codes: list[np.ndarray], places: list[np.ndarray], left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a of left, b of right, a < b) that no label joins and whose corners may agree: all that do, and few others.

    Images of at most MOST_AT_ONCE corners, at least one. One product has half the inner products of all descriptors, less the
    numbers that corners have in their images as fractions: its greatest values are the first nearest ones, exactly.
    """
    code_a, code_b = np.concatenate([codes[k] for k in left]), np.concatenate([codes[k] for k in right])
    size_a, size_b = np.array([len(codes[k]) for k in left]), np.array([len(codes[k]) for k in right])
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    image_a = np.repeat(np.arange(len(left)), size_a)
    x, y = np.empty((len(code_a), BITS + 2), np.float32), np.empty((len(code_b), BITS + 2), np.float32)
    x[:, :BITS], y[:, :BITS] = np.unpackbits(code_a, axis=1), np.unpackbits(code_b, axis=1)
    x[:, :BITS] -= 0.5
    y[:, :BITS] *= 2
    y[:, :BITS] -= 1
    x[:, BITS], x[:, BITS + 1] = -1, (start_a[image_a] - np.arange(len(code_a))) / (2 * MOST_AT_ONCE**2)
    y[:, BITS], y[:, BITS + 1] = (np.arange(len(code_b)) - np.repeat(start_b, size_b)) / (2 * MOST_AT_ONCE), 1
    open_ = (left[:, None] < right) & (joined[left][:, None] != joined[right])
    hits, room = [], np.empty(0, np.float32)
    for part in _parts(size_b, PRODUCT):
        low, high = start_b[part[0]], start_b[part[-1]] + size_b[part[-1]]
        if room.size < len(x) * (high - low):
            room = np.empty(len(x) * (high - low), np.float32)
        near = np.matmul(x, y[low:high].T, out=room[: len(x) * (high - low)].reshape(len(x), -1))
        to = np.maximum.reduceat(near, start_b[part] - low, axis=1)
        back = np.stack([near[s : s + n].max(0) for s, n in zip(start_a, size_a, strict=True)])
        row, at = np.divmod(np.flatnonzero(to > BITS // 2 - MOST_BITS - 1), len(part))
        value = to[row, at]
        at = part[at]
        col = start_b[at] + (2 * MOST_AT_ONCE * (np.ceil(value) - value)).astype(np.int64)
        image = image_a[row]
        keep = (back[image, col - low] == value) & open_[image, at]
        hits.append((image[keep] * len(right) + at[keep], row[keep], col[keep]))
    pair, row, col = (np.concatenate(v) for v in zip(*hits, strict=True))
    keep = np.bincount(pair, minlength=open_.size)[pair] >= INLIERS
    pair, row, col = pair[keep], row[keep], col[keep]
    order = np.argsort(pair.astype(np.uint16) if open_.size <= 1 << 16 else pair, kind="stable")
    matches = np.bincount(pair, minlength=open_.size)
    pair, row, col = np.flatnonzero(matches), row[order], col[order]
    matches = matches[pair]
    first = np.cumsum(matches) - matches
    # in single precision: rounding is allowed for, and whoever asks compares exactly
    place_a, place_b = np.concatenate([places[k] for k in left]), np.concatenate([places[k] for k in right])
    most = np.abs(place_a[:, :2]).max() * 2 * (place_b[:, 3].max() / place_a[:, 3].min()) + np.abs(place_b[:, :2]).max() * 2
    allowed = ((6 * np.maximum(1, place_b[:, 3]) + 0.01 + 1e-5 * most) ** 2).astype(np.float32)
    cos_a, sin_a = np.cos(place_a[:, 2]) / place_a[:, 3], np.sin(place_a[:, 2]) / place_a[:, 3]
    cos_b, sin_b = np.cos(place_b[:, 2]) * place_b[:, 3], np.sin(place_b[:, 2]) * place_b[:, 3]
    xa, ya, xb, yb = (np.ascontiguousarray(p[:, k]) for p in (place_a, place_b) for k in (0, 1))

    def inside(i: np.ndarray, j: np.ndarray, tested: int) -> np.ndarray:
        """(match, pair): of the first `tested` matches, how many agree with each match's transform. i, j: (match, pair)."""
        cos, sin = cos_b[j] * cos_a[i] + sin_b[j] * sin_a[i], sin_b[j] * cos_a[i] - cos_b[j] * sin_a[i]
        ax, ay, bx, by = xa[i], ya[i], xb[j], yb[j]
        shift_x, shift_y = bx - cos * ax + sin * ay, by - sin * ax - cos * ay
        ax, ay, bx, by = (v[:tested, None] for v in (ax, ay, bx, by))
        off_x, off_y = cos * ax, sin * ax
        off_x -= sin * ay
        off_y += cos * ay
        off_x += shift_x
        off_y += shift_y
        off_x -= bx
        off_y -= by
        off_x *= off_x
        off_y *= off_y
        off_x += off_y
        return np.add.reduce((off_x <= allowed[j[:tested]][:, None]).view(np.uint8), axis=0, dtype=np.uint16)

    found = []
    for n in np.unique(matches):
        some, missing = np.flatnonzero(matches == n), n - INLIERS
        for k in range(0, len(some), step := max(1, _CHUNK // 64 // n**2)):
            near_ones = some[k : k + step]
            # a transform that misses more of the first matches than may be missing needs no look at the others
            for tested in (min(n, missing + 3), n):
                part = first[near_ones] + np.arange(n)[:, None]
                near_ones = near_ones[(inside(row[part], col[part], tested) >= tested - missing).any(0)]
            found.append(pair[near_ones])
    a, b = np.divmod(np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64), len(right))
    return left[a], right[b]


def _candidates(codes: list[np.ndarray], places: list[np.ndarray], sides: list[np.ndarray], joined: np.ndarray):
    """Arrays of pairs (a, b), a < b, of one image of each side (of one, if there is one side) that may agree; joined is read as it is then."""
    size = np.array([len(v) for v in codes])
    sides = [side[size[side] > 0] for side in sides]
    few, many = [side[size[side] <= MOST_AT_ONCE] for side in sides], [side[size[side] > MOST_AT_ONCE] for side in sides]
    # the smaller one is the left one of a pair, so that two sides meet both ways
    for k, side in enumerate(few):
        other = few[len(few) - 1 - k]
        for at in _parts(size[side], PRODUCT):
            left = side[at]
            further = other[other > left[0]]
            for at in _parts(size[further], 8 * PRODUCT):
                right = further[at]
                if (joined[left] != joined[right[0]]).any() or (joined[right] != joined[left[0]]).any():
                    yield _might_agree(codes, places, left, right, joined)
    # images of more corners are compared one by one
    for k, side in enumerate(many):
        rest = sides[1 - k] if len(sides) == 2 else sides[0]
        for a in side:
            others = rest[~(np.isin(rest, side) & (rest <= a)) & (rest != a)] if len(sides) == 1 else rest[(size[rest] <= MOST_AT_ONCE) | (k == 0)]
            others = others[joined[others] != joined[a]]
            yield np.minimum(a, others), np.maximum(a, others)


def _compare_rest(members: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a cell's pairs that share VOTES keys and whose corners agree, but for pairs that others already join.

    members: i, j, block, short, node, root, places, codes. Pairs are of one image of each of the cell's blocks.
    """
    rows = members.sort_values(["short", "node"]).reset_index(drop=True)
    _, label = np.unique(rows["root"].to_numpy(object), return_inverse=True)
    found: list[tuple] = []
    if not label.any():
        return pd.DataFrame(found, columns=["a", "b"])
    codes = [np.frombuffer(v, np.uint8).reshape(-1, BITS // 8) for v in rows["codes"]]
    places = [np.frombuffer(v, np.float32).reshape(-1, 4) for v in rows["places"]]
    block, i, j = rows["block"].to_numpy(), rows["i"][0], rows["j"][0]
    sides = [np.flatnonzero(block == k) for k in ([i] if i == j else [i, j])]
    keys = functools.lru_cache(1 << 10)(lambda k: _keys(codes[k]))
    for left, right in _candidates(codes, places, sides, label):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if label[a] != label[b] and len(np.intersect1d(keys(a), keys(b), assume_unique=True)) >= VOTES and agreeing(places[a], codes[a], places[b], codes[b]) >= INLIERS:
                found.append((rows["node"][a], rows["node"][b]))
                label[label == label[b]] = label[a]
    return pd.DataFrame(found, columns=["a", "b"])


def _remaining_pairs(found: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): nodes of further pairs that share VOTES keys and whose corners agree, so that links and these join all that any pair joins.

    Every image meets every other in a cell of two blocks; only pairs that the links so far leave apart are compared.
    """
    held = found.agg(F.sum(F.length("places") + F.length("codes"))).first()[0] or 0
    sides = max(REST_SIDES, -(-held // REST_BYTES))
    roots = connected_components(links).select(F.col("node").alias("k"), "component")
    rooted = found.filter("n >= %d" % INLIERS).join(roots, F.col("node") == F.col("k"), "left").withColumn("root", F.coalesce("component", "node"))
    other, block = F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("other"), F.pmod(F.xxhash64("short"), F.lit(sides)).cast("int")
    dealt = rooted.select(block.alias("block"), other, "short", "node", "root", "places", "codes")
    cells = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "short", "node", "root", "places", "codes")
    # a number of partitions that is given is not lowered to that of few bytes; with more of them than cells, few cells share one
    return cells.repartition(2 * sides * (sides + 1), "i", "j").groupBy("i", "j").applyInPandas(_compare_rest, "a binary, b binary")


def find_copies(images: DataFrame, row: str = "image_id", image: str = "image") -> DataFrame:
    """One row per image: its id, class_id, class_size, n_links and n_corners.

    A class is a connected component of images that are byte for byte equal or whose descriptors agree on a transform;
    class_id is its smallest id. n_links counts the different images (not equal ones) that an image was found to agree
    with, of those that were compared: pairs that share keys, of which one is the smallest or largest of a bucket or
    that no links found before joined. Null images, and those that can't be decoded and are equal to no other, are a class each; flat images have no
    corners. Repeated ids stay rows of their own. Other columns are not read; an empty table gives no rows.
    """
    small_batches(images.sparkSession)
    node = F.when(F.length(image) > 0, F.unhex(F.md5(F.col(image)))).alias("node")
    keyed = images.select(F.col(row).alias("id"), F.col(image).alias("image"), node)
    filled = keyed.filter("node is not null")
    exact = cut(filled.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    one = exact.select(F.col("node").alias("k"), "first_id")
    # images are described where they lie; what is shuffled is their corners
    described = filled.select("node", "id", describe("image").alias("f"))
    single = described.join(one, (described["node"] == one["k"]) & described["id"].eqNullSafe(one["first_id"])).dropDuplicates(["node", "id"])
    found = cut(single.select("node", F.xxhash64("node").alias("short"), "f.n", "f.places", "f.codes"))
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out once, for the buckets' ends and for the images that meet them
    held = found.select("short", F.explode(table_keys("codes")).alias("key")).repartition(tasks, "key")
    ends = held.groupBy("key").agg(F.min("short").alias("low"), F.max("short").alias("high")).filter("low <> high")
    met = held.join(ends, "key")
    pairs = met.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("short").alias("b")), F.struct(F.col("short").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.a", "p.b").filter("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("votes")).filter(F.col("votes") >= VOTES).drop("votes")
    links = cut(_agreeing_pairs(pairs, found))
    links = cut(links.unionByName(_remaining_pairs(found, links)))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    roots = connected_components(links).withColumnRenamed("component", "root")
    rooted = exact.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    per_node = rooted.select("node", "root").join(classes, "root").join(degree, "node", "left").join(found.select("node", F.col("n").alias("n_corners")), "node", "left")
    names = ["id", "class_id", "class_size", "n_links", "n_corners"]
    out = filled.select("id", "node").join(per_node, "node").fillna(0, ["n_links", "n_corners"]).select(*names)
    none = keyed.filter("node is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(0).alias("n_corners"))
    return out.unionByName(none).withColumnRenamed("id", row)


def pgm(grey: np.ndarray) -> bytes:
    """A binary netpbm image of grey levels."""
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


@F.arrow_udf(T.BinaryType())
def drawn(vectors: pa.Array) -> pa.Array:
    """Each vector as an image of 96 x 96 grey levels: its components weigh plane waves. Not finite components count as 0."""
    y, x = np.mgrid[0:96, 0:96] / 96
    waves: dict[int, np.ndarray] = {}
    out = []
    for value in vectors:
        v = value.as_py()
        if not v:
            out.append(None)
            continue
        if len(v) not in waves:
            rng = np.random.default_rng(len(v))
            ways = [(*rng.uniform(-7, 7, 2), rng.uniform(0, 1)) for _ in v]
            waves[len(v)] = np.stack([np.cos(2 * np.pi * (a * x + b * y + c)).ravel() for a, b, c in ways]).astype(np.float32)
        weight = np.array([c if c is not None and np.isfinite(c) else 0.0 for c in v], np.float32)
        grey = weight @ waves[len(v)]
        out.append(pgm(128 + (45 / max(1e-12, float(grey.std())) * grey).reshape(96, 96)))
    return pa.array(out, pa.binary())


def embedding_images(vectors: DataFrame, row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    column: Column = drawn(F.col(vector))
    return vectors.select(F.col(row).alias("image_id"), column.alias("image"))


def op5(spark, sf_dir: str) -> DataFrame:
    """The test tables hold no images, so every row of embeddings is drawn as one."""
    return find_copies(embedding_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("image_id", "vec_id")
