"""Column functions on boxes, landmarks and poses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions.scalar import lit, truncate

#: Order of the five named points in a landmark vector.
POINTS = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")


def box(bbox: Column) -> dict[str, Column]:
    x1, y1, x2, y2 = (bbox[i] for i in range(4))
    w, h = x2 - x1, y2 - y1
    return {"width": w, "height": h, "area": w * h, "center_x": (x1 + x2) / 2, "center_y": (y1 + y2) / 2}


def landmark_points(v: Column) -> Column:
    """Struct of five points; null for a null vector or one of fewer than ten values."""
    point = lambda i: F.struct(v[2 * i].alias("x"), v[2 * i + 1].alias("y"))
    return F.when(F.coalesce(F.size(v), F.lit(0)) >= 10, F.struct(*[point(i).alias(n) for i, n in enumerate(POINTS)]))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes whose sides count both end pixels."""
    w = F.greatest(lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    h = F.greatest(lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (area(a) + area(b) - w * h)


def _turn(a: tuple, b: tuple, c: tuple) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a: tuple, b: tuple, p: tuple) -> Column:
    return (_turn(a, b, p) == 0) & p[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & p[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))


def _cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    s = F.signum
    proper = (s(_turn(a, b, c)) * s(_turn(a, b, d)) < 0) & (s(_turn(c, d, a)) * s(_turn(c, d, b)) < 0)
    return proper | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)


def face_geometry(v: Column) -> tuple[Column, Column]:
    """(the eyes and mouth corners form a simple quadrilateral, the nose lies strictly inside it). Both are false for a
    null vector or one of fewer than ten values. A nose on an edge is outside. A quadrilateral with two equal
    neighbouring points is a triangle and is simple if that has an area."""
    # bound through one-element arrays, so that neither the corners nor the first answer are spelled out again
    valid = F.transform(F.array(v), lambda x: _quad_valid(_corners(x)))[0]
    inside = F.transform(F.array(v), lambda x: _inside(_corners(x), (x[4], x[5])))[0]
    enough, no = F.coalesce(F.size(v), F.lit(0)) >= 10, F.lit(False)
    quad = F.when(enough, F.coalesce(valid, no)).otherwise(no)
    return quad, F.when(quad, F.coalesce(inside, no)).otherwise(no)


def _corners(v: Column) -> list[tuple]:
    return [(v[2 * i], v[2 * i + 1]) for i in (0, 1, 4, 3)]


def _quad_valid(quad: list[tuple]) -> Column:
    same = lambda a, b: (a[0] == b[0]) & (a[1] == b[1])
    repeated = same(quad[0], quad[1]) | same(quad[1], quad[2]) | same(quad[2], quad[3]) | same(quad[3], quad[0])
    area = _turn(quad[0], quad[1], quad[2]) + _turn(quad[0], quad[2], quad[3])
    simple = ~_cross(quad[0], quad[1], quad[2], quad[3]) & ~_cross(quad[1], quad[2], quad[3], quad[0])
    return F.when(repeated, area != 0).otherwise(simple & (area != 0))


def _inside(quad: list[tuple], p: tuple) -> Column:
    crossings, edge = F.lit(0), F.lit(False)
    for a, b in zip(quad, [*quad[1:], quad[0]], strict=True):
        edge = edge | _on(a, b, p)
        spans = (a[1] > p[1]) != (b[1] > p[1])
        at = a[0] + (p[1] - a[1]) * (b[0] - a[0]) / F.when(b[1] != a[1], b[1] - a[1])
        crossings = crossings + F.when(spans & (p[0] < at), 1).otherwise(0)
    return ~edge & (crossings % 2 == 1)


def basic_score(w: Column, h: Column, width: Column, height: Column, confidence: Column, config: EngineConfig = DEFAULT) -> Column:
    big = (w > config.min_face_size) & (h > config.min_face_size) & (w / width > config.min_face_ratio) & (h / height > config.min_face_ratio)
    return F.when(big & (confidence >= config.max_confidence), lit(1)).when(big & (confidence >= config.min_confidence), lit(0.5)).otherwise(lit(0))


def geometry_score(v: Column) -> Column:
    valid, inside = face_geometry(v)
    return F.when(valid & inside, lit(1)).when(valid, lit(0.5)).otherwise(lit(0))


def decode_box(loc: Column, prior: Column, config: EngineConfig = DEFAULT) -> list[Column]:
    """Corners of a box from the model's offsets and its prior (cx, cy, w, h)."""
    a, b = (lit(x) for x in config.prior_variances)
    cx, cy = (prior[i] + loc[i] * a * prior[i + 2] for i in (0, 1))
    w, h = (prior[i] * F.exp(loc[i] * b) for i in (2, 3))
    x1, y1 = cx - w / 2, cy - h / 2
    return [x1, y1, w + x1, h + y1]


def decode_landmarks(pre: Column, prior: Column, config: EngineConfig = DEFAULT) -> Column:
    a = lit(config.prior_variances[0])
    return F.transform(pre, lambda v, i: F.element_at(prior, (i % 2 + 1).cast("int")) + v * a * F.element_at(prior, (i % 2 + 3).cast("int")))


def detector_scale(width: Column, height: Column, config: EngineConfig = DEFAULT) -> Column:
    return lit(config.detector_side) / F.greatest(width, height)


def expand_box(bbox: Column, width: Column, height: Column) -> list[Column]:
    """50 pixels wider to each side, 50 up and 30 down, inside the image."""
    return [F.greatest(bbox[0] - 50, lit(0)), F.greatest(bbox[1] - 50, lit(0)), F.least(bbox[2] + 50, width), F.least(bbox[3] + 30, height)]


def loose_crop(x1: Column, y1: Column, x2: Column, y2: Column, k: Column, top: float = 2.0, bottom: float = 0.6) -> list[Column]:
    """A box widened by shares of its sides one after another: each step sees the sides as the step before left them."""
    a = x1 - lit(0.6) * k * F.abs(x2 - x1)
    b = y1 - lit(top) * k * F.abs(y2 - y1)
    c = x2 + lit(0.6) * k * F.abs(x2 - a)
    return [a, b, c, y2 + lit(bottom) * k * F.abs(y2 - b)]


def center_crop(width: Column, height: Column, aspect: Column) -> Column:
    """Struct (x_off, y_off, w, h) of the largest centred crop of an aspect ratio; the whole frame within 0.001 of it."""
    now = width / height
    w, h = truncate(height * aspect), truncate(width / aspect)
    full = F.struct(F.lit(0).cast("bigint").alias("x_off"), F.lit(0).cast("bigint").alias("y_off"), width.cast("bigint").alias("w"), height.cast("bigint").alias("h"))
    narrow = F.struct(F.floor((width - w) / 2).alias("x_off"), F.lit(0).cast("bigint").alias("y_off"), w.alias("w"), height.cast("bigint").alias("h"))
    flat = F.struct(F.lit(0).cast("bigint").alias("x_off"), F.floor((height - h) / 2).alias("y_off"), width.cast("bigint").alias("w"), h.alias("h"))
    return F.when(F.abs(now - aspect) < 0.001, full).when(now > aspect, narrow).otherwise(flat)


def resize_mode(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    return F.when((w == to_w) & (h == to_h), "identity").when(to_w * to_h > w * h, "cubic").otherwise("area")


def pose_angle(bins: Column) -> Column:
    """Expected angle of 66 bins of 3 degrees from -99, after a softmax."""
    start = F.struct(F.array_max(bins).alias("top"), lit(0).alias("e"), lit(0).alias("ei"))
    place = F.transform(bins, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def add(s: Column, v: Column) -> Column:
        e = F.exp(v["x"] - s["top"])
        return F.struct(s["top"].alias("top"), (s["e"] + e).alias("e"), (s["ei"] + e * v["i"]).alias("ei"))

    return F.aggregate(place, start, add, lambda s: s["ei"] / s["e"] * 3 - 99)


def pose_deviation(yaw: Column, pitch: Column, roll: Column) -> Column:
    return F.least(F.sqrt(yaw * yaw + pitch * pitch + roll * roll), lit(90))


def pose_bin(angle: Column) -> Column:
    """Place among the edges -99, -96, ..., 99, less one: -1 below the first, 66 from the last on."""
    return F.greatest(F.lit(-1), F.least(F.lit(66), F.floor((angle + 99) / 3))).cast("int")


def euler_from_matrix(m: list[list[Column]]) -> list[Column]:
    """Degrees (roll, pitch, yaw in the annotation's sense) of a rotation given by rows; it is transposed first."""
    r = [[m[j][i] for j in range(3)] for i in range(3)]
    roll = -F.atan2(r[1][0], r[0][0])
    yaw = -F.atan2(-r[2][0], F.sqrt(r[2][1] * r[2][1] + r[2][2] * r[2][2]))
    pitch = F.atan2(r[2][1], r[2][2])
    return [x * lit(180) / lit(math.pi) for x in (roll, pitch, yaw)]


def axis_ends(yaw: Column, pitch: Column, roll: Column, size: float = 100.0) -> list[Column]:
    """End points (x, y) of the three axes of a pose in degrees, from the origin; the yaw is negated."""
    y, p, r = -F.radians(yaw), F.radians(pitch), F.radians(roll)
    s = lit(size)
    return [
        s * F.cos(y) * F.cos(r), s * (F.cos(p) * F.sin(r) + F.cos(r) * F.sin(p) * F.sin(y)),
        -s * F.cos(y) * F.sin(r), s * (F.cos(p) * F.cos(r) - F.sin(p) * F.sin(y) * F.sin(r)),
        s * F.sin(y), -s * F.cos(y) * F.sin(p),
    ]


def landmark_box(v: Column) -> Column:
    """Array (x1, y1, x2, y2) around a vector of x, y pairs; null for an empty one."""
    xs, ys = F.filter(v, lambda _, i: i % 2 == 0), F.filter(v, lambda _, i: i % 2 == 1)
    return F.when(F.size(v) >= 2, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """exp(v / temperature) over their sum."""
    start = F.struct(F.array_max(values).alias("top"), lit(0).alias("s"))
    total = F.aggregate(values, start, lambda s, v: F.struct(s["top"].alias("top"), (s["s"] + F.exp((v - s["top"]) / temperature)).alias("s")))
    return F.transform(F.array(total), lambda t: F.transform(values, lambda v: F.exp((v - t["top"]) / temperature) / t["s"]))[0]


def squared_error(a: Column, b: Column) -> Column:
    """The sum of squared differences of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit(0), lambda s, x: s + x)


def draw(key: Column, seed: str) -> Column:
    """A number from 0 to 1 from a key, fixed by the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / lit(2**32)


def augmentation(key: Column, seed: str = "0") -> Column:
    """Struct (flip, blur, factor) of an image's training variant: flipped with a share of 0.5, blurred with 0.05, reduced by
    1, 6, 11 or 16."""
    factor = F.lit(1) + 5 * F.floor(draw(key, seed + ":factor") * 4).cast("int")
    return F.struct((draw(key, seed + ":flip") < 0.5).alias("flip"), (draw(key, seed + ":blur") < 0.05).alias("blur"), factor.alias("factor"))


def flip_pose(yaw: Column, pitch: Column, roll: Column, flip: Column) -> list[Column]:
    """Yaw and roll negated where flip holds."""
    return [F.when(flip, -yaw).otherwise(yaw), pitch, F.when(flip, -roll).otherwise(roll)]


def cube_corners(yaw: Column, pitch: Column, roll: Column, x: Column, y: Column, size: float = 150.0) -> Column:
    """Array of the eight corners (x, y) of a pose's cube round a point: the first corner lies half a side left of and above
    the point; the corner of number b has the axes of the set bits of b added."""
    ends = axis_ends(yaw, pitch, roll, size)
    half = lit(0.5 * size)

    def corner(b: int) -> Column:
        used = [i for i in range(3) if b >> i & 1]
        return F.struct(sum((ends[2 * i] for i in used), x - half).alias("x"), sum((ends[2 * i + 1] for i in used), y - half).alias("y"))

    return F.array(*[corner(b) for b in range(8)])


def crop_then_resize(width: Column, height: Column, to_w: Column, to_h: Column) -> Column:
    """Struct (crop, mode): the centred crop of the target's aspect ratio and how the rest is scaled to it."""
    crop = center_crop(width, height, to_w / to_h)
    return F.struct(crop.alias("crop"), resize_mode(crop["w"], crop["h"], to_w, to_h).alias("mode"))


def detector_size(width: Column, height: Column, config: EngineConfig = DEFAULT) -> Column:
    """Struct (scale, w, h) of a frame as the detector sees it; small frames grow."""
    s = detector_scale(width, height, config)
    return F.struct(s.alias("scale"), truncate(width * s).alias("w"), truncate(height * s).alias("h"))


#: The means of the blue, green and red channels that the detector takes off; the weights of gray.
CHANNEL_MEANS = (104.0, 117.0, 123.0)
GRAY_WEIGHTS = (0.114, 0.587, 0.299)


def detector_channels(pixel: Column) -> Column:
    """Array of a (blue, green, red) pixel's channels without their means."""
    return F.array(*[pixel[i] - lit(m) for i, m in enumerate(CHANNEL_MEANS)])


def gray(pixel: Column) -> Column:
    """Gray of a (blue, green, red) pixel, to the nearest whole number."""
    b, g, r = (pixel[i] * lit(w) for i, w in enumerate(GRAY_WEIGHTS))
    return F.floor(b + g + r + lit(0.5)).cast("int")


def overlay_label(confidence: Column, score: Column) -> Column:
    return F.format_string("conf %.3f score %.1f", confidence, score)
