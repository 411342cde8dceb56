"""Column functions: numbers, strings, JSON. All run in the JVM; none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig


def lit(x: float) -> Column:
    return F.lit(float(x))


def truncate(x: Column) -> Column:
    """Towards zero, as an integer."""
    return x.cast("bigint")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), x))


def sample_step(fps: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), truncate(fps * lit(config.sample_interval_sec)))


def window_size(fps: Column, config: EngineConfig = DEFAULT) -> Column:
    return truncate(fps * lit(config.sample_interval_sec))


def duration(total: Column, fps: Column) -> Column:
    return F.when(fps > 0, total / fps).otherwise(lit(0))


def usable_fps(fps: Column) -> Column:
    """0 where the rate isn't in (0, 120]."""
    return F.when((fps > 0) & (fps <= 120), fps).otherwise(lit(0))


def index_to_time(idx: Column, fps: Column) -> Column:
    return F.when(fps > 0, idx / fps).otherwise(lit(0))


def fraction(text: Column) -> Column:
    """The value of "a/b"; null where it is no such text or b is 0."""
    a, b = (F.get(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(b != 0, a / b)


def parse_resolution(text: Column) -> Column:
    """Struct (width, height) of "WxH" in any case, null unless both are whole numbers from 1 to 7680 and 4320."""
    parts = F.split(F.lower(F.trim(text)), "x")
    a, b = (F.trim(F.get(parts, F.lit(i))) for i in (0, 1))
    w, h = a.try_cast("int"), b.try_cast("int")
    good = (F.size(parts) == 2) & a.rlike(r"^[+-]?\d+$") & b.rlike(r"^[+-]?\d+$") & w.between(1, 7680) & h.between(1, 4320)
    return F.when(good, F.struct(w.alias("width"), h.alias("height")))


def parse_scale(args: Column) -> Column:
    """Struct (width, height) of a scale=W:H or scale=WxH argument, null without one."""
    w = F.regexp_extract(args, r"scale=(\d+)[x:](\d+)", 1)
    h = F.regexp_extract(args, r"scale=(\d+)[x:](\d+)", 2)
    return F.when(w != "", F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def is_video(path: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(config.video_extensions) + ")$")


def output_path(path: Column, input_base: Column, output_base: Column, ext: str) -> Column:
    """The path below output_base that mirrors path below input_base, with another extension. If input_base is the
    file itself, its name is put below output_base."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    below = F.when(path == input_base, name).otherwise(F.substr(path, F.length(input_base) + 2))
    stem = F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(output_base, F.lit("/"), stem, F.lit("." + ext))


def file_signature(path: Column, size: Column, mtime_text: Column) -> Column:
    """MD5 of path:size:mtime; the time as the text that its writer uses."""
    return F.md5(F.concat_ws(":", path, size.cast("string"), mtime_text))


#: Message patterns of a device that is out of memory.
OOM_PATTERNS = (
    "out of memory",
    "cuda out of memory",
    "cuda error: out of memory",
    "runtime error.*out of memory",
    "allocation failed",
    "cuda_error_out_of_memory",
)


def is_out_of_memory(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(OOM_PATTERNS)), F.lit(False))


def container_duration(probe: Column) -> Column:
    return F.get_json_object(probe, "$.format.duration").try_cast("double")


def stream_fps(probe: Column) -> Column:
    """The first video stream's r_frame_rate as a number: 25/1 where it has none, 25.0 where there is no such stream."""
    streams = F.from_json(probe, "streams array<struct<codec_type:string,r_frame_rate:string>>")["streams"]
    rate = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.coalesce(F.when(rate.isNotNull(), fraction(F.coalesce(rate["r_frame_rate"], F.lit("25/1")))), lit(25))


def chain(predicates: list[Column]) -> Column:
    """All predicates hold; a null counts as false. No predicate: true."""
    out = F.lit(True)
    for p in predicates:
        out = out & F.coalesce(p, F.lit(False))
    return out


def animation_frames(fps: Column, config: EngineConfig = DEFAULT) -> Column:
    """Frames of an animation at a rate, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), truncate(fps * lit(config.animation_sec)))


def day_stamp(at: Column) -> Column:
    """The day as eight digits, as log files carry it in their names."""
    return F.date_format(at, "yyyyMMdd")


def strip_set(text: Column, characters: str) -> Column:
    """text without the characters of a set at either end; the set isn't a suffix."""
    return F.btrim(text, F.lit(characters))


def half(x: Column) -> Column:
    """The nearest half-precision value (11 significant bits, ties to even, no subnormals below 2**-24), as a double.
    Beyond 65,504 it is infinite."""
    size = F.abs(x)
    power = F.greatest(F.lit(-14.0), F.floor(F.log2(size)))
    # log2 may be off by one just below a power of two
    power = F.when(F.pow(lit(2), power) > size, F.greatest(F.lit(-14.0), power - 1)).when(F.pow(lit(2), power + 1) <= size, power + 1).otherwise(power)
    step = F.pow(lit(2), power - 10)
    near = F.rint(x / step) * step
    return F.when(x == 0, x).when(F.abs(near) > 65504, F.signum(x) * lit(float("inf"))).otherwise(near)


def frame_count(valid_frames: Column) -> Column:
    """The number of frames in a map from scores to frames."""
    return F.aggregate(F.map_values(valid_frames), F.lit(0).cast("bigint"), lambda n, v: n + F.size(v))


def best_frames(valid_frames: Column) -> Column:
    """The frames of the highest score of a map keyed by scores as texts; null for an empty map."""
    keys = F.map_keys(valid_frames)
    top = F.array_max(F.transform(keys, lambda k: F.struct(k.cast("double").alias("s"), k.alias("k"))))["k"]
    return F.when(F.size(keys) > 0, F.element_at(valid_frames, top))
