"""Column functions on the argument lists of encoder commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is added for seekable output, and for a source longer than half a minute.
KEYFRAME_ARGS = ("-g", "30", "-keyint_min", "30", "-sc_threshold", "0")
SKIP_ARGS = ("-ss", "30")


def _after(args: Column, *flags: str) -> Column:
    """The arguments that follow one of the flags, in order."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(args) - 2, F.lit(0))), lambda i: F.get(args, i).isin(*flags) & (i + 1 < F.size(args)))
    return F.transform(at, lambda i: F.get(args, i + 1))


def _resolutions(args: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(args) - 2, F.lit(0)))

    def one(i: Column) -> Column:
        flag, value = F.get(args, i), F.get(args, i + 1)
        scale = F.regexp_extract(value, r"scale=(\d+)[x:](\d+)", 1), F.regexp_extract(value, r"scale=(\d+)[x:](\d+)", 2)
        return F.when((flag == "-vf") & (scale[0] != ""), F.concat(scale[0], F.lit("x"), scale[1])).when((flag == "-s") & value.rlike(r"^\d+x\d+$"), value)

    return F.filter(F.transform(at, one), lambda r: r.isNotNull())


def command(args: Column) -> Column:
    """Struct (input, output, animated, x264, webp, resolution) of an argument list: the last input, the last argument, whether
    a length is given, the encoders asked for (a .webp output asks for webp), the last resolution. Null without arguments."""
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    encoders, output = _after(args, "-vcodec", "-c:v"), F.element_at(args, -1)
    found = F.struct(
        last(_after(args, "-i")).alias("input"),
        output.alias("output"),
        F.array_contains(args, "-t").alias("animated"),
        F.array_contains(encoders, "libx264").alias("x264"),
        (F.array_contains(encoders, "libwebp") | F.lower(output).endswith(".webp")).alias("webp"),
        last(_resolutions(args)).alias("resolution"),
    )
    return F.when(F.size(args) > 0, found)


def rewritten(args: Column, duration: Column) -> Column:
    """The arguments for the real encoder: after the last input, key-frame settings for x264 and, for webp from a source
    of more than 30 whole seconds, a skip. Without an input they come first."""
    c = command(args)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(args) - 1, F.lit(0))), lambda i: F.get(args, i) == "-i")
    end = F.when(F.size(places) > 0, F.element_at(places, -1) + 2).otherwise(0)
    none = F.array().cast("array<string>")
    key = F.when(c["x264"], F.array(*[F.lit(x) for x in KEYFRAME_ARGS])).otherwise(none)
    skip = F.when(c["webp"] & (F.floor(duration) > 30), F.array(*[F.lit(x) for x in SKIP_ARGS])).otherwise(none)
    return F.when(F.size(args) > 0, F.concat(F.slice(args, F.lit(1), end), key, skip, F.slice(args, end + 1, F.size(args))))
