"""python -m lumiframe local IN OUT --detector module:function, or: requests INBOX OUTBOX --detector module:function."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lumiframe.jobs import batch, requests


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumiframe")
    modes = parser.add_subparsers(dest="mode", required=True)
    for name, first, second in (("local", "input", "output"), ("requests", "inbox", "outbox")):
        own = modes.add_parser(name)
        own.add_argument(first)
        own.add_argument(second)
        own.add_argument("--detector", required=True, help="module:function, a factory of face detectors")
        own.add_argument("--decoder", default="y4m", help="a registered decoder or module:function")
    modes.choices["local"].add_argument("--encoder", help="module:function, a factory of image encoders")
    modes.choices["requests"].add_argument("--watch", action="store_true", help="go on after all requests are answered")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("lumiframe").getOrCreate()
    detector = batch.load(given.detector)
    if given.mode == "local":
        done = batch.run(spark, given.input, given.output, detector, batch.load(given.encoder) if given.encoder else None, given.decoder)
        good, bad = done.filter("success").count(), done.filter("not success").count()
        print(f"{good} processed, {bad} failed")
        return 1 if bad else 0
    requests.serve(spark, given.inbox, given.outbox, f"{given.outbox}/_checkpoint", detector, given.decoder, once=not given.watch).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
