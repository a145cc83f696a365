"""Command line: prepare a raw file, archive a delimited file, restore it.

    python -m colforest.cli compress --input data.csv --output archive
    spark-submit --py-files colforest.zip colforest/cli.py restore --input archive --output restored
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession


class Timer:
    """Wall seconds of each stage, as they are."""

    def __init__(self) -> None:
        self.began, self.stages = time.perf_counter(), []

    def __call__(self, stage: str) -> None:
        now = time.perf_counter()
        self.stages.append((stage, now - self.began))
        self.began = now


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colforest", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("prepare", "compress", "restore"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        if name == "prepare":
            c.add_argument("--has-header", action="store_true")
        if name == "compress":
            c.add_argument("--delimiter", default=",")
            c.add_argument("--rare-threshold", type=int, default=1)
            c.add_argument("--mi-mode", choices=("exact", "hashed", "auto"), default="exact")
            c.add_argument("--mi-buckets", type=int, default=4096)
            c.add_argument("--mi-sample", type=int)
            c.add_argument("--mi-seed", type=int, default=0)
            c.add_argument("--two-phase", action="store_true")
            c.add_argument("--stripe", type=int, default=131_072)
            c.add_argument("--use-model", dest="coder", action="store_const", const="model", default="histogram")
            c.add_argument("--use-autoregressive", dest="coder", action="store_const", const="autoregressive")
            c.add_argument("--use-neural", dest="coder", action="store_const", const="neural")
            c.add_argument("--use-line-graph", action="store_true")
            c.add_argument("--single-line", action="store_true", help="no line breaks in cells: a file is read by many tasks")
            c.add_argument("--profile", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from colforest.operators import segments
    from colforest.sources import delimited

    spark = SparkSession.builder.appName(f"colforest {a.command}").getOrCreate()
    if a.command == "prepare":
        delimited.prepare_file(spark, a.input, a.output, a.has_header)
    elif a.command == "compress":
        timer = Timer()
        rows = delimited.scan(spark, a.input, a.delimiter, multi_line=False if a.single_line else None)
        learn = {"mode": a.mi_mode, "buckets": a.mi_buckets, "sample": a.mi_sample, "seed": a.mi_seed, "two_phase": a.two_phase}
        segments.write_archive(rows, a.output, key="row_id", forest="chain" if a.use_line_graph else None, rare=a.rare_threshold, stripe=a.stripe, learn=learn, coder=a.coder, timer=timer)
        facts = spark.createDataFrame([("delimiter", json.dumps(delimited.delimiter_of(a.delimiter))), ("ending", json.dumps(delimited.line_ending(spark, a.input)))], "key string, value string")
        facts.coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{a.output}/options")
        if a.profile:
            for stage, seconds in timer.stages:
                print(f"{stage}: {seconds:.2f} s")
    else:
        options = {r.key: json.loads(r.value) for r in spark.read.parquet(f"{a.input}/options").collect()}
        delimited.write_text(segments.read_archive(spark, a.input), a.output, "row_id", options.get("delimiter", ","), options.get("ending", "\n"))


if __name__ == "__main__":
    main()
