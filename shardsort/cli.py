"""Command line: python -m shardsort.cli -I DIR... -O DIR --partitions N [--binary]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shardsort.plans.job import sort_lines, sort_records


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shardsort", description="Sort the lines or records of directories by their first ten characters or bytes.")
    parser.add_argument("-I", dest="inputs", nargs="+", required=True, metavar="DIR", help="input directories")
    parser.add_argument("-O", dest="output", required=True, metavar="DIR", help="output directory; replaced")
    parser.add_argument("--partitions", type=int, default=1, metavar="N", help="sorted output ranges")
    parser.add_argument("--skip-missing", action="store_true", help="pass over absent input directories")
    parser.add_argument("--binary", action="store_true", help="records of 100 bytes instead of lines; not a byte is changed")
    parser.add_argument("--sampling", choices=("weighted", "equal"), default="weighted", help="draw keys by size, or as many from every file")
    parser.add_argument("--seed", type=int, default=0, help="of the drawn keys")
    parser.add_argument("--budget", type=int, metavar="BYTES", help="of drawn records; at least one")
    args = parser.parse_args(argv)
    if args.partitions < 1:
        parser.error("--partitions must be at least 1")
    if args.budget is not None and args.budget < 1:
        parser.error("--budget must be at least 1")
    spark = SparkSession.builder.appName("shardsort").getOrCreate()
    sort = sort_records if args.binary else sort_lines
    done = sort(spark, args.inputs, args.output, args.partitions, "skip" if args.skip_missing else "error", args.sampling, args.seed, args.budget)
    print(f"read {done.input_bytes} bytes of {done.files} files; wrote {done.rows} rows, {done.bytes} bytes, {done.partitions} ranges")
    for number, size in done.sizes.items():
        print(f"range {number}: {size} bytes")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
