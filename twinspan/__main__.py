"""python -m twinspan -p project.json: run a project file."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from twinspan.functions import load_plugins
from twinspan.plans.options import Options, read_options
from twinspan.plans.runner import execute_project
from twinspan.plans.spec import read_project


def main(argv: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="twinspan", description="De-duplicate one dataset or link two, as a project file says.")
    parser.add_argument("-p", "--project", required=True, help="path of the project's JSON file")
    parser.add_argument("-c", "--config", help="ini file with options in its section [twinspan]")
    parser.add_argument("--format", help="format of the results: csv, parquet or any other that Spark writes")
    parser.add_argument("--order", choices=["input", "index", "entity"], help="order of de-duplicated records")
    parser.add_argument("--synonyms", help='table of SYNONYMS where the project names none: "builtin" or the path of a CSV file')
    args = parser.parse_args(argv)
    options = read_options(args.config) if args.config else Options()
    options = replace(options, **{k: v for k, v in (("format", args.format), ("order", args.order), ("synonyms", args.synonyms)) if v})
    load_plugins()
    spark = SparkSession.builder.appName("twinspan").getOrCreate()
    path = execute_project(spark, read_project(args.project), options)
    print(path)
    return path


if __name__ == "__main__":
    main()
