"""Command line: learn, parse, suggest, dict, tokens and infer."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .sources import dictionary, sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglathe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="learn the structure of text files and parse them")
    learn.add_argument("input")
    learn.add_argument("out")
    learn.add_argument("--emit", choices=("true", "false"), default="true", help="write a columnar copy too")
    again = sub.add_parser("parse", help="parse text files with a learned parser")
    again.add_argument("learned")
    again.add_argument("input")
    again.add_argument("out")
    s = sub.add_parser("suggest", help="suggest field names from a dictionary")
    s.add_argument("dictionary")
    s.add_argument("records")
    s.add_argument("-k", type=int, default=1)
    s.add_argument("-d", action="store_true", help="show schemas too")
    s.add_argument("-f", metavar="OUT", help="write the records with the first suggestion's names as Parquet")
    d = sub.add_parser("dict", help="show a dictionary or add to it")
    d.add_argument("dictionary")
    d.add_argument("-d", action="store_true", help="show its entries")
    d.add_argument("-a", metavar="RECORDS", help="records to add; needs -m")
    d.add_argument("-m", metavar="MESSAGE", help="what they are")
    for name, what in (("tokens", "count lines and tokens"), ("infer", "show the learned structure")):
        x = sub.add_parser(name, help=what)
        x.add_argument("input")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loglathe").getOrCreate()
    if args.command == "learn":
        if sinks.exists(spark, args.out):
            print(f"{args.out} is there already", file=sys.stderr)
            return 1
        print(json.dumps(api.learn(spark, args.input, args.out, args.emit == "true")))
    elif args.command == "parse":
        learned = api.Learned(sinks.read_parser(spark, args.learned), False, 0)
        sinks.write_records(learned.records(text.read_lines(spark, args.input)), args.out)
    elif args.command == "suggest":
        df = text.read_records(spark, args.records)
        found = api.suggest(spark, args.dictionary, df, args.k).persist()
        for r in dictionary.report(found).collect():  # k entries
            print(f"{r['distance']:g}\t{r['info']}\t{r['section']}\t{r['source']}\t{r['target']}")
        rows = found.orderBy("distance", "schema").collect()
        if args.d:
            for r in rows:
                print(r["info"], r["schema"])
        if args.f and rows:
            dictionary.renamed(df, rows[0]["ops"]).write.mode("errorifexists").parquet(args.f)
    elif args.command == "dict":
        if bool(args.a) != bool(args.m):
            print("-a and -m go together", file=sys.stderr)
            return 2
        if args.a:
            print(dictionary.add(spark, args.dictionary, text.read_records(spark, args.a), args.m))
        if args.d:
            for r in dictionary.contents(spark, args.dictionary).orderBy("info", "entry_id").toLocalIterator():
                print(f"{r['entry_id']}\t{r['info']}\t{r['schema']}")
    else:
        lines = text.read_lines(spark, args.input)
        print(json.dumps(api.tokenize_report(lines) if args.command == "tokens" else api.infer_report(lines, order="line_no")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
