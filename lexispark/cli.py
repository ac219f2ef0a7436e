"""Command line: load, ingest and aggregate into a store; lookup from it."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lexispark.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexispark", description=__doc__)
    out.add_argument("-d", "--db", default="lexicon-store", help="the store's folder")
    sub = out.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="load morph records (JSON lines)")
    load.add_argument("-l", "--lang", help="language code; by default from the file's name")
    load.add_argument("-n", "--no-delete", action="store_true", help="keep what the language has")
    load.add_argument("file")
    ingest = sub.add_parser("ingest", help="ingest a lexicon: a file or a folder of them")
    ingest.add_argument("-n", "--no-delete", action="store_true", help="keep what the lexicon has")
    ingest.add_argument("-r", "--number-repeats", action="store_true", help="tell entries of one key apart by a number behind it")
    ingest.add_argument("lexicon_id")
    ingest.add_argument("path")
    aggregate = sub.add_parser("aggregate", help="add the statistics of a corpus folder")
    aggregate.add_argument("dir")
    look = sub.add_parser("lookup", help="look a word up")
    look.add_argument("word")
    look.add_argument("-l", "--lang", default="grc")
    look.add_argument("--document")
    look.add_argument("--prior")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
    engine = Engine(spark, args.db)
    if args.command == "load":
        out = json.dumps(engine.load_morph(args.file, args.lang, not args.no_delete))
    elif args.command == "ingest":
        out = json.dumps(engine.ingest_lexicon(args.lexicon_id, args.path, not args.no_delete, args.number_repeats))
    elif args.command == "aggregate":
        out = json.dumps(engine.aggregate(args.dir))
    else:
        asked = spark.createDataFrame([(1, args.word, args.lang, args.document, args.prior)], "request_id long, word string, language_code string, document_id string, prior_word string")
        out = engine.lookup(asked).drop("request_id").toJSON().first()
    print(out)
    return out


if __name__ == "__main__":
    main()
