"""A thin command line: ingest a folder into a store, ask it questions, or run a named query."""

from __future__ import annotations

import argparse

from .plans.engine import Engine
from .plans.queries import QUERIES
from .session import session
from .sources import files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioflux", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read folders into a store")
    ingest.add_argument("store")
    ingest.add_argument("folders", nargs="+")
    ingest.add_argument("--pattern", default="*.txt")
    ingest.add_argument("--parser", default="text", choices=sorted(files.PARSERS))
    ingest.add_argument("--replace", action="store_true")
    ask = commands.add_parser("ask", help="answer questions from a store")
    ask.add_argument("store")
    ask.add_argument("questions", nargs="+")
    ask.add_argument("-k", type=int)
    ask.add_argument("--rerank", action="store_true")
    run = commands.add_parser("query", help="run a named query on a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("folder")
    args = parser.parse_args(argv)

    spark = session()
    if args.command == "ingest":
        raw = files.parse(files.scan(spark, *args.folders, pattern=args.pattern), args.parser)
        Engine(spark, args.store).ingest(raw, args.replace).show()
    elif args.command == "ask":
        asked = spark.createDataFrame(list(enumerate(args.questions)), "question_id long, question string")
        for row in Engine(spark, args.store).answer(asked, args.k, args.rerank).orderBy("question_id").toLocalIterator():
            print(row["answer"] or f"({row['status']})")
    else:
        QUERIES[args.name](spark, args.folder).show(truncate=100)


if __name__ == "__main__":
    main()
