"""The engine from a command line: python -m quern --store FOLDER COMMAND ...

Results go to standard output, as text or as a JSON object a line."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession

from quern.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description="Index documents, search them, learn from their use.")
    top.add_argument("--store", required=True, help="the folder that holds the engine's tables")
    top.add_argument("--format", choices=["text", "json"], default="text")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *names: str, under=commands, **options):
        p = under.add_parser(name, help=about)
        for x in names:
            p.add_argument(x)
        for x, default in options.items():
            flag = f"--{x.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
            else:
                p.add_argument(flag, default=default, type=str if default is None else type(default))
        return p

    command("index", "read documents below a folder", "folder", recursive=True, dedup=False)
    command("query", "find documents for a task", "words", top=5, method="rrf", threshold=0.0, budget=0, session=None, feedback=True)
    command("adaptive", "as many results as the scores allow", "words", most=10)
    session = commands.add_parser("session", help="sessions of use").add_subparsers(dest="action", required=True)
    for action, options in {"start": {}, "end": {}, "context": {}}.items():
        command(action, f"{action} of a session", under=session, id=None, **options)
    command("use", "note that a document was used", "name", under=session, id=None, query="", success=None)
    command("optimize", "rewrite documents' metadata", "folder", dry_run=True)
    feedback = commands.add_parser("feedback", help="whether documents helped").add_subparsers(dest="action", required=True)
    command("record", "record one", "query", "name", under=feedback, success=True, rating=0)
    command("stats", "success rates", under=feedback)
    command("list", "the catalogue, most used first", category=None)
    command("stats", "documents and tokens by category")
    command("insights", "what was asked and used", days=30)
    command("neighbors", "related documents", "name")
    command("dedup", "merge documents of nearly one name")
    command("recipe", "a recipe's documents", "name", should=True)
    command("guide", "how an agent works with the tools")
    return top


def run(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> list[DataFrame] | str:
    """What a command gives: tables, or a text."""
    e, c = Engine(spark, args.store), args.command
    ask = lambda: spark.createDataFrame([(1, args.words)], "qid int, query string")
    if c == "index":
        return f"{e.index(args.folder, recursive=args.recursive, dedup=args.dedup)} documents"
    if c == "query":
        options = {"session": args.session} if args.session else {}
        found = e.query(ask(), args.top, args.method, args.threshold, use_feedback=args.feedback, budget=args.budget or None, log_at=None if args.budget else now, **options)
        return [found if args.budget or args.format == "json" else e.shown(found).orderBy("rank").select("line")]
    if c == "adaptive":
        return [e.query_adaptive(ask(), most=args.most)]
    if c == "session":
        if args.action == "context":
            return [e.session_context(args.id)]
        if not args.id:
            raise SystemExit("--id is missing")
        if args.action == "use":
            yes = None if args.success is None else args.success.lower() in ("true", "1", "yes")
            e.session_use(args.id, args.name, now, args.query, yes)
        else:
            (e.session_start if args.action == "start" else e.session_end)(args.id, now)
        return f"{args.action}: {args.id}"
    if c == "optimize":
        return [e.optimize_folder(args.folder, apply=not args.dry_run).select("path", "changed", "description", "error")]
    if c == "feedback":
        if args.action == "stats":
            return list(e.feedback_stats())
        e.feedback(args.query, args.name, args.success, now, rating=args.rating or None)
        return f"recorded: {args.name}"
    if c == "list":
        return [e.list(args.category).select("name", "category", "use_count", "description")]
    if c == "insights":
        return list(e.insights(now + datetime.timedelta(seconds=1), args.days).values())
    if c == "dedup":
        return list(e.dedup())
    if c == "recipe":
        return [e.recipe(args.name, args.should)]
    if c == "neighbors":
        return [e.neighbors(args.name)]
    return e.guide() if c == "guide" else [e.stats()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = run(own, args, datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        for table in [found] if isinstance(found, str) else found:
            if isinstance(table, str):
                print(table)
                continue
            for row in (r.json for r in table.selectExpr("to_json(struct(*)) as json").toLocalIterator()) if args.format == "json" else table.toLocalIterator():
                print(row if args.format == "json" else "\t".join("" if v is None else str(v) for v in row))
    except SystemExit:
        raise
    except Exception as e:  # told, not shown as a trace
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        if spark is None:
            own.stop()
    return 0
