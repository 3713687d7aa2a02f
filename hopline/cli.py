"""Command line: ``python -m hopline.cli <verb> …``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hopline import config
from hopline.errors import HoplineError
from hopline.plans import migration
from hopline.plans.lint import lint
from hopline.plans.schema import parse_schema
from hopline.session import GraphSession

FORMATS = ("table", "kv", "csv", "jsonl", "json")


def show(df: DataFrame, form: str, out=None, width: int = 0) -> None:
    """Print a result; rows are streamed one partition at a time.  ``width`` cuts the cells of a table."""
    out = out or sys.stdout
    names = df.columns
    if form in ("json", "jsonl"):
        rows = (json.loads(x) for x in df.toJSON().toLocalIterator())
        if form == "jsonl":
            for r in rows:
                print(json.dumps(r, ensure_ascii=False), file=out)
        else:
            print(json.dumps(list(rows), ensure_ascii=False, indent=1), file=out)
        return
    if form == "csv":
        import csv

        writer = csv.writer(out)
        writer.writerow(names)
        writer.writerows(df.toLocalIterator())
        return
    rows = [[("" if v is None else str(v)) for v in r] for r in df.toLocalIterator()]
    if form == "kv":
        for r in rows:
            print(*(f"{n}: {v}" for n, v in zip(names, r)), "", sep="\n", file=out)
        return
    if width:
        flat = [[" ".join(v.split()) for v in r] for r in rows]
        rows = [[v if len(v) <= width else v[: width - 1] + "…" for v in r] for r in flat]
    widths = [max(map(len, [n, *(r[i] for r in rows)])) for i, n in enumerate(names)]
    for r in [names, ["-" * w for w in widths], *rows]:
        print(" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip(), file=out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hopline")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **flags) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        return v

    v = verb("version")
    v.add_argument("--graph")
    verb("init", "graph", "schema")
    v = verb("describe", "graph")
    v.add_argument("--type")
    v.add_argument("--format", choices=("json", "table"), default="json")
    v.add_argument("--verbose", action="store_true", help="with files and bytes")
    v = verb("load", "graph", "data")
    v.add_argument("--mode", choices=("overwrite", "append", "merge"))
    v.add_argument("--media-base", help="folder of relative media files")
    v.add_argument("--chunk", type=int, default=0, help="characters of a text that are embedded at once; 0 for all")
    v.add_argument("--overlap", type=int, default=128)
    v = verb("run", "graph", "queries")
    v.add_argument("--name")
    v.add_argument("--param", action="append", default=[], metavar="NAME=JSON")
    v.add_argument("--format", choices=FORMATS, default="table")
    v = verb("alias", "alias")
    v.add_argument("words", nargs="*")
    v.add_argument("--config", default=config.NAME)
    v.add_argument("--param", action="append", default=[], metavar="NAME=JSON")
    v.add_argument("--format", choices=FORMATS)
    v = verb("delete", "graph", "type", "where")
    v = verb("export", "graph", "out")
    v.add_argument("--ids", action="store_true")
    v.add_argument("--no-vectors", action="store_true")
    v.add_argument("--format", choices=("jsonl", "json"), default="jsonl")
    v = verb("changes", "graph")
    v.add_argument("--after", "--since", type=int, default=0, help="versions above this one")
    v.add_argument("--from", dest="first", type=int, help="versions from this one on")
    v.add_argument("--upto", "--to", type=int)
    v.add_argument("--no-vectors", action="store_true")
    v.add_argument("--format", choices=FORMATS, default="jsonl")
    v = verb("embed", "graph")
    v.add_argument("--type")
    v.add_argument("--property")
    v.add_argument("--all", action="store_true")
    v.add_argument("--limit", type=int)
    v.add_argument("--dry-run", action="store_true")
    v = verb("compact", "graph")
    v.add_argument("--rows-per-file", type=int, default=1_048_576)
    v = verb("cleanup", "graph")
    v.add_argument("--keep", type=int, default=128)
    v.add_argument("--tables", type=int, help="states of each table to keep")
    v = verb("doctor", "graph")
    v.add_argument("--schema", help="compare with this schema too")
    v.add_argument("--verbose", action="store_true", help="with files and bytes")
    v = verb("cdc-materialize", "graph")
    v.add_argument("--least", type=int, default=1)
    v.add_argument("--force", action="store_true")
    verb("storage", "graph")
    v = verb("migrate", "graph", "schema")
    v.add_argument("--confirm", action="store_true")
    v.add_argument("--dry-run", action="store_true")
    v = verb("schema-diff", "old", "new")
    v.add_argument("--format", choices=("jsonl", "table"), default="jsonl")
    for name in ("lint", "check"):
        verb(name, "schema", "queries")
    return p


def given(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        name, _, value = pair.partition("=")
        try:
            out[name.lstrip("$")] = json.loads(value)
        except ValueError:
            out[name.lstrip("$")] = value
    return out


def describe(g: GraphSession, kind: str | None, form: str, verbose: bool) -> None:
    info = g.describe()
    for part in ("nodes", "edges"):
        info[part] = [t for t in info[part] if kind in (None, t["name"])]
    if kind is not None and not info["nodes"] and not info["edges"]:
        raise HoplineError(f"no type {kind}")
    if verbose:
        info["storage"] = [t for t in g.storage() if kind in (None, t["type"])]
    if form == "json":
        print(json.dumps(info, indent=1))
        return
    print(f"version {info['version']}")
    for part in ("nodes", "edges"):
        for t in info[part]:
            print(f"{part[:-1]} {t['name']}: {t['rows']} rows")
    for t in info.get("storage", ()):
        print(f"{t['type']}: {t['files']} files, {t['bytes']} bytes")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)

    def text(path: str) -> str:
        return Path(path).read_text()

    if a.verb == "version" and not a.graph:
        print("hopline 0.1")
        return 0
    try:
        if a.verb == "schema-diff":
            for s in migration.diff(parse_schema(text(a.old)), parse_schema(text(a.new))):
                print(json.dumps(asdict(s)) if a.format == "jsonl" else f"{s.safety:8} {s.kind:20} {s.type}{'.' + s.prop if s.prop else ''} {s.detail}".rstrip())
            return 0
        if a.verb in ("lint", "check"):
            found = lint(parse_schema(text(a.schema)), text(a.queries))
            for f in found:
                print(json.dumps(asdict(f)))
            return int(any(f.level == "error" for f in found))
        spark = spark or SparkSession.builder.appName("hopline").getOrCreate()
        if a.verb == "init":
            GraphSession.init(spark, a.graph, text(a.schema))
            return 0
        if a.verb == "alias":
            project = config.load(a.config)
            if a.alias not in project.aliases:
                raise HoplineError(f"no alias {a.alias}; there are {', '.join(project.aliases) or 'none'}")
            if project.graph is None:
                raise HoplineError("the config names no graph: db.default_path")
            alias = project.aliases[a.alias]
            values = {**{k: given([f"{k}={v}"])[k] for k, v in project.params(alias, a.words).items()}, **given(a.param)}
            g = GraphSession.open(spark, str(project.folder / project.graph))
            query = g.graph().find(project.find(alias.query).read_text(), alias.name)
            strings = {p.name for p in query.params if p.type == "String"}  # a word that looks like a number stays text
            values = {k: a.words[alias.args.index(k)] if k in strings and k in alias.args[: len(a.words)] and k not in given(a.param) else v for k, v in values.items()}
            show(g.run(query, values), a.format or alias.format or project.format, width=project.width)
            return 0
        g = GraphSession.open(spark, a.graph)
        if a.verb == "version":
            print(f"hopline 0.1, graph version {g.version}")
        elif a.verb == "describe":
            describe(g, a.type, a.format, a.verbose)
        elif a.verb == "load":
            print(json.dumps(g.load(a.data, a.mode, a.media_base, a.chunk, a.overlap)))
        elif a.verb == "run":
            show(g.run(text(a.queries), given(a.param), a.name), a.format)
        elif a.verb == "delete":
            show(g.run(f"query q() {{ delete {a.type} where {a.where} }}"), "json")
        elif a.verb == "export":
            lines = g.export(a.ids, not a.no_vectors)
            if a.format == "json":  # one array, in one file
                with open(a.out, "w") as out:
                    for at, r in enumerate(lines.toLocalIterator()):
                        out.write(("[" if at == 0 else ",\n") + r[0])
                    out.write("]\n")
            else:
                lines.write.text(a.out)
        elif a.verb == "changes":
            show(g.changes(a.after if a.first is None else a.first - 1, a.upto, not a.no_vectors), a.format)
        elif a.verb == "embed":
            print(g.embed(a.type, a.property, not a.all, a.limit, a.dry_run))
        elif a.verb == "compact":
            print(json.dumps(g.compact(a.rows_per_file)))
        elif a.verb == "cleanup":
            print(g.cleanup(a.keep, a.tables))
        elif a.verb == "doctor":
            found = g.doctor()
            show(found, "table")
            steps = migration.diff(g.catalog, parse_schema(text(a.schema))) if a.schema else []
            for s in steps:
                print(f"schema: {s.kind} {s.type}{'.' + s.prop if s.prop else ''}")
            if a.verbose:
                print(json.dumps(g.storage(), indent=1))
            return int(found.limit(1).count() > 0 or bool(steps))
        elif a.verb == "cdc-materialize":
            print(g.materialize_changes(0 if a.force else a.least))
        elif a.verb == "storage":
            print(json.dumps(g.storage(), indent=1))
        elif a.verb == "migrate":
            for s in g.migrate(text(a.schema), a.confirm, a.dry_run):
                print(json.dumps(asdict(s)))
        return 0
    except HoplineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
