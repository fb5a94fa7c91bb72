"""Command line: run, rehydrate, list, show, edit, add-entry.

    python -m velario.cli run PROJECT FILES... --store DIR --out DIR
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario import interactive
from velario.operators import codenames
from velario.operators.store import MappingStore, mapping_json, upsert
from velario.plans import pseudonymise
from velario.sources import ooxml


def _write(rows: DataFrame, out: str) -> None:
    Path(out).mkdir(parents=True, exist_ok=True)
    for r in rows.select("out_name", "content", "error").toLocalIterator():
        Path(out, r["out_name"]).write_bytes(bytes(r["content"]) if r["content"] is not None else r["error"].encode())
        print(Path(out, r["out_name"]))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Analyse, ask or unify where told to, save the mapping, write the files and report what is left.

    The review table is kept as the project's session until the files are written; ``--resume``
    takes it up again instead of a new analysis.
    """
    store = MappingStore(spark, args.store)
    files = ooxml.read_files(spark, args.files)
    review = store.load_session(args.project) if args.resume else None
    if review is None:
        found = pseudonymise.analyse(spark, args.files, store, args.project, args.type, args.mode, args.main_company)
        store.save_session(args.project, found.review)
        review = store.load_session(args.project)
    review.select("type", "canonical", "total_count", "codename", "context").orderBy("row_id").show(50, 60)
    if args.unify:
        review = codenames.unify(review, codenames.merge_suggestions(review))
    if args.ask:
        review = interactive.resolve(review, store.load(args.project), args.project, ask_all=args.ask_all)
    if args.dry_run:
        return 0
    new = codenames.review_to_mapping(review, args.project)
    store.save(args.project, upsert(store.load(args.project).drop("updated_at"), new))
    done, report = pseudonymise.apply_mapping(files, store, args.project)
    _write(done, args.out)
    store.clear_session(args.project)
    totals = report.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("surviving")).alias("leaks"), F.count_if(~F.col("verifiable")).alias("unverifiable")).first()
    store.log(args.project, "run", files=totals["files"], entities=store.load(args.project).count(), leaks=totals["leaks"] or 0, unverifiable=totals["unverifiable"])
    report.show(50, 60)
    return int(bool(totals["leaks"] or totals["unverifiable"]))


def rehydrate(spark: SparkSession, args: argparse.Namespace) -> int:
    done, _ = pseudonymise.apply_mapping(ooxml.read_files(spark, args.files), MappingStore(spark, args.store), args.project, inverse=True)
    _write(done, args.out)
    return 0


def list_projects(spark: SparkSession, args: argparse.Namespace) -> int:
    store = MappingStore(spark, args.store)
    for p in store.projects():
        print(p, store.load(p).count())
    return 0


def show(spark: SparkSession, args: argparse.Namespace) -> int:
    MappingStore(spark, args.store).load(args.project).orderBy("kind_ord", "entry_ord").select("kind", "original", "codename").show(1000, 80)
    return 0


def edit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Open a project's mapping as JSON in an editor; what is saved there becomes its next version."""
    store = MappingStore(spark, args.store)
    rows = mapping_json(store.load(args.project)).collect()  # one project's JSON, as a person edits it
    entries = json.loads(rows[0]["entries"]) if rows else {}
    nested = {kind: json.loads(inner) if isinstance(inner, str) else inner for kind, inner in entries.items()}
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, f"{args.project}.json")
        path.write_text(json.dumps({"project": args.project, "entries": nested}, ensure_ascii=False, indent=2))
        before = path.read_text()
        subprocess.run([*shlex.split(args.editor or os.environ.get("EDITOR", "vi")), str(path)], check=True)
        after = path.read_text()
    if after == before:
        return 0
    given = json.loads(after)["entries"]
    entries = [(args.project, kind, i, original, j, code) for i, (kind, own) in enumerate(given.items()) for j, (original, code) in enumerate(own.items())]
    store.save(args.project, spark.createDataFrame(entries, codenames.MAPPING))
    return 0


def add_entry(spark: SparkSession, args: argparse.Namespace) -> int:
    store = MappingStore(spark, args.store)
    row = [(args.project, args.kind, 0, args.original, 0, args.codename)]
    store.save(args.project, upsert(store.load(args.project).drop("updated_at"), spark.createDataFrame(row, codenames.MAPPING)))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="velario")
    verbs = parser.add_subparsers(required=True)

    def verb(name: str, f, *names: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.set_defaults(f=f)
        for n in names:
            p.add_argument(n, nargs="+" if n == "files" else None)
        p.add_argument("--store", default="velario-store")
        return p

    p = verb("run", run, "project", "files")
    p.add_argument("--out", default="out")
    p.add_argument("--type", default="auto", choices=pseudonymise.FORCED)
    p.add_argument("--mode", default="account_full", choices=codenames.MODES)
    p.add_argument("--main-company", default="")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--resume", action="store_true", help="go on with the review table that a run left unfinished")
    p.add_argument("--unify", action="store_true", help="merge all suggested duplicates")
    p.add_argument("--ask", action="store_true", help="ask for the codename of each new company and person")
    p.add_argument("--ask-all", action="store_true", help="with --ask, ask for identifiers too")
    verb("rehydrate", rehydrate, "project", "files").add_argument("--out", default="out")
    verb("list", list_projects)
    verb("show", show, "project")
    verb("edit", edit, "project").add_argument("--editor", default="")
    verb("add-entry", add_entry, "project", "kind", "original", "codename")
    args = parser.parse_args(argv)
    return args.f(SparkSession.builder.appName("velario").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
