"""The command line: index, query, pack, prompt, stats and clear over a folder."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from corvane.config import Config
from corvane.functions import text as tx
from corvane.operators import packing
from corvane.plans.engine import SHOWN_CHANGES, Engine
from corvane.plans.ports import http_embedder
from corvane.sources import files

#: Of a result's text so many bytes are shown.
SHOWN_BYTES = 500


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description="Search a folder of texts and pack what is found for a language model.")
    top.add_argument("-d", "--dir", default=".", help="the folder (default: this one)")
    top.add_argument("--config", help="settings file (default: rag.yaml in the folder)")
    top.add_argument("--master", help="Spark master (default: that of the environment, else local[*])")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("index", help="index the folder, or bring its index up to date")
    query = sub.add_parser("query", help="search")
    query.add_argument("-q", "--query", required=True)
    query.add_argument("-k", "--top-k", type=int, default=0, help="results (default from the settings)")
    query.add_argument("-c", "--context", type=int, default=0, help="lines before and after")
    query.add_argument("--json", action="store_true")
    query.add_argument("--no-mmr", action="store_true", help="no diversity, no threshold")
    query.add_argument("--semantic", action="store_true", help="vectors only")
    query.add_argument("--no-auto-index", action="store_true", help="fail without an index, do not ask for changed files")
    pack = sub.add_parser("pack", help="pack passages into a token budget")
    pack.add_argument("-q", "--query", required=True)
    pack.add_argument("-b", "--budget", type=int, default=0)
    pack.add_argument("-o", "--output", help="file (default: standard output)")
    pack.add_argument("-k", "--top-k", type=int, default=0, help="candidates (default from the settings)")
    prompt = sub.add_parser("runprompt", help="a prompt from a packed context")
    kind = prompt.add_mutually_exclusive_group(required=True)
    kind.add_argument("--runtime", dest="template", action="store_const", const="runtime", help="to answer the question")
    kind.add_argument("--builder", dest="template", action="store_const", const="builder", help="to prepare the context")
    prompt.add_argument("--ctx", required=True, help="file of a packed context")
    prompt.add_argument("-q", "--query", help="another question")
    sub.add_parser("stats", help="sizes of the index")
    sub.add_parser("clear", help="empty the index")
    return top


def ask(question: str) -> bool:
    """Yes or no; yes where nobody can be asked."""
    if not sys.stdin.isatty():
        print(f"{question} [auto: yes]", file=sys.stderr)
        return True
    return input(f"{question} [Y/n]: ").strip().lower() not in ("n", "no")


def _session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("corvane").config("spark.ui.showConsoleProgress", "false")
    active = SparkSession.getActiveSession()
    if active is None and master:
        builder = builder.master(master)
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """Run one command; 0 if it went well."""
    args = parser().parse_args(argv)
    folder = Path(args.dir).resolve()
    config = Config.load(args.config) if args.config else Config.find(folder)
    spark = _session(args.master)
    embedder = http_embedder(config.embedding) if config.embedding.enabled else None
    engine = Engine(spark, f"file://{folder}/.rag/index", config, embedder)
    try:
        return _COMMANDS[args.command](args, engine, folder)
    except (LookupError, OSError, ValueError) as failed:
        print(f"Error: {failed}", file=sys.stderr)
        return 1


def _documents(engine: Engine, folder: Path):
    i = engine.config.index
    return files.read_documents(engine.spark, str(folder), list(i.includes), [*i.excludes, "**/.rag/**"])


def _index(args, engine: Engine, folder: Path) -> int:
    start = time.monotonic()
    done = engine.index(_documents(engine, folder))
    took = engine.spark.range(1).select(tx.format_duration(F.lit(time.monotonic() - start))).first()[0]
    print(f"Indexed {done.indexed}, skipped {done.skipped}, deleted {done.deleted}; {done.chunks} passages; {took}")
    return 0


def _query(args, engine: Engine, folder: Path) -> int:
    changed = engine.ensure(_documents(engine, folder), not args.no_auto_index, ask)
    for path in changed:
        print(f"  - {path}", file=sys.stderr)
    if len(changed) == SHOWN_CHANGES:
        print("  (the first of the changed files)", file=sys.stderr)
    if args.semantic and not engine.config.embedding.enabled:
        raise ValueError("semantic search needs embeddings: set embedding.enabled in the settings")
    found = engine.query(args.query, args.top_k, "semantic" if args.semantic else "", not args.no_mmr, args.context)
    if args.json:
        cut = lambda t: t if len(t.encode()) <= SHOWN_BYTES else t[:SHOWN_BYTES] + "..."
        print(json.dumps([{"path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"], "score": r["score"], "text": cut(r["text"])} for r in found], indent=2, ensure_ascii=False))
        return 0
    for n, r in enumerate(found, 1):
        print(f"{n}. {r['path']}:L{r['start_line']}-{r['end_line']} (score: {r['score']:.4f})\n{r['text']}\n")
    if not found:
        print("No results found.")
    return 0


def _pack(args, engine: Engine, folder: Path) -> int:
    if not engine.store.has("docs"):
        raise LookupError("no index found: run the index command first")
    said = engine.pack_json(args.query, args.budget, args.output, args.top_k)
    packed = json.loads(said)
    if not packed["snippets"]:
        print("No relevant content found.", file=sys.stderr)
    elif args.output:
        print(f"Context packed to: {args.output}\n  Snippets: {len(packed['snippets'])}\n  Tokens:   {packed['used_tokens']} / {packed['budget_tokens']}")
    else:
        print(said)
    return 0


def _runprompt(args, engine: Engine, folder: Path) -> int:
    packed = json.loads(Path(args.ctx).read_text(encoding="utf-8"))
    snippets = [(s.get("path"), s.get("range"), s.get("why"), s.get("text")) for s in packed.get("snippets") or []]
    frame = engine.spark.createDataFrame([(0, packed.get("query") or "", snippets)], "query_id long, query string, snippets array<struct<path:string,range:string,why:string,text:string>>")
    print(packing.prompts(frame, args.template, args.query).first()["prompt"])
    return 0


def _stats(args, engine: Engine, folder: Path) -> int:
    print(json.dumps(engine.stats(), indent=2))
    return 0


def _clear(args, engine: Engine, folder: Path) -> int:
    engine.clear()
    return 0


_COMMANDS = {"index": _index, "query": _query, "pack": _pack, "runprompt": _runprompt, "stats": _stats, "clear": _clear}
