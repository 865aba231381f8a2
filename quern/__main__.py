"""``python -m quern COMMAND SOURCE ...``: a folder searched from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from quern.search import Index
from quern.session import local_session
from quern.sources import render, stores, tree


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("command", choices=["search", "pack", "find-related", "list-files", "status", "get", "eval", "tune"])
    p.add_argument("source", help="a folder or the address of a repository")
    p.add_argument("text", nargs="?", default="", help="the query, or a place FILE:LINE")
    p.add_argument("--ref")
    p.add_argument("--offline", action="store_true")
    p.add_argument("--mode", choices=["bm25", "semantic", "hybrid"])
    p.add_argument("--limit", type=int)
    p.add_argument("--alpha", type=float)
    p.add_argument("--budget", type=int)
    p.add_argument("--language", action="append", default=[])
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--documents", action="store_true", help="index documents too")
    p.add_argument("--index", help="where the index is kept between runs")
    p.add_argument("--cases", help="feedback cases, one JSON object a line")
    p.add_argument("--profiles", help="a file of profiles")
    p.add_argument("--profile", help="the profile whose settings hold where none is given")
    p.add_argument("--format", choices=["text", "compact", "jsonl", "json"], default="text")
    return p.parse_args(argv)


def run(argv: list[str], spark=None) -> str:
    """What a command prints."""
    args = options(argv)
    profile = stores.Profiles(args.profiles).all()[args.profile] if args.profile else {}
    defaults = {"mode": "hybrid", "limit": {"list-files": 200, "eval": 10, "tune": 10, "pack": 20}.get(args.command, 5), "alpha": None, "budget": 6000}
    use = stores.resolve(defaults, {k: profile.get(k) for k in defaults}, {k: getattr(args, k) for k in defaults})
    kind, source, _ = tree.resolve_source(args.source, args.ref, args.offline)
    spark = spark or local_session()
    more = {"folder": args.index, "include_documents": args.documents}
    index = Index.from_git(spark, source, args.ref, args.offline, **more) if kind == "git" else Index.from_tree(spark, source, **more)
    filters = {"languages": args.language or None, "paths": args.path or None}
    if args.command == "search":
        found = index.search_with(args.text, use["mode"], use["limit"], alpha=use["alpha"], **filters)
        return shown(found, args.format, f"Search results for: {args.text!r} (mode={use['mode']})", use["mode"])
    if args.command == "find-related":
        place, _, line = args.text.rpartition(":")
        return shown({"hits": index.find_related(place, int(line), use["limit"])}, args.format, f"Related to {args.text}", "semantic")
    if args.command == "pack":
        return render.json_lines(index.pack([args.text], use["budget"], use["limit"], alpha=use["alpha"], **filters))
    if args.command == "get":
        place, _, line = args.text.rpartition(":")
        chunk = index.chunk_at(place, int(line))
        return render.fenced(chunk.content, chunk.language or "") if chunk else "No chunk there."
    if args.command in ("eval", "tune"):
        cases = [(r.query, r.expected) for r in stores.list_feedback(spark, args.cases, 1_000_000)[0]]
        return json.dumps(index.evaluate(cases, use["mode"], use["limit"], use["alpha"]) if args.command == "eval" else index.tune(cases, use["limit"]))
    if args.command == "list-files":
        listed = index.indexed_files(use["limit"])
        return "\n".join(listed["files"]) + (f"\n... {listed['total']} files in all" if listed["truncated"] else "")
    stats = index.stats()
    return f"{stats['indexed_files']} files, {stats['total_chunks']} chunks: {render.languages(stats['languages'])}"


def shown(found: dict, form: str, header: str, source: str) -> str:
    if form == "json":
        return json.dumps(found | {"hits": [h.asDict(recursive=True) for h in found["hits"]]}, default=str)
    if form == "jsonl":
        return render.json_lines(found["hits"])
    text = render.compact(found["hits"]) if form == "compact" else render.results(header, found["hits"], source) if found["hits"] else "No results found."
    return "\n".join([*found.get("warnings", []), text])


if __name__ == "__main__":
    print(run(sys.argv[1:]))
