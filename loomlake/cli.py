"""python -m loomlake.cli BASE index|search|status|duplicates ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .sources.config import BACKENDS
from .sources.library import Library


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomlake")
    out.add_argument("base", help="folder of the library's tables")
    sub = out.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring the catalog up to date")
    index.add_argument("--root", action="append", help="image folder; may be given again")
    search = sub.add_parser("search", help="rank the library against query images")
    search.add_argument("query", nargs="+")
    search.add_argument("--k", type=int, default=20)
    search.add_argument("--alpha", type=float)
    for p in (index, search):
        p.add_argument("--backend", choices=BACKENDS)
        p.add_argument("--no-tta", action="store_true")
        p.add_argument("--model", help="ONNX file of an image model")
    out.add_argument("-v", "--verbose", action="store_true", help="log what is done")
    sub.add_parser("status", help="count rows")
    sub.add_parser("duplicates", help="pairs of alike images")
    return out


def line(r) -> str:
    """A result as text: place, score, what it is made of, path, and what is to be noted."""
    notes = [text for text, on in (("[duplicate]", r.is_duplicate), ("(below threshold)", r.below_threshold)) if on]
    return " ".join([f"{r.query_id}:{r['rank']}", f"{r.score:.4f}", f"pattern={r.pattern_score:.4f}", f"colour={r.color_sim:.4f}", f"hamming={'-' if r.hamming is None else r.hamming}", r.path, *notes])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("loomlake").getOrCreate()
    library = Library(spark, args.base)
    if args.command in ("index", "search"):
        c = library.config
        c.library_roots = getattr(args, "root", None) or c.library_roots
        c.backend, c.tta = args.backend or c.backend, c.tta and not args.no_tta
        c.model_path = args.model or c.model_path
        library.save_config()
    if args.command == "index":
        if not library.config.library_roots:
            print("no image folder: give --root", file=sys.stderr)
            return 2
        print(library.reindex())
    elif args.command == "search":
        for r in library.search(args.query, args.k, args.alpha).orderBy("query_id", "rank").collect():  # k rows for each query
            print(line(r))
    elif args.command == "status":
        print(library.stats())
    else:
        library.duplicates().orderBy("dist", "a", "b").show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
