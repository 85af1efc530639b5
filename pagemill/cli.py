"""Command line: python -m pagemill.cli URL [options]."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pagemill.options import FLAGS, VALUES, DeepStrategy, Options

#: Short forms.
SHORT = {"output": ("-o",), "output_dir": ("-O",), "query": ("-q",)}
HELP = {
    "raw": "keep the whole page", "prune": "keep the main content alone", "citations": "links as numbered citations", "refs": "citations with a list of references",
    "full": "scroll to the end (browser)", "no_links": "text of links only", "no_images": "no images", "site": "every page of the site's sitemaps", "browser": "render pages",
    "ignore_robots": "don't ask robots.txt", "no_delay": "no pause between requests", "no_metadata": "no front matter", "verbose": "say more", "copy": "to the clipboard (desktop builds)",
    "jsonl": "JSON lines", "query": "keep the blocks that fit these words", "css": "keep what this selector matches", "wait_for": "wait for a selector (browser)", "timeout_ms": "milliseconds a request",
    "match_pattern": "URLs must hold this", "deep": "follow links: bfs or dfs", "max_pages": "pages at most, 0 for all", "max_depth": "links followed in a row", "concurrency": "requests in flight",
    "output": "write one file", "output_dir": "write a folder of files",
}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser("pagemill", description="Web pages to markdown for language models.")
    made.add_argument("url")
    made.add_argument("--tui", action="store_true", help="interactive screens (none in this build)")
    for name, flag in FLAGS.items():
        made.add_argument(flag, dest=name, action="store_true", help=HELP[name])
    for name, flag in VALUES.items():
        default = getattr(Options, name)
        kind = int if isinstance(default, int) else str
        made.add_argument(*SHORT.get(name, ()), flag, dest=name, type=kind, default=default, help=HELP[name], choices=[s.value for s in DeepStrategy] if name == "deep" else None)
    made.add_argument("--print-options", action="store_true", help=argparse.SUPPRESS)
    return made


def parse(args: list[str]) -> tuple[Options, bool]:
    found = vars(parser().parse_args(args))
    show = found.pop("print_options")
    return Options(**found).normalised(), show


def main(args: list[str] | None = None) -> int:
    options, show = parse(sys.argv[1:] if args is None else args)
    if options.tui:
        print("this build has no interactive screens; run without --tui", file=sys.stderr)
        return 2
    if options.copy:
        print("this build can't reach a clipboard; run without --copy", file=sys.stderr)
        return 2
    if show:
        print("\n".join(f"{f.name}: {getattr(options, f.name)}" for f in dataclasses.fields(options)))
        return 0
    from pyspark.sql import SparkSession

    from pagemill.run import run

    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if options.verbose else "WARN")
    run(spark, options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
