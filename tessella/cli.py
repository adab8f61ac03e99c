"""The command line: extract, a whole run over code and catalogues, and config, a sample of a configuration file.

    python -m tessella.cli extract CODE LOCALES -l en -l de [options]

Options on the command line win over those of [tool.<section>] in the nearest
pyproject.toml, which win over defaults. Exit codes: 0 done, 1 problems in
sources or catalogues, 2 wrong options.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tessella.plans import extract as X
from tessella.sources.options import Options, called, find_config, load_config, sample_config

DONE, PROBLEMS, USAGE = 0, 1, 2
#: (flags, field, adds to the set instead of replacing it)
LISTS = (
    (("-l", "--language"), "locales", False),
    (("-k", "--i18n-keys"), "names", False),
    (("-K", "--i18n-keys-append"), "names", True),
    (("-p", "--i18n-keys-prefix"), "prefixes", False),
    (("-e", "--exclude-dirs"), "exclude", False),
    (("-E", "--exclude-dirs-append"), "exclude", True),
    (("-i", "--ignore-attributes"), "ignore_attributes", False),
    (("-I", "--append-ignore-attributes"), "ignore_attributes", True),
    (("--ignore-kwargs",), "ignore_kwargs", False),
)
TEXTS = (("--default-ftl-file", "default_file"), ("--comment-keys-mode", "comment_mode"), ("--line-endings", "line_endings"))
SWITCHES = (("--dry-run", "dry_run"), ("--allow-parse-errors", "allow_errors"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m tessella.cli")
    top.add_argument("-c", "--config", help="a pyproject.toml")
    top.add_argument("--section", default="extract", help="the part of [tool] that has the options")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("extract", help="extract keys and reconcile the catalogues")
    run.add_argument("code_path", nargs="?")
    run.add_argument("locales_path", nargs="?")
    for flags, field, more in LISTS:
        run.add_argument(*flags, action="append", dest=f"{field}{'+' if more else ''}", default=None)
    for flag, field in TEXTS:
        run.add_argument(flag, dest=field, default=None)
    for flag, field in SWITCHES:
        run.add_argument(flag, dest=field, action="store_true", default=None)
    sub.add_parser("config", help="show a configuration file with all defaults")
    return top


def options(args: argparse.Namespace) -> Options:
    path = Path(args.config) if args.config else find_config(".")
    given = {called(k.rstrip("+")) + ("-append" if k.endswith("+") else ""): v for k, v in vars(args).items() if v is not None and k not in ("command", "config", "section")}
    o = Options().resolved(load_config(path, args.section), given)
    if not o.code_path or not o.locales_path:
        raise ValueError("the paths of code and locales must be given, as arguments or in the configuration")
    return o


def line(level: str, text: str) -> str:
    return f"[{level:<5} cli] " + text.replace("\n", "\n    ")


def said(o: Options, out: X.Outcome, seconds: float) -> list[str]:
    """The log of a run."""
    lines = [line("INFO", f"Code path: {o.code_path}"), line("INFO", f"Locales path: {o.locales_path}"), *[line("WARN", w) for w in out.warnings]]
    if out.exit:
        n = f"{out.problems} problem{'' if out.problems == 1 else 's'}"
        more = [f"  ... and {out.problems - len(out.messages)} more"] if out.problems > len(out.messages) else []
        return [*lines, line("ERROR", "\n".join([f"Extraction aborted: {n} found, no .ftl files were written.", *[f"  - {m}" for m in out.messages], *more]))]
    by = lambda name: "{" + ", ".join(f'"{x}": {s[name]}' for x, s in out.statistics.items()) + "}"
    counts = [f"Py files count: {out.py_files}", "FTL files count: {" + ", ".join(f'"{x}": {n}' for x, n in out.ftl_files.items()) + "}", f"FTL keys in code: {out.keys}"]
    counts += [f"FTL keys {name}: {by(name)}" for name in ("stored", "updated", "added", "commented")]
    return [*lines, line("INFO", "Extraction statistics:"), *[line("INFO", f"  - {c}") for c in counts], line("INFO", f"Done in {seconds:.3f}s.")]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        print(sample_config(args.section), end="")
        return DONE
    try:
        o = options(args)
    except ValueError as e:
        print(line("ERROR", str(e)), file=sys.stderr)
        return USAGE
    began = time.time()
    own = spark is None
    spark = spark or SparkSession.builder.appName("extract").getOrCreate()
    try:
        out = X.run(spark, o.code_path, o.locales_path, o)
    finally:
        if own:
            spark.stop()
    print("\n".join(said(o, out, time.time() - began)), file=sys.stderr)
    return out.exit


if __name__ == "__main__":
    sys.exit(main())
