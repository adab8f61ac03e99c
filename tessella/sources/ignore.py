"""Ordered ignore rules: the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str  # a regular expression for the start of a path
    ignore: bool
    folders_only: bool = False


def verdict(path: Column, rules: list[Rule]) -> Column:
    """'ignore' or 'keep' as an expression: later rules are asked first."""
    out = F.lit("keep")
    for r in rules:
        out = F.when(path.rlike(f"^(?:{r.pattern})"), "ignore" if r.ignore else "keep").otherwise(out)
    return out


def compiled(glob: str) -> str:
    """A gitignore glob as a regular expression for a whole relative path ('**' crosses folders, '*' and '?' don't)."""
    anchored = "/" in glob.rstrip("/")
    body = glob.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out if anchored else "(?:.*/)?" + out


def parsed(lines: list[str]) -> list[Rule]:
    """Rules of an ignore file; '!' keeps, a trailing '/' is for folders, '#' is a comment."""
    rules = []
    for line in lines:
        text = line.rstrip("\n").rstrip()
        if not text or text.startswith("#"):
            continue
        keep = text.startswith("!")
        glob = text[1:] if keep else text
        rules.append(Rule(compiled(glob) + "$", not keep, glob.endswith("/")))
    return rules


def excluding(globs: list[str]) -> list[Rule]:
    """Rules for exclude globs; 'g/**' also excludes the folder g."""
    more = [g for x in globs for g in ((x, x[:-3]) if x.endswith("/**") else (x,))]
    return parsed(more)


def ignored(path: str, folder: bool, rules: list[Rule]) -> bool | None:
    """True or False by the last rule that matches, None if none does."""
    for r in reversed(rules):
        if (folder or not r.folders_only) and re.match(r.pattern, path):
            return r.ignore
    return None
