"""A reader and writer for message catalogues of the Fluent kind: messages, terms, comments, references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tessella.session import ship

HEAD = re.compile(r"(-?[A-Za-z][\w-]*)[ ]*=")
ATTRIBUTE = re.compile(r"[ ]+\.([A-Za-z][\w-]*)[ ]*=")
#: What stands inside braces: strings, variables, terms, names (with `call`: functions and named arguments), arrows, braces.
TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\$(?P<variable>[A-Za-z][\w-]*)|(?P<ref>-?[A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)?)(?P<call>\s*[(:])?|->|.', re.S)
VARIANT = re.compile(r"\s*\*?\[\s*[\w.-]+\s*\]")
ENTRY = "locale string, path string, position int, entry_type string, name string, text string, comment string, variables array<string>, refs array<string>, attributes array<struct<name:string,variables:array<string>,refs:array<string>>>, error string"


@dataclass
class Entry:
    kind: str  # message, term, comment
    name: str | None
    text: str
    position: int
    comment: str | None = None
    variables: list[str] = field(default_factory=list)  # of the value, not of the attributes
    refs: list[str] = field(default_factory=list)  # 'name', '-term', each with '.attribute' if it has one
    attributes: list[dict] = field(default_factory=list)  # name, variables, refs


class Pattern:
    """Variables and references of a pattern: inside braces only, in variants too, not in strings."""

    def __init__(self, text: str):
        self.text, self.variables, self.refs = text, set(), []
        self.read(0, False)

    def read(self, at: int, variant: bool) -> int:
        """The place after a pattern; a variant ends before the next one or its closing brace."""
        while at < len(self.text):
            c = self.text[at]
            if c == "{":
                at = self.placeable(at + 1)
            elif c == "}" and not variant:
                raise ValueError("unbalanced braces")
            elif c == "}" or (variant and c == "\n" and VARIANT.match(self.text, at)):
                return at
            else:
                at += 1
        return at

    def placeable(self, at: int) -> int:
        while token := TOKEN.match(self.text, at):
            at = token.end()
            if token[0] == "}":
                return at
            if token[0] == "{":
                at = self.placeable(at)
            elif token[0] == "->":
                while variant := VARIANT.match(self.text, at):
                    at = self.read(variant.end(), True)
            elif token["variable"]:
                self.variables.add(token["variable"])
            elif token["ref"] and (not token["call"] or token["ref"][0] == "-"):
                self.refs.append(token["ref"])
        raise ValueError("unbalanced braces")


def parts(text: str) -> Iterator[tuple[str | None, str]]:
    """(None, value) and (name, value) of each attribute of an entry."""
    name, held = None, []
    for n, line in enumerate(text.split("\n")):
        head = ATTRIBUTE.match(line) if n else HEAD.match(line)
        if head and n:
            yield name, "\n".join(held)
            name, held = head[1], []
        held.append(line[head.end() :] if head else line)
    yield name, "\n".join(held)


#: A further line that starts so is not text of a value.
NO_TEXT = re.compile(r"[ ]*[.*\[}]")


def has_text(value: str) -> bool:
    """Whether a value says anything: on its first line, or on a later one that can be text."""
    first, *rest = value.split("\n")
    return bool(first.strip()) or any(x.strip() and not NO_TEXT.match(x) for x in rest)


def parse(source: str) -> list[Entry]:
    """Entries in order; ValueError has place and kind of the first problem and how many more there are.

    What can't be read runs on to the next line that starts an entry or a comment,
    and is one problem, also where it follows an entry that is one itself.
    """
    out: list[Entry] = []
    comment: list[str] = []
    problems: list[tuple[int, str]] = []
    after: dict[int, Entry | None] = {}  # line of a problem: the entry before it
    blank = 0  # blank lines since the last line of an entry; they are part of it if it goes on
    lost = False
    for n, line in enumerate(re.split(r"\r\n|\n|\r", source), 1):
        if line.startswith("#"):
            comment.append(line)
            blank, lost = 0, False
            continue
        head = HEAD.match(line)
        if head:
            name = head[1]
            note = "\n".join(c.lstrip("#").removeprefix(" ") for c in comment) if comment and comment[0].startswith("# ") else None
            if comment and note is None:
                out.append(Entry("comment", None, "\n".join(comment), n))
            out.append(Entry("term" if name[0] == "-" else "message", name, line, n, note))
            comment, lost = [], False
        elif not line.strip():
            blank += 1
            if comment:
                out.append(Entry("comment", None, "\n".join(comment), n))
                comment = []
            continue
        elif line[0] in " }" and out and out[-1].kind != "comment" and not comment and not lost:
            out[-1].text += "\n" * (blank + 1) + line
        elif not lost:
            problems.append((n, "Expected an entry start"))
            after[n] = out[-1] if out and not comment else None
            lost = True
        blank = 0
    if comment:
        out.append(Entry("comment", None, "\n".join(comment), len(source)))
    for e in out:
        if e.kind == "comment":
            continue
        wrong = None
        for name, value in parts(e.text):
            try:
                read = Pattern(value)
            except (ValueError, RecursionError) as error:
                wrong = f"{error} in \"{e.name}\""
                break
            if name is None:
                e.variables, e.refs = sorted(read.variables), read.refs
                bare = not has_text(value)
            else:
                e.attributes.append({"name": name, "variables": sorted(read.variables), "refs": read.refs})
        if wrong is None and bare and (e.kind == "term" or not e.attributes):
            wrong = f"Expected a {e.kind} field for \"{e.name.lstrip('-')}\""
        if wrong is not None:
            problems = [(n, what) for n, what in problems if after.get(n) is not e] + [(e.position, wrong)]
    if problems:
        line, what = min(problems)
        more = f" (and {len(problems) - 1} more)" if len(problems) > 1 else ""
        raise ValueError(f"{line}:1: {what}{more}")
    return out


def serialize(entries: list[Entry]) -> str:
    """Entries by position, a comment above its entry; a free comment stands alone."""
    lines = []
    for e in sorted(entries, key=lambda e: e.position):
        if e.kind == "comment":
            lines.append(e.text + "\n")
        else:
            lines += [f"# {c}".rstrip() for c in (e.comment.split("\n") if e.comment is not None else [])]
            lines.append(e.text)
    return "\n".join(lines) + "\n" if lines else ""


def entries(files: DataFrame) -> DataFrame:
    """files: locale, path, text -> a row for each entry, or one with an error for a file that doesn't parse."""
    ship(files.sparkSession)
    columns = files.sparkSession.createDataFrame([], ENTRY).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for locale, path, text in zip(batch["locale"], batch["path"], batch["text"], strict=True):
                try:
                    rows += [(locale, path, e.position, e.kind, e.name, e.text, e.comment, e.variables, e.refs, e.attributes, None) for e in parse(text)]
                except ValueError as e:
                    rows.append((locale, path, 0, "junk", None, None, None, [], [], [], str(e)))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("locale", "path", "text").mapInPandas(run, ENTRY)
