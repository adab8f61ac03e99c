"""Key occurrences and key candidates of Python sources, as table functions over file rows."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ship
from tessella.sources.options import Options

OCCURRENCE = "file_idx int, path string, key string, kwargs array<string>, entry_path string, line int, col int, is_star boolean, error string"
CANDIDATE = "file_idx int, cand_idx int, kind string, text string, line int, col int, depth int, first_positional boolean, in_kwargs boolean, before array<string>, focus array<string>, after array<string>, key_name string, call_line int, call_col int"
BEFORE, AFTER = 12, 6


#: Files whose rows a task makes at once: the rows of a whole Arrow batch of files would take many times its size.
FILES = 256


def by_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of FILES files at most."""
    for batch in batches:
        for i in range(0, len(batch), FILES):
            yield batch.iloc[i : i + FILES]


def dotted(node: ast.expr) -> list[str] | None:
    """['a', 'b', 'c'] of a.b.c; None where the root isn't a plain name."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    return [node.id, *parts] if isinstance(node, ast.Name) else None


def key_of(call: ast.Call, o: Options) -> str | None:
    """The key a call asks for: its literal for name(...) and name.get(...), the joined attributes for name.a.b(...)."""
    chain = dotted(call.func)
    if chain is None:
        return None
    if len(chain) > 1 and chain[0] in o.prefixes and chain[0] not in o.names and chain[1] in o.names:
        chain = chain[1:]
    if chain[0] not in o.names:
        return None
    rest = chain[1:]
    if not rest or rest == ["get"]:
        first = call.args[0] if call.args else None
        return first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
    return None if rest[0] in o.ignore_attributes else "-".join(rest)


def occurrences_in(text: str, o: Options) -> Iterator[tuple[str, list[str], str | None, int, int, bool]]:
    """(key, kwargs, literal _path, line, column, has **) of every call in source order, outer calls first."""
    lines = text.splitlines(keepends=True)
    calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call)]
    for call in sorted(calls, key=lambda n: (n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset)):
        key = key_of(call, o)
        if key is None:
            continue
        named = {k.arg: k.value for k in call.keywords if k.arg is not None}
        where = named.get("_path")
        path = where.value if isinstance(where, ast.Constant) and isinstance(where.value, str) and where.value else None
        kwargs = sorted({k for k in named if k != "_path" and k not in o.ignore_kwargs})
        column = len(lines[call.lineno - 1].encode()[: call.col_offset].decode()) + 1
        yield key, kwargs, path, call.lineno, column, any(k.arg is None for k in call.keywords)


def entry_path(path: str | None, default_file: str) -> str:
    if not path:
        return default_file
    name = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
    return path if name.find(".") > 0 else f"{path.rstrip('/')}/{default_file}"


def occurrences(files: DataFrame, o: Options) -> DataFrame:
    """A row for each occurrence; a file that doesn't parse is one row with an error."""
    ship(files.sparkSession)
    columns = [x.split()[0] for x in OCCURRENCE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_files(batches):
            rows = []
            for idx, path, text, error in zip(batch["file_idx"], batch["path"], batch["text"], batch["error"], strict=True):
                if error is None and text is not None:
                    try:
                        rows += [(idx, path, k, kw, entry_path(p, o.default_file), ln, c, star, None) for k, kw, p, ln, c, star in occurrences_in(text, o)]
                    except SyntaxError as e:
                        rows.append((idx, path, None, None, None, e.lineno, e.offset, None, f"parse-error: {e.msg}"))
                else:
                    rows.append((idx, path, None, None, None, None, None, None, error))
            out = pd.DataFrame(rows, columns=columns)
            for c in ("line", "col"):
                out[c] = out[c].astype("Int32")
            out["is_star"] = out["is_star"].astype("boolean")
            yield out

    return files.select("file_idx", "path", "text", "error").mapInPandas(run, OCCURRENCE)


SKIP = {tokenize.NL, tokenize.COMMENT, tokenize.ENCODING, tokenize.INDENT, tokenize.DEDENT}


def chain_key(names: list[str], o: Options) -> str | None:
    """The key that a dotted name would ask for; None for a bare name and name.get, whose key is an argument."""
    rest = names[2:] if len(names) > 1 and names[0] in o.prefixes and names[1] in o.names else names[1:]
    return "-".join(rest) if rest and rest != ["get"] else None


def candidates_in(text: str, o: Options = Options()) -> Iterator[tuple]:
    """Strings right after '(' or ',' and dotted names right before '(': all that could be a key, with their context.

    Both have the place of the call they belong to, where its dotted name starts.
    """
    toks = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in SKIP]
    words = [t.string for t in toks]
    depth, stack, opened, levels = 0, [], [], []
    for t in toks:
        levels.append(depth)
        opened.append(stack[-1] if stack else None)
        if t.string in ("(", "[", "{") and t.type == tokenize.OP:
            stack.append(len(levels) - 1)
            depth += 1
        elif t.string in (")", "]", "}") and t.type == tokenize.OP:
            stack = stack[:-1]
            depth = max(0, depth - 1)
    # an '=' on a level since its last comma puts what follows into a value
    since: dict[int | None, bool] = {}
    value_at = []
    for i, t in enumerate(toks):
        value_at.append(since.get(opened[i], False))
        if t.string == ",":
            since[opened[i]] = False
        elif t.string == "=":
            since[opened[i]] = True

    def in_value(i: int) -> bool:
        while True:
            if value_at[i]:
                return True
            if opened[i] is None:
                return False
            i = opened[i]

    def chain_start(i: int) -> int | None:
        """Where the dotted name right before the '(' at i starts."""
        if not i or toks[i - 1].type != tokenize.NAME or keyword.iskeyword(words[i - 1]):
            return None
        start = i - 1
        while start >= 2 and words[start - 1] == "." and toks[start - 2].type == tokenize.NAME and not keyword.iskeyword(words[start - 2]):
            start -= 2
        return start

    def literal(parts: list[str]) -> str | None:
        try:
            value = ast.literal_eval(" ".join(parts))
        except (ValueError, SyntaxError):
            return None
        return value if isinstance(value, str) else None

    def row(kind: str, a: int, b: int, shown: str) -> tuple:
        first = kind == "string" and words[a - 1] == "("
        call = a if kind == "chain" else chain_start(opened[a]) if opened[a] is not None and words[opened[a]] == "(" else None
        key = chain_key(words[a:b:2], o) if kind == "chain" else literal(words[a:b])
        at = (None, None) if call is None else (toks[call].start[0], toks[call].start[1] + 1)
        return kind, shown, toks[a].start[0], toks[a].start[1] + 1, levels[a], first, in_value(a), words[max(0, a - BEFORE) : a], words[a:b], words[b : b + AFTER], key, *at

    for i, t in enumerate(toks):
        if t.type == tokenize.STRING and i and words[i - 1] in ("(", ",") and not t.string[:1] in "bB":
            end = i + 1
            while end < len(toks) and toks[end].type == tokenize.STRING:
                end += 1
            yield row("string", i, end, t.string)
        elif t.string == "(" and (start := chain_start(i)) is not None:
            yield row("chain", start, i, "".join(words[start:i]))


def labelled(candidates: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(file_idx, line, col, key, cand_idx): the candidate of each occurrence, at the same call.

    A dotted name with a key of its own must be that key; else it is the first
    string argument. Not exactly one such candidate is an error when rows are read.
    """
    at = candidates.where("call_line is not null").select("file_idx", F.col("call_line").alias("line"), F.col("call_col").alias("col"), "kind", "key_name", "cand_idx", "first_positional")
    chain = at.where("kind = 'chain'").select("file_idx", "line", "col", F.col("key_name").alias("_chain"), F.col("cand_idx").alias("_which"))
    x = occurrences.select("file_idx", "line", "col", "key").join(chain, ["file_idx", "line", "col"], "left")
    strings = at.where("kind = 'string' and first_positional").select("file_idx", "line", "col", F.col("key_name").alias("key"), F.col("cand_idx").alias("_string"))
    x = x.join(strings, ["file_idx", "line", "col", "key"], "left")
    mine = F.when(F.col("_chain").isNull(), F.col("_string")).when(F.col("_chain") == F.col("key"), F.col("_which"))
    n = x.groupBy("file_idx", "line", "col", "key").agg(F.count(mine).alias("_n"), F.min(mine).alias("cand_idx"))
    one = F.assert_true(F.col("_n") == 1, F.concat(F.lit("not one candidate for "), F.col("key")))
    return n.withColumn("_ok", one).where("_ok is null").drop("_n", "_ok")


def candidates(files: DataFrame, o: Options | None = None) -> DataFrame:
    o = o or Options()
    ship(files.sparkSession)
    columns = [x.split()[0] for x in CANDIDATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_files(batches):
            rows = [(idx, n, *c) for idx, text in zip(batch["file_idx"], batch["text"], strict=True) if text for n, c in enumerate(candidates_in(text, o))]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"call_line": "Int32", "call_col": "Int32"})

    return files.where("text is not null").select("file_idx", "text").mapInPandas(run, CANDIDATE)
