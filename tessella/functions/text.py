"""Scalar text functions as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one word, or one sign that is neither word nor blank.
TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
#: Python's hard keywords.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield"
).split()
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_class(token: Column, names=("i18n", "L"), prefixes=(), ignored=(), ignored_kwargs=("when",)) -> Column:
    """Normal form of a token: signs and keywords as they are, known names by role, else <NAME>, <NUM>."""
    return (
        F.when(~token.rlike(r"^[A-Za-z0-9_]+$"), token)
        .when(token.isin(list(names)), "<I18N>")
        .when(token.isin(list(prefixes)) if prefixes else F.lit(False), "<PREFIX>")
        .when(token.isin(list(ignored)) if ignored else F.lit(False), "<IGNORE>")
        .when(token.isin(list(ignored_kwargs)) if ignored_kwargs else F.lit(False), "<IGNORE_KW>")
        .when(token.isin(*KEYWORDS, "get", "_path"), token)
        .when(token.rlike(r"^[0-9]"), "<NUM>")
        .otherwise("<NAME>")
    )


def path_components(path: Column) -> Column:
    """Non-empty components; sorting by them is component-wise ('a/b' before 'a.py')."""
    return F.filter(F.split(path, r"[\\/]+"), lambda x: x != "")


def code_path(path: Column, default_file: str) -> Column:
    """Where a key's entry lives: the default file, the default file of a folder, or the file named."""
    last = F.element_at(F.split(path, r"[\\/]+"), -1)
    return F.when(path.isNull() | (path == ""), default_file).when(last.rlike(r"^.+\.[^.]+$"), path).otherwise(F.concat(F.rtrim(F.lit("/"), path), F.lit("/" + default_file)))


def line_endings(text: Column, mode: str) -> Column:
    """default keeps the text; lf, cr and crlf make all line ends alike."""
    end = {"lf": "\n", "cr": "\r", "crlf": "\r\n"}.get(mode)
    if end is None:
        return text
    return F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit(end))


def indented(message: Column) -> Column:
    """Continuation lines of a log message by four spaces."""
    return F.replace(message, F.lit("\n"), F.lit("\n    "))


def log_line(level: Column, target: Column, message: Column) -> Column:
    """[INFO  target] message, its further lines indented."""
    return F.concat(F.lit("["), F.rpad(level, 5, " "), F.lit(" "), target, F.lit("] "), indented(message))


def commented(text: Column) -> Column:
    """Each line as a comment; blank lines as a bare '#', trailing blank lines dropped."""
    body = F.regexp_replace(text, r"\s+$", "")
    return F.array_join(F.transform(F.split(body, "\n"), lambda x: F.when(F.trim(x) == "", "#").otherwise(F.concat(F.lit("# "), x))), "\n")


def placeholder_text(key: Column, names: Column) -> Column:
    """key = key{ $a }{ $b } with sorted names."""
    return F.concat(key, F.array_join(F.transform(F.array_sort(names), lambda x: F.concat(F.lit("{ $"), x, F.lit(" }"))), ""))


def ignore_marker(comment: Column, prefix: str = "extract:") -> Column:
    """Checks that a comment opts out of, sorted; null without a marker.

    A line is a marker if it is 'ignore' alone (old style, 'untranslated') or has
    the prefix and after it 'ignore' with names behind blanks or commas; without
    names it is 'all'. Lines add up, and letter case doesn't matter.
    """

    def of(line: Column) -> Column:
        low = F.lower(F.trim(line))
        rest = F.trim(F.regexp_extract(low, f"^.*?{prefix}(.*)$", 1))
        names = F.filter(F.split(F.regexp_replace(rest, "^ignore", ""), r"[\s,]+"), lambda x: x != "")
        return (
            F.when((low == "ignore") | (rest == "ignore-untranslated"), F.array(F.lit("untranslated")))
            .when(rest == "ignore", F.array(F.lit("all")))
            .when(rest.rlike(r"^ignore\s"), F.when(F.size(names) == 0, F.array(F.lit("all"))).otherwise(names))
            .otherwise(F.array().cast("array<string>"))
        )

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(comment, "\n"), of))))
    return F.when(F.size(found) > 0, found)


def marker_covers(comment: Column, check: str, prefix: str = "extract:") -> Column:
    m = ignore_marker(comment, prefix)
    return F.coalesce(F.array_contains(m, check) | F.array_contains(m, "all"), F.lit(False))


def thousands(n: Column) -> Column:
    """1234567 as '1 234 567'."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", " ")


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def bar(done: Column, total: Column, width: int = 20) -> Column:
    full = F.floor(F.when(total > 0, done * width / total).otherwise(0)).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def scrubbed(text: Column) -> Column:
    """Timings replaced, so that logs of two runs compare."""
    return F.regexp_replace(text, r"\d+(\.\d+)?\s?(ms|s)\b", "<time>")


def end_location(text: Column) -> Column:
    """(line, column) of the end of a text, lines from 1, columns from 0."""
    return F.struct((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.length(F.substring_index(text, "\n", -1)).alias("column"))


def character_column(text: Column, byte: Column) -> Column:
    """Characters in the first bytes of a text: a UTF-8 byte offset as a character offset."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte), "UTF-8"))


def syntax_message(message: Column) -> Column:
    """A parser's wording as a linter's."""
    return (
        F.when(message.rlike("was never closed"), "unexpected EOF while parsing")
        .when(message.rlike("unterminated (triple-quoted )?string"), "missing closing quote in string literal")
        .when(message.rlike("expected an indented block"), F.concat(F.lit("Expected an indented block"), F.coalesce(F.nullif(F.regexp_extract(message, "( after .*)$", 1), F.lit("")), F.lit(""))))
        .otherwise(message)
    )


def glomerulus(name: Column) -> Column:
    """The capital-letter code before _ or space in a cell type."""
    return F.regexp_extract(name, r"([A-Z]{1,4}\d*[a-z]*)[_ ]", 1)


#: Sign of a transmitter.
SIGNS = {"acetylcholine": 1, "gaba": -1, "glutamate": -1}


def primary_transmitter(known: Column, best: Column) -> Column:
    """The first classical transmitter of a ; or , list that isn't '-negative', else the predicted one."""
    named = F.filter(F.transform(F.split(F.lower(known), "[;,]"), lambda x: F.trim(x)), lambda x: x.isin(list(SIGNS)) & ~x.endswith("-negative"))
    return F.coalesce(F.get(named, 0), F.lower(best))


def sign_of(transmitter: Column) -> Column:
    out = F.lit(0)
    for name, sign in SIGNS.items():
        out = F.when(transmitter == name, sign).otherwise(out)
    return out


def described(kind: Column, text: Column, line: Column, column: Column) -> Column:
    return F.format_string("%s %s at %d:%d", kind, text, line, column)


def update_section(text: Column, name: str, body: Column, skeleton: str = "") -> Column:
    """text with body between the markers of a section; markers that are missing come at the end, all else stays.

    Null text is the skeleton.
    """
    start, end = F.lit(f"<!-- {name}:start -->"), F.lit(f"<!-- {name}:end -->")
    old = F.coalesce(text, F.lit(skeleton))
    block = F.concat(start, F.lit("\n"), F.regexp_replace(body, r"\s+$", ""), F.lit("\n"), end)
    a, b = F.instr(old, f"<!-- {name}:start -->"), F.instr(old, f"<!-- {name}:end -->")
    inside = F.concat(F.substring(old, F.lit(1), a - 1), block, F.substring(old, b + F.length(end), F.length(old)))
    return F.when((a > 0) & (b > 0), inside).otherwise(F.concat(F.regexp_replace(old, r"\s+$", ""), F.lit("\n\n"), block, F.lit("\n")))
