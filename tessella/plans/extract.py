"""From sources to reconciled catalogues: the whole extraction as one set of plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import merge as M
from tessella.operators import prefix, reach
from tessella.operators import reconcile as R
from tessella.sources import fluent, python_code, tree
from tessella.sources.options import Options


@dataclass
class Extraction:
    keys: DataFrame  # key, kwargs, path, location, unknown_at, occurrences
    diagnostics: DataFrame  # path, line, col, error
    conflicts: DataFrame  # key, kind, first, other, first_at, other_at
    files: DataFrame  # path of the files that have a key


def read_code(spark: SparkSession, root: str, o: Options) -> DataFrame:
    """The Python files that mention any of the names, by their whole paths."""
    files = tree.tree(spark, root, ".py", sorted(o.exclude), (".ignore", ".gitignore"), sorted(o.names | o.prefixes))
    return files.withColumn("path", F.when(F.col("path") == "", root).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), "path")))


def extract(files: DataFrame, o: Options, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> Extraction:
    """files: file_idx, path, text, error. The kwargs and path of a key are those of its winning occurrence.

    kept: what is to be done with the occurrences, which all results are made of, such as to persist them.
    """
    found = kept(python_code.occurrences(files, o))
    ok = found.where("key is not null")
    location = F.struct(T.path_components(F.col("path")).alias("parts"), "line", "col", "path")
    keys = M.merge_occurrences(ok, ["key"], F.col("is_star"), location, F.col("kwargs"), F.col("entry_path"))
    diagnostics = found.where("error is not null").select("path", "line", "col", "error")
    return Extraction(keys, diagnostics, M.conflicting(ok, ["key"], F.col("is_star"), location, F.col("kwargs"), F.col("entry_path")), ok.select("path").distinct())


#: Problems that are shown; all are counted.
SHOWN = 50


def problems(e: Extraction) -> DataFrame:
    """(allowed, key, message): what is wrong with the sources; allowed tells whether a run may go on all the same."""
    at = lambda c: F.concat_ws(":", f"{c}.path", f"{c}.line", f"{c}.col")
    tag, said = (F.when(F.col("kind") == "path", a).otherwise(b) for a, b in (("key-path-conflict", "key-message-conflict"), ("has different paths", "is used with different keyword arguments")))
    message = F.concat(F.lit("["), tag, F.lit("] Fluent key "), "key", F.lit(" "), said, F.lit(": "), "first", F.lit(" and "), "other", F.lit(" ("), at("first_at"), F.lit(", "), at("other_at"), F.lit(")"))
    own = F.regexp_extract("error", "[(]([0-9]+:[0-9]+)[)]$", 1)
    place = F.concat_ws(":", "path", F.when(F.col("line") > 0, F.concat_ws(":", "line", "col")).when(own != "", own))
    detail = F.regexp_extract("error", "^[^:]*: ?(.*?)(?: [(][0-9]+:[0-9]+[)])?$", 1)
    kind = F.substring_index("error", ":", 1)
    what = F.concat(F.when(kind == "parse-error", "Failed to parse Python file: ").when(kind == "invalid-utf8", "Python file is not valid UTF-8: ").otherwise("Failed to read Python file: "), detail)
    return e.conflicts.select(F.lit(False).alias("allowed"), "key", message.alias("message")).unionByName(e.diagnostics.select(F.lit(True).alias("allowed"), F.col("path").alias("key"), F.concat(F.lit("["), F.substring_index("error", ":", 1), F.lit("] "), what, F.lit(" ("), place, F.lit(")")).alias("message")))


def gate(e: Extraction, o: Options) -> tuple[int, list[str], list[str]]:
    """(problems that stop a run, the first of their messages, the first of what is skipped): conflicts always stop it, unreadable files unless allowed."""
    found = problems(e).persist()
    stops = found.where(~F.col("allowed") | F.lit(not o.allow_errors))
    first = lambda x: [r["message"] for r in x.orderBy("key", "message").limit(SHOWN).collect()]
    n = stops.count()
    out = n, first(stops) if n else [], first(found.where("allowed")) if o.allow_errors else []
    found.unpersist()
    return out


def variables(entries: DataFrame) -> DataFrame:
    """(locale, name, variables, needed): variables of each message's value and of the parts it refers to, at any depth.

    A part is a value or an attribute, seen from the caller or from inside a term:
    there variables are the term's own and don't count. What a message refers to,
    through terms too, is needed as long as it is.
    """
    node = lambda name, scope: F.concat_ws("\x1f", "locale", name, scope)
    own = entries.where("name is not null")
    inner = own.select("locale", "name", F.explode("attributes").alias("a")).select("locale", F.concat_ws(".", "name", "a.name").alias("name"), "a.variables", "a.refs")
    part = own.select("locale", "name", "variables", "refs").unionByName(inner).withColumn("scope", F.explode(F.array(F.lit("caller"), F.lit("term"))))
    edges = part.select("locale", "scope", node("name", "scope").alias("src"), F.explode("refs").alias("ref"))
    edges = edges.select("src", node("ref", F.when(F.col("ref").startswith("-"), "term").otherwise(F.col("scope"))).alias("dst"))
    roots = entries.where("entry_type = 'message'").select(node("name", F.lit("caller")).alias("name")).distinct()
    held = part.where("scope = 'caller'").select(node("name", "scope").alias("name"), F.explode(F.transform("variables", lambda v: F.struct(F.lit("variable").alias("kind"), v.alias("what")))).alias("value"))
    of = lambda c: F.substring_index(F.split(c, "\x1f")[1], ".", 1)
    # what is needed is every message that is reached, whether or not it has entries
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(roots).distinct()
    values = held.unionByName(ends.where(~of("name").startswith("-")).select("name", F.struct(F.lit("needed").alias("kind"), of("name").alias("what")).alias("value")))
    ids = prefix.numbered(ends.unionByName(held.select("name")).distinct(), [F.col("name")], "node")
    src, dst = (ids.withColumnsRenamed({"name": c, "node": f"_{c}"}) for c in ("src", "dst"))
    numbered = edges.join(src, "src").join(dst, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    part_of, sets = reach.gathered(numbered, values.join(ids, "name").select("node", "value"))
    got = roots.join(ids, "name").join(part_of, "node").join(sets, "component", "left")
    is_needed = (F.col("value.kind") == "needed") & (F.col("value.what") != of("name"))
    out = got.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("value.kind") == "variable", F.col("value.what")))).alias("variables"), F.collect_set(F.when(is_needed, F.col("value.what"))).alias("needed"))
    return out.select(F.split("name", "\x1f")[0].alias("locale"), of("name").alias("name"), "variables", "needed")


def reconcile(keys: DataFrame, entries: DataFrame, o: Options) -> DataFrame:
    """(locale, key, status): added, moved, updated, same, kept or commented."""
    spark = keys.sparkSession
    locales = spark.createDataFrame([(x,) for x in o.locales], "locale string")
    code = keys.select("key", "path", F.array_sort("kwargs").alias("kwargs"), F.col("unknown_at").isNotNull().alias("unknown")).crossJoin(F.broadcast(locales))
    stored = entries.where("entry_type = 'message'").select("locale", F.col("name").alias("key"), "path", "comment")
    held = variables(entries).withColumnRenamed("name", "key")
    stored = stored.join(held, ["locale", "key"]).select("locale", "key", "path", F.col("variables").alias("kwargs"), "needed", "comment")
    # a key whose kwargs nobody can know, or whose marker says so, is compared by path only
    hush = stored.where(T.marker_covers(F.col("comment"), "kwargs", o.marker)).select("locale", "key").withColumn("_hush", F.lit(True))
    c = code.join(stored.select("locale", "key", F.col("kwargs").alias("_stored")), ["locale", "key"], "left").join(hush, ["locale", "key"], "left")
    code = c.select("locale", "key", "path", F.when(F.col("unknown") | F.col("_hush"), F.coalesce("_stored", "kwargs")).otherwise(F.col("kwargs")).alias("kwargs"))
    used = stored.join(code.select("locale", "key"), ["locale", "key"], "left_semi").select("locale", F.explode("needed").alias("key"))
    marked = stored.where(T.marker_covers(F.col("comment"), "stale", o.marker))
    keep = used.unionByName(marked.select("locale", "key")).unionByName(marked.select("locale", F.explode("needed").alias("key")))
    return R.reconcile(code, stored.select("locale", "key", "path", "kwargs"), keep)


def rendered(keys: DataFrame, entries: DataFrame, status: DataFrame, o: Options) -> DataFrame:
    """(locale, path, content): the catalogue files after reconciliation.

    Entries keep their places, commented ones too; new ones follow, by key. A
    comment stands between blank lines, but for the start of a file. A file
    without any entry is left alone.
    """
    commenting = o.comment_mode == "comment"
    of = lambda kinds: status.where(F.col("status").isin(*kinds)).select("locale", F.col("key").alias("name"))
    gone = ("commented", "moved", "updated")
    named = entries.where("entry_type in ('message', 'term')")
    dropped = named.where("entry_type = 'message'").join(of(gone), ["locale", "name"], "left_semi")
    stay = named.join(of(gone), ["locale", "name"], "left_anti").unionByName(entries.where("entry_type = 'term'").join(of(gone), ["locale", "name"], "left_semi"))
    note = F.when(F.col("comment").isNotNull(), F.concat(F.array_join(F.transform(F.split("comment", "\n"), lambda x: F.rtrim(F.concat(F.lit("# "), x))), "\n"), F.lit("\n"))).otherwise("")
    full, line = F.concat(note, "text"), lambda c: F.concat(c, F.lit("\n"))
    apart = lambda c: F.concat(F.lit("\n"), c, F.lit("\n\n"))
    row = lambda df, text: df.select("locale", "path", "position", F.col("name").alias("tie"), text.alias("text"), F.lit(True).alias("entry"))
    new = status.where(F.col("status").isin("added", "moved", "updated") if commenting else F.col("status") == "added").join(keys, "key")
    new = new.select("locale", "path", F.lit(1 << 30).alias("position"), F.col("key").alias("name"), F.concat("key", F.lit(" = "), T.placeholder_text(F.col("key"), F.col("kwargs"))).alias("text"))
    free = entries.where("entry_type = 'comment'").select("locale", "path", "position", F.lit("").alias("tie"), apart(F.col("text")).alias("text"), F.lit(False).alias("entry"))
    out = row(stay, line(full)).unionByName(row(dropped, apart(T.commented(full)) if commenting else line(full))).unionByName(row(new, line(F.col("text")))).unionByName(free)
    files = R.serialized(out, ["locale", "path"], ["position", "tie"], "text", "", F.max("entry").alias("entries")).where("entries")
    body = F.regexp_replace("content", "^\n", "")
    return files.select("locale", "path", T.line_endings(body, o.line_endings).alias("content"))


def read_catalogues(spark: SparkSession, root: str, o: Options) -> DataFrame:
    """(locale, path, text, error) of the files of each locale's folder; a folder that isn't there yet has none."""
    out = None
    for lang in o.locales:
        one = tree.tree(spark, f"{root}/{lang}", ".ftl", (), (".ignore", ".gitignore")).select(F.lit(lang).alias("locale"), "path", "text", "error")
        out = one if out is None else out.unionByName(one)
    return out


def defined_twice(stored: DataFrame) -> DataFrame:
    """(message) for each message or term that a locale defines more than once, with all places."""
    rows = M.duplicates(stored.where("name is not null").withColumn("at", F.struct(T.path_components(F.col("path")).alias("parts"), "position", "path")), ["locale", "name"], "at")
    places = F.transform(F.array_sort(F.collect_list("at")), lambda x: F.concat("locale", F.lit("/"), x["path"], F.lit(":"), x["position"].cast("string")))
    x = rows.groupBy("locale", "name").agg(places.alias("places"))
    listed = F.concat(F.array_join(F.slice("places", 1, F.size("places") - 1), ", "), F.lit(" and "), F.element_at("places", -1))
    return x.select(F.concat(F.lit("Fluent key "), "name", F.lit(" is defined more than once in locale "), "locale", F.lit(": "), listed).alias("message"))


@dataclass
class Outcome:
    exit: int
    problems: int = 0
    messages: list[str] = field(default_factory=list)  # the first problems
    warnings: list[str] = field(default_factory=list)
    py_files: int = 0
    keys: int = 0
    ftl_files: dict[str, int] = field(default_factory=dict)
    statistics: dict[str, dict] = field(default_factory=dict)
    written: int = 0


def run(spark: SparkSession, code: str, locales: str, o: Options) -> Outcome:
    """Extract, reconcile and write. Nothing is written if the sources or the catalogues have problems."""
    held: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    try:
        return _run(spark, code, locales, o, kept)
    finally:
        for df in held:
            df.unpersist()


def _run(spark: SparkSession, code: str, locales: str, o: Options, kept: Callable[[DataFrame], DataFrame]) -> Outcome:
    e = extract(read_code(spark, code, o), o, kept)
    n, first, skipped = gate(e, o)
    if n:
        return Outcome(1, n, first)
    e.keys = kept(e.keys)
    there = kept(read_catalogues(spark, locales, o))
    stored = kept(fluent.entries(there.where("error is null")))
    at = F.concat_ws("/", F.lit(locales), "locale", "path")
    bad = stored.where("error is not null").select(F.concat(F.lit("Failed to parse FTL file "), at, F.lit(":"), "error").alias("message"))
    unread = there.where("error is not null").select(F.concat(F.lit("Failed to read FTL file "), at, F.lit(": "), "error").alias("message"))
    wrong = kept(bad.unionByName(unread).unionByName(defined_twice(stored)))
    n = wrong.count()
    if n:
        return Outcome(1, n, [r[0] for r in wrong.orderBy("message").limit(SHOWN).collect()])
    status = kept(reconcile(e.keys, stored, o))
    commenting = o.comment_mode == "comment"
    zero = {"stored": 0, "updated": 0, "added": 0, "commented": 0}
    stats = {x: dict(zero) for x in o.locales} | {r["locale"]: {k: r[k] for k in zero} for r in R.statistics(status, commenting).collect()}
    out = Outcome(0, 0, [], [f"Skipping Python file: {x}" for x in skipped], e.files.count(), e.keys.count(), {x: 0 for x in o.locales} | {r["locale"]: r["count"] for r in there.groupBy("locale").count().collect()}, stats)
    if not commenting:
        stays = stored.where("entry_type = 'message'").join(status.where("status in ('commented', 'moved', 'updated')").select("locale", F.col("key").alias("name")), ["locale", "name"], "left_semi")
        out.warnings += [f"Key `{r['name']}` in `{locales}/{r['locale']}/{r['path']}` is not in code (kwargs mismatch or missing)." for r in stays.orderBy("locale", "path", "position").limit(SHOWN).collect()]
    files = rendered(e.keys, stored, status, o).select(F.concat_ws("/", "locale", "path").alias("path"), "content")
    changed = kept(files.join(there.select(F.concat_ws("/", "locale", "path").alias("path"), F.col("text").alias("content")), ["path", "content"], "left_anti"))
    if not o.dry_run:
        out.written = changed.count()
        if out.written:
            tree.write_tree(changed, locales)
    return out
