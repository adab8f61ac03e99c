"""Message catalogues of a web site's pages, and what each locale lacks.

Reads pages (page_id, url, html). Every link to a named target is an occurrence
of a message: its key is the target, its text what the page shows; the page's
locale stands in its url, and ordered ignore rules decide which urls count. Each
key's text in a locale is that of its earliest occurrence. The catalogue of every
locale is then reconciled with the one of the source locale.

Writes, each time as a whole and so with the same result however often it runs,
  <out>/messages  key, text, first_page, occurrences, variants by locale
  <out>/status    key, status, text, source_text, first_page, occurrences, variants by locale
where status is source, missing, stale (not in the source locale), untranslated
(the source's text) or translated. variants counts the different texts of a key
in a locale; with stop_on_conflicts nothing more than the messages is written if
any key of the source locale has several.

    python -m jobs.page_catalogue --pages PATH --out PATH [--config FILE]
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tessella.operators import merge, reconcile
from tessella.operators.counters import Counters
from tessella.sources.ignore import Rule, verdict

STATUS = {"added": "missing", "commented": "stale", "same": "untranslated", "updated": "translated"}
CONFLICTS, DONE = 1, 0


def unescaped(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def occurrences(pages: DataFrame, config: dict) -> DataFrame:
    """(locale, key, text, page_id, ordinal) of all links, in the order of a page."""
    rules = [Rule(r["pattern"], r["ignore"]) for r in config["ignore"]]
    locale = F.regexp_extract("url", config["locale"], 1)
    kept = pages.where(F.coalesce(verdict(F.col("url"), rules), F.lit("keep")) == "keep").where(F.col("html").isNotNull())
    both = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(config["message"]), F.lit(i)).alias(n) for i, n in ((1, "key"), (2, "text"))])
    x = kept.select("page_id", F.when(locale != "", locale).otherwise("und").alias("locale"), F.posexplode(both).alias("ordinal", "m"))
    x = x.select("locale", F.lower(F.trim("m.key")).alias("key"), F.trim(unescaped(F.col("m.text"))).alias("text"), "page_id", "ordinal")
    return x.where("key <> '' and text <> ''")


def messages(found: DataFrame) -> DataFrame:
    """One row for each locale and key: the earliest text, where it is, and how many there are."""
    place = F.struct("page_id", "ordinal", "text")
    one = merge.merge_occurrences(found, ["locale", "key"], F.lit(False), place, F.col("text"), F.lit(""), {"variants": F.count_distinct("text")})
    return one.select("locale", "key", F.col("kwargs").alias("text"), F.col("location.page_id").alias("first_page"), "occurrences", "variants")


def statuses(catalogue: DataFrame, source: str) -> DataFrame:
    """The status of every key of the source locale in every other one, and of their own keys."""
    own = catalogue.where(F.col("locale") == source)
    others = catalogue.where(F.col("locale") != source)
    side = lambda x: x.select("locale", "key", F.lit("").alias("path"), F.col("text").alias("kwargs"))
    # as many locales as the pattern of two letters allows
    wanted = side(own).drop("locale").crossJoin(F.broadcast(others.select("locale").distinct()))
    judged = reconcile.reconcile(wanted, side(others))
    said = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    x = judged.select("locale", "key", said[F.col("status")].alias("status")).unionByName(own.select("locale", "key", F.lit("source").alias("status")))
    x = x.join(catalogue, ["locale", "key"], "left").join(own.select("key", F.col("text").alias("source_text")), "key", "left")
    return x.select("locale", "key", "status", "text", "source_text", "first_page", "occurrences", "variants")


def written(df: DataFrame, path: str, files: int) -> DataFrame:
    """Replace the table at path, by locale with a few files each, and read it back."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, "locale", F.pmod(F.xxhash64("key"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("locale").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, config: dict, pages: str, out: str) -> int:
    counts = Counters()
    found = counts.tap(occurrences(counts.tap(spark.read.parquet(pages), "pages"), config), "occurrences")
    catalogue = written(messages(found), f"{out}/messages", config["files_per_locale"])
    seen = counts.read()
    # without any occurrence adaptive execution drops the taps
    n_pages = seen["pages"]["rows"] if seen["pages"] else spark.read.parquet(pages).count()
    log.info("read %d pages of %s: %d occurrences of messages", n_pages, pages, seen["occurrences"]["rows"] if seen["occurrences"] else 0)
    for r in catalogue.groupBy("locale").agg(F.count(F.lit(1)).alias("keys"), F.sum("occurrences").alias("n")).orderBy("locale").collect():
        log.info("wrote %s/messages: locale %s has %d keys in %d occurrences", out, r["locale"], r["keys"], r["n"])
    several = catalogue.where((F.col("locale") == config["source_locale"]) & (F.col("variants") > 1))
    n = several.count()
    for r in several.orderBy(F.desc("variants"), "key").limit(5).collect():
        log.warning("key `%s` has %d texts in %s, the first on page %s", r["key"], r["variants"], r["locale"], r["first_page"])
    if n and config["stop_on_conflicts"]:
        log.error("%d keys of the source locale have several texts; no status is written", n)
        return CONFLICTS
    status = written(statuses(catalogue, config["source_locale"]), f"{out}/status", config["files_per_locale"])
    for r in status.groupBy("locale").pivot("status", ["source", *STATUS.values()]).count().na.fill(0).orderBy("locale").collect():
        log.info("wrote %s/status: %s", out, r.asDict())
    return DONE


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/status").select("locale", "key", "status", "text", "source_text", "first_page", "occurrences", "variants")


if __name__ == "__main__":
    sys.exit(command_line("page_catalogue", "page_catalogue.json", {"pages": "a Parquet table of page_id, url, html", "out": "the folder for messages and status"}, run))
