"""The messages of a growing folder of documents, document by document, taking only what is new.

Reads the Parquet files that are new under <documents> (doc_id, text, lang) as a
stream that ends when it has seen all; a checkpoint knows the files of earlier
runs. Each text is cut into messages where it is read; numbers become a variable,
and a message's key is the start of its hash. What was found goes through a state
by document that keeps a fingerprint of the text, so only new and changed
documents are written; of several rows of one document the one in the file
written last counts. A document whose text is null is gone.

Appends one row for each change to <out>, by locale: doc_id, version, gone,
n_messages, n_with_variables, message_keys (distinct, sorted). A run over
nothing new writes nothing; a run that was cut off is finished by the next one.
`current` gives the last version of each document that is there.

    python -m jobs.document_messages --documents PATH --out PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tessella.streaming import incremental

COLUMNS = ["doc_id", "version", "gone", "n_messages", "n_with_variables", "message_keys", "locale"]
VARIABLE = "{ $n }"


def messages(documents: DataFrame, config: dict) -> DataFrame:
    """What each document says, in one row without its text: what goes through the state is short."""
    cut = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(config["message"]), F.lit(0)), lambda x: F.regexp_replace(F.trim(x), config["variable"], VARIABLE.replace("$", "\\$")))
    x = documents.withColumn("_m", F.filter(cut, lambda m: F.regexp_count(m, F.lit("[^ ]+")) >= config["least_words"]))
    return x.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.size("_m").cast("long").alias("n_messages"),
        F.size(F.filter("_m", lambda m: F.contains(m, F.lit(VARIABLE)))).cast("long").alias("n_with_variables"),
        F.array_sort(F.array_distinct(F.transform("_m", lambda m: F.substring(F.sha2(m, 256), 1, 16)))).alias("message_keys"),
        F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("locale"),
        F.unix_micros("_metadata.file_modification_time").alias("written"),
    )


def run(spark: SparkSession, config: dict, documents: str, out: str, checkpoint: str) -> int:
    read = spark.readStream.schema("doc_id long, text string, lang string")
    if config["files_per_trigger"]:
        read = read.option("maxFilesPerTrigger", config["files_per_trigger"])
    found = messages(read.parquet(documents), config)
    changed = incremental.changes(found, "doc_id", ["text_sha256", "locale"], F.col("written"), F.col("text_sha256").isNull())
    counted = F.count(F.lit(1)).alias("rows"), F.count_if("gone").alias("gone"), F.sum("n_messages").alias("messages")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(x: DataFrame) -> DataFrame:
        """The table's columns, dealt out so that a batch writes a few files for each locale."""
        return x.select(*COLUMNS).repartition(n, "locale", F.pmod(F.xxhash64("doc_id"), F.lit(config["files_per_locale"]))).observe("written", *counted)

    query = incremental.incremental(changed, rows, out, checkpoint, ("locale",))
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    for p in batches:
        w = p["observedMetrics"].get("written")
        log.info("batch %d: read %d rows of %s; wrote %s changes to %s, %s of them gone, %s messages", p["batchId"], p["numInputRows"], documents, *((w["rows"], out, w["gone"], w["messages"]) if w else (0, out, 0, 0)))
    if not batches:
        log.info("nothing new under %s", documents)
    return 0


def result(spark: SparkSession, out: str) -> DataFrame:
    """All changes, also those that later ones replace."""
    return spark.read.parquet(out).select(*COLUMNS)


def current(spark: SparkSession, out: str) -> DataFrame:
    return incremental.latest(spark, out, "doc_id").select(*COLUMNS)


if __name__ == "__main__":
    paths = {"documents": "a folder of Parquet files of doc_id, text, lang", "out": "the folder for the changes", "checkpoint": "the folder for the stream's checkpoint"}
    sys.exit(command_line("document_messages", "document_messages.json", paths, run))
