"""Code extraction, catalogues and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.operators import training
from tessella.operators import sample as B
from tessella.operators import score as S
from tessella.plans import extract as X
from tessella.plans.registry import query, spread, table
from tessella.sources import fluent, generated, python_code
from tessella.sources.options import Options

#: A small program of our own with the shapes that matter.
PROGRAM = '''
def start(i18n, user, _):
    i18n.get("hello-user", name=user.name)
    i18n.menu.main.title(_path="menu", count=1)
    i18n.menu.main.title(**user.data)
    L("lazy", when=True, a=1, b=2)
    self.i18n.set_locale("de")
    cls.i18n.outer(inner=i18n.get("inner", n=3))
    i18n.get(user.key)
    i18n("call-name", *user.args)
'''
CATALOGUE = """# Greeting
hello-user = Hello { $name }, { -brand }
-brand = Brand { $unused }
menu-main-title = { hello-user } { $count }

### Free comment

# extract: ignore stale
old = Kept { lone }
lone = Referenced
gone = Gone
"""


def sources(spark):
    files = [(0, "app/start.py", PROGRAM, None), (1, "app/broken.py", "i18n.get('x'\n", None), (2, "app/gone.py", None, "read-error: no such file")]
    return spark.createDataFrame(files, "file_idx int, path string, text string, error string")


def made(spark, d):
    """The program above, and one made by the number of every page."""
    seeds = spread(table(spark, d, "pages").select(F.col("page_id").alias("seed")))
    return sources(spark).unionByName(generated.corpus(seeds.select((F.col("seed") + 3).alias("seed")), "seed", Options()))


@query("python_occurrences")
def python_occurrences(spark, d):
    return python_code.occurrences(made(spark, d), Options())


@query("python_candidates")
def python_candidates(spark, d):
    return python_code.candidates(made(spark, d).where("file_idx <> 1"), Options())


@query("candidate_labels")
def candidate_labels(spark, d):
    """Every occurrence with the one candidate that stands for it."""
    files = made(spark, d).where("file_idx <> 1")
    return python_code.labelled(python_code.candidates(files, Options()), python_code.occurrences(files, Options()).where("key is not null"))


@query("proxy_probe")
def proxy_probe(spark, d):
    """A linear probe on three encodings of the embeddings."""
    x = B.group_split(table(spark, d, "embeddings"), "vec_id").withColumn("y", F.col("embedding")[0] + F.col("embedding")[1] > 0)
    e = F.transform("embedding", lambda v: F.greatest(v, F.lit(0.0)).cast("double"))
    return training.probe(x, {m: S.feature_modes(e, m) for m in ("binary", "log1p", "both")}, "y", "split")


@query("extract_merged_keys")
def extract_merged_keys(spark, d):
    return X.extract(made(spark, d), Options()).keys.select("key", "kwargs", "path", "occurrences", F.col("unknown_at").isNotNull().alias("unknown"))


LINK = '<a href="/([A-Za-z][A-Za-z0-9_-]*)">([^<{}]*[^<{} ][^<{}]*)</a>'


@query(
    "fluent_entries",
    f"""with p as (select page_id, regexp_extract_all(html, '{LINK}', 1) k, regexp_extract_all(html, '{LINK}', 2) v from pages),
     e as (select page_id, unnest(range(1, len(k) + 1)) i, unnest(k) k, unnest(v) v from p)
     select 'p' || page_id path, (2 * i)::int as "position", k as name, k || ' = ' || trim(v) as "text", 'Link ' || i as "comment" from e""",
)
def fluent_entries(spark, d):
    """The links of every page, written as a catalogue of its own and read back entry by entry."""
    both = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(LINK), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "v"))])
    lines = F.transform(both, lambda x, i: F.concat(F.lit("# Link "), (i + 1).cast("string"), F.lit("\n"), x["k"], F.lit(" = "), F.trim(x["v"])))
    files = table(spark, d, "pages").where("html is not null").select(F.lit("en").alias("locale"), F.concat(F.lit("p"), "page_id").alias("path"), F.array_join(lines, "\n").alias("text"))
    return fluent.entries(files).select("path", "position", "name", "text", "comment")


@query("reconcile_catalogue")
def reconcile_catalogue(spark, d):
    o = Options()
    entries = fluent.entries(spark.createDataFrame([("en", "_default.ftl", CATALOGUE)], "locale string, path string, text string"))
    return X.reconcile(X.extract(made(spark, d), o).keys, entries, o)


@query("blake_bucket")
def blake_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.blake_bucket(F.col("p_name"), F.lit(124), F.lit("v1"), F.lit(0)).alias("bucket"))


@query("delta_rule_fit")
def delta_rule_fit(spark, d):
    """Readouts of whether each of four sums of neighbouring dimensions is positive, over all embeddings."""
    x = B.group_split(table(spark, d, "embeddings"), "vec_id").select("embedding", "split", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("wanted"))
    y = F.aggregate(F.slice("embedding", F.col("wanted") * 4 + 1, F.lit(4)), F.lit(0.0), lambda a, v: a + v) > 0
    found = training.fit(x.withColumn("y", y), "wanted", "embedding", "y", "split", rate=6.0, epochs=30, patience=30)
    return spark.createDataFrame([(k, r.epochs, round(r.f1, 6), round(float(np.abs(r.w).sum()), 6)) for k, r in found.items()], "wanted int, epochs int, f1 double, weight double")
