"""The jobs as queries: each runs its job's function twice into one new folder and reads the output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import document_messages, page_catalogue
from jobs.common import HERE, configuration, new_folder


def job1_page_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        page_catalogue.run(spark, configuration(HERE / "page_catalogue.json"), f"{sf_dir}/pages.parquet", out)
    return page_catalogue.result(spark, out)


def job2_document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job2")
    # a pattern for just this name: a stream reads a folder or a pattern, and the table may be a single file
    documents = f"{sf_dir}/documents.parque[t]"
    for _ in range(2):
        document_messages.run(spark, configuration(HERE / "document_messages.json"), documents, f"{at}/changes", f"{at}/checkpoint")
    return document_messages.result(spark, f"{at}/changes")


CATALOGUE = """
with p as (select page_id, html, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)', 1), ''), 'und') locale from pages
  where html is not null and (url is null or not regexp_matches(url, '^(?:https?://spam[^/]*/)') or regexp_matches(url, '^(?:https?://spam[^/]*/en/)'))),
 l as (select page_id, locale, regexp_extract_all(html, '<a href="/([^"<>]*)">([^<]*)</a>', 1) k, regexp_extract_all(html, '<a href="/([^"<>]*)">([^<]*)</a>', 2) t from p),
 o as (select page_id, locale, unnest(range(0, len(k))) i, unnest(k) k, unnest(t) t from l),
 q as (select page_id, locale, i, lower(trim(k)) "key", trim(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) "text" from o),
 m as (select locale, "key", arg_min("text", (page_id, i, "text")) "text", min(page_id) first_page, count(*) occurrences, count(distinct "text") variants from q where "key" <> '' and "text" <> '' group by all),
 s as (select * from m where locale = 'en'), n as (select * from m where locale <> 'en'),
 w as (select s."key", l.locale from s cross join (select distinct locale from n) l),
 j as (select coalesce(w.locale, n.locale) locale, coalesce(w."key", n."key") "key", case when n."key" is null then 'missing' when w."key" is null then 'stale' when n."text" = s."text" then 'untranslated' else 'translated' end status
  from w full join n on w.locale = n.locale and w."key" = n."key" left join s on s."key" = w."key"
  union all select locale, "key", 'source' from s)
select j.locale, j."key", j.status, m."text", s."text" source_text, m.first_page, m.occurrences, m.variants
from j left join m on m.locale = j.locale and m."key" = j."key" left join s on s."key" = j."key"
"""

MESSAGES = """
with c as (select doc_id, lang, text is null gone, [regexp_replace(trim(x), '[0-9]+', '{ $n }', 'g') for x in regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?]*')] m from documents where doc_id is not null),
 d as (select doc_id, lang, gone, [x for x in m if len(regexp_extract_all(x, '[^ ]+')) >= 3] m from c where not gone)
select doc_id, 1::bigint "version", gone, len(m)::bigint n_messages, len([x for x in m if contains(x, '{ $n }')])::bigint n_with_variables, list_sort(list_distinct([substr(sha256(x), 1, 16) for x in m])) message_keys, coalesce(nullif(lang, ''), 'und') locale from d
"""


def queries() -> dict:
    return {"job1_page_catalogue": job1_page_catalogue, "job2_document_messages": job2_document_messages}


def oracle_sql() -> dict[str, str]:
    return {"job1_page_catalogue": CATALOGUE, "job2_document_messages": MESSAGES}
