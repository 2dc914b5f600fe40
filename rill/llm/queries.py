"""The operators' named queries over the dataset tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rill.llm import html, licenses, mixing, neighbours, packing, quality, secrets, simhash, substring, toxicity
from rill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op6_quality(spark, d):
    docs = table(spark, d, "documents")
    return quality.judge(docs, quality.fit_rules(docs, table(spark, d, "labels")))


@query
def op4_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_substring(spark, d):
    return substring.remove_repeats(table(spark, d, "documents"))


ORACLES["op9_substring"] = r"""
with w as (
    select row_number() over () r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
), windows as (
    select r, unnest(range(1, len(ws) - 33)) s, ws from w where len(ws) >= 35
), hashed as (
    select r, s, sha256(array_to_string(ws[s:s + 34], ' ')) h from windows
), again as (
    select h from hashed group by h having count(*) > 1
), gone as (
    select r, list_distinct(flatten(list(range(s, s + 35)))) gone from hashed join again using (h) group by r
), kept as (
    select doc_id, len(ws) n, case when gone is null then ws
        else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(gone, i)), lambda i: ws[i]) end k
    from w left join gone using (r)
)
select doc_id, n::bigint n_words, (n - len(k))::bigint n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from kept
"""


@query
def op1_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query
def op7_secrets(spark, d):
    return secrets.scan(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_html(spark, d):
    return html.extract(table(spark, d, "pages"))


@query
def op5_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "rill_mix.*")


@query
def op10_licenses(spark, d):
    return licenses.scan(table(spark, d, "documents"))


_NORMAL = (
    r"list_filter(regexp_split_to_array(regexp_replace(translate(lower(coalesce(text, '')), '" + licenses.STRIPPED.replace("'", "''")
    + r"', ''), '\.+([\x20\x09-\x0D]|$)', '\1', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
)
_SHINGLES = f"unnest(list_distinct(list_transform(range(1, len(w) - {licenses.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {licenses.SHINGLE - 1}], ' '))))"
ORACLES["op10_licenses"] = f"""
with d as (select row_number() over () r, doc_id, {_NORMAL} w from documents),
t as (select license, {_NORMAL} w from (values {', '.join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.TEMPLATES.items())}) v(license, text)),
ds as (select r, doc_id, {_SHINGLES} s from d),
ts as (select license, {_SHINGLES} s from t),
n as (select license, count(*) n from ts group by license)
select doc_id, license, count(*) n_matched, n n_shingles, count(*)::double / n containment
from ds join ts using (s) join n using (license) group by r, doc_id, license, n having count(*) >= {licenses.THRESHOLD} * n
"""


@query
def op8_neighbours(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"))


@query
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
