"""The registered queries of the training-data operators, with production parameters, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, language, packing, pii, quality_model, quality_rules, simhash, token_counts, toxicity
from .common import crc_mod, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), crc_mod(5) != 4)
    return quality_model.classify(docs, model).select("doc_id", F.coalesce(crc_mod(5) == 4, F.lit(False)).alias("held_out"), "expected_grade", "tail", "kept")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language.fit(docs, crc_mod(4) != 2)
    return language.identify(docs.select("doc_id", "text"), trees).select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(docs, pii.fit(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(3) != 1)
    return toxicity.toxicity(docs, terms, weights).select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_quality_model, op4_embedding_dedup, op5_language, op6_pii, op7_quality_rules, op8_bpe, op9_toxicity, op10_packing)}

_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_QUALITY = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
grams as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
keyed as (select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from grams),
repeated as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from keyed) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from repeated) group by r),
m as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
      cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
      len(lines) as n_lines, len(list_filter(words, lambda x: lower(x) in ({_STOP}))) as n_stop_words
      from w left join covered on w.r = covered.r),
f as (select *, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false else {" and ".join(f"({r.value}) between {r.low} and {r.high}" for r in quality_rules.RULES)} end as kept from f
"""

_UNIT = "select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings"
_EMBEDDING = f"""
with recursive v as ({_UNIT}),
ok as (select vec_id, label, norm, list_transform(embedding, lambda x: x::double) as e from v where label is not null and norm > 0 and norm < 1e300),
link as (select a.vec_id as u, b.vec_id as v from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
         where list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98),
reach as (select vec_id as u, vec_id as v from embeddings union select reach.u, link.v from reach join link on reach.v = link.u),
component as (select u, min(v) as c from reach group by u),
degree as (select u, count(*) as n from link group by u)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, vec_id = c as kept
from embeddings left join degree on vec_id = degree.u join component on vec_id = component.u
"""

ORACLE_SQL = {"op7_quality_rules": _QUALITY, "op4_embedding_dedup": _EMBEDDING}
