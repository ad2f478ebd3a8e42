"""The operators' registered queries: thin applications to the whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_id, near_join, neighbours, passages, quality, secrets, sharding, token_ids, token_store
from strandline.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.filter(~held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels.filter(~held_out()))
    scored = quality.predict(docs, network)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.similar_documents(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _, dictionary, files = token_store.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_ids(spark, dictionary, files)


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, bench))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_byte_cnn_quality, op3_ngram_jaccard_join, op4_byte_bpe, op5_secret_scan, op6_substring_dedup, op7_token_store, op8_hash_prefix_forest, op9_sharding, op10_decontamination)}

# DuckDB SQL for the joins and scans that it can express
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LENGTHS = range(1, decontaminate.WINDOW + 1)


def _words_sql(table: str, key: str, pattern: str) -> str:
    """A row for each word: its text, its number and how many there are."""
    return f"select {key}, n, unnest(w) as word, unnest(range(1, n + 1)) as i from (select {key}, w, len(w) as n from (select {key}, regexp_extract_all({_LOWER}, {pattern}) as w from {table})) where n > 0"


def _grams_sql(key: str, k: int) -> str:
    return f"string_agg(word, ' ') over (partition by {key} order by i rows between current row and {k - 1} following)"


_GRAMS = {key: ", ".join(f"{_grams_sql(key, k)} as g{k}" for k in _LENGTHS) for key in ("item_id", "doc_id")}
_PICK = "case k " + " ".join(f"when {k} then g{k}" for k in _LENGTHS) + " end"

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""with recursive words as ({_words_sql("documents", "doc_id", _SPACED)}),
grams as (select doc_id, n, i, {_grams_sql("doc_id", near_join.WIDTH)} as g from words),
shingles as (select distinct doc_id, g from grams where i + 3 <= n or (n < 4 and i = 1)),
sizes as (select doc_id, count(*) as n_shingles from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * shared >= {near_join.PERCENT} * (x.n_shingles + y.n_shingles - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from reach r join both_ways l on r.seen = l.a),
least as (select node, min(seen) as component_id from reach group by node),
degrees as (select a, count(*) as n from both_ways group by a)
select t.doc_id, coalesce(s.n_shingles, 0) as n_shingles, l.component_id, coalesce(d.n, 0) as n_links
from documents t join least l on t.doc_id = l.node left join sizes s on t.doc_id = s.doc_id left join degrees d on t.doc_id = d.a""",
    "op10_decontamination": f"""with doc_words as ({_words_sql("documents", "doc_id", _ALNUM)}), item_words as ({_words_sql("benchmark", "item_id", _ALNUM)}),
item_grams as (select cast(item_id as varchar) as item_id, least({decontaminate.WINDOW}, n) as k, n, i, {_GRAMS["item_id"]} from item_words),
windows as (select distinct item_id, k, {_PICK} as g from item_grams where i + k - 1 <= n),
doc_grams as (select doc_id, n, i, {_GRAMS["doc_id"]} from doc_words),
doc_windows as (select doc_id, i, k, {_PICK} as g from doc_grams, (select distinct k from windows) where i + k - 1 <= n),
hits as (select d.doc_id, d.i, d.k, b.item_id from doc_windows d join windows b on d.k = b.k and d.g = b.g),
hit_words as (select doc_id, count(distinct i + j - 1) as n_hit from (select distinct doc_id, i, k from hits), range(1, {decontaminate.WINDOW + 1}) r(j) where j <= k group by doc_id),
hit_items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hits group by doc_id)
select t.doc_id, len(regexp_extract_all({_LOWER}, {_ALNUM})) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items, sha256(coalesce(m.items, '')) as items_sha256, h.doc_id is not null as contaminated
from documents t left join hit_words h on t.doc_id = h.doc_id left join hit_items m on t.doc_id = m.doc_id""",
}
