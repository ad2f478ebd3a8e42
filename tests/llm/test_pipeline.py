"""The corpus pipeline against its stages done by brute force."""

import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import language_id, secrets, token_ids
from strandline.llm.common import held_out
from tests.llm.brute import contamination
from tests.llm.test_near_join import brute

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for a, b, _ in secrets.find_spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = language_id.predict(docs, language_id.fit(docs.filter(~held_out()))).collect()
    left = [(r.doc_id, r.text) for r in judged if r.familiar]
    groups = brute(left, width=corpus_pipeline.SHINGLE_WORDS, percent=corpus_pipeline.SIMILAR_PERCENT)
    gone = {r[0] for r in groups if r[0] != r[2]}
    left = [r for r in left if r[0] not in gone]
    dirty = {r[0] for r in contamination(left, bench) if r[5]}
    left = [(d, masked(t)) for d, t in left if d not in dirty]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ids.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {d: library.encode_ordinary(t) for d, t in left}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in rows} == want
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in left}
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert gone and dirty and len(want) > 100


def test_stages_keep_the_columns_of_odd_documents(spark):
    key = "password=hunter2hunter2"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "plain words of english text here " + key, "en", "s", 5), (3, "plain words of english text here " + key, "en", "s", 5), (None, "another text with words and more words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert k == 4 or out.columns == docs.columns
            assert out.count() >= (table is docs)
    clash = docs.withColumnsRenamed({"source": "lang_pred", "lang": "node"}).withColumns({"score": F.lit(7), "secrets": F.lit("x"), "n_hit": F.lit(8), "items": F.lit(9)})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and {(r.score, r.secrets, r.n_hit, r["items"]) for r in out.collect()} == {(7, "x", 8, 9)}
    kept = corpus_pipeline.known_language(spark, docs.withColumns({"lang_pred": F.lit("mine"), "score": F.lit(7)}), SF)
    assert {(r.lang_pred, r.score) for r in kept.collect()} == {("mine", 7)}
    assert corpus_pipeline.without_near_copies(spark, docs, SF).filter("doc_id = 3").count() == 1
    cleaned = corpus_pipeline.without_secrets(spark, docs, SF).filter("doc_id = 3").select("text", "n_chars").distinct().collect()
    assert [tuple(r) for r in cleaned] == [("plain words of english text here [SECRET]", len("plain words of english text here [SECRET]"))]
    assert corpus_pipeline.known_language(spark, docs, SF).filter(F.col("doc_id").isin(1, 2)).count() == 0
    assert re.match("[a-z_]+$", "_".join(name for name, _ in corpus_pipeline.STAGES))
