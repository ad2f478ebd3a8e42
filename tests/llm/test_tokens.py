"""Byte-level BPE against the tiktoken library, and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import queries, token_ids, token_store

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RARE = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \nb", "a\n \nb", "x  y", "it's I'LL we've 'tis", "1234 ½ Ⅳ ٣", "漢字かな交じり文", "𝒳𐐷 😀😀", "ǅ՘࢏", "<|endoftext|> a<|endoftext|>b", "a, b. c.. d,. ǅ, ՘, ֈ. é. 1. x.\ny, z,",
    "a" * 1000, "!?" * 400, "é" * 300, "ab" * 64, "word " * 3000, "\x1c \x85x", "  a 　b", "tab\tand\rmore \x0b x", "x" * 128 + " " + "y" * 129, "\x00\x01", " a  b\n", " c d\n", " e\n\n",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ids.load_ranks(RANKS), special_tokens={})


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_all_documents_equal_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, docs[r.doc_id])


def test_rare_texts_and_round_trip(spark, library, monkeypatch):
    rng = random.Random(2)
    texts = RARE + ["".join(rng.choice("ab é\n 's1漢.") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(k if k % 50 else None, t, "x", [1]) for k, t in enumerate(texts)], "doc_id long, text string, words string, ids array<int>")
    rows = token_ids.encode(df, RANKS, public_tokenizers.PATTERN)
    assert rows.columns == ["doc_id", "ids"]
    ids = {r.doc_id: r.ids for r in rows.filter("doc_id is not null").collect()}
    assert all(ids[k] == library.encode_ordinary(t or "") for k, t in enumerate(texts) if k % 50)
    back = {r.doc_id: bytes(r.decoded).decode() for r in token_ids.decode(rows, RANKS).filter("doc_id is not null").collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts) if k % 50)
    assert token_ids.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    both = token_ids.encode(df, RANKS, public_tokenizers.PATTERN, make=token_ids.Decoded).filter("doc_id is not null").collect()
    assert all((r.ids, r.decoded_sha256) == (ids[r.doc_id], hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()) for r in both)
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [0, 10**6])], "doc_id long, ids array<int>")
    assert [r.decoded for r in token_ids.decode(nothing, RANKS).orderBy("doc_id").collect()] == [None, b"", next(k for k, v in token_ids.load_ranks(RANKS).items() if v == 0)]


def test_the_sessions_batches_stay_as_they_were(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    token_ids.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()
    assert spark.conf.get(name) == before


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aab \n\t'sé1漢! "), max_size=40))
def test_units_split_as_the_whole(text):
    find = token_ids.regex.compile(public_tokenizers.PATTERN).findall
    assert [w for u in token_ids.units_of(pa.array([text]))[0] for w in find(u)] == find(text)



@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("aбé ", max_size=60).map(str.encode))
def test_heap_merges_in_rank_order(word):
    ranks = token_ids.load_ranks(RANKS)
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert token_ids.merge_by_heap(word, ranks) == [ranks[p] for p in parts]


def test_a_task_that_begins_anew(spark, library, monkeypatch):
    monkeypatch.setattr(token_ids, "WORDS_HELD", 5)
    ranks = token_ids.load_ranks(RANKS)
    texts = [f"one two {k % 7} three{k % 13}" for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = token_ids.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert ranks and all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in rows) and len(rows) == 1000


# token files
def plain(rows, tokenizer):
    out, before = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_all_documents_come_back(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op7_token_store(spark, SF).collect())
    assert got == plain(docs, Tokenizer.from_file(JSON))


def test_files_index_and_rare_texts(spark, tmp_path):
    texts = list(enumerate(RARE * 3))
    df = spark.createDataFrame([*((k, t, "clash") for k, t in texts), (None, "no id", "x")], "doc_id long, text string, tokens string").repartition(3)
    folder, dictionary, files = token_store.write_ids(df, JSON, 2, f"file://{tmp_path}/ids", file_bytes=2000)
    assert len(files) > 3
    got = sorted((tuple(r) for r in token_store.read_ids(spark, dictionary, files).collect()), key=lambda r: r[1])
    assert got == plain([*texts, (None, "no id")], Tokenizer.from_file(JSON))
    reader = token_store.Reader(files[1][0], dictionary)
    place = len(reader.index) // 2
    some = int(reader.index["id"][place])
    assert reader.find(some).tolist() == [*Tokenizer.from_file(JSON).encode(dict(texts)[some] or "", add_special_tokens=False).ids, 2]
    assert reader.find(10**9) is None
    with pytest.raises(ValueError):
        token_store.Reader(files[0][0], b"another dictionary")
    _, _, none = token_store.write_ids(df.limit(0), JSON, 2, f"file://{tmp_path}/none")
    assert none == [] and token_store.read_ids(spark, b"", none).count() == 0
    assert folder == f"file://{tmp_path}/ids"


def test_one_id_over_many_files_and_long_texts_in_the_sample(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["one", "two", "three", "vier"]) for _ in range(n))
    rows = [(7 if k % 3 else None, text(6000)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, dictionary, files = token_store.write_ids(df, JSON, 2, f"file://{tmp_path}/ids", file_bytes=100_000)
    assert len(files) > 8 and max(f[1] for f in files) < 20 and dictionary
    got = sorted((tuple(r) for r in token_store.read_ids(spark, dictionary, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 20 + [7] * 40
    tokenizer = Tokenizer.from_file(JSON)
    assert sorted(r[3] for r in got) == sorted(r[3] for r in plain(rows, tokenizer))


def test_repeated_ids_follow_each_other(spark, tmp_path):
    df = spark.createDataFrame([(7, "a b"), (7, "a b"), (3, "c")] * 5, "doc_id long, text string")
    _, dictionary, files = token_store.write_ids(df, JSON, 2, f"file://{tmp_path}/ids")
    got = sorted((tuple(r) for r in token_store.read_ids(spark, dictionary, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [3] * 5 + [7] * 10
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])


def test_few_units_and_rows_at_once(spark, tmp_path, monkeypatch):
    """The tokenizer's results and Arrow's batches stay small however many texts there are."""
    with open(JSON) as f:
        encoder = token_store.UnitEncoder(f.read(), np.dtype("<u2"))
    real, sizes = encoder.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, **options)

    encoder.tokenizer = Spy()
    texts = [f"x{k}y w{k}" for k in range(5000)]
    got = encoder.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in real.encode_batch_fast(texts, add_special_tokens=False)]
    assert max(sizes) <= 4096
    seen, limit = [], token_store.batches_of
    monkeypatch.setattr(token_store, "batches_of", lambda session, rows: seen.append(rows) or limit(session, rows))
    token_store.write_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), JSON, 2, f"file://{tmp_path}/ids")
    assert seen == [token_store.PART_ROWS]
