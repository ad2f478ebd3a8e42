"""Verbatim runs of words across documents, against all windows."""

import random

from strandline.llm import passages, queries, spans

SF = "/root/testdata/sf0.01"


def brute(rows, run):
    """(doc, word) of every word in a window that another document holds."""
    held, words = {}, {}
    for doc, text in rows:
        words[doc] = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        for k in range(len(words[doc]) - run + 1):
            held.setdefault(tuple(words[doc][k : k + run]), set()).add(doc)
    return {(doc, k + j) for doc, own in words.items() for k in range(len(own) - run + 1) if len(held[tuple(own[k : k + run])]) > 1 for j in range(run)}


def covered(texts, rows):
    out = set()
    for r in rows:
        first = len(texts[r.doc_id][: r.start].split())
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words
        out |= {(r.doc_id, first + j) for j in range(r.n_words)}
    return out


def test_passages_over_short_lines_and_inside_long_ones(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    wrapped, inner = [line(11) for _ in range(6)], line(55)
    rows = [(k, line(rng.randrange(1, 120))) for k in range(10)]
    rows += [(10, line(30) + "\n" + "\n".join(wrapped)), (11, "\n".join(wrapped) + "\n" + line(7)), (12, " ".join(wrapped).upper().replace("É", "é"))]
    rows += [(20, f"{line(80)} {inner} {line(90)}"), (21, f"{line(5)} {inner} {line(40)}"), (22, None), (23, ""), (24, inner.replace(" ", "  ", 1))]
    rows += [(30, " ".join(wrapped[:4])), (31, "x " * 3000), (32, "x " * 3000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(df).filter("paragraph is null").collect()
    assert covered(dict(rows), got) == brute(rows, passages.MIN_WORDS)
    assert {r.doc_id: (r.cluster, r.removed) for r in got} == {10: (10, False), 11: (10, True), 20: (20, False), 21: (20, True), 24: (20, True), 31: (31, False), 32: (31, True), 12: (10, True)}
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_documents_equal_all_windows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in queries.op6_substring_dedup(spark, SF).collect() if r.paragraph is None]
    want = brute(docs, passages.MIN_WORDS)
    assert want and covered(dict(docs), rows) == want


def test_null_ids_and_repeated_rows(spark):
    text = "\n".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(None, text), (3, "a\n" + text), (3, "a\n" + text), (3, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.cluster, r.removed) for r in spans.repeated_spans(df).collect())
    assert got == [("3", 50, None, True), ("3", 50, None, True), ("None", 50, None, False)]
    assert spans.repeated_spans(df.filter("doc_id = 3")).count() == 0
