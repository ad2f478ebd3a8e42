"""Repeated paragraphs against all pairs, and their removal."""

import random

import numpy as np
import pytest

from strandline.llm import passages, queries
from tests.llm.test_near_join import shingles

SF = "/root/testdata/sf0.01"


def brute(rows, min_words, width=5, percent=80):
    found = [(doc, k, line, shingles(line, width)) for doc, text in rows for k, line in enumerate((text or "").split("\n")) if len(line.split()) >= min_words]
    root = list(range(len(found)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][3], found[j][3]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for k, x in enumerate(found):
        groups.setdefault(find(k), []).append(x)
    out = []
    for own in groups.values():
        if len({x[0] for x in own}) > 1:
            first = min((x[0], x[1]) for x in own)
            out += [(doc, k, len(line.split()), first[0], (doc, k) != first) for doc, k, line, _ in own]
    return sorted(set(out))


def test_documents_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in queries.op6_substring_dedup(spark, SF).collect() if r.paragraph is not None]  # spans have a test of their own
    texts = dict(docs)
    got = sorted((r.doc_id, r.paragraph, r.n_words, r.cluster, r.removed) for r in rows)
    want = brute(docs, passages.MIN_WORDS)
    assert want and len(set(got) & set(want)) >= 0.99 * len(want)
    assert {g[:3] for g in got} <= {w[:3] for w in want}
    for r in rows:
        assert texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph]


def test_planted_passages_and_odd_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    rows = []
    for doc in range(40):
        lines = [line(rng.randrange(1, 90)) for _ in range(rng.randrange(1, 6))]
        if doc % 4 == 0:
            own = passage.split(" ")
            if doc % 8:
                own[rng.randrange(60)] = "changed"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(own))
        rows.append((doc, "\n".join(lines)))
    twice = line(50)
    rows += [(50, twice + "\n" + twice), (51, None), (52, ""), (53, "\n\n"), (54, "x " * 100_000), (55, "x " * 100_000 + "\n")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, node string, paragraph int").repartition(3)
    got = passages.repeated_paragraphs(df)
    want = brute(rows, passages.MIN_WORDS)
    assert sorted((r.doc_id, r.paragraph, r.n_words, r.cluster, r.removed) for r in got.collect()) == want
    assert {w[0] for w in want} == {*range(0, 40, 4), 54, 55}
    assert passages.repeated_paragraphs(df.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in passages.remove_repeats(df).collect()}
    assert passages.remove_repeats(df).columns == df.columns
    texts = dict(rows)
    for doc, text in texts.items():
        gone = {w[1] for w in want if w[0] == doc and w[4]}
        kept = text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert left[doc] == (kept if doc != 55 else "")  # the last one also repeats across its line break


def test_lines_and_spans_are_taken_out(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    one, two, inner, wrapped = line(60), line(50), line(55), "\n".join(line(10) for _ in range(6))
    rows = [
        (1, f"{one}\n{two}\nend"), (2, f"{one}\n{two}\nc"), (3, f"a\n{one}\n{two}"), (4, f"{two}\nb\n{one}"),
        (5, f"{line(40)} {inner} y"), (6, f"front {inner} back {line(40)}"), (7, f"top\n{wrapped}\nlow"), (8, f"{wrapped}\n\nlast"), (9, one), (None, one),
    ]
    df = spark.createDataFrame([(a, b, "c0", 3) for a, b in rows], "doc_id long, text string, gone string, text_id int").repartition(2)
    left = {r.doc_id: r.text for r in passages.remove_repeats(df.filter("doc_id is not null")).collect()}
    assert left == {1: rows[0][1], 2: "c", 3: "a", 4: "b", 5: rows[4][1], 6: rows[5][1].replace(inner, ""), 7: rows[6][1], 8: "\n\nlast", 9: ""}
    kept = passages.remove_repeats(df).filter("doc_id is null").collect()
    assert [r.text for r in kept] == [one]


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(None, text), (3, "a\n" + text), (3, "a\n" + text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.paragraph, r.cluster, r.removed) for r in passages.repeated_paragraphs(df).collect()), key=str)
    assert got == [(3, 1, None, True), (3, 1, None, True), (None, 0, None, False)]
    alone = spark.createDataFrame([(3, text), (3, text)], "doc_id long, text string")
    assert passages.repeated_paragraphs(alone).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bands_meet_at_the_threshold(seed):
    rng = np.random.default_rng(seed)
    missed = 0
    for _ in range(400):
        base = passages.W.mix(rng.integers(0, 1 << 62, 60).astype(np.uint64))
        other = base.copy()
        other[:6] = passages.W.mix(rng.integers(0, 1 << 62, 6).astype(np.uint64))  # 54 of 66: 0.818
        missed += not len(np.intersect1d(passages.bands(base), passages.bands(other)))
    assert missed <= 4
