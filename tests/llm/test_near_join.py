"""The n-gram Jaccard join against all pairs of string shingles."""

import random
import re

import numpy as np
import pytest

from strandline.llm import near_join, queries
from strandline.llm.components import connected_components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((doc, len(sets[k]), least.get(find(k)), links[k]) for k, (doc, _) in enumerate(rows)), key=str)


def test_all_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op3_ngram_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_dense_groups_over_blocks(spark, monkeypatch, orders):
    monkeypatch.setattr(near_join, "BLOCK_DOCS", 7)
    rng = random.Random(orders)
    rows, vocabulary = [], [f"w{i}" for i in range(40)]
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 90]))]
        for _ in range(rng.choice([1, 12, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else "\t".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (None, rows[0][1]), (None, "alone here"), rows[3], rows[3], (len(rows) + 9, "a b " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, token string")
    got = near_join.similar_documents(df, orders=orders)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert near_join.similar_documents(df.limit(0)).count() == 0


def test_prefixes_hold_a_common_token():
    rng = np.random.default_rng(5)
    pool = near_join.W.mix(np.arange(400, dtype=np.uint64))
    tokens, times = np.sort(pool[:60]), rng.integers(4, 50, 60).astype(np.uint8)
    for _ in range(300):
        a = np.sort(rng.choice(pool, rng.integers(1, 120), replace=False))
        b = a.copy()
        b = np.unique(np.where(rng.random(len(b)) < 0.08, rng.choice(pool, len(b)), b))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            for order in range(3):
                assert len(np.intersect1d(near_join.prefix(a, tokens, times, order), near_join.prefix(b, tokens, times, order)))


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, k).astype(np.uint64)) for k in (1, 5, 30, 60, 80)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_join.overlaps(sets).tolist() == want


def test_chains_in_two_steps_join_what_one_would():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = 80
        token, node = rng.integers(0, 6, rows).astype(np.uint64), rng.integers(0, 60, rows)
        size = (10 * 1.13 ** (np.arange(60) % 17)).astype(np.int64)[rng.permutation(60)]
        n = size[node]

        def roots(pairs):
            root = list(range(60))
            for _ in range(60):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        want = [(int(node[i]), int(node[j])) for i in range(rows) for j in range(rows) if token[i] == token[j] and 100 * n[i] >= 85 * n[j] and n[i] <= n[j]]
        pairs, kept = [], []
        for part in np.array_split(np.arange(rows), 3):
            a, b, stay = near_join.chains(token[part], node[part], n[part], 85)
            pairs += zip(a.tolist(), b.tolist(), strict=True)
            kept.append(part[stay])
        kept = np.concatenate(kept)
        a, b, _ = near_join.chains(token[kept], node[kept], n[kept], 85)
        assert roots(pairs + list(zip(a.tolist(), b.tolist(), strict=True))) == roots(want)


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        base = near_join.W.mix(rng.integers(0, 1 << 60, rng.integers(1, 300)).astype(np.uint64))
        for _ in range(6):
            sets.append(np.unique(np.where(rng.random(len(base)) < rng.choice([0.0, 0.03, 0.1]), near_join.W.mix(rng.integers(0, 1 << 60, len(base)).astype(np.uint64)), base)))
    n = np.array([len(x) for x in sets])
    both = near_join.overlaps(sets)
    linked = 100 * both >= 85 * (n[:, None] + n[None, :] - both)
    may = near_join.may_link([near_join.sketch(x) for x in sets], n, 85)
    assert (may | ~linked).all()
    assert may.sum() < len(sets) ** 2 / 4


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (7, "other words here now"), (None, "a b c d e f"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_join.keep_one(df)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, 8, None]
    assert kept.columns == df.columns


def test_keep_one_of_repeated_rows_and_ids(spark):
    t, u = "a b c d e f g", "other words stand here alone"
    rows = [(5, t, "x", 1), (5, t, "x", 1), (9, t, "x", 2), (3, u, "y", 3), (4, u, "y", 4), (4, t, "z", 5), (4, "third text of the id four", "z", 6)]
    rows += [(7, None, "n", 7), (7, None, "n", 7), (8, " \n", "n", 8), (None, t, "n", 9), (None, t, "n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, times int").repartition(3)
    kept = near_join.keep_one(df)
    assert kept.columns == df.columns
    want = [(4, t, "z", 5), (3, u, "y", 3), (4, "third text of the id four", "z", 6), *rows[7:]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    twice = near_join.keep_one(df.filter("doc_id = 5")).collect()
    assert [tuple(r) for r in twice] == [(5, t, "x", 1)]
    assert near_join.keep_one(df.limit(0)).count() == 0


def test_names_of_many_sets_at_once():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (1, 2, 50, 3)]
    bounds = np.cumsum([0, *map(len, sets)])
    assert near_join.names_of(np.concatenate(sets), bounds).tolist() == [near_join.node_of(x) for x in sets]
    assert near_join.node_of(sets[2]) != near_join.node_of(sets[2][1:])


def test_pairs_pass_only_if_they_share_a_token_under_every_order():
    rng = np.random.default_rng(7)
    tokens, classes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    base = near_join.W.mix(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(60) < p, near_join.W.mix(rng.integers(0, 1 << 60, 60).astype(np.uint64)), base)) for p in (0, 0.03, 0.1, 0.5, 0.8, 0.9, 0.95, 1)]
    filters = [[near_join.prefix(x, tokens, classes, order) for order in range(2)] for x in sets]
    payloads = [near_join.sketch(x) + np.concatenate(f).astype(np.uint32).tobytes() for x, f in zip(sets, filters, strict=True)]
    n = np.array([len(x) for x in sets])
    got = near_join.may_pair(payloads, n, 85, 2)
    both = near_join.overlaps(sets)
    for i in range(len(sets)):
        for j in range(len(sets)):
            share = all(len(np.intersect1d(filters[i][o], filters[j][o])) for o in range(2))
            assert not got[i, j] or (share and i != j)
            if i != j and 100 * both[i, j] >= 85 * (n[i] + n[j] - both[i, j]):
                assert got[i, j]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 9), (5, 4), (5, 4), (4, 6)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + k, 201 + k) for k in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} | {100 + k: 100 for k in range(50)} | {200 + k: 200 for k in range(41)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counted_tokens_sort_first(spark):
    """Tokens of other tasks' texts count too, so that a text's prefix is of tokens that no other text holds."""
    own = {k: [f"own{k}x{i}" for i in range(60)] for k in range(8)}
    rows = [(k, " ".join([*own[k], *(f"both{k // 2}x{i}" for i in range(60))])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, _, counts = near_join._members(df.select("text"), 4, 85)
    sets = [own for _, own in near_join.text_sets(near_join.pa.array([r[1] for r in rows]))]
    tokens, times = np.unique(np.concatenate(sets), return_counts=True)
    ranks = near_join.W.mix(tokens ^ near_join.W.U(near_join._SEEDS[0])) >> near_join.W.U(8)
    counted, tiers = counts.tiers(ranks)
    assert len(counted) and (tiers[times[counted] == 2] == near_join._TIMES[2]).all() and (tiers == 0).sum() > 0.9 * (times[counted] == 1).sum()
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    prefixes = [near_join.prefix(x, *nothing, 0, 85, counts) for x in sets]
    shared = [len(np.intersect1d(prefixes[k], prefixes[k + 1])) for k in range(0, 8, 2)]
    plain = [len(np.intersect1d(near_join.prefix(sets[k], *nothing, 0), near_join.prefix(sets[k + 1], *nothing, 0))) for k in range(0, 8, 2)]
    assert sum(shared) < sum(plain)
