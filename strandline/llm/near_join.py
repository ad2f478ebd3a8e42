"""Exact n-gram Jaccard join by prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first n - ceil(t n) + 1 of each, whatever global
order sorts the tokens. So a pair is a candidate only if it shares a prefix token under every order: the filters are
intersected pair by pair, and what is left is verified on the whole sets. The orders put tokens that repeat most last and
break ties differently.

Pairs are looked for within cells, so that no list of pairs is ever built: under one order, linked sets lie in one
component of the graph "shares a prefix token", and under several orders in one cell of the components' intersection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import words as W
from strandline.llm.common import batches_of, materialize, releasing, remove_path, stored, text_blocks
from strandline.llm.components import connected_components

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, PERCENT = 4, 85
#: Tokens that the list of frequent tokens may hold; the list is broadcast, 9 bytes for each.
FREQUENT = 4_000_000
#: Shingles that are counted together in a task when it looks for repeated tokens.
COUNTED = 2_000_000
#: Slots of the table of counts at most, half a byte each; it is broadcast. Tokens that meet in a slot only sort later.
COUNT_SLOTS = 1 << 27
#: Documents of a block; cells beyond that are verified block against block.
BLOCK_DOCS = 256
#: Bytes of text that are hashed together; one longer text is hashed by itself.
HASHED_BYTES = 1 << 18
#: Rows of an Arrow batch, so that a task holds few texts or sets at once.
BATCH_ROWS = 2048
#: Bits of the set of documents that a later order still has to look at; a larger table only leaves more of them in.
SURVIVOR_BITS = 1 << 23
_SEEDS = (0x51ED270B, 0x2F6E2B1D, 0x7A3D4C99)


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its row and its sorted distinct shingle hashes (none for a text without words)."""
    for first, end, raw, offs in text_blocks(column, HASHED_BYTES):
        starts, ends = W.runs(low := W.LOWER[raw], offs, W.NOT_SPACE)
        hashes = W.word_hashes(low, starts, ends)
        grams = W.shingle_hashes(hashes, width)
        at = W.doc_word_offsets(starts, offs).tolist()
        for k in range(end - first):
            a, b = at[k], at[k + 1]
            if b - a >= width:
                own = np.sort(grams[a : b - width + 1])
                yield first + k, own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield first + k, np.array([W.whole(width, hashes[a:b])], W.U) if b > a else grams[:0]


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    return int(names_of(own, np.array([0, len(own)]))[0])


def names_of(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The names of the sets flat[a:b] between ``bounds``, none of them empty."""
    at = bounds[:-1]
    with np.errstate(over="ignore"):
        plain = np.add.reduceat(W.mix(flat + W.U(0x632BE59BD9B4E019)), at)
        sized = np.add.reduceat(W.mix(W.mix(flat) ^ np.repeat(np.diff(bounds), np.diff(bounds)).astype(W.U)), at)
        return W.mix(plain ^ sized * W.U(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of about as many bits as the set has tokens; a bit that only one of two sets has is a token that only it has."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(own & W.U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_link(sketches: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets can reach the similarity, by the most tokens that their sketches let them share."""
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in sketches]
    size = np.array([len(x) for x in bits])
    out = np.zeros((len(n), len(n)), bool)
    for least in np.unique(size):
        # sizes of linked sets, and so those of their sketches, are within a factor; longer sketches are folded
        own = np.flatnonzero((size >= least) & (size * percent <= 200 * least))
        table = np.stack([bits[k].reshape(-1, least).max(axis=0) for k in own]).astype(np.float32)
        filled, both, count = table.sum(axis=1), table @ table.T, n[own]
        most = np.minimum(count[:, None] - (filled[:, None] - both), count[None, :] - (filled[None, :] - both))
        near = 100 * most >= percent * (count[:, None] + count[None, :] - most)
        here = np.minimum(size[own][:, None], size[own][None, :]) == least
        out[np.ix_(own, own)] |= near & here
    return out


def counted_share(percent: int) -> int:
    """Tokens are counted whose rank under the first order lies below this: twice as many as a prefix takes."""
    return min(1 << 56, (2 * (100 - percent) << 56) // 100)


def _slot(rank: np.ndarray, share: int, slots: int) -> np.ndarray:
    """The slot of a counted token, by its rank: slots lie in the order of ranks."""
    return ((rank >> W.U(24)) * W.U(slots) // W.U((share >> 24) + 1)).astype(np.int64)


#: How often a token occurs, as a class of half a byte; 0 stands for once or never.
_TIMES = np.array([0, 0, *range(1, 9), 9, 9, 10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 12, 13, 13, 13, 13, 13, 13, 14], np.uint8)
#: Counted tokens that one bucket should hold.
COUNTED_ROWS = 1_000_000


@dataclass(frozen=True)
class Counts:
    """How often the tokens of the lowest ranks under the first order occur in the whole table, two slots in a byte."""

    table: np.ndarray
    share: int

    def tiers(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ranks are of counted tokens, and the classes of their counts."""
        counted = np.flatnonzero(rank < W.U(self.share))
        slot = _slot(rank[counted], self.share, 2 * len(self.table))
        return counted, self.table[slot >> 1] >> (4 * (slot & 1)).astype(np.uint8) & 15


def _members(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, Counts]:
    """One pass over the texts, the last column of ``rows``: the other columns with n and node of each row's set, how often
    tokens repeat within a task's share, and how often those of the lowest ranks occur in all."""
    kept = len(rows.columns) - 1
    spark, share = rows.sparkSession, counted_share(percent)
    names = ["n", "node", "token", "times", "part", "ranks"]
    kinds_of = [T.LongType()] * 4 + [T.IntegerType(), T.BinaryType()]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:kept]], *[T.StructField(c, t) for c, t in zip(names, kinds_of, strict=True)]])
    parts = 256

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, kinds, seen = [], 0, [], set()

        def batch_of(size: int, **columns) -> pa.RecordBatch:
            given = {"n": pa.int64(), "node": pa.int64(), "token": pa.int64(), "times": pa.int64(), "part": pa.int32(), "ranks": pa.binary()}
            return pa.RecordBatch.from_arrays([*(pa.nulls(size, t) for t in kinds), *(columns.get(c, pa.nulls(size, t)) for c, t in given.items())], names=schema.names)

        def repeated() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            counts = np.diff(at, append=len(every))
            at, counts = at[counts > 1], counts[counts > 1]
            yield batch_of(len(at), token=pa.array(every[at].view(np.int64)), times=pa.array(counts))
            low = []
            for k in range(0, len(every), 1 << 17):
                ranks = W.mix(every[k : k + (1 << 17)] ^ W.U(_SEEDS[0])) >> W.U(8)
                low.append(ranks[ranks < W.U(share)])
            ranks = np.sort(np.concatenate(low))
            cuts = np.searchsorted(_slot(ranks, share, parts), np.arange(parts + 1))
            short = (ranks >> W.U(8)).astype("<u8").view("<u2").reshape(-1, 4)[:, :3]
            own = np.flatnonzero(np.diff(cuts))
            yield batch_of(len(own), part=pa.array(own, pa.int32()), ranks=pa.array([short[cuts[k] : cuts[k + 1]].tobytes() for k in own.tolist()], pa.binary()))

        for batch in batches:
            kinds = [c.type for c in batch.columns[:kept]]
            ns, nodes = [], []
            for _, own in text_sets(batch.column(kept), width):
                ns.append(len(own))
                nodes.append(node_of(own) if len(own) else None)
                if len(own) and nodes[-1] not in seen:  # copies count once in a task's share
                    seen.add(nodes[-1])
                    held.append(own)
                    n_held += len(own)
                if n_held >= COUNTED:
                    yield from repeated()
                    n_held = 0
                    seen.clear()
            full = batch_of(len(ns), n=pa.array(ns, pa.int64()), node=pa.array(nodes, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *full.columns[kept:]], names=schema.names)
        if held:
            yield from repeated()

    both, path = stored(rows.mapInArrow(releasing(scan), schema), "near-scan")
    members = materialize(both.filter("n is not null").drop("token", "times", "part", "ranks"), "near-members")
    repeats = materialize(both.filter("times is not null").select("token", "times"), "near-repeats")
    counts = _counts(both.filter("part is not null").select("part", "ranks"), share, parts)
    remove_path(spark, path)
    return members, repeats, counts


def _counts(ranks: DataFrame, share: int, parts: int) -> Counts:
    """Counts of tokens by their ranks, given in ``parts`` ranges of ranks; ranges are as fine as the table is large."""
    total = ranks.agg(F.coalesce(F.sum(F.octet_length("ranks")), F.lit(0)).alias("n")).first().n // 6
    slots = min(COUNT_SLOTS, max(1 << 16, 1 << (total // 2).bit_length()))
    finer = max(1, -(-total // (parts * COUNTED_ROWS)))
    finer = 1 << (finer - 1).bit_length()
    size = slots // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            own = np.zeros((len(b"".join(held)) // 6, 4), "<u2")
            own[:, :3] = np.frombuffer(b"".join(held), "<u2").reshape(-1, 3)
            # a bucket's tokens are counted in slices of their ranks, which bounds what is sorted at once
            full, classes = own.reshape(-1).view("<u8") << W.U(8), np.zeros(size, np.uint8)
            by = _slot(full, share, parts * finer)
            for k in range(key * finer, (key + 1) * finer):
                tokens, times = np.unique(full[by == k], return_counts=True)
                tokens, times = tokens[times > 1], times[times > 1]
                if len(tokens):
                    slot = np.clip(_slot(tokens, share, slots) - key * size, 0, size - 1)
                    np.maximum.at(classes, slot, _TIMES[np.minimum(times, len(_TIMES) - 1)])
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([(classes[::2] | classes[1::2] << 4).tobytes()], pa.binary())], names=["part", "classes"])

        key, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != key:
                    if held:
                        yield close()
                    key, held = part, []
                held.append(blob)
        if held:
            yield close()

    table = np.zeros((parts, size // 2), np.uint8)
    found = ranks.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(count), "part int, classes binary").toArrow()
    for part, classes in zip(found["part"].to_pylist(), found["classes"].to_pylist(), strict=True):
        table[part] = np.frombuffer(classes, np.uint8)
    return Counts(table.reshape(-1), share)


def _frequent(repeats: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that repeat most, sorted, and classes of their counts; as many whole classes as ``most`` tokens allow."""
    totals = repeats.groupBy("token").agg(F.least(F.lit(250), F.floor(4 * F.log2(F.sum("times")))).cast("short").alias("class"))
    totals = materialize(totals, "near-frequent")
    least, held = None, 0
    for r in totals.groupBy("class").count().orderBy(F.desc("class")).collect():
        held += r["count"]
        if held > most:
            break
        least = r["class"]
    if least is None:
        return np.zeros(0, W.U), np.zeros(0, np.uint8)
    rows = totals.filter(F.col("class") >= least).toArrow()
    tokens, classes = rows["token"].to_numpy().view(W.U), rows["class"].to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], classes[order]


def _rank(own: np.ndarray, tokens: np.ndarray, classes: np.ndarray, order: int, counts: Counts | None = None) -> np.ndarray:
    """Sort keys of tokens under one of the global orders: rarest first by classes of counts, ties by a permutation.

    With ``counts``, the first order begins with tokens that were counted, the rarest first; then come those that weren't,
    and then those that are known to be frequent.
    """
    rank = W.mix(own ^ W.U(_SEEDS[order])) >> W.U(8)
    exact = counts is not None and order == 0
    if exact:
        counted, times = counts.tiers(rank)
        tier = np.full(len(rank), 15, np.uint8)
        tier[counted] = np.where(times == 14, 16, times)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        known = np.flatnonzero(tokens[at] == own)
        if exact:
            known = known[tier[known] >= 15]
            tier[known] = 16 + classes[at[known]].astype(np.int64) * 15 // 16
        elif len(known):
            rank[known] |= (1 + classes[at[known]].astype(W.U) // W.U(1 if order == 0 else 4)) << W.U(56)
    if exact:
        rank |= tier.astype(W.U) << W.U(56)
    return rank


def prefix(own: np.ndarray, tokens: np.ndarray, classes: np.ndarray, order: int, percent: int = PERCENT, counts: Counts | None = None) -> np.ndarray:
    """The tokens of which a similar set must share one."""
    n = len(own)
    size = n - (percent * n + 99) // 100 + 1
    return own if size >= n else own[np.argpartition(_rank(own, tokens, classes, order, counts), size - 1)[:size]]


#: A function, called in each task, that gives a function of a batch, which yields (node, size, tokens) of sets; tokens are
#: worked out by a call, as sets that a task has met already aren't looked at again.
Pull = Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[int, int, Callable[[], np.ndarray]]]]]


def _first_order(shared, percent: int, width: int) -> Pull:
    """Prefixes under the first order, from texts."""

    def make():
        tokens, classes, counts = shared.value

        def pull(batch: pa.RecordBatch):
            for _, own in text_sets(batch.column(0), width):
                if len(own):
                    yield node_of(own), len(own), partial(prefix, own, tokens, classes, 0, percent, counts)

        return pull

    return make


def _later_order(order: int, orders: int) -> Pull:
    """Prefixes under another order, from the table of sets (node, n, filters)."""

    def make():
        def pull(batch: pa.RecordBatch):
            for node, n, filters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield node, n, lambda filters=filters: np.frombuffer(filters, W.U).reshape(orders - 1, -1)[order - 1]

        return pull

    return make


#: What travels for each prefix token: 48 bits of it, the set's name and size. Shortened tokens may meet by chance, which
#: only makes a cell larger.
_ROW = np.dtype([("token", "<u2", 3), ("node", "<i8"), ("n", "<u4")])
#: Prefix tokens that a task sorts at once, and that one bucket should hold.
CHUNK_ROWS, BUCKET_ROWS = 500_000, 1_000_000
#: Edges that a task holds before it sends the distinct ones.
EDGES_HELD = 500_000


def chains(token: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between neighbours by size among the sets of each token, as distinct pairs, and which rows stand for all.

    A chain breaks where the sizes of two neighbours alone rule out a link. Of a token's sets, the first and the last
    stay and between them as many as keep the chain whole: whatever else may link with a set that goes can link with,
    or stands between, two that stay.
    """
    order = np.lexsort((node, n, token))
    token, node, n = token[order], node[order], n[order].astype(np.int64)
    same = token[1:] == token[:-1]
    twice = same & (node[1:] == node[:-1])
    if twice.any():
        stay = np.concatenate([[True], ~twice])
        order, token, node, n = order[stay], token[stay], node[stay], n[stay]
        same = token[1:] == token[:-1]
    near = same & (100 * n[:-1] >= percent * n[1:])
    pairs = np.unique(np.stack([node[1:][near], node[:-1][near]], axis=1), axis=0)
    keep = np.ones(len(token), bool)
    inner = np.flatnonzero(same[:-1] & same[1:]) + 1
    if len(inner):
        firsts = np.concatenate([[True], ~same])
        first_of = np.maximum.accumulate(np.where(firsts, np.arange(len(token)), 0))
        last = -1
        for k in inner.tolist():  # only tokens of three sets or more
            if last < first_of[k]:
                last = int(first_of[k])
            keep[k] = 100 * n[last] < percent * n[k + 1]
            if keep[k]:
                last = k
    return pairs[:, 0], pairs[:, 1], order[keep]


def chained(rows: DataFrame, pull: Pull, percent: int, buckets: int, *broadcasts: Broadcast) -> DataFrame:
    """Edges (a, b) that join all sets which share a token and whose sizes allow a link; ``pull`` gives sets and tokens, and
    reads ``broadcasts``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = pull()
        held: dict[int, tuple[np.ndarray, int]] = {}
        n_held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(own) for own, _ in held.values()])
            token = np.concatenate([own for own, _ in held.values()]) >> W.U(16)
            node = np.repeat(np.array(list(held), np.int64), sizes)
            n = np.repeat(np.array([n for _, n in held.values()], np.int64), sizes)
            a, b, stay = chains(token, node, n, percent)
            rows = np.empty(len(stay), _ROW)
            rows["token"] = token[stay].astype("<u8").view("<u2").reshape(-1, 4)[:, :3]
            rows["node"], rows["n"] = node[stay], n[stay]
            bucket = (token[stay] % W.U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            blobs = [x.tobytes() for x in np.split(rows[by], cuts)]
            names = bucket[by][np.concatenate([[0], cuts])].tolist()
            if len(a):
                blobs.append(np.stack([a, b], axis=1).tobytes())
                names.append(-1)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for node, n, tokens_of in sets_of(batch):
                if node not in held:
                    held[node] = (tokens_of(), n)
                    n_held += len(held[node][0])
                    if n_held >= CHUNK_ROWS:
                        yield flush()
                        held, n_held = {}, 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []

        def edges() -> pa.RecordBatch:
            found = np.unique(np.concatenate(pairs), axis=0)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

        def close() -> None:
            rows = np.frombuffer(b"".join(held), _ROW)
            token = rows["token"].astype(np.uint64)
            token = token[:, 0] | token[:, 1] << W.U(16) | token[:, 2] << W.U(32)
            pairs.append(np.stack(chains(token, rows["node"], rows["n"], percent)[:2], axis=1))

        key, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    pairs.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
                elif bucket != key:
                    if held:
                        close()
                    key, held = bucket, [blob]
                else:
                    held.append(blob)
                # a pair meets in many buckets, so each is sent once for the task
                if sum(map(len, pairs)) >= EDGES_HELD:
                    yield edges()
        if held:
            close()
        if pairs:
            yield edges()

    dealt = rows.mapInArrow(releasing(deal, *broadcasts), "bucket int, rows binary")
    # a task's own edges carry no bucket: they are spread by their content
    spread = F.when(F.col("bucket") < 0, F.xxhash64("rows")).otherwise(F.col("bucket"))
    return dealt.repartition(spread).sortWithinPartitions("bucket").mapInArrow(releasing(meet), "a long, b long")


#: Hashes that leave a task in one batch.
BATCH_HASHES = 1_000_000


def alive_sets(rows: DataFrame, pull, alive, *broadcasts: Broadcast, whole: bool = True) -> DataFrame:
    """(node, n, hashes, payload, filters) of the distinct sets that are still alive, written to the shared folder.

    ``pull``, called in each task, gives a function of a batch that yields node, set and a function that gives payload
    (a sketch, and shortened filter tokens) and filters (whole ones), and reads ``broadcasts``; hashes are left empty unless
    ``whole``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sets_of, seen = alive.value, pull(), set()
        held: list[tuple[int, np.ndarray, bytes, bytes]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nodes, sets, payloads, filters = zip(*held, strict=True)
            sizes = np.array([len(x) for x in sets])
            offsets = np.concatenate([[0], np.cumsum(sizes)]) if whole else np.zeros(len(sets) + 1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets if whole else [W.U(0) * sets[0][:0]]).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes), lists, pa.array(payloads, pa.binary()), pa.array(filters, pa.binary())], names=["node", "n", "hashes", "payload", "filters"])

        for batch in batches:
            for node, own, more in sets_of(batch):
                if bits[node % SURVIVOR_BITS] and node not in seen:
                    seen.add(node)
                    held.append((node, own.copy() if whole else own, *more()))
                    n_held += len(own)
                    if n_held >= BATCH_HASHES:
                        yield flush()
                        held, n_held = [], 0
        if held:
            yield flush()

    found = rows.mapInArrow(releasing(scan, alive, *broadcasts), "node long, n long, hashes array<long>, payload binary, filters binary")
    return materialize(found.dropDuplicates(["node"]), "near-sets")


def _later_filters(shared, percent: int, width: int, orders: int):
    """Sets of texts with their sketch, and their prefixes under all orders but the first."""

    def make():
        tokens, classes, counts = shared.value

        def more(own: np.ndarray) -> tuple[bytes, bytes]:
            return sketch(own), b"".join(prefix(own, tokens, classes, order, percent).tobytes() for order in range(1, orders))

        def pull(batch: pa.RecordBatch):
            for _, own in text_sets(batch.column(0), width):
                if len(own):
                    yield node_of(own), own, partial(more, own)

        return pull

    return make


def _all_filters(shared, percent: int, width: int, orders: int):
    """Sets of texts with their sketch, and shortened tokens of their prefixes under all orders."""

    def make():
        tokens, classes, counts = shared.value

        def more(own: np.ndarray) -> tuple[bytes, bytes]:
            filters = [prefix(own, tokens, classes, order, percent, counts) for order in range(orders)]
            return sketch(own) + np.concatenate(filters).astype(np.uint32).tobytes(), b""

        def pull(batch: pa.RecordBatch):
            for _, own in text_sets(batch.column(0), width):
                if len(own):
                    yield node_of(own), own, partial(more, own)

        return pull

    return make


def may_pair(payloads: list[bytes], n: np.ndarray, percent: int, orders: int) -> np.ndarray:
    """Which pairs share a filter token under every order that payloads hold, and a similarity that their sketches allow."""
    cuts = [max(64, 1 << (int(k) - 1).bit_length()) // 8 for k in n]
    out = may_link([x[:cut] for x, cut in zip(payloads, cuts, strict=True)], n, percent)
    np.fill_diagonal(out, False)
    for order in range(orders):
        left = np.flatnonzero(out.any(axis=1))  # sets that still may have a partner
        if not len(left):
            break
        tokens = [np.frombuffer(payloads[k], np.uint32, offset=cuts[k]).reshape(orders, -1)[order] for k in left]
        out[np.ix_(left, left)] &= overlaps(tokens) > 0
    return out


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A set of nodes of fixed size; at most as many numbers as it has bits come to the driver."""
    rows = nodes.select(F.pmod("node", F.lit(SURVIVOR_BITS)).cast("int").alias("k")).distinct().toArrow()
    bits = np.zeros(SURVIVOR_BITS, bool)
    bits[rows["k"].to_numpy()] = True
    return bits


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets."""
    out = np.diag([len(s) for s in sets]).astype(np.int64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    everything = np.concatenate(sets)
    order = np.argsort(everything, kind="stable")
    tokens, doc = everything[order], doc[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    group = np.cumsum(new) - 1
    common = np.bincount(group) > 1
    keep = common[group]
    if not keep.any():
        return out
    group, doc = (np.cumsum(common) - 1)[group[keep]], doc[keep]
    total = np.zeros(out.shape, np.float32)
    for at in range(0, int(group[-1]) + 1, 8192):
        a, b = np.searchsorted(group, [at, at + 8192])
        table = np.zeros((len(sets), min(8192, int(group[-1]) + 1 - at)), np.float32)
        table[doc[a:b], group[a:b] - at] = 1
        total += table @ table.T
    total = np.rint(total).astype(np.int64)
    np.fill_diagonal(total, np.diag(out))
    return total


def block_pairs(sets: DataFrame, cells: DataFrame, scan) -> DataFrame:
    """Deal (cell, node, n, times, payload and perhaps hashes) over pairs of blocks of their cells and run ``scan`` over each
    pair; ``cells`` has a row for each set, which is all that the numbers of blocks are counted from."""
    blocks = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.join(blocks, "cell").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in ("n", "times", "payload", "hashes") if c in sets.columns]
    pairs = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), *rest)
    return pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(releasing(scan), "a long, b long, links long")


def _links(near_of):
    """Scan of block pairs: a spanning forest of the near sets, and each set's number of linked documents."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        nodes, side, n, times = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
        near = near_of([r[4] for r in rows], n, [r[5] for r in rows] if len(rows[0]) > 5 else None)
        np.fill_diagonal(near, False)
        if side.any():  # two blocks: pairs across only
            near &= side[:, None] != side[None, :]
        degrees = [(int(v), None, int(d)) for v, d in zip(nodes, near @ times, strict=True) if d]
        forest, todo = [], np.ones(len(nodes), bool)
        for first in range(len(nodes)):
            if not todo[first]:
                continue
            todo[first], stack = False, [first]
            while stack:
                k = stack.pop()
                fresh = np.flatnonzero(near[k] & todo)
                todo[fresh] = False
                stack += fresh.tolist()
                forest += [(int(nodes[k]), int(nodes[x]), None) for x in fresh]
        a, b, count = zip(*forest, *degrees, strict=True) if forest or degrees else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int64())], names=["a", "b", "links"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:8]]
            if batch.num_columns > 8:
                bounds, hashes = batch.column(8).offsets.to_numpy(), batch.column(8).values.to_numpy().view(W.U)
                columns.append([hashes[a:b].copy() for a, b in zip(bounds, bounds[1:], strict=False)])
            for cell, i, j, *row in zip(*columns, strict=True):
                if (cell, i, j) != key:
                    if len(held) > 1:
                        yield links(held)
                    key, held = (cell, i, j), []
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held)

    return scan


def links_of_cells(sets: DataFrame, whole: Callable[..., DataFrame], classes: DataFrame, cells: DataFrame, percent: int, light_orders: int, whole_orders: int) -> DataFrame:
    """(a, b, links): a spanning forest (a, b) of the links within cells, and (a, null, links) with numbers of linked rows.

    ``sets`` is as :func:`alive_sets` gives it, ``classes`` has node and times of each set, ``cells`` the cell of those that
    may link. First pairs are held against their sketches and the tokens of ``light_orders`` filters, as what travels here is
    copied to each pair of blocks of a cell. ``whole`` then gives the whole sets of what hangs together by pairs that pass
    (called with their :func:`bitmap`, as a broadcast); of these, pairs that share a token under each of ``whole_orders``
    filters are verified.
    """
    sc = sets.sparkSession.sparkContext

    def verified(payloads, n, hashes):
        out = may_pair(payloads, n, percent, whole_orders)
        left = np.flatnonzero(out.any(axis=1))
        if len(left):
            both, m = overlaps([hashes[k] for k in left]), n[left]
            out[np.ix_(left, left)] &= 100 * both >= percent * (m[:, None] + m[None, :] - both)
        return out

    known = classes.select("node", "times")
    light = sets.select("node", "n", "payload").join(known, "node").join(cells, "node")
    near = block_pairs(light, cells, _links(lambda payloads, n, _: may_pair(payloads, n, percent, light_orders)))
    cells = materialize(connected_components(near.filter("b is not null").select("a", "b"), "near-cells").withColumnRenamed("root", "cell"), "near-cells")
    full = whole(sc.broadcast(bitmap(cells))).select("node", "n", "payload", "hashes").join(known, "node").join(cells, "node")
    return materialize(block_pairs(full, cells, _links(verified)), "near-links")


@dataclass
class Linked:
    """The rows of a table with n and node of their sets, and the linked sets: their roots and numbers of linked rows."""

    members: DataFrame
    classes: DataFrame
    roots: DataFrame
    degrees: DataFrame


def _linked(rows: DataFrame, width: int, percent: int, orders: int, frequent: int) -> Linked:
    """All links among the texts in the last column of ``rows``."""
    if not 1 <= orders <= len(_SEEDS):
        raise ValueError(f"there can be 1 to {len(_SEEDS)} orders")
    with batches_of(rows.sparkSession, BATCH_ROWS):
        return _links_of(rows, width, percent, orders, frequent)


def _links_of(rows: DataFrame, width: int, percent: int, orders: int, frequent: int) -> Linked:
    spark = rows.sparkSession
    sc = spark.sparkContext
    texts = rows.select(F.col(rows.columns[-1]).alias("text"))
    members, repeats, counts = _members(rows, width, percent)
    shared = sc.broadcast((*_frequent(repeats, frequent), counts))
    total = members.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0.0)).alias("rows")).first().rows
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_ROWS))
    cells = connected_components(chained(texts, _first_order(shared, percent, width), percent, buckets, shared), "near-cells")
    cells = materialize(cells.withColumnRenamed("root", "cell"), "near-cells")
    sets = alive_sets(texts, _later_filters(shared, percent, width, orders), sc.broadcast(bitmap(cells)), shared, whole=False)
    for order in range(1, orders):
        mine = sets.select("node", "n", "filters").join(cells.select("node"), "node", "left_semi")
        found = connected_components(chained(mine, _later_order(order, orders), percent, buckets), "near-cells")
        both = cells.join(found, "node")
        names = both.groupBy("cell", "root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
        cells = materialize(both.join(names, ["cell", "root"]).select("node", F.col("least").alias("cell")), "near-cells")
    classes = members.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    filtered = _all_filters(shared, percent, width, orders)
    found = links_of_cells(sets, lambda alive: alive_sets(texts, filtered, alive, shared), classes, cells, percent, 0, orders)
    roots = connected_components(found.filter("b is not null"), "near-links")
    degrees = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return Linked(members, classes, roots, degrees)


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, orders: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id and n_links.

    A text's set holds the distinct ``width``-word shingles of its words (split at ASCII white space, A-Z lower-cased);
    with fewer words the whole sequence is the only shingle. Two texts link when their Jaccard similarity is at least
    ``percent`` hundredths; component_id is the least id reachable by links, n_links the number of rows linked with.
    A null text or one without words has no shingles, links with nothing and is its own component. Rows with a null id
    link as others do, but give no component its name. Repeated rows and equal texts link with each other; an empty
    table gives an empty result. Sets are compared by 64-bit hashes of their shingles. Other columns are not carried.

    Exact for any table: no group, cell or candidate list is capped. What is broadcast is bounded by ``frequent`` tokens
    and a bitmap of fixed size. Equal sets are collapsed first; a cell of many documents is filtered and verified block
    by block, so that its work grows with the square of its blocks.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _linked(rows, width, percent, orders, frequent)
    classes = found.members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = classes.join(found.roots, "node", "left").join(found.degrees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    return found.members.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, orders: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """``df`` with one row of each group of similar texts, columns and their names unchanged whatever these are.

    Groups are the components of links of :func:`similar_documents`. The row with the least id stays, of several with that
    id one by a hash of all columns, and of rows that are equal in every column exactly one. Two different texts under one
    id are two rows, each judged by its own text. Rows with a null id always stay, and take no other row's place; so do
    null and empty texts, and texts without words, which link with nothing. An empty table gives an empty result. ``df`` is
    evaluated several times, and must give the same rows each time.
    """
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    own = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in inner.schema.fields]
    doc, text = F.col(f"c{names.index(id_col)}").cast("long"), F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    # rows are known by 128 bits of their content, so that texts needn't be written again to be known by a number
    keyed = inner.withColumns({"doc_id": doc, "first_key": F.xxhash64(*own), "second_key": F.xxhash64(F.lit(1), *own), "scanned": text})
    key = ["doc_id", "first_key", "second_key"]
    found = _linked(keyed.select(*key, "scanned"), width, percent, orders, frequent)
    each = found.members.filter("node is not null and doc_id is not null").groupBy("node", *key).agg(F.count(F.lit(1)).alias("times"))
    first = each.groupBy("node").agg(F.min(F.struct(*key, "times")).alias("first"))
    rooted = first.join(found.roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    winners = materialize(rooted.select("first.*"), "near-winners")
    free = F.col("doc_id").isNull() | ~F.col("scanned").rlike(r"[^\x20\x09-\x0D]")
    stay = keyed.filter(~free).join(winners, key)
    if not winners.filter("times > 1").isEmpty():
        stay = stay.filter("times = 1").unionByName(stay.filter("times > 1").dropDuplicates(key))
    return stay.select(inner.columns).union(keyed.filter(free).select(inner.columns)).toDF(*names)
