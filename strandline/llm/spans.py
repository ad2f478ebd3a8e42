"""Runs of words that stand verbatim in several documents, wherever their lines begin and end.

A window is a sequence of ``RUN`` words; its anchor is the least hash of the ``GRAM``-word sequences inside, so equal
windows have equal anchors, and neighbouring windows mostly share theirs. A first pass finds the anchors that several
documents have and sets their bits in a map of fixed size; a second one compares the windows of such anchors by 64-bit
hashes. Windows that several documents hold are joined into spans. Nothing is sampled or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import words as W
from strandline.llm.common import materialize, releasing, text_blocks

#: Words of a window, and of the sequences of which the least is its anchor.
RUN, GRAM = 45, 22
#: Bits of the map of shared anchors; a fuller map only lets more windows through to the comparison.
MAP_BITS = 26
#: Rows that a task holds before it deals them out, and that one bucket should hold.
CHUNK_ROWS, BUCKET_ROWS = 1_000_000, 2_000_000
#: The document without an id sorts first.
NULL_ID = -(1 << 63)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words by prefix sums, whatever the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, W.U)
    sums = np.zeros(len(hashes) + 1, W.U)
    np.cumsum(hashes * W._power("up", W._BASE, len(hashes)), out=sums[1:])
    return W.mix((sums[width:] - sums[:n]) * W._power("down", W._BASE_INV, n))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def windows(column: pa.Array, run: int, gram: int):
    """For each block of texts with a window: (first row, row of each window, anchors, word hashes, numbers of words in
    their texts, first bytes and ends of words, offsets, bytes, numbers of the windows' first words)."""
    for first, _, raw, offs in text_blocks(column):
        low = W.LOWER[raw]
        starts, ends = W.runs(low, offs, W.NOT_SPACE)
        if len(starts) < run:
            continue
        hashes = W.word_hashes(low, starts, ends)
        at = W.doc_word_offsets(starts, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        begin = np.flatnonzero(row[: len(row) - run + 1] == row[run - 1 :])  # windows don't cross texts
        if len(begin):
            # a bijection spreads the least hashes, which are small numbers
            anchors = W.mix(sliding_least(rolling(hashes, gram), run - gram + 1))[begin]
            yield first, row[begin], anchors, hashes, at, starts, ends, offs, raw, begin


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])


def _blobs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces of an array between ``cuts`` as binary values."""
    data = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _ends_of(anchor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor its least and its greatest document, one row if they are the same."""
    order = np.lexsort((key, anchor))
    anchor, key = anchor[order], key[order]
    fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    last = np.concatenate([fresh[1:], [True]])
    keep = fresh | last
    once = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])])
    keep &= once | (last & ~fresh & (key != key[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]))
    return anchor[keep], key[keep]


def _shared_anchors(docs: DataFrame, run: int, gram: int, buckets: int) -> np.ndarray:
    """The map of the anchors that two documents or more have, as packed bits."""
    bits = min(MAP_BITS - 3, max(0, (buckets - 1).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            anchor, key = _ends_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = (anchor >> W.U(64 - MAP_BITS)).astype(np.int64) >> (MAP_BITS - bits)
            cuts = _cuts(bucket)  # anchors are sorted, and so are buckets
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), _blobs(anchor, cuts), _blobs(key, cuts)], names=["bucket", "anchor", "key"])

        for batch in batches:
            keys = _keys(batch.column(0))
            for first, row, anchors, *_ in windows(batch.column(1), run, gram):
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
                held.append((anchors[new], keys[first + row[new]]))
                n_held += len(held[-1][0])
                if n_held >= CHUNK_ROWS:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            anchor, key = _ends_of(np.frombuffer(b"".join(a), W.U), np.frombuffer(b"".join(k), np.int64))
            several = anchor[1:][anchor[1:] == anchor[:-1]]
            filled = np.zeros(1 << (MAP_BITS - bits), bool)
            filled[((several >> W.U(64 - MAP_BITS)) & W.U(len(filled) - 1)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(filled).tobytes()], pa.binary())], names=["bucket", "bits"])

        name, a, k = None, [], []
        for batch in batches:
            for bucket, anchor, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != name:
                    if a:
                        yield close()
                    name, a, k = bucket, [], []
                a.append(anchor)
                k.append(key)
        if a:
            yield close()

    dealt = docs.mapInArrow(releasing(deal), "bucket int, anchor binary, key binary")
    slices = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(releasing(meet), "bucket int, bits binary")
    out, size = np.zeros(1 << (MAP_BITS - 3), np.uint8), 1 << (MAP_BITS - 3 - bits)
    found = slices.toArrow()  # no more than the map holds, in one job; an iterator would take one for each partition
    for bucket, own in zip(found["bucket"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[bucket * size : (bucket + 1) * size] = np.frombuffer(own, np.uint8)
    return out


_COLUMNS = {"hash": np.uint64, "key": np.int64, "text": np.uint64, "word": np.uint32, "start": np.uint32, "end": np.uint32}


def _shared_windows(docs: DataFrame, run: int, gram: int, buckets: int, shared) -> DataFrame:
    """The windows that several documents hold, by part: texts, first words, characters and first documents."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            bucket = (rows[0] % W.U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = _cuts(bucket[by])
            return pa.RecordBatch.from_arrays([pa.array(bucket[by][cuts[:-1]], pa.int32()), *(_blobs(x[by], cuts) for x in rows)], names=["bucket", *_COLUMNS])

        for batch in batches:
            keys = _keys(batch.column(0))
            texts = batch.column(2).to_numpy().view(W.U)
            for first, row, anchors, hashes, at, starts, ends, offs, raw, begin in windows(batch.column(1), run, gram):
                bit = (anchors >> W.U(64 - MAP_BITS)).astype(np.int64)
                found = np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                if not len(found):
                    continue
                row, begin = row[found], begin[found]
                chars = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
                base = chars[offs[row]]
                values = (rolling(hashes, run)[begin], keys[first + row], texts[first + row], begin - at[row], chars[starts[begin]] - base, chars[ends[begin + run - 1]] - base)
                held.append([x.astype(t) for x, t in zip(values, _COLUMNS.values(), strict=True)])
                n_held += len(found)
                if n_held >= CHUNK_ROWS:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_found = [], 0

        def close() -> None:
            nonlocal n_found
            value, key, text, word, start, end = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), _COLUMNS.values(), strict=True))
            by = np.argsort(value, kind="stable")
            heads = _cuts(value[by])[:-1]
            least, most = np.minimum.reduceat(key[by], heads), np.maximum.reduceat(key[by], heads)
            sizes = np.diff(np.append(heads, len(by)))
            stay = np.repeat(least != most, sizes)
            by = by[stay]
            if len(by):
                found.append((key[by], text[by], word[by], start[by], end[by], np.repeat(least, sizes)[stay]))
                n_found += len(by)

        def flush() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*found, strict=True)]
            part = (W.mix(rows[0].view(W.U) ^ rows[1]) % W.U(buckets)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = _cuts(part[by])
            return pa.RecordBatch.from_arrays([pa.array(part[by][cuts[:-1]], pa.int32()), *(_blobs(x[by], cuts) for x in rows)], names=["part", *_PIECE])

        name, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != name:
                    if held:
                        close()
                    name, held = bucket, []
                    if n_found >= CHUNK_ROWS:
                        yield flush()
                        found, n_found = [], 0
                held.append(row)
        if held:
            close()
        if found:
            yield flush()

    dealt = docs.mapInArrow(releasing(deal), "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(releasing(meet), "part int, " + ", ".join(f"{c} binary" for c in _PIECE))


#: What goes back to the texts: each shared window's text, first word, characters and first document.
_PIECE = {"key": np.int64, "text": np.uint64, "word": np.uint32, "start": np.uint32, "end": np.uint32, "origin": np.int64}
_SPAN = ["key", "text", "start", "end", "words", "origin"]


def _joined(run: int):
    """Scan of shared windows, sorted by part of the texts: the spans of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            key, text, word, start, end, origin = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), _PIECE.values(), strict=True))
            by = np.lexsort((word, text, key))
            key, text, word, start, end, origin = (x[by] for x in (key, text, word.astype(np.int64), start, end, origin))
            other = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            once = np.concatenate([[True], other | (word[1:] != word[:-1])])  # repeated rows are one document
            key, text, word, start, end, origin = (x[once] for x in (key, text, word, start, end, origin))
            new = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (np.diff(word) > 1) | (origin[1:] != origin[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(word)]])
            a, b = cuts[:-1], cuts[1:] - 1
            values = (key[a], text[a].view(np.int64), start[a].astype(np.int64), end[b].astype(np.int64), word[b] - word[a] + run, origin[a])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=_SPAN)

        name, held = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != name:
                    if held:
                        yield close()
                    name, held = part, []
                held.append(row)
        if held:
            yield close()

    return scan


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Spans of ``run`` words or more that stand verbatim in another document: one row for each place.

    doc_id, start and end (characters, end exclusive), n_words, cluster (the least id of the documents that hold the
    span's windows) and removed, which is false in that document; text_id, the xxhash64 of the text, tells texts of one id
    apart. Words are split at ASCII white space, A-Z lower-cased, so spans run over lines. A span is a maximal sequence of
    neighbouring windows with one cluster; spans of several clusters may overlap. Every window of ``run`` words that two
    documents hold is found; they are compared by 64-bit hashes. Null and empty texts, and those of fewer words, have no
    spans. A null id is one more document, which sorts first; equal rows count once, other texts under one id belong
    to the same document. An empty table gives an empty result; other columns are not carried.
    """
    gram = max(1, run * GRAM // RUN)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / BUCKET_ROWS))
    shared = df.sparkSession.sparkContext.broadcast(_shared_anchors(docs, run, gram, buckets))
    pieces = _shared_windows(docs, run, gram, buckets, shared)
    found = pieces.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(_joined(run)), ", ".join(f"{c} long" for c in _SPAN))
    name = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = found.select(name("key").alias("doc_id"), F.col("text").alias("text_id"), "start", "end", F.col("words").alias("n_words"), name("origin").alias("cluster"), (F.col("key") != F.col("origin")).alias("removed"))
    return materialize(out, "spans")
