"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The benchmark's windows go to every task as a sorted array of 64-bit hashes with the words behind them. Each training
text is cut into the same windows; a hash that is found is verified against the words themselves before it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import words as W
from strandline.llm.common import append_columns, cut_text, fresh_name, text_blocks

#: Consecutive words that make a window.
WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is scanned in several chained passes.
BROADCAST_BYTES = 16 << 20
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WindowSet:
    """Windows of benchmark items: by length, sorted hashes and for each hash its words and the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        by_len: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            found = [w.encode() for w in _WORD.findall((text or "").translate(_UPPER))]
            width = min(window, len(found))
            for i in range(len(found) - width + 1 if width else 0):
                by_len.setdefault(width, {}).setdefault(b" ".join(found[i : i + width]), set()).add(item)
        self.by_len = {}
        for width, grams in by_len.items():
            table: dict[int, list[tuple[bytes, tuple[str, ...]]]] = {}
            for gram, ids in grams.items():
                table.setdefault(_gram_hash(gram), []).append((gram, tuple(sorted(ids))))
            keys = np.array(sorted(table), W.U)
            bits = np.zeros(1 << 20, bool)
            bits[(keys >> W.U(44)).astype(np.int64)] = True
            self.by_len[width] = (keys, bits, table)

    def scan(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]], dict[int, set[str]]]:
        """Words per text; by text the verified hits as (word, end word, byte, end byte); by text the items."""
        low = W.LOWER[raw]
        starts, ends = W.runs(low, offs, W.ALNUM)
        firsts = W.doc_word_offsets(starts, offs)
        hashes = W.word_hashes(low, starts, ends)
        hits: dict[int, list[tuple[int, int, int, int]]] = {}
        found: dict[int, set[str]] = {}
        for width, (keys, bits, table) in self.by_len.items():
            grams = W.shingle_hashes(hashes, width)
            if not len(grams):
                continue
            maybe = np.flatnonzero(bits[(grams >> W.U(44)).astype(np.int64)])
            at = np.searchsorted(keys, grams[maybe])
            maybe = maybe[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == grams[maybe])]
            docs = np.searchsorted(firsts, maybe, side="right") - 1
            for i, doc in zip(maybe.tolist(), docs.tolist(), strict=True):
                if i + width > firsts[doc + 1]:
                    continue
                gram = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist(), strict=True))
                for known, ids in table[int(grams[i])]:
                    if known == gram:
                        first = int(firsts[doc])
                        hits.setdefault(doc, []).append((i - first, i - first + width, int(starts[i] - offs[doc]), int(ends[i + width - 1] - offs[doc])))
                        found.setdefault(doc, set()).update(ids)
        return np.diff(firsts), hits, found


def _gram_hash(gram: bytes) -> int:
    raw = np.frombuffer(gram, np.uint8)
    offs = np.array([0, len(raw)], np.int64)
    hashes = W.word_hashes(raw, *W.runs(raw, offs, W.ALNUM))
    return int(W.shingle_hashes(hashes, len(hashes))[0])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: What a pass finds out about each document.
FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_words": _SPANS, "hit_chars": _SPANS, "items": T.ArrayType(T.StringType())}
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _as_spans(values: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in v] for v in values], _ARROW_SPANS)


def _scanner(shared, text_col: str, before: dict[str, str] | None):
    """A scan for one piece of the benchmark; ``before`` names the columns in which the earlier pieces' hits stand."""

    def make():
        windows = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(text_col))
            n = batch.num_rows
            counts, by_word, by_char, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for first, _, raw, offs in text_blocks(column):
                n_words, hits, found = windows.scan(raw, offs)
                counts[first : first + len(n_words)] = n_words
                for doc, spans in hits.items():
                    own = raw[offs[doc] : offs[doc + 1]]
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    by_word[first + doc] = merge([(a, b) for a, b, _, _ in spans])
                    by_char[first + doc] = merge([(int(chars[a]), int(chars[b])) for _, _, a, b in spans])
                    items[first + doc] = sorted(found[doc])
            if before:
                for name, own in (("hit_words", by_word), ("hit_chars", by_char)):
                    for k, old in enumerate(batch.column(batch.schema.get_field_index(before[name])).to_pylist()):
                        if old:
                            own[k] = merge([*own[k], *((x["start"], x["end"]) for x in old)])
                for k, old in enumerate(batch.column(batch.schema.get_field_index(before["items"])).to_pylist()):
                    if old:
                        items[k] = sorted({*items[k], *old})
            total = pa.array([sum(b - a for a, b in s) for s in by_word], pa.int64())
            return [pa.array(counts), total, _as_spans(by_word), _as_spans(by_char), pa.array(items, pa.list_(pa.string()))]

        return work

    return make


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in pieces of at most about ``limit`` bytes, each read from Spark by itself."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("item is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 64), F.lit(0)).alias("n")).first().n
    pieces = max(1, -(-total * 2 // limit)) if total > limit else 1
    for k in range(pieces):
        own = items if pieces == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == k)
        yield [(r.item, r.text) for r in own.collect()]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, bench_col: str, broadcast_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of FOUND under names that no other column bears, and those names."""
    sc, out, before = docs.sparkSession.sparkContext, docs, None
    for chunk in _chunks(benchmark, item_col, bench_col, broadcast_bytes):
        names = {c: fresh_name(c) for c in FOUND}
        fields = [T.StructField(names[c], kind) for c, kind in FOUND.items()]
        out = append_columns(out, fields, _scanner(sc.broadcast(WindowSet(chunk, window)), text_col, before), text_col)
        if before:
            out = out.drop(*before.values())
        before = names
    return out, before


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_words, hit_chars (merged half-open spans) and items (ids, sorted as strings).

    Words are runs of digits, letters a-z (A-Z lower-cased) and all that isn't ASCII. A window is ``window``
    consecutive words of an item, or all words of an item that has fewer. Each word inside any occurrence is hit once,
    however many windows cover it. A null or empty text has no words and no hits; an item without words, or without an
    id, matches nothing; items that share an id count once; repeated documents are each scanned. Input columns that
    bear the name of a result column are replaced; all others stay. An empty benchmark leaves everything clean, and an
    empty table of documents gives an empty result.

    The benchmark comes to the driver in pieces of at most about ``broadcast_bytes`` of text; each is broadcast for a pass
    of its own. The passes run one after the other within the same tasks, without a shuffle, and give the same rows however
    many they are.
    """
    out, names = _found(docs, benchmark, window, text_col, item_col, bench_col, broadcast_bytes)
    kept = [c for c in docs.columns if c.lower() not in FOUND]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(own).alias(c) for c, own in names.items()])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The per-document report of :func:`find_contamination`."""
    return found.select(
        F.col(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents that hold any benchmark window, by the rules of :func:`find_contamination`.

    Columns stay as they are, whatever their names; null and empty texts stay, repeated rows stay or go alike.
    """
    found, names = _found(docs, benchmark, window, text_col, item_col, bench_col, broadcast_bytes)
    return found.filter(F.col(names["n_hit"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the hit passages cut out of ``text_col``; a document that is nothing else becomes empty.

    All rows stay, and all columns whatever their names; null and empty texts stay as they are, repeated rows are cut alike.
    """
    found, names = _found(docs, benchmark, window, text_col, item_col, bench_col, broadcast_bytes)
    cut = fresh_name("cut")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            spans = batch.column(batch.schema.get_field_index(names["hit_chars"])).to_pylist()
            return [pa.array([cut_text(t, [(x["start"], x["end"]) for x in own]) if own else t for t, own in zip(texts, spans, strict=True)], pa.string())]

        return work

    out = append_columns(found, [T.StructField(cut, T.StringType())], make, text_col)
    return out.select(*[F.col(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
