"""Substring dedup: paragraphs that repeat across documents, nearly or verbatim, wherever lines begin and end.

Two kinds of paragraphs are banded by MinHash. Lines have 13 bands of 4 minima, tuned for high recall; those that collide
are verified by the exact Jaccard similarity of their word shingles, pair by pair within cells and without a list of
pairs. Windows of 45 words, those of ``spans``, have a single band of one minimum, on which equal windows always collide;
they are verified word by word through 64-bit hashes. Linked lines form clusters by components, and a window's cluster is
that of the least document that holds it; the first occurrence stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import words as W
from strandline.llm.common import cut_text, materialize, releasing, text_blocks
from strandline.llm.components import connected_components
from strandline.llm.near_join import BUCKET_ROWS, alive_sets, bitmap, chained, links_of_cells, names_of, sketch
from strandline.llm.spans import NULL_ID, repeated_spans

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Fewest words of a line that is banded as a whole, and the words of a window; shorter repeats are no passages.
MIN_WORDS = 45
#: Bands and rows of a band: at a similarity of 0.8, one pair in 900 shares no band; at 0.9, one in some millions.
BANDS, ROWS = 13, 4
_FACTORS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | W.U(1)


class Lines:
    """The lines of ``least`` words or more of a block of texts: where they stand, and their sets of shingles.

    ``row`` counts texts of the column, ``line`` the text's lines, ``start`` and ``end`` its characters, ``words`` the line's
    words; flat[bounds[k]:bounds[k + 1]] is the k-th set, sorted, and ``names`` its name.
    """

    def __init__(self, first: int, raw: np.ndarray, offs: np.ndarray, width: int, least: int):
        low = W.LOWER[raw]
        starts, ends = W.runs(low, offs, W.NOT_SPACE)
        breaks = np.flatnonzero(raw == 0x0A)
        lines = np.unique(np.concatenate([offs[:-1], breaks + 1]))  # where lines begin, for every text anew
        lines = lines[lines < len(raw)]
        at = np.searchsorted(starts, np.append(lines, len(raw)))
        pick = np.flatnonzero(np.diff(at) >= max(least, 1))
        self.count = len(pick)
        if not self.count:
            return
        row = np.searchsorted(offs, lines[pick], side="right") - 1
        end = np.append(lines, len(raw))[pick + 1]
        end = end - ((end > lines[pick]) & (raw[end - 1] == 0x0A))
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        begin = chars[offs[row]]
        self.row, self.line = first + row, np.searchsorted(breaks, lines[pick]) - np.searchsorted(breaks, offs[row])
        self.start, self.end, self.words = chars[lines[pick]] - begin, chars[end] - begin, np.diff(at)[pick]
        hashes = W.word_hashes(low, starts, ends)
        grams, a = W.shingle_hashes(hashes, width), at[pick]
        sizes = np.maximum(self.words - width + 1, 0)
        own = np.repeat(np.arange(self.count), sizes)
        flat = grams[np.arange(len(own)) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)] if len(own) else grams[:0]
        short = np.flatnonzero(sizes == 0)  # fewer words than a shingle has: the whole sequence is one
        if len(short):
            whole = np.array([W.whole(width, hashes[a[k] : a[k] + self.words[k]]) for k in short], W.U)
            flat, own = np.concatenate([flat, whole]), np.concatenate([own, short])
        order = np.lexsort((flat, own))
        flat, own = flat[order], own[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])])
        self.flat = flat[new]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=self.count))])
        self.names = names_of(self.flat, self.bounds)


def _lines(column: pa.Array, width: int, least: int) -> Iterator[Lines]:
    for first, _, raw, offs in text_blocks(column):
        if (lines := Lines(first, raw, offs, width, least)).count:
            yield lines


def bands_of(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the bands of the MinHash signatures of the sets flat[a:b], a row for each set."""
    least = np.stack([np.minimum.reduceat(flat * f, bounds[:-1]) for f in _FACTORS], axis=1)
    return W.mix(W.shingle_hashes(least.reshape(-1), ROWS)[::ROWS].reshape(len(least), BANDS) + np.arange(BANDS, dtype=np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    return bands_of(own, np.array([0, len(own)]))[0]


def _occurrences(docs: DataFrame, width: int, least: int) -> DataFrame:
    """One row for each long line of (doc_id, text_id, text): where it stands, words, n and node, and its bands where its
    task meets the node first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for x in _lines(batch.column(2), width, least):
                fresh = []
                for k, node in enumerate(x.names.tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh.append(k)
                marks = np.zeros(x.count, bool)
                marks[fresh] = True
                sizes = np.diff(x.bounds)
                found: list[bytes | None] = [None] * x.count
                if fresh:
                    flat = x.flat[np.repeat(marks, sizes)]
                    for k, own in zip(fresh, bands_of(flat, np.concatenate([[0], np.cumsum(sizes[marks])])), strict=True):
                        found[k] = own.tobytes()
                rows = pa.array(x.row)
                values = [pa.array(v.astype(np.int64)) for v in (x.start, x.end, x.words, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.line.astype(np.int32)), *values, pa.array(x.names), pa.array(found, pa.binary())], names=["doc_id", "text_id", "paragraph", "start", "end", "words", "n", "node", "bands"])

    return docs.mapInArrow(releasing(scan), "doc_id long, text_id long, paragraph int, start long, end long, words long, n long, node long, bands binary")


def _banded():
    """Lines and their bands, from the table of occurrences."""

    def pull(batch: pa.RecordBatch):
        for node, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield node, n, partial(np.frombuffer, own, W.U)

    return pull


def _whole_lines(width: int, least: int):
    """Sets of lines with their sketches and bands, from texts."""

    def make():
        def more(own: np.ndarray) -> tuple[bytes, bytes]:
            return sketch(own) + bands(own).astype(np.uint32).tobytes(), b""

        def pull(batch: pa.RecordBatch):
            for x in _lines(batch.column(0), width, least):
                for node, a, b in zip(x.names.tolist(), x.bounds[:-1].tolist(), x.bounds[1:].tolist(), strict=True):
                    yield node, x.flat[a:b], partial(more, x.flat[a:b])

        return pull

    return make


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def _repeated_lines(docs: DataFrame, width: int, percent: int, least: int) -> DataFrame:
    found = materialize(_occurrences(docs, width, least), "passages").withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    total = found.count() * BANDS
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_ROWS))
    banded = found.filter("bands is not null").select("node", "n", "bands")
    cells = connected_components(chained(banded, _banded, percent, buckets), "passage-cells").withColumnRenamed("root", "cell")
    cells = materialize(cells, "passage-cells")
    sets = alive_sets(docs.select("text"), _whole_lines(width, least), docs.sparkSession.sparkContext.broadcast(bitmap(cells)))
    each = found.groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "paragraph")).alias("first"), F.max("key").alias("last"))
    each = materialize(each, "passage-classes")
    # bands let through little else than what is verified, so that the whole sets are in the one table
    roots = connected_components(links_of_cells(sets, lambda _: sets, each, cells, percent, 1, 1).filter("b is not null"), "passage-links")
    rooted = each.join(roots, "node", "left").select("node", "first", "last", F.coalesce("root", "node").alias("root"))
    clusters = rooted.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first.key != last")
    named = materialize(rooted.select("node", "root").join(clusters, "root").select("node", F.col("first.key").alias("origin"), F.col("first.paragraph").alias("place")), "passage-clusters")
    cluster = F.when(F.col("origin") != NULL_ID, F.col("origin"))
    removed = (F.col("key") != F.col("origin")) | (F.col("paragraph") != F.col("place"))
    return found.join(named, "node").select("doc_id", "text_id", "paragraph", "start", "end", F.col("words").alias("n_words"), cluster.alias("cluster"), removed.alias("removed"))


def repeated_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines that repeat, exactly or nearly, in another document: one row for each of their occurrences.

    doc_id, paragraph (number of the line, from 0), start and end (characters, end exclusive), n_words, cluster (a
    document id: that of the first occurrence) and removed. Two lines of ``min_words`` words or more link when the
    Jaccard similarity of their ``width``-word shingles (A-Z lower-cased, words split at ASCII white space) is at least
    ``percent`` hundredths; clusters are the components of links. A cluster counts if it spans two documents; its first
    occurrence, by document id and line, has removed = false.

    A null or empty text has no lines. A null id stands for one more document, which sorts first. Repeated rows are the
    same document. An empty table gives an empty result; other columns are not carried. Recall is that of the bands;
    what is reported is verified by exact sets of 64-bit shingle hashes. No bucket or cluster is capped.
    """
    return _repeated_lines(_texts(df, id_col, text_col), width, percent, min_words).drop("text_id")


def _repeated(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, min_words: int) -> DataFrame:
    docs = _texts(df, id_col, text_col)
    spans = repeated_spans(docs, run=min_words).withColumn("paragraph", F.lit(None).cast("int"))
    return _repeated_lines(docs, width, percent, min_words).unionByName(spans)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of :func:`repeated_paragraphs`, and those of :func:`~strandline.llm.spans.repeated_spans` with a null paragraph.

    A line that repeats verbatim is in both.
    """
    return _repeated(df, id_col, text_col, width, percent, min_words).drop("text_id")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with what :func:`repeated_passages` marks as removed taken out of its texts; all rows and columns stay.

    A removed line goes with one line break. Rows with a null id, null texts and texts without repeats stay as they are;
    a text that is nothing but repeats becomes empty. Rows are told apart by id and text, so that equal rows are cut alike and
    several texts under one id each by themselves. Other columns may bear any name.
    """
    names = df.columns
    text, doc = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    gone = _repeated(df, id_col, text_col, width, percent, min_words).filter("removed and doc_id is not null")
    gone = gone.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("paragraph", "start", "end")).alias("gone"))
    keyed = inner.withColumns({"doc_id": F.col(doc).cast("long"), "text_id": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    joined = keyed.join(gone, ["doc_id", "text_id"], "left").select(*inner.columns, F.col(text).cast("string").alias("scanned"), "gone")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in inner.schema.fields])
    place = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lists = list(batch.columns[:-2]), batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(batch.num_columns - 2).to_pylist()
            out = []
            for own, spans in zip(texts, lists, strict=True):
                lines = sorted(s["paragraph"] for s in spans or [] if s["paragraph"] is not None)
                leading = sum(k == line for k, line in enumerate(lines))  # these go with the break after, others with that before
                ranges = [(s["start"], s["end"]) if s["paragraph"] is None else (s["start"], s["end"] + 1) if s["paragraph"] < leading else (s["start"] - 1, s["end"]) for s in spans or []]
                out.append(cut_text(own, ranges) if ranges else own)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(releasing(cut), schema).toDF(*names)
