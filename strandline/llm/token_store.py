"""Token ids in binary files: a shared zstandard dictionary, one frame for each document, and an index of offsets.

A file holds, in ascending order of ids: a header with the dictionary's hash, the frames, an index entry for each
document, and a footer. Any document is read by its index entry alone.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, releasing, scratch_path, text_or_empty
from strandline.llm.token_ids import Ids, distinct_units, wide_tasks

#: Fixed values of the format: magic numbers and the layout of header, index entry and footer.
MAGIC, END = b"STRNDID1", b"STRNDEND"
HEADER, FOOTER = struct.Struct("<8s32sB7x"), struct.Struct("<QQQ8s")
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("tokens", "<u4"), ("null", "u1"), ("pad", "u1", 7)])
#: Documents, and bytes of the serialized ids of each, on which a dictionary is trained at most, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 4000, 16_384, 64 << 10
#: Texts that one file should hold, in bytes.
FILE_BYTES = 64 << 20
#: What orders documents: the id, a null one first, and a hash of the text.
_KEY, _NULL = np.dtype([("id", "<i8"), ("tie", "<i8")]), np.iinfo(np.int64).min
#: Units of text whose ids a task remembers.
UNITS_HELD = 1_000_000
#: Texts that are encoded together: more meet more units once, and take more memory.
PART_ROWS = 2048
#: Units that the tokenizer is given at once, in one text, and how many such texts; its results are many times as large as ids.
UNITS_JOINED, TEXTS_AT_ONCE = 1024, 4
LEVEL = 3


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    end_id: int
    dictionary: bytes
    folder: str
    width: int


class UnitEncoder:
    """Encodes texts unit by unit with a tokenizers file; the ids of units stand side by side, numbered by their unit."""

    def __init__(self, tokenizer: str, dtype: np.dtype):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.known = Tokenizer.from_str(tokenizer), dtype, {}
        self.flat, self.starts, self.count = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, dtype).tobytes() for m in ".,"}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # one character of a byte-level token stands for one byte
            self.sizes[k] = len(token)

    def _encodings(self, texts: list[str], at_once: int) -> Iterator:
        for k in range(0, len(texts), at_once):
            yield from self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)

    def _fresh(self, fresh: list[str]) -> None:
        """A mark at the end of a word is a token of its own, so the word is encoded without it. Units that begin with a
        space are encoded many at once: they split at those spaces, and the tokens' sizes tell where each begins."""
        known, got = self.known, {}
        marked = {u: u[:-1] for u in fresh if u[-1:] in self.marks and "a" <= u[-2:-1] < "\u0250" and u[-2].isalpha()}
        need = list(dict.fromkeys(v for u in fresh if (v := marked.get(u, u)) not in known))
        plain = [u[:1] == " " and u[1:2].strip() != "" and u[-1:].strip() != "" for u in need]
        spaced, singles = list(compress(need, plain)), [u for u, own in zip(need, plain, strict=True) if not own]
        chunks = [spaced[k : k + UNITS_JOINED] for k in range(0, len(spaced), UNITS_JOINED)]
        width = self.dtype.itemsize
        for chunk, e in zip(chunks, self._encodings(["".join(c) for c in chunks], TEXTS_AT_ONCE), strict=True):
            ids = np.array(e.ids, np.int64)
            begins = np.concatenate([[0], np.cumsum(self.sizes[ids])])
            ends = np.cumsum([len(u.encode()) for u in chunk])
            cuts = np.searchsorted(begins, ends)
            if begins[-1] != ends[-1] or (begins[np.minimum(cuts, len(ids))] != ends).any():
                singles += chunk
                continue
            data, at = ids.astype(self.dtype).tobytes(), 0
            for u, cut in zip(chunk, (cuts * width).tolist(), strict=True):
                got[u] = data[at:cut]
                at = cut
        for u, e in zip(singles, self._encodings(singles, UNITS_JOINED * TEXTS_AT_ONCE), strict=True):
            got[u] = np.array(e.ids, self.dtype).tobytes()
        for u, word in marked.items():
            if (own := got.get(word)) is None:
                own = self._held(known[word])
            got[u] = own + self.marks[u[-1]]
        if got:
            ids, sizes = np.frombuffer(b"".join(got.values()), self.dtype), np.fromiter(map(len, got.values()), np.int64, len(got)) // width
            begin, end = int(self.starts[self.count]), self.count + len(got)
            self.starts, self.flat = Ids.grown(self.starts, end + 1), Ids.grown(self.flat, begin + len(ids))
            self.starts[self.count + 1 : end + 1] = begin + np.cumsum(sizes)
            self.flat[begin : begin + len(ids)] = ids
            known.update(zip(got, range(self.count, end), strict=True))
            self.count = end

    def _held(self, number: int) -> bytes:
        return self.flat[self.starts[number] : self.starts[number + 1]].tobytes()

    def _forget(self, count: int, entries: int) -> None:
        """Drop what came last, down to so many units."""
        for _ in range(len(self.known) - entries):
            self.known.popitem()
        self.count = count

    def encode(self, column: pa.Array) -> list[bytes]:
        """The serialized ids of each text."""
        names, numbers, sizes = distinct_units(column)
        known = self.known
        found = list(map(known.get, names))
        late = [k for k, number in enumerate(found) if number is None]
        before = self.count, len(known)
        self._fresh([names[k] for k in late if len(names[k]) <= 64])
        if self.count <= UNITS_HELD:  # short units stay as long as there is room
            before = self.count, len(known)
        self._fresh([names[k] for k in late if len(names[k]) > 64])
        for k in late:
            found[k] = known[names[k]]
        places = np.array(found, np.int64)
        first = self.starts[places]
        lengths = self.starts[places + 1] - first
        counts = lengths[numbers]
        ends = np.cumsum(counts)
        data = self.flat[np.repeat(first[numbers] - ends + counts, counts) + np.arange(int(counts.sum()))].tobytes()
        self._forget(*before)
        bounds = (np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])] * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; too few samples become the dictionary's content themselves."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams documents, in order, into one file; nothing is seen under its name before it is complete."""

    def __init__(self, uri: str, dictionary: bytes, width: int):
        self.system, self.path = _file_system(uri)
        self.width, self.entries = width, []
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.system.open_output_stream(self.partial)
        self.at, self.tokens = HEADER.size, 0
        self.out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))

    def add(self, doc_id: int | None, frame: bytes, tokens: int) -> None:
        self.out.write(frame)
        self.entries.append((doc_id or 0, self.at, len(frame), tokens, doc_id is None, 0))
        self.at += len(frame)
        self.tokens += tokens

    def close(self) -> tuple[int, int]:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.entries), self.tokens, END))
        self.out.close()
        self.system.move(self.partial, self.path)
        return len(self.entries), self.tokens


class Reader:
    """Reads documents of one file by place or by id."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, digest, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        index, docs, self.tokens, end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or end != END:
            raise ValueError(f"{uri} isn't a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(docs * ENTRY.itemsize, index), ENTRY)
        self.inflate = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, place: int) -> np.ndarray:
        entry = self.index[place]
        data = self.inflate(self.file.read_at(int(entry["bytes"]), int(entry["offset"])), max_output_size=int(entry["tokens"]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this id, by binary search in the index."""
        first = int(self.index["null"].sum())
        place = first + int(np.searchsorted(self.index["id"][first:], doc_id))
        return self.ids(place) if place < len(self.index) and self.index["id"][place] == doc_id else None


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _sample(docs: DataFrame, tokenizer: str, dtype: np.dtype, rows: int) -> list[bytes]:
    """Serialized ids of documents picked by a hash, whatever their length, each cut to SAMPLE_BYTES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer, dtype)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in encoder.encode(batch.column(0))], pa.binary())], names=["ids"])

    every = max(1, 2 * rows // SAMPLE_DOCS)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).select("text")
    return [bytes(r.ids) for r in picked.mapInArrow(releasing(cut), "ids binary").limit(SAMPLE_DOCS).collect()]


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Where files begin: the first (id, tie) of each but the first, as Spark's range partitioning finds them from ids alone."""
    if parts < 2:
        return np.zeros(0, _KEY)
    ranged = docs.select("doc_id", "tie").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect()
    keys = sorted((r.first.doc_id if r.first.doc_id is not None else _NULL, r.first.tie) for r in firsts)
    return np.array(keys[1:], _KEY)


def write_ids(df: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> tuple[str, bytes, list[tuple[str, int, int]]]:
    """Write the ids of every whole text, ``end_id`` after each, and return (folder, dictionary, files).

    ``files`` lists (uri, documents, tokens) by ascending ids. The dictionary is trained on at most SAMPLE_DOCS documents,
    SAMPLE_BYTES of the serialized ids of each; it only helps compression. A null text is empty and holds the end id alone; null
    ids stand first; rows with the same id follow each other, by a hash of their text, and may go on in the next file; an
    empty table gives no files. Other columns are not carried. The order of ids comes from ranges of the id column alone, so
    texts are encoded once and only compressed frames are shuffled, each file's to a task of its own. A task that runs again
    writes its file anew under the same name; a store must move a file at once for that name never to show half a file.
    """
    spark = df.sparkSession
    folder = (folder or scratch_path(spark, "token-ids")).rstrip("/")
    with open(tokenizer_path) as f:
        tokenizer = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    dtype = np.dtype(f"<u{width}")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    stats = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if not stats.rows:
        return folder, b"", []
    dictionary = train_dictionary(_sample(docs, tokenizer, dtype, stats.rows))
    bounds = _bounds(docs, -(-stats.size // file_bytes))
    shared = spark.sparkContext.broadcast((Settings(tokenizer, end_id, dictionary, folder, width), bounds))

    def pack_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds = shared.value
        encoder = UnitEncoder(own.tokenizer, dtype)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(own.dictionary)).compress
        end = np.array([own.end_id], dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                ids = [x + end for x in encoder.encode(part.column(1))]
                keys = np.empty(part.num_rows, _KEY)
                keys["id"], keys["tie"] = part.column(0).fill_null(_NULL).to_numpy(), part.column(2).to_numpy()
                files = pa.array(np.searchsorted(bounds, keys, side="right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([files, part.column(0), part.column(2), pa.array([len(x) // own.width for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary())], names=["file", "doc_id", "tie", "tokens", "frame"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        now, writer = None, None

        def done() -> pa.RecordBatch:
            docs, tokens = writer.close()
            return pa.RecordBatch.from_pylist([{"file": now, "docs": docs, "tokens": tokens}], schema=pa.schema([("file", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for file, doc_id, _, tokens, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if writer:
                        yield done()
                    now, writer = file, Writer(file_uri(own.folder, file), own.dictionary, own.width)
                writer.add(doc_id, frame, tokens)
        if writer:
            yield done()

    frames = wide_tasks(docs).mapInArrow(releasing(pack_frames), "file int, doc_id long, tie long, tokens long, frame binary")
    sorted_frames = frames.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("file", "doc_id", "tie", "frame")
    with batches_of(spark, PART_ROWS):  # no batch is larger than what is encoded together
        written = sorted_frames.mapInArrow(releasing(store), "file int, docs long, tokens long").collect()
    return folder, dictionary, [(file_uri(folder, r.file), r.docs, r.tokens) for r in sorted(written, key=lambda r: r.file)]


def file_uri(folder: str, file: int) -> str:
    return f"{folder}/ids-{file:08d}.bin"


def read_ids(spark: SparkSession, dictionary: bytes, files: list[tuple[str, int, int]]) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the ids as stored.

    One row for each document that was written, repeated ones too; a null id comes back as null; no files give no rows.
    """
    before, rows = 0, []
    for uri, _, tokens in files:
        rows.append((uri, before, len(rows)))
        before += tokens
    shared = spark.sparkContext.broadcast(dictionary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(uri, shared.value)
                counts = np.zeros(len(reader.index), np.int64)
                crcs = np.zeros(len(reader.index), np.int64)
                for k in range(len(reader.index)):
                    ids = reader.ids(k)
                    counts[k], crcs[k] = len(ids), zlib.crc32(ids.tobytes())
                doc = pa.array(reader.index["id"].copy(), pa.int64(), mask=reader.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "uri string, start long, number int")
    return table.repartitionById(max(1, len(rows)), "number").mapInArrow(releasing(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")
