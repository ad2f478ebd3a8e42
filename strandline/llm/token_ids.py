"""Byte-level BPE by Spark's higher-order functions, and back.

A task walks its texts and lists each distinct word (a match of the pre-tokenizer's pattern) once. Spark folds the
ranked merges over the bytes of those words, looking up pairs in a literal rank map, and decodes each word's ids again by
concatenating their pieces. The texts follow as lists of word numbers, so that their ids and their decoded bytes are put
together from their words' without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import words as W
from strandline.llm.common import batches_of, materialize, releasing, string_buffers, text_or_empty

#: Bytes of a word up to which it is folded; the fold's time grows with the square of the length, so longer words
#: are merged by a heap instead, with the same result. At most 255, as entries keep a place in 8 bits.
FOLD_BYTES = 128
#: Distinct words in a row of the plan.
WORDS_PER_ROW = 2000
#: Distinct words that a task remembers before it begins anew, and units of several words that it remembers.
WORDS_HELD, UNITS_HELD = 1_000_000, 400_000
#: Rows of an Arrow batch at most, so that a task holds few texts at once.
BATCH_ROWS = 512
#: Least bytes of input that a task should see, so that it meets most words only once.
TASK_BYTES = 128 << 20
#: Stands for a text's border in pair keys; no id reaches it.
BORDER = 65535


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def unicode_ranges(prop: str, below: int = sys.maxunicode + 1) -> str:
    """The code points of a Unicode class up to ``below``, as a regular expression's ranges, as the tiktoken library's
    engine has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    probe = tiktoken.Encoding("probe", pat_str=prop, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = np.frombuffer(probe.decode_bytes(probe.encode_ordinary(every[:below])).decode().encode("utf-32-le"), np.uint32)
    cuts = np.flatnonzero(np.diff(found) != 1) + 1
    return "".join(f"\\U{int(x[0]):08X}-\\U{int(x[-1]):08X}" for x in np.split(found, cuts) if len(x))


#: Texts of characters below these are split by patterns with short classes.
LIMITS = (0x80, 0x250, sys.maxunicode + 1)


def exact_pattern(pattern: str, below: int = LIMITS[-1]) -> str:
    """``pattern`` with its Unicode classes spelled out, so that every engine splits alike, for characters up to ``below``."""
    for prop in (r"\p{L}", r"\p{N}"):
        ranges = unicode_ranges(prop, below) if prop in pattern else ""
        pattern = _replace(pattern, prop, ranges)
    return pattern


def _replace(pattern: str, prop: str, ranges: str) -> str:
    """Put ``ranges`` for ``prop``, in brackets where it doesn't stand in a class already."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        if pattern.startswith(prop, at):
            out += ranges if inside else f"[{ranges}]"
            at += len(prop)
            continue
        if pattern[at] == "\\":
            out += pattern[at : at + 2]
            at += 2
            continue
        inside = {"[": True, "]": False}.get(pattern[at], inside)
        out += pattern[at]
        at += 1
    return out


class RankMap:
    """Pairs of ids that merge: an array of (pair, id) without collisions, found by a remainder and a displacement."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= BORDER:
            raise ValueError(f"ids must stay below {BORDER}")
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 16 | right)
                    ids.append(rank)
        self._place(np.array(keys, np.int64), np.array(ids, np.int64))
        first, known = [ranks[bytes([i])] for i in range(256)], dict(zip(keys, ids, strict=True))
        ends = [*first, BORDER]
        self.opening = [1 << 56 | BORDER << 16 | x for x in first]
        self.pairs = [known.get(x << 16 | y, 1 << 16) << 40 | x << 16 | y for x in first for y in ends]

    def _place(self, keys: np.ndarray, ids: np.ndarray) -> None:
        slots, groups = _prime(max(7, 2 * len(keys))), _prime(max(5, len(keys) // 2))
        while True:  # a larger array until no two pairs of a group share their remainder and all find a place
            home, group = keys % slots, keys % groups
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(begins, len(keys)))
            table, shift, used = np.full(slots, (1 << 47) - 1, np.int64), np.zeros(groups, np.int64), np.zeros(slots, bool)
            if all(self._settle(order[begins[g] : begins[g] + sizes[g]], home, group, keys, ids, table, shift, used) for g in np.argsort(-sizes, kind="stable") if sizes[g] > 1):
                break
            slots = _prime(slots + slots // 7)
        single = order[begins[sizes == 1]]
        free = np.flatnonzero(~used)[: len(single)]
        shift[group[single]] = (free - home[single]) % slots
        table[free] = keys[single] << 16 | ids[single]
        self.table, self.shift, self.slots, self.groups = table, shift, slots, groups

    @staticmethod
    def _settle(own, home, group, keys, ids, table, shift, used) -> bool:
        homes, slots = home[own], len(table)
        if len(np.unique(homes)) < len(homes):
            return False
        for low in range(0, slots, 256):
            tries = np.arange(low, min(low + 256, slots))
            fits = ~used[(homes[:, None] + tries) % slots].any(axis=0)
            if fits.any():
                by = int(tries[fits.argmax()])
                at = (homes + by) % slots
                used[at], table[at], shift[group[own[0]]] = True, keys[own] << 16 | ids[own], by
                return True
        return False

    def fold(self, word: Column) -> Column:
        """The ids of a word, an array of its bytes as numbers: a fold that merges the leftmost pair of the lowest rank until none is left.

        The accumulator has an entry for each pair of neighbours, borders included: from the top, the rank of what it
        merges to (65536: nothing), the byte at which its left part begins, and the ids of its left and right part. Its
        least entry is the next merge, which changes the two entries beside it.
        """
        table, shift = _literal(self.table), _literal(self.shift)
        opening, pairs = _literal(self.opening), _literal(self.pairs)
        low16, low32, begin8 = _long(0xFFFF), _long(0xFFFFFFFF), _long(0xFF << 32)

        def entry(e):
            """With its rank, from an entry without one; an unknown key's slot gives more than 65536."""
            key = e.bitwiseAND(low32)
            found = F.get(table, (key % self.slots + F.get(shift, key % self.groups)) % self.slots).bitwiseXOR(F.shiftleft(key, 16))
            return F.shiftleft(F.least(found, _long(1 << 16)), 40).bitwiseOR(e)

        # bytes are paired by a table of their own, in which 256 stands for the end
        paired = F.transform(word, lambda byte, i: F.get(pairs, byte.cast("int") * 257 + F.coalesce(F.get(word, i + 1), F.lit(256))).bitwiseOR(F.shiftleft((i + 1).cast("long"), 32)))
        entries = F.concat(F.array(F.get(opening, F.get(word, F.lit(0)))), paired)

        def step(acc, _):
            def merged(least):
                def at(p):
                    rank, left, right = F.shiftright(least, 40), F.get(acc, p - 2), F.get(acc, p)
                    before = left.bitwiseAND(_long((0xFF << 32) | 0xFFFF0000)).bitwiseOR(rank)
                    after = least.bitwiseAND(begin8).bitwiseOR(F.shiftleft(rank, 16)).bitwiseOR(right.bitwiseAND(low16))
                    return F.concat(F.slice(acc, F.lit(1), p - 2), F.transform(F.array(before, after), entry), F.slice(acc, p + 2, F.size(acc)))

                return F.when(least < (1 << 56), _let(F.array_position(acc, least).cast("int"), at)).otherwise(acc)

            return _let(F.array_min(acc), merged)

        def finish(acc):
            return F.transform(F.slice(acc, F.lit(2), F.size(acc)), lambda e: F.shiftright(e, 16).bitwiseAND(low16).cast("int"))

        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), entries, step, finish)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(numbers) -> Column:
    """A literal array of longs.

    Made from a primitive array, whose plan text is short and whose numbers aren't boxed. Without a JVM at hand it is
    made from text, which Catalyst folds into the same constant.
    """
    session = SparkSession.getActiveSession()
    if not hasattr(session, "_jvm"):
        return F.expr(f"cast(split('{','.join(map(str, numbers))}', ',') as array<bigint>)")
    jvm, data = session._jvm, np.asarray(numbers, ">i8")
    array = session.sparkContext._gateway.new_array(jvm.long, len(data))
    jvm.java.nio.ByteBuffer.wrap(data.tobytes()).asLongBuffer().get(array)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    kind = jvm.org.apache.spark.sql.types.DataTypes.createArrayType(jvm.org.apache.spark.sql.types.DataTypes.LongType, False)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(array), kind)))


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs: time grows with n log n, for words of any length."""
    import heapq

    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(word[start[a] : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


# A text without touching or rare white space is cut into units, of which each space begins one: the pre-tokenizer splits them
# as if they stood alone.
#: Kinds of bytes: 1 for ASCII white space, 2 for rare kinds of it, 4 for the first bytes of all other white space in
#: UTF-8, 8 for its second bytes (and those of some characters besides).
_KINDS = np.array([(b == 0x20 or 0x09 <= b <= 0x0D) + 2 * (0x1C <= b <= 0x1F) + 4 * (b in (0xC2, 0xE1, 0xE2, 0xE3)) + 8 * (b in (0x80, 0x81, 0x85, 0x9A, 0xA0)) for b in range(256)], np.uint8)


def whole_texts(column: pa.Array) -> np.ndarray:
    """Which texts have white space that touches other white space, or is rare: those aren't cut into units."""
    raw, offs = string_buffers(column)
    kinds = _KINDS[raw]
    pairs = kinds[:-1] & kinds[1:] & 1 | (kinds[:-1] >> 2 & kinds[1:] >> 3) & 1
    odd = np.concatenate([np.flatnonzero(pairs) + 1, np.flatnonzero(kinds & 2)])
    return np.bincount(np.searchsorted(offs, odd, side="right") - 1, minlength=len(offs) - 1) > 0


def distinct_units(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of a column's texts, which of them stand in the texts, one after the other, and how many in each.

    A text that can't be cut is one unit; all others are cut and told apart by Arrow, without a string for each unit.
    """
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.string()).fill_null("")
    odd = whole_texts(column)
    split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
    bounds = split.offsets.to_numpy().astype(np.int64)
    encoded = split.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
    strings, lengths, firsts = encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(bounds), bounds[:-1] - bounds[0]
    keys = encoded.indices.to_numpy().astype(np.int64) * 2 + 1  # odd: after a space, which is its own
    keys[firsts] -= 1
    nothing = 2 * strings.index("") if "" in strings else -1
    skipped = (keys[firsts] == nothing) & (lengths > 1)  # a space begins the text
    keys = np.delete(keys, firsts[skipped])
    present = np.flatnonzero(np.bincount(keys, minlength=1))
    names = [" " + strings[k >> 1] if k & 1 else strings[k >> 1] for k in present.tolist()]
    place = np.zeros(2 * len(strings) + 1, np.int64)
    place[present] = np.arange(len(present))
    wholes = {text: len(names) + k for k, text in enumerate(dict.fromkeys(column.filter(pa.array(odd)).to_pylist()))}
    sizes = np.ones(len(odd), np.int64)
    sizes[~odd] = lengths - skipped
    numbers, apart = np.empty(int(sizes.sum()), np.int64), (np.cumsum(sizes) - sizes)[odd]
    cut = np.ones(len(numbers), bool)
    cut[apart] = False
    numbers[cut] = place[keys]
    numbers[apart] = [wholes[text] for text in column.filter(pa.array(odd)).to_pylist()]
    return [*names, *wholes], numbers, sizes


def units_of(column: pa.Array) -> list[list[str]]:
    """Units of each text; a text that can't be cut is one unit."""
    names, numbers, sizes = distinct_units(column)
    units, ends = [names[k] for k in numbers.tolist()], np.cumsum(sizes).tolist()
    return [units[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]


class Listing:
    """Numbers the distinct words of a task, and gives texts as lists of these numbers.

    One table holds all: a word, which may be a unit of its own, has its number, a unit of several words -1 less the place where their
    numbers stand side by side.
    """

    def __init__(self, patterns: list[str], units_held: int):
        self.plain, self.latin, self.every = (regex.compile(p).findall for p in patterns)
        self.units_held, self.limit = units_held, chr(LIMITS[1])
        letters = "".join(chr(x) for x in range(128) if chr(x).isalpha())
        # does the pattern take any run of ASCII letters, and a space before it, as one word? Then such units needn't be split
        self.letters_join = all(self.plain(x) == [x] for y in (letters, letters[::-1], letters.swapcase()) for x in (y, " " + y))
        self.begin()

    def begin(self) -> None:
        self.codes: dict[str, int] = {}
        self.words = 0
        self.flat, self.starts = array("i"), array("q", [0])

    def _number(self, word: str, fresh: list[str]) -> int:
        if (k := self.codes.get(word)) is None:
            k = self.codes[word] = self.words
            self.words += 1
            fresh.append(word)
        return k

    def _add(self, unit: str, fresh: list[str]) -> None:
        if self.letters_join and unit[1:].isalpha() and unit.isascii() and (unit[0] == " " or unit[0].isalpha()):
            self._number(unit, fresh)
            return
        split = (self.plain if unit.isascii() else self.latin if max(unit) < self.limit else self.every)(unit)
        if len(split) == 1:
            self._number(unit, fresh)
        else:
            self.flat.extend([self._number(w, fresh) for w in split])
            self.codes[unit] = -len(self.starts)
            self.starts.append(len(self.flat))

    def list(self, column: pa.Array) -> tuple[list[str], list[bytes]]:
        """The words that are new, in the order of their numbers, and each text's numbers as 32-bit integers."""
        names, numbers, sizes = distinct_units(column)
        fresh: list[str] = []
        known = self.codes
        found = list(map(known.get, names))
        late = [k for k, code in enumerate(found) if code is None]
        new = [names[k] for k in late]
        passing = new if len(self.starts) > self.units_held else [u for u in new if len(u) > 64]
        for u in new if passing is not new else ():
            if len(u) <= 64:
                self._add(u, fresh)
        kept, held = len(self.starts), len(self.flat)
        for u in passing:
            self._add(u, fresh)
        for k in late:
            found[k] = known[names[k]]
        codes = np.array(found, np.int64)[numbers]
        several = np.flatnonzero(codes < 0)
        counts, flat = np.ones(len(codes), np.int64), np.array(self.flat, np.int32)
        starts = np.array(self.starts, np.int64)
        place = -1 - codes[several]
        counts[several] = starts[place + 1] - starts[place]
        ends = np.cumsum(counts)
        out = np.repeat(codes, counts).astype(np.int32)
        lengths = counts[several]
        at = np.repeat(ends[several] - lengths, lengths) + (within := np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        out[at] = flat[np.repeat(starts[place], lengths) + within]
        for u in passing:  # words stay, long and late units don't
            if self.codes[u] < 0:
                del self.codes[u]
        del self.starts[kept:], self.flat[held:]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])] * 4
        data = out.tobytes()
        return fresh, [data[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


class Ids:
    """Holds the ids of each word of a task, side by side, and puts those of a text together."""

    #: What is given for each text, and whether that takes the bytes which words decode to.
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    decodes = False

    def __init__(self, ranks: dict[bytes, int]):
        self.ids, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.words = 0

    @staticmethod
    def grown(held: np.ndarray, size: int) -> np.ndarray:
        return held if len(held) >= size else np.concatenate([held, np.zeros(max(size, 2 * len(held)) - len(held), held.dtype)])

    def add(self, words: pa.ListArray, decoded: pa.Array | None = None) -> None:
        """More words, numbered on from those held; each is a list of ids, and perhaps the bytes that these decode to."""
        bounds = words.offsets.to_numpy()
        fresh = words.values.to_numpy()[bounds[0] : bounds[-1]]
        begin, n = int(self.starts[self.words]), len(words)
        self.starts, self.ids = self.grown(self.starts, self.words + n + 1), self.grown(self.ids, begin + len(fresh))
        self.starts[self.words + 1 : self.words + n + 1] = begin + (bounds[1:] - bounds[0])
        self.ids[begin : begin + len(fresh)] = fresh
        self.words += n

    def of(self, words: np.ndarray) -> np.ndarray:
        first = self.starts[words]
        sizes = self.starts[words + 1] - first
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def text(self, words: np.ndarray) -> tuple:
        return (self.of(words),)


class Decoded(Ids):
    """Gives the ids of a text, and a digest of the bytes that they decode to."""

    fields = [*Ids.fields, T.StructField("decoded_sha256", T.StringType())]
    decodes = True

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.bytes: list[bytes] = []

    def add(self, words: pa.ListArray, decoded: pa.Array | None = None) -> None:
        super().add(words)
        self.bytes += decoded.to_pylist()

    def decoded(self, words: np.ndarray) -> str:
        return hashlib.sha256(b"".join(map(self.bytes.__getitem__, words.tolist()))).hexdigest()

    def text(self, words: np.ndarray) -> tuple:
        return self.of(words), self.decoded(words)


class Digests(Decoded):
    """Gives the number of a text's ids, and digests of their decimal text and of the bytes that they decode to."""

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.decimals = [str(k).encode() for k in range(max(ranks.values()) + 1)]

    def text(self, words: np.ndarray) -> tuple:
        ids = self.of(words).tolist()
        pick = itemgetter(*ids)(self.decimals) if len(ids) > 1 else [self.decimals[k] for k in ids]
        return len(ids), hashlib.sha256(b",".join(pick)).hexdigest(), self.decoded(words)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", make: type[Ids] = Ids, words_held: int | None = None, units_held: int | None = None) -> DataFrame:
    """``id_col``, and ids (array of int) of each whole text under the ranks, each match of ``pattern`` by itself.

    Equal to the tiktoken library's encode_ordinary with these ranks. A null text counts as empty and has no ids;
    repeated rows are each encoded, a null id is kept, an empty table gives an empty result, and columns other than
    the two are not carried. Words longer than FOLD_BYTES are merged by a heap, with the same result: the fold's time grows
    with the square of a word's length, and a text may be one word. ``make`` may give other fields than the ids, such as
    :class:`Decoded` and :class:`Digests`.

    The result is written to the shared folder at once, as Arrow batches are limited to BATCH_ROWS rows meanwhile: two Python
    workers and the JVM hold one each. A task remembers ``words_held`` distinct words before it begins anew, and
    ``units_held`` units of text; fewer take less memory and more time, with the same result.
    """
    spark = df.sparkSession
    words_held, units_held = words_held or WORDS_HELD, units_held or UNITS_HELD
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, [exact_pattern(pattern, x) for x in LIMITS]))
    fields = make.fields
    names = ["row_id", "words", "long", "doc", "anew"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, patterns = shared.value
        listing = Listing(patterns, units_held)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                if anew := listing.words > words_held:
                    listing.begin()
                fresh, docs = listing.list(part.column(1))
                words = [w.encode() for w in fresh]
                folded = [_byte_lists([w if len(w) <= FOLD_BYTES else b"" for w in words[k : k + WORDS_PER_ROW]]) for k in range(0, len(words), WORDS_PER_ROW)]
                heaped = [[None if len(w) <= FOLD_BYTES else merge_by_heap(w, ranks) for w in words[k : k + WORDS_PER_ROW]] for k in range(0, len(words), WORDS_PER_ROW)]
                if anew and not folded:
                    folded, heaped = [_byte_lists([])], [[]]
                if folded:
                    nulls = pa.nulls(len(folded))
                    yield pa.RecordBatch.from_arrays([nulls.cast(id_arrow), pa.ListArray.from_arrays(np.cumsum([0, *map(len, folded)], dtype=np.int32), pa.concat_arrays(folded)), pa.array(heaped, pa.list_(pa.list_(pa.int32()))), nulls.cast(pa.binary()), pa.array([anew and k == 0 for k in range(len(folded))])], names=names)
                nulls = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), nulls.cast(pa.list_(pa.list_(pa.int16()))), nulls.cast(pa.list_(pa.list_(pa.int32()))), pa.array(docs, pa.binary()), nulls.cast(pa.bool_())], names=names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = make(shared.value[0])
        for batch in batches:
            ids_of, docs, anew = batch.column(1), batch.column(2), batch.column(3)
            out, rows = [], []
            for k in range(batch.num_rows):
                if docs[k].is_valid:
                    out.append(kept.text(np.frombuffer(docs[k].as_buffer(), np.int32)))
                    rows.append(k)
                else:
                    if anew[k].as_py():
                        kept = make(shared.value[0])
                    own = ids_of[k].values
                    kept.add(own.field("ids"), own.field("bytes")) if make.decodes else kept.add(own)
            if rows:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, a) for c, a in zip(columns, arrow, strict=True))], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    texts = df.select(F.col(id_col).alias("row_id"), text_or_empty(text_col).alias("text"))
    id_type = texts.schema["row_id"].dataType
    id_arrow, arrow = to_arrow_type(id_type), [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([T.StructField(id_col, id_type), *fields])
    middle = T.StructType([T.StructField("row_id", id_type), T.StructField("words", T.ArrayType(T.ArrayType(T.ShortType()))), T.StructField("long", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("doc", T.BinaryType()), T.StructField("anew", T.BooleanType())])
    whole = wide_tasks(texts).mapInArrow(releasing(listed, shared), middle)
    merged = F.zip_with("words", "long", lambda w, ids: F.coalesce(ids, F.when(F.size(w) > 0, RankMap(ranks).fold(w))))
    if make.decodes:
        merged = F.transform(merged, lambda ids: F.struct(ids.alias("ids"), _decoded(ids, ranks).alias("bytes")))
    folded = whole.select("row_id", F.when(F.col("words").isNotNull(), merged).alias("ids"), "doc", "anew")
    with batches_of(spark, BATCH_ROWS):
        return materialize(folded.mapInArrow(releasing(joined, shared), schema), "token-ids")


def _byte_lists(words: list[bytes]) -> pa.ListArray:
    """Words as lists of their bytes' numbers."""
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, words)], dtype=np.int32), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16)))


def wide_tasks(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions where the session splits files finely, but at least one for each core."""
    spark = df.sparkSession
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = df.rdd.getNumPartitions()
    few = max(spark.sparkContext.defaultParallelism, -(-parts * share // TASK_BYTES))
    return df.coalesce(few) if few < parts else df


def _decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their pieces, looked up in a literal table, one after the other."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        pieces[k] = token
    table = F.expr("split('" + ",".join(p.hex() for p in pieces) + "', ',')")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each row's ids, by concatenating their binary pieces.

    Null ids give null, no ids no bytes; an id that the ranks don't have gives no bytes; a column named ``out_col`` is replaced.
    """
    return df.withColumn(out_col, _decoded(F.col(ids_col), load_ranks(ranks_path)))


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the bytes decoded from the ids).

    Rows and odd values are treated as by :func:`encode`.
    """
    return encode(df, ranks_path, pattern, id_col, text_col, Digests)
