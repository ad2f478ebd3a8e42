"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) the vectors of its letters,
each permuted by its distance from the n-gram's end; a text is the bundle (sum) of its n-grams' vectors, a language the
bundle of its texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import BLOCK_BYTES, append_columns, releasing, text_blocks

#: Components of a vector.
DIMENSIONS = 1024
#: Letters of an n-gram.
ORDER = 3
#: Texts that are counted together, and n-grams that are turned into vectors together.
TEXTS, GRAMS = 128, 2048
#: Labels that a table may have; more are refused, as each is a prototype on the driver and in every task.
LANGUAGES = 1000
#: A text is familiar unless its n-grams fit its language worse than this share of what that language's own n-grams do, by more
#: than this many deviations of the noise, which is 1 for one n-gram and falls with the root of their number.
FAMILIAR_SHARE, FAMILIAR_NOISE = 0.25, 3.0
SEED = 20240601
UNDETERMINED = "und"
#: Code points; 0 stands for a gap, any run of non-letters.
_POINTS = 0x110000
#: Bytes at which a long text may be cut: ASCII, but no letter.
_GAPS = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def _letter_table() -> np.ndarray:
    """For each code point of the first three planes its lower-case letter, 0 if it is none; letters beyond are left alone."""
    out = np.zeros(_POINTS, np.int32)
    for cp in range(0x40000):
        if (ch := chr(cp)).isalpha():
            out[cp] = ord(ch.lower()[:1])
    return out


_table: list[np.ndarray] = []


@dataclass
class Encoder:
    """Turns blocks of text into n-gram counts and counts into bundled vectors."""

    dimensions: int = DIMENSIONS
    seed: int = SEED
    vectors: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not _table:
            _table.append(_letter_table())
        self.table = _table[0]
        self.place = np.zeros(_POINTS, np.int32)

    def letter(self, point: int) -> np.ndarray:
        """The random vector of a letter, or of the gap: each code point has its own."""
        if (own := self.vectors.get(point)) is None:
            rng = np.random.default_rng([self.seed, point])
            own = self.vectors[point] = (rng.integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return own

    def ngram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of n-grams, given as rows of code points."""
        points, local = np.unique(grams, return_inverse=True)
        base, local = np.stack([self.letter(int(p)) for p in points]), local.reshape(grams.shape)
        out = np.roll(base, ORDER - 1, axis=1)[local[:, 0]]
        for k in range(1, ORDER):
            out = out * np.roll(base, ORDER - 1 - k, axis=1)[local[:, k]]
        return out.astype(np.float32)

    def ngrams(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams as rows of code points; the number and the text of each that occurs; whether texts have a letter."""
        lead = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])[offs]
        symbols = self.table[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        sums = np.concatenate([[0], np.cumsum(symbols > 0)])
        lettered = sums[before[1:]] > sums[before[:-1]]
        # every text begins and ends with a gap, and a run of non-letters is one gap
        padded = np.append(np.insert(symbols, before[:-1], 0), 0)
        doc = np.append(np.repeat(np.arange(len(before) - 1), np.diff(before) + 1), max(len(before) - 2, 0))
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
        padded, doc = padded[keep], doc[keep]
        none = np.zeros(0, np.int64)
        if len(padded) < ORDER:
            return np.zeros((0, ORDER), np.int64), none, none, lettered
        # the middle letter's text is the n-gram's: a gap at either end may stand for a border
        inside = padded[1:-1] > 0
        marks = np.zeros(_POINTS, bool)
        marks[padded] = True
        points = np.flatnonzero(marks)
        self.place[points] = np.arange(len(points))
        local = self.place[padded].astype(np.int64)
        codes = ((local[:-2] * len(points) + local[1:-1]) * len(points) + local[2:])[inside]
        if len(points) ** ORDER <= 1 << 22:
            present = np.flatnonzero(np.bincount(codes, minlength=1))
            where = np.zeros(len(points) ** ORDER, np.int32)
            where[present] = np.arange(len(present))
            numbers = where[codes]
        else:
            present, numbers = np.unique(codes, return_inverse=True)
        if not len(codes):
            present = none
        grams = np.stack([points[present // len(points) ** (ORDER - 1 - k) % len(points)] for k in range(ORDER)], axis=1)
        return grams, numbers, doc[1:-1][inside], lettered

    def summed(self, counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Rows of counts of n-grams as bundled vectors."""
        out = np.zeros((len(counts), self.dimensions), np.float64)
        for at in range(0, len(grams), GRAMS):
            out += counts[:, at : at + GRAMS].astype(np.float32) @ self.ngram_vectors(grams[at : at + GRAMS])
        return out

    def bundles(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vector of each text, and its number of n-grams, which is 0 only without a letter."""
        texts = len(offs) - 1
        vectors, sizes = np.zeros((texts, self.dimensions)), np.zeros(texts, np.int64)
        for own, rows in pieces(raw, offs):
            grams, numbers, doc, _ = self.ngrams(own, rows)
            if len(numbers):
                n = len(rows) - 1
                counts = np.bincount(doc * len(grams) + numbers, minlength=n * len(grams)).reshape(n, -1)
                vectors += self.summed(counts, grams)  # of one text if there are several pieces
                sizes += counts.sum(axis=1)
        return vectors, sizes


def pieces(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block as it is, or one long text in parts that end at gaps, so that their n-grams are the whole's."""
    if len(offs) > 2 or len(raw) <= 2 * BLOCK_BYTES:
        yield raw, offs
        return
    at = 0
    while at < len(raw):
        end = min(at + BLOCK_BYTES, len(raw))
        while end < len(raw) and not _GAPS[raw[end - 1]]:
            ahead = np.flatnonzero(_GAPS[raw[end : end + BLOCK_BYTES]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + BLOCK_BYTES, len(raw))
        yield raw[at:end], np.array([0, end - at])
        at = end


@dataclass
class Profiles:
    """Language prototypes: sorted names, unit vectors, and how well a language's own n-grams fit it on average."""

    names: list[str]
    vectors: np.ndarray
    fit: np.ndarray
    dimensions: int = DIMENSIONS
    seed: int = SEED


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Bundle the texts of each non-null language of ``df`` into one prototype.

    All rows and whole texts count; null texts are empty and repeated rows count as often as they stand. Each task sums the
    vectors of the n-grams it counts and sends one vector per language that it has seen, added up component-wise; only the
    prototypes, languages x dimensions, reach the driver, and more than LANGUAGES of them are an error. An empty table, or
    one without labels, gives no prototypes, and then every text is undetermined.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, end, raw, offs in text_blocks(batch.column(0)):
                names, own = np.unique(langs[first:end].astype(str), return_inverse=True)
                for part, rows in pieces(raw, offs):
                    grams, numbers, doc, _ = encoder.ngrams(part, rows)
                    if len(numbers):
                        counts = np.bincount(own[doc] * len(grams) + numbers, minlength=len(names) * len(grams)).reshape(len(names), -1)
                        both = np.concatenate([encoder.summed(counts, grams), counts.sum(axis=1, keepdims=True)], axis=1)
                        for name, row in zip(names.tolist(), both, strict=True):
                            sums[name] = sums[name] + row if name in sums else row
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["lang", "k", "x"])

    labelled = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    most = LANGUAGES * (dimensions + 1)
    rows = labelled.mapInArrow(releasing(partial), "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    names = sorted({r.lang for r in rows})
    sums = np.zeros((len(names), dimensions + 1))
    at = {name: i for i, name in enumerate(names)}
    for r in rows:
        sums[at[r.lang], r.k] = r.x
    norms = np.linalg.norm(sums[:, :-1], axis=1)
    return Profiles(names, sums[:, :-1] / np.where(norms > 0, norms, 1)[:, None], norms / np.maximum(sums[:, -1], 1), dimensions, seed)


def predict(df: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "familiar")) -> DataFrame:
    """``df`` with lang_pred, score (the cosine with the nearest prototype, clipped to 0..1) and familiar.

    Texts are judged whole, long ones in parts whose vectors add up. A null text, or one without any letter, is ``und``
    with score 0 and not familiar; so is every text if there are no prototypes. Familiar are texts whose n-grams fit the language, on
    average, at least FAMILIAR_SHARE as well as that language's own do, less the noise to be expected of so few n-grams: so
    a single word stays familiar, and a long text of random letters isn't. Equal texts get equal results, ties go to the
    language that sorts first, and input columns that bear one of ``names`` are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def make():
        p = shared.value
        encoder = Encoder(p.dimensions, p.seed)
        known = np.array([*p.names, UNDETERMINED], object)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            best, score, familiar = np.full(batch.num_rows, len(p.names)), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for first, end, raw, offs in text_blocks(batch.column(batch.schema.get_field_index(text_col)), most_rows=TEXTS):
                if not len(raw) or not p.names:
                    continue
                vectors, sizes = encoder.bundles(raw, offs)
                norms = np.linalg.norm(vectors, axis=1)
                products = vectors @ p.vectors.T
                cosines = np.round(products / np.where(norms > 0, norms, 1)[:, None], 6)
                own = cosines.argmax(axis=1)
                fits = np.take_along_axis(products, own[:, None], axis=1)[:, 0] / np.maximum(sizes, 1)
                best[first:end] = np.where(sizes > 0, own, len(p.names))
                score[first:end] = np.where(sizes > 0, np.clip(cosines.max(axis=1), 0, 1), 0)
                familiar[first:end] = (sizes > 0) & (fits >= FAMILIAR_SHARE * p.fit[own] - FAMILIAR_NOISE / np.sqrt(np.maximum(sizes, 1)))
            return [pa.array(known[best], pa.string()), pa.array(score), pa.array(familiar)]

        return work

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return append_columns(df, [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)], make, text_col)
