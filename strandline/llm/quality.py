"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, with a mark on those that repeat what stands shortly before them; learned filters slide over
overlapping chunks of 24 bytes, a new chunk every 8, so that they cover the whole text; each filter's largest response is
pooled, and a logistic unit turns those into a probability. The pool is kept up over parts of a long text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import append_columns, text_blocks, text_or_empty

#: Bytes between the begins of chunks, strides in a chunk, components of a byte, filters.
STRIDE, STRIDES, WIDTH, FILTERS = 8, 3, 8, 32
#: Labelled texts that a model is fitted on at most, and the longest such text in bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 32_768
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.004, 5
PAD = 256
#: Bytes of a text whose responses are held at once, whole strides.
PART = 1 << 18
#: A byte is marked as repeated if the four bytes up to it stand at most so many bytes before, too; no more than the
#: pads between two texts, so that none is marked by another text.
REPEAT = 16


@dataclass
class Network:
    """Parameters by name; ``window`` has a row for each byte of a chunk."""

    embed: np.ndarray  # bytes and the pad, components
    window: np.ndarray  # strides, stride bytes x (components and the mark of repeats), filters
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.standard_normal((257, WIDTH)).astype(np.float32) * 0.5
        embed[PAD] = 0
        window = rng.standard_normal((STRIDES, STRIDE * (WIDTH + 1), FILTERS)).astype(np.float32) / np.sqrt(STRIDE * STRIDES * WIDTH)
        zeros = np.zeros(FILTERS, np.float32)
        return Network(embed, window, zeros.copy(), zeros.copy(), np.zeros(1, np.float32))

    def parts(self) -> dict[str, np.ndarray]:
        return vars(self)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Each filter's response to the chunk that begins at each stride; ``codes`` is laid out by :func:`layout`."""
        table = np.zeros((len(codes), WIDTH + 1), np.float32)
        np.take(self.embed, codes, axis=0, out=table[:, :WIDTH])
        table[:, WIDTH] = repeats(codes)
        each = table.reshape(len(codes) // STRIDE, -1) @ self.window.transpose(1, 0, 2).reshape(-1, STRIDES * FILTERS)
        total = each[:, :FILTERS] + self.bias
        for k in range(1, STRIDES):
            total[:-k] += each[k:, k * FILTERS : (k + 1) * FILTERS]
        return total

    def pooled(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each filter's largest response over the chunks of each text, at least 0."""
        if len(offs) == 2 and len(raw) > 2 * PART:
            # parts overlap by what a mark looks back and a chunk looks ahead
            back, ahead, out = STRIDE * STRIDES, STRIDE * (STRIDES - 1), np.zeros((1, FILTERS), np.float32)
            for at in range(0, len(raw), PART):
                first, end = max(0, at - back), min(len(raw), at + PART + ahead)
                codes, _, ends = layout(raw[first:end], np.array([0, end - first]))
                last = (at + PART - first) // STRIDE if at + PART < len(raw) else int(ends[0])
                out = np.maximum(out, self.responses(codes)[(at - first) // STRIDE : last].max(axis=0))
            return out
        codes, begins, ends = layout(raw, offs)
        return np.maximum(np.maximum.reduceat(self.responses(codes), np.stack([begins, ends], axis=1).reshape(-1), axis=0)[::2], 0)

    def probabilities(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(raw, offs).astype(np.float64) @ self.out + self.offset, -30, 30)))


def layout(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes of all texts, each padded to whole strides, one at least, and followed by pads; the strides where they
    begin and where their pads begin."""
    sizes = np.diff(offs)
    strides = np.maximum(1, -(-sizes // STRIDE))
    begins = np.concatenate([[0], np.cumsum(strides + STRIDES - 1)])
    codes = np.full(int(begins[-1]) * STRIDE, PAD, np.int16)
    codes[np.arange(len(raw)) + np.repeat(begins[:-1] * STRIDE - offs[:-1], sizes)] = raw
    return codes, begins[:-1], begins[:-1] + strides


def repeats(codes: np.ndarray) -> np.ndarray:
    """Marks of the bytes that end four bytes which also stand up to REPEAT bytes before, in the same text."""
    four = codes.astype(np.uint64)
    for k in (1, 2, 3):
        four[k:] |= codes[:-k].astype(np.uint64) << np.uint64(16 * k)
    out = np.zeros(len(codes), bool)
    for lag in range(1, REPEAT + 1):
        out[lag:] |= four[lag:] == four[:-lag]
    return out & (codes != PAD)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit by Adam on the logistic loss; the gradient of a pooled filter goes to the chunk that it was pooled from."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(y):
        rate = float(np.clip(y.mean(), 0.01, 0.99))
        net.offset[:] = np.log(rate / (1 - rate))
    net.out[:] = rng.standard_normal(FILTERS).astype(np.float32) * (0.1 if len(y) else 0)
    first = {k: np.zeros_like(v) for k, v in net.parts().items()}
    second = {k: np.zeros_like(v) for k, v in net.parts().items()}
    step, steps = 0, max(1, epochs * -(-len(y) // BATCH))
    for _ in range(epochs if len(y) else 0):
        for at in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            grads = _gradients(net, [texts[k] for k in at], y[at])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, value in net.parts().items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                value -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.embed[PAD] = 0
    return net


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes, begins, ends = layout(np.frombuffer(b"".join(texts), np.uint8), offs)
    responses = net.responses(codes)
    best = np.stack([a + responses[a:b].argmax(axis=0) for a, b in zip(begins, ends, strict=True)])
    top = np.take_along_axis(responses, best, axis=0)
    pooled = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.offset, -30, 30)))
    error = (p - y) / len(y)
    back = error[:, None] * net.out * (top > 0)  # texts, filters
    padded = np.concatenate([codes, np.full(STRIDE * STRIDES, PAD, codes.dtype)]).astype(np.int64)
    chunk = padded[best[:, :, None] * STRIDE + np.arange(STRIDE * STRIDES)]  # texts, filters, bytes
    flat = net.window.reshape(STRIDE * STRIDES, WIDTH + 1, FILTERS)[:, :WIDTH]
    marks = np.concatenate([repeats(codes), np.zeros(STRIDE * STRIDES, bool)])[best[:, :, None] * STRIDE + np.arange(STRIDE * STRIDES)]
    inputs = np.concatenate([net.embed[chunk], marks[..., None]], axis=3, dtype=np.float32)
    window = np.einsum("df,dfbw->bwf", back, inputs, optimize=True).reshape(net.window.shape)
    moved = (back[:, :, None, None] * flat.transpose(2, 0, 1)[None]).reshape(-1, WIDTH)
    embed = np.stack([np.bincount(chunk.reshape(-1), weights=moved[:, k], minlength=257) for k in range(WIDTH)], axis=1)
    return {"embed": embed.astype(np.float32), "window": window, "bias": back.sum(axis=0), "out": error @ pooled, "offset": np.array([error.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> Network:
    """Fit a network on at most ``sample`` labelled texts of at most ``longest`` bytes, picked by a hash of their id.

    The pick is among the labelled texts that are short enough, so that it is full wherever there are enough of them. Rows
    with a null id or label are not used; a null text is empty; a repeated row counts as often as it is picked. The sample is all
    that reaches the driver: ``sample`` times ``longest`` bytes at most. Without any usable label the network gives one half
    to every text.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).filter(F.octet_length("_text") <= longest)
    # ids and labels are picked first, so that texts travel for the pick alone
    picked = texts.select("_id").join(known, "_id").orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample).distinct()
    rows = texts.join(F.broadcast(picked), "_id").orderBy(F.xxhash64("_id"), "_id", "_label", "_text").limit(sample).collect()
    return train([r._text.encode() for r in rows], [int(r._label > 0) for r in rows])


def predict(df: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``df`` with score, the probability of label 1 for each whole text.

    A null text counts as empty; empty texts get the probability of no response at all. Equal texts get equal scores,
    an input column named ``score`` is replaced, and an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            score = np.zeros(batch.num_rows)
            for first, end, raw, offs in text_blocks(batch.column(batch.schema.get_field_index(text_col)), 1 << 18):
                score[first:end] = net.probabilities(raw, offs)
            return [pa.array(np.round(score, 6))]

        return work

    return append_columns(df, [T.StructField("score", T.DoubleType())], make, text_col)
