"""Secret scans with structural confirmation.

Patterns find candidates; what looks like encoded key material is decoded, and only what parses as a signed token, a
key's nested lengths or a key file is reported beyond the base kinds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import words as W
from strandline.llm.common import append_columns, cut_text, fresh_name, text_blocks

#: Kinds in the order that breaks ties between spans that begin together; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "hexkey")
# No pattern tries a run of its characters from more than one place, or gives characters back, so that each takes time in
# proportion to the text.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----([^-]*+)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}+")
#: Fewest characters of a base64 candidate, and of a hexadecimal one of the base kind.
MIN_BASE64, MIN_HEX, MIN_HEXKEY = 32, 24, 48
#: Fewest characters of any span without a delimiter: a signed token with the shortest header that names an algorithm.
MIN_RUN = 18
_HEX_BYTES = W.byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66 or 0x41 <= b <= 0x46)
_B64_BYTES = W.byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b in b"+/_-.")


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding, None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(token: str) -> bool:
    """Does the first part of a dotted token decode to a JSON object that names its algorithm?"""
    data = unbase64(token.split(".", 1)[0])
    try:
        head = json.loads(data) if data and data.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length that begins at ``at`` and where its content begins."""
    if at >= len(data):
        return None
    n = data[at]
    if n < 0x80:
        return n, at + 1
    wide = n & 0x7F
    if not 1 <= wide <= 4 or at + 1 + wide > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + wide]), at + 1 + wide


def der_key(data: bytes) -> bool:
    """Is it one ASN.1 sequence whose nested lengths fill each other exactly, with an integer or an object identifier?"""
    if len(data) < 16 or data[0] != 0x30 or (head := _der_length(data, 1)) is None or sum(head) != len(data):
        return False
    tags: set[int] = set()
    todo = [(head[1], len(data))]
    while todo:
        at, end = todo.pop()
        while at < end:
            tag = data[at]
            if (found := _der_length(data, at + 1)) is None or found[1] + found[0] > end:
                return False
            tags.add(tag)
            if tag & 0x20:
                todo.append((found[1], found[1] + found[0]))
            at = found[1] + found[0]
    return bool(tags & {0x02, 0x06}) and len(tags) > 1 or tags == {0x02}


def ssh_key(data: bytes) -> bool:
    """Is it a sequence of length-prefixed fields that ends exactly, the first naming a key type?"""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(fields) > 1 and re.fullmatch(rb"(sk-)?(ssh|ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that are reported by their pattern alone."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose content decodes and parses."""
    out, at = [], 0
    for m in _JWT.finditer(text):  # candidates overlap: any part of a dotted name may be the header
        if m.start() >= at and signed_header(m[1]):
            out.append((m.start(), at := m.end(1), "jwt"))
    for m in _PEM.finditer(text):
        lines = [x for x in m[2].split("\n") if x.strip() and ":" not in x]
        data = unbase64("".join("".join(lines).split()))
        if data and (der_key(data) or ssh_key(data)):
            out.append((m.start(), m.end(), "pem"))
    for m in _BASE64.finditer(text):
        if data := unbase64(m[0]):
            if der_key(data):
                out.append((m.start(), m.end(), "der"))
            elif ssh_key(data):
                out.append((m.start(), m.end(), "ssh"))
    out += [(m.start(), m.end(), "hexkey") for m in _HEXKEY.finditer(text) if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0]))]
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of one text by start, then kind, in code points with the end exclusive."""
    return sorted([*base_spans(text), *confirmed_spans(text)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _suspects(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts that can hold any span at all: with a delimiter, a long run of code characters or a key's first letters."""
    marks = [np.flatnonzero((raw == 0x3A) | (raw == 0x3D))]
    for table, least in ((_HEX_BYTES, MIN_HEX), (_B64_BYTES, MIN_RUN)):
        starts, ends = W.runs(raw, offs, table)
        marks.append(starts[ends - starts >= least])
    data, at = raw.tobytes(), -1
    dashes = []
    while (at := data.find(b"-----BEGIN ", at + 1)) >= 0:
        dashes.append(at)
    marks.append(np.array(dashes, np.int64))
    return np.unique(np.searchsorted(offs, np.concatenate(marks), side="right") - 1)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``secrets``, an array of (start, end, kind), by start and then kind, over whole texts of any length.

    Kinds ``assign``, ``access`` and ``hex`` are reported by their pattern alone; ``jwt``, ``pem``, ``der``, ``ssh`` and
    ``hexkey`` only once decoded and parsed. Spans of different kinds may overlap. A null or empty text has no spans;
    repeated rows are each scanned; an input column named ``secrets`` is replaced. One vectorised pass over the bytes
    sets aside the texts that can't hold any span; all others go through every pattern.
    """

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for first, _, raw, offs in text_blocks(batch.column(batch.schema.get_field_index(text_col))):
                for k in _suspects(raw, offs).tolist():
                    found = find_spans(raw[offs[k] : offs[k + 1]].tobytes().decode())
                    spans[first + k] = [{"start": a, "end": b, "kind": kind} for a, b, kind in found]
            return [pa.array(spans, _ARROW)]

        return work

    return append_columns(df, [T.StructField("secrets", _SPANS)], make, text_col)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The per-document report of :func:`scan`."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(F.col(id_col), *[of(k) for k in KINDS[:3]], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mask``, overlapping spans by one; rows and other columns, of
    whatever name, stay as they are. A null text stays null, an empty one empty; repeated rows are cut alike."""
    masked = fresh_name("masked")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            marks, texts = np.zeros(batch.num_rows, bool), []
            for first, _, raw, offs in text_blocks(column):
                for k in _suspects(raw, offs).tolist():
                    text = raw[offs[k] : offs[k + 1]].tobytes().decode()
                    if found := find_spans(text):
                        marks[first + k] = True
                        texts.append(cut_text(text, [(a, b) for a, b, _ in found], mask))
            return [pc.replace_with_mask(column, pa.array(marks), pa.array(texts, pa.string())) if texts else column]

        return work

    out = append_columns(df, [T.StructField(masked, T.StringType())], make, text_col)
    return out.select(*[F.col(masked).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
