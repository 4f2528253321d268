"""Operator 5: SentencePiece encoding and decoding with source offsets.

The model's compiled character map (a double-array trie and its replacement
strings) is read once a worker. A text is normalised by longest prefix: at
every place the longest entry of the map is replaced, and each normalised byte
records the source bytes it came from. Ids come from the library; each piece's
normalised bytes are projected through that record onto original byte spans.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import id_text, released
from quire.session import ship_package
from quire.sources.papers import load_table

BATCH_BYTES = 1 << 20
BLANK = "▁".encode()


def _fields(data: bytes):
    """(number, value) of a serialised message's fields: the wire format."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out
    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """A compiled character map: longest-prefix lookup of UTF-8 bytes."""

    def __init__(self, compiled: bytes):
        self.units, self.strings = [], b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled[4:4 + size], dtype="<u4").tolist()
            self.strings = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest entry at ``at``."""
        units, found = self.units, None

        def offset(unit):
            return (unit >> 10) << ((unit & 512) >> 6)
        pos = offset(units[0])
        for i in range(at, len(data)):
            pos ^= data[i]
            unit = units[pos]
            if unit & 0x800000FF != data[i]:
                break
            pos ^= offset(unit)
            if unit >> 8 & 1:
                value = units[pos] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value:self.strings.index(b"\0", value)])
        return found


class Normaliser:
    """Longest-prefix normalisation that records, for every normalised byte,
    the source byte it starts from (and one past the end at the end)."""

    def __init__(self, spec: bytes):
        parts = dict(_fields(spec))
        self.map = CharacterMap(parts.get(2, b""))
        self.dummy_prefix = bool(parts.get(3, 1))
        self.squeeze = bool(parts.get(4, 1))
        self.escape = bool(parts.get(5, 1))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        # Replaced text and, for each of its bytes, where its source begins.
        out, src, at = bytearray(), [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                lead = data[at]
                take = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (take, data[at:at + take])
            out += hit[1]
            src += [at] * len(hit[1])
            at += hit[0]
        src.append(len(data))
        norm, source = bytes(out), np.array(src, dtype=np.int64)
        if self.squeeze:
            blanks = np.frombuffer(norm, np.uint8) == 32
            inner = ~blanks
            keep = inner.copy()
            keep[:-1] |= blanks[:-1] & inner[1:]  # the last blank of a run before a word
            if inner.any():
                keep[:np.argmax(inner)] = False
            norm = np.frombuffer(norm, np.uint8)[keep].tobytes()
            source = np.append(source[:-1][keep], _end_of(source, keep, len(data)))
        return self._escaped(norm, source)

    def _plain(self, data: bytes):
        return self._escaped(data, np.arange(len(data) + 1, dtype=np.int64))

    def _escaped(self, norm: bytes, source: np.ndarray):
        if not norm:
            return b"", np.array([int(source[-1])], dtype=np.int64)
        if self.dummy_prefix:
            norm, source = b" " + norm, np.concatenate((source[:1], source))
        if self.escape:
            width = np.where(np.frombuffer(norm, np.uint8) == 32, len(BLANK), 1)
            source = np.append(np.repeat(source[:-1], width), source[-1])
            norm = norm.replace(b" ", BLANK)
        return norm, source


def _end_of(source, keep, size):
    last = np.flatnonzero(keep)
    return int(source[last[-1] + 1]) if len(last) else size


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = next((v for n, v in _fields(model) if n == 3), b"")
        self.normalise = Normaliser(spec)
        sp, size = self.sp, self.sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        # Normalised bytes of each piece; a byte piece stands for one, an
        # unknown one for whatever is left over (-1), a control for none.
        self.width = np.array([1 if sp.is_byte(i) else -1 if sp.is_unknown(i) else
                               0 if sp.is_control(i) else len(names[i].encode()) for i in range(size)])
        # Long texts may be cut before a blank if no piece reaches across one.
        self.cuts = (not self.normalise.map.units and not self.normalise.squeeze and
                     self.normalise.dummy_prefix and self.normalise.escape and
                     not any("▁" in n.lstrip("▁") for n in names))

    def segments(self, text: str, most: int) -> list[str]:
        """``text`` cut before single blanks that the next segment's prefix stands for."""
        if not self.cuts or len(text) <= most:
            return [text]
        out, at = [], 0
        while len(text) - at > most:
            cut = text.find(" ", at + most)
            while cut > 0 and (cut + 1 == len(text) or text[cut - 1] in " ▁"):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        out.append(text[at:])
        return out

    def ids(self, texts: list[str], most: int) -> list[np.ndarray]:
        """Ids of whole texts, with begin and end."""
        cut = [self.segments(t, most) for t in texts]
        flat = self.sp.encode([s for c in cut for s in c], num_threads=1)
        out, at = [], 0
        for c in cut:
            body = [i for ids in flat[at:at + len(c)] for i in ids]
            at += len(c)
            out.append(np.array([self.sp.bos_id(), *body, self.sp.eos_id()], dtype=np.uint32))
        return out

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans (begin, end) of every id; begin and end ids are empty."""
        norm, source = self.normalise(data)
        width = self.width[ids]
        if (width < 0).any():
            # unknown pieces cover what no other piece spells out
            width = self._unknown_widths(norm, ids, width)
        ends = np.minimum(np.cumsum(width), len(norm))
        begins = ends - width
        return source[begins], np.where(width > 0, source[ends], source[begins])

    def _unknown_widths(self, norm: bytes, ids, width):
        width, at = width.copy(), 0
        for k, w in enumerate(width):
            if w < 0:
                follow = next((self.sp.id_to_piece(int(i)).encode() for i, x in zip(ids[k + 1:], width[k + 1:]) if x > 0), None)
                end = norm.find(follow, at + 1) if follow else len(norm)
                width[k] = (end if end >= 0 else len(norm)) - at
            at += width[k]
        return width


_encoders: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


#: What an encoded text can be returned as.
OUTPUTS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "begins": pa.list_(pa.int64()),
    "ends": pa.list_(pa.int64()), "decoded": pa.string(), "ids_sha256": pa.string(),
    "spans_sha256": pa.string(), "decoded_sha256": pa.string(),
}
_SQL_TYPES = {"n_tokens": "long", "ids": "array<int>", "begins": "array<long>", "ends": "array<long>"}


def _encode(batches, model: bytes, outputs: tuple[str, ...], batch_bytes: int):
    encoder = _encoder(model)
    need_spans = {"begins", "ends", "spans_sha256"} & set(outputs)
    need_text = {"decoded", "decoded_sha256"} & set(outputs)
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_pylist()
        lo, n = 0, batch.num_rows
        while lo < n:
            hi, size = lo, 0
            while hi < n and (hi == lo or size + sizes[hi] <= batch_bytes):
                size += sizes[hi]
                hi += 1
            part = batch.slice(lo, hi - lo)
            texts = part.column(1).to_pylist()
            ids = encoder.ids(texts, batch_bytes // 8)
            columns = {"n_tokens": [len(x) for x in ids]}
            if "ids" in outputs:
                columns["ids"] = [x.astype(np.int32) for x in ids]
            if "ids_sha256" in outputs:
                columns["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            if need_spans:
                spans = [encoder.spans(t.encode(), x) for t, x in zip(texts, ids)]
                columns["begins"], columns["ends"] = ([s[i] for s in spans] for i in (0, 1))
                if "spans_sha256" in outputs:
                    columns["spans_sha256"] = [hashlib.sha256(np.stack(s, axis=1).astype("<u4").tobytes()).hexdigest()
                                               for s in spans]
            if need_text:
                columns["decoded"] = encoder.sp.decode([x.tolist() for x in ids], num_threads=1)
                columns["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in columns["decoded"]] \
                    if "decoded_sha256" in outputs else []
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(columns[o], OUTPUTS[o]) for o in outputs)], ["_id", *outputs])
            lo = hi


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"),
           batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``df``: ``id_col`` and ``outputs`` (see ``OUTPUTS``).

    Ids are those of the ``sentencepiece`` library for the model at
    ``model_path`` (read on the driver; under 1 MB), with begin and end ids;
    ``decoded`` is its decoding of them; ``begins`` and ``ends`` are the
    original UTF-8 byte spans of the pieces, empty for begin and end ids.
    ``spans_sha256`` hashes (begin, end) pairs as little-endian unsigned 32-bit
    integers. Null counts as empty, which has only begin and end. Ids of rows
    are returned as they are, null or repeated; other columns are ignored; an
    empty table gives an empty result. Nothing is shuffled.
    """
    ship_package(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["_id"].dataType.simpleString()
    schema = ", ".join([f"_id {kind}", *(f"{o} {_SQL_TYPES.get(o, 'string')}" for o in outputs)])
    out = docs.mapInArrow(lambda it: released(_encode(it, model, outputs, batch_bytes), _encoders.clear), schema)
    return out.select(F.col("_id").alias(id_col), *outputs)


def encode_digests(df: DataFrame) -> DataFrame:
    import public_tokenizers
    return encode(df, public_tokenizers.path("piece_bpe_32k.model"),
                  outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load_table(spark, sf_dir, "documents"))
