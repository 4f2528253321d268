"""Operator 1: token counts of whole texts, batch-encoded in Arrow tasks.

A task cuts its texts at safe boundaries, encodes the distinct pieces in
batches of a set number of bytes and returns lengths only. Pieces that a task
has met before are looked up in a memory of bounded size.

A boundary is safe before a blank, tab or line end that follows anything else:
the byte-level pattern ends a token there whatever comes next, and its only
look-ahead (white space before a word) lies behind the boundary. Special
strings hold no white space, so none is cut. Texts with other white space
(no-break space, separators) are cut only between an ASCII letter or digit and
a following blank or line end. What has no such place is encoded whole.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import id_text
from quire.session import ship_package
from quire.sources.papers import load_table

#: Bytes of distinct pieces encoded at once, and characters of pieces a task remembers.
BATCH_BYTES = 1 << 20
MEMORY_CHARS = 8 << 20

_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_SURE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_loaded: dict[bytes, object] = {}


def _tokenizer(definition: bytes):
    """The tokenizer, loaded once a worker; the library's threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = Tokenizer.from_str(definition.decode("utf-8"))
        _loaded[definition].no_truncation()
        _loaded[definition].no_padding()
    return _loaded[definition]


def pieces(text: str) -> list[str]:
    """``text`` in order, cut at safe boundaries."""
    if _RARE_SPACE.search(text):
        return _SURE.split(text)
    return _PIECE.findall(text)


class Lengths:
    """Token counts of pieces, encoded in batches balanced by bytes."""

    def __init__(self, definition: bytes, batch_bytes: int, memory_chars: int):
        self.tokenizer, self.batch_bytes = _tokenizer(definition), batch_bytes
        self.memory_chars, self.known, self.held = memory_chars, {}, 0

    def learn(self, new: set[str]) -> None:
        if self.held > self.memory_chars:
            self.known, self.held = {}, 0
        batch, size = [], 0
        for piece in new:
            batch.append(piece)
            size += len(piece)
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            out = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, out)))
            self.held += sum(map(len, batch))

    def of(self, texts: list[str]) -> list[int]:
        """Counts of a group of texts, of about ``batch_bytes`` together."""
        cut = [pieces(t) for t in texts]
        need = set().union(*cut) if cut else set()
        if not need <= self.known.keys():
            self.learn(need - self.known.keys() if self.held <= self.memory_chars else need)
        look = self.known.__getitem__
        return [sum(map(look, c)) for c in cut]


def _counts(batches, definition: bytes, batch_bytes: int, memory_chars: int):
    lengths = Lengths(definition, batch_bytes, memory_chars)
    for batch in batches:
        sizes = pc.binary_length(batch.column("_text")).to_pylist()
        out, lo, n = [], 0, batch.num_rows
        while lo < n:  # groups balanced by bytes; a longer text stands alone
            hi, size = lo, 0
            while hi < n and (hi == lo or size + sizes[hi] <= batch_bytes):
                size += sizes[hi]
                hi += 1
            out += lengths.of(batch.column("_text").slice(lo, hi - lo).to_pylist())
            lo = hi
        at = batch.schema.get_field_index("_text")
        yield batch.set_column(at, "n_tokens", pa.array(out, pa.int64()))


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, batch_bytes: int = BATCH_BYTES,
                 memory_chars: int = MEMORY_CHARS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit``.

    Counts are those of the ``tokenizers`` library for the byte-level file at
    ``tokenizer_path`` (read on the driver; a few MB), special strings as its
    default, nothing added or truncated. Null and empty texts count 0; ids are
    returned as they are, null or repeated; other columns are ignored. An empty
    table gives an empty result. Nothing is shuffled: work is dealt by the
    bytes of the scan.
    """
    ship_package(df.sparkSession)
    with open(tokenizer_path, "rb") as f:
        definition = f.read()
    docs = id_text(df, id_col, text_col).select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "_text")
    kind = docs.schema["_id"].dataType.simpleString()
    out = docs.mapInArrow(lambda it: _counts(it, definition, batch_bytes, memory_chars),
                          f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(load_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))
