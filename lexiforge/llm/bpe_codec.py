"""BPE encoding and decoding of whole texts (tree concatenation of long unsplit text)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.bpe import Merges, as_read
from lexiforge.llm.common import documents

TOKENIZER = "word_bpe_49k.json"

#: Texts of these characters only (below U+0250 or general punctuation) are normalised
#: and split here, with the classes of the vocabulary file's pattern spelled out; others
#: take the library's normaliser and splitter, whose Unicode tables may differ.
PLAIN = re.compile(r"[\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203e]*")
GAPS = r"\t-\r\x20\x85\xa0"
LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{GAPS}{LETTERS}{NUMBERS}]+")
#: Words whose ids a worker remembers, the first it meets.
CACHE = 200_000
#: Texts held as Python objects at a time.
ROWS = 64
_TYPES = {"ids": pa.binary(), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


class Codec:
    """Encoder and decoder of one vocabulary file whose decoder joins tokens with spaces."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter, for texts beyond PLAIN
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in self.merges.special)) if self.merges.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.merges.encode(self.merges.symbols(piece.encode("utf-8")))
        got = pack(f"<{len(ids)}I", *ids), " ".join(map(self.merges.token.__getitem__, ids))
        if len(piece) <= 40 and len(self.known) < self.cache:
            self.known[piece] = got
        return got

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or PLAIN.fullmatch(text) and is_normalized("NFC", text):
            return _SPLIT.findall(text.lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [as_read(piece) for piece, _ in shown]

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded text) of a whole text."""
        parts = [text]
        if self.special is not None and any(map(text.__contains__, self.merges.special)):
            parts = [p for p in self.special.split(text) if p]
        raw, shown = [], []
        for part in parts:
            if part in self.merges.special:
                raw.append(np.array([self.merges.special[part]], dtype="<u4").tobytes())
                shown.append(part)
                continue
            known, piece = self.known, self._piece
            for p in self._pieces(part):
                a, b = known.get(p) or piece(p)
                raw.append(a)
                shown.append(b)
        return b"".join(raw), " ".join(shown)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, cache: int = CACHE) -> Codec:
    if (path, cache) not in _CODECS:
        _CODECS[path, cache] = Codec(path, cache)
    return _CODECS[path, cache]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coded_column(text: Column, name: str = TOKENIZER, outputs: tuple[str, ...] = ("ids", "decoded"), cache: int = CACHE) -> Column:
    """struct(ids binary, decoded string, n_tokens, ids_sha256, decoded_sha256) of a text column.

    Null encodes as the empty text: no ids, an empty decoded text. Repeated rows are rows of their
    own, with equal values. Very long texts are encoded whole; only unsplit runs need the tree.
    ``name`` is a file of the tokenizer folder, resolved on the executor; nothing is shipped
    with the job. Of ids and decoded, what ``outputs`` doesn't name is null. ``cache``: words remembered."""

    @F.arrow_udf("ids binary, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(tokenizer_path(name), cache)

        def coded(texts: pa.Array) -> pa.Array:
            rows = []
            for t in texts.to_pylist():
                ids, decoded = own.encode(t or "")
                shown = decoded.encode("utf-8")
                rows.append((ids if "ids" in outputs else None, decoded if "decoded" in outputs else None, len(ids) // 4, sha256(ids).hexdigest(), sha256(shown).hexdigest()))
            return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES.values())], list(_TYPES))

        for texts in batches:
            yield pa.concat_arrays([coded(texts.slice(i, ROWS)) for i in range(0, max(len(texts), 1), ROWS)])

    return run(text)


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Per document: token count and digests of ids and decoded text. No shuffle."""
    docs = documents(spark, sf_dir)
    coded = docs.select("doc_id", coded_column(F.col("text"), outputs=()).alias("d"))
    return coded.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
