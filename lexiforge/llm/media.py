"""Media columns: texts stored as baseline JPEG, read back, with dimensions and hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import jpeg
from lexiforge.llm.common import documents

#: Payload bytes handled together.
CHUNK = 2 << 20


def _chunks(texts: pd.Series) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8")
        held.append(raw)
        size += len(raw) + jpeg.TILE
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def jpeg_column(text: Column) -> Column:
    """The JPEG file of a text (null: of the empty text)."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f for raw in _chunks(texts) for f in jpeg.encode_many([jpeg.pad(r) for r in raw])], dtype=object)

    return run(text)


def read_back(files: list[bytes]) -> list[tuple[bytes, str]]:
    """(payload, feature) of JPEG files; the feature is width x height : thumbnail hash."""
    frames = [jpeg.parse(f) for f in files]
    planes = iter(jpeg.luminance([x for fs in frames for x in fs]))
    out = []
    for fs in frames:
        own = [next(planes) for _ in fs]
        payload = b"".join(plane.tobytes()[: int(f.comment.removeprefix(b"bytes="))] for f, plane in zip(fs, own))
        out.append((payload, f"{fs[0].width}x{fs[0].height}:{jpeg.thumbnail_hash(own[0])}"))
    return out


_ROW = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(text: Column) -> Column:
    """Stores each text, reads the stored bytes back and digests both. Equal texts, equal values.

    A null is the empty text, stored as one tile of 255s. Repeated rows are rows of their own, with
    equal values. The feature is that of the file's first image: beyond ``jpeg.BLOCKS`` bytes,
    what the format's sides allow, a payload goes on in further images."""

    @F.pandas_udf(_ROW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for raw in _chunks(texts):
                files = jpeg.encode_many([jpeg.pad(r) for r in raw])
                for r, f, (back, feature) in zip(raw, files, read_back(files)):
                    rows.append((len(r), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), sha256(f).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])

    return run(text)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's stored form and of what is read back. No shuffle."""
    return documents(spark, sf_dir).select("doc_id", media_column(F.col("text")).alias("m")).select("doc_id", "m.*")
