"""Token counts by the whole-token shortcut: most pre-tokens are proven single tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.bpe import Merges
from lexiforge.llm.bpe_codec import GAPS, LETTERS, NUMBERS, PLAIN, tokenizer_path
from lexiforge.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE = 400_000

_SPLIT = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{GAPS}{LETTERS}{NUMBERS}]+|[{GAPS}]+(?![^{GAPS}])|[{GAPS}]+")


class Counter:
    """Counts tokens of whole texts. ``more[p]`` is the tokens of pre-token p beyond one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)  # its splitter, for texts beyond PLAIN
        self.whole = dict.fromkeys(self.merges.whole_tokens(), 0)
        self.special = re.compile("|".join(map(re.escape, self.merges.special)))
        outer = self

        class More(dict):
            def __missing__(self, piece: str) -> int:
                n = len(outer.merges.encode(outer.merges.symbols(piece.encode("utf-8")))) - 1
                if len(piece) <= 40 and len(self) < CACHE:
                    self[piece] = n
                return n

        self.more = More(self.whole)

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if any(map(text.__contains__, self.merges.special)):  # a special string inside a text is one token, as the library does
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if PLAIN.fullmatch(part):
                pieces = _SPLIT.findall(part)
                total += len(pieces) + sum(map(self.more.__getitem__, pieces))
            elif part:
                shown = self.library.pre_tokenizer.pre_tokenize_str(part)
                pieces = [part[a:b] for _, (a, b) in shown]
                total += len(pieces) + sum(map(self.more.__getitem__, pieces))
        return total


_COUNTERS: dict[str, Counter] = {}


def count_column(text: Column, name: str = TOKENIZER) -> Column:
    """Tokens of a whole text as the library counts them, without added special tokens;
    null counts as the empty text, which has none. Repeated rows are counted alike."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = tokenizer_path(name)
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        own = _COUNTERS[path]
        for texts in batches:
            yield pd.Series([own.count(t or "") for t in texts], dtype="int64")

    return run(text)


def op9_token_counts(spark, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether they pass the limit. No shuffle."""
    docs = documents(spark, sf_dir)
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_column(F.col("text")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
