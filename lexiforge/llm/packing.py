"""Packing token pieces into sequences of bounded length.

The corpus is reduced to a histogram of piece lengths, which the sequence length bounds. On it the
configuration linear program (which fillings of a sequence, how often, so that every length is
covered) is solved by multiplicative weights: each phase prices the lengths, a knapsack dynamic
program finds the best filling of every remaining capacity, all fillings that are near the best price
are taken to the extent of their scarcest length, and covered lengths get cheaper. The fractional
solution is rounded against what is left, phases go on over the rest, and what no filling takes goes
best-fit into gaps and new sequences. Pieces find their place by their number within their length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.bpe import as_bytes_shown
from lexiforge.llm.bpe_codec import CACHE, TOKENIZER, Codec, tokenizer_path
from lexiforge.llm.common import documents, rank_id
from lexiforge.operators.numbering import numbered

CAPACITY, END = 4096, 1
#: Phases of a solution, solutions over what is left, step of the weights, and how far from the best price a filling may be.
PHASES, SOLUTIONS, STEP, NEAR = 24, 4, 0.2, 0.02
#: Texts held as Python objects at a time, and bytes of ids in an outgoing batch, about.
ROWS, BYTES = 64, 4 << 20
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

Filling = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- the histogram's plan


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, take): the highest value of any multiset of lengths within each capacity, and the length to
    take first there, 0 for leaving a unit. ``value[l]`` is a length's price, -inf where it has none; of
    equal choices the longest."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down = value[::-1]  # down[-1 - l] is value[l]
    for c in range(1, capacity + 1):
        worth = down[capacity - c : capacity] + best[:c]  # lengths c, c - 1, ... 1
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], take[c] = worth[i], c - i
        else:
            best[c] = best[c - 1]
    return best, take


def filling(lead: int, value: np.ndarray, best: np.ndarray, take: np.ndarray, have: np.ndarray, settled: np.ndarray, capacity: int) -> Filling:
    """The best filling with ``lead`` in it and no more of a length than there is."""
    used = {lead: 1}
    c = int(settled[capacity - lead])
    while c:
        length = int(take[c])
        if used.get(length, 0) >= have[length]:
            worth = value[c:0:-1] + best[:c]
            for full, n in used.items():
                if n >= have[full] and full <= c:
                    worth[c - full] = -np.inf
            i = int(worth.argmax())
            if not worth[i] > 0:
                break
            length = c - i
        used[length] = used.get(length, 0) + 1
        c = int(settled[c - length])
    return tuple(sorted(used.items(), reverse=True))


def solve(have: np.ndarray, capacity: int, phases: int = PHASES) -> tuple[dict[Filling, float], float]:
    """Fractional fillings that cover the histogram ``have`` in proportion, and the lower bound on
    sequences that the prices prove: no filling is worth more than ``best``, so pieces worth v together need
    v / best of them."""
    lengths = np.nonzero(have)[0]
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = lengths
    bound, total = 0.0, {}
    for _ in range(phases):
        best, take = knapsack(price, capacity)
        bound = max(bound, float((price[lengths] * have[lengths]).sum() / best[capacity]))
        settled = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))
        covered, found = np.zeros(capacity + 1), {}
        for lead in lengths[::-1]:
            if price[lead] + best[capacity - lead] < (1 - NEAR) * best[capacity]:
                continue
            f = filling(int(lead), price, best, take, have, settled, capacity)
            if f in found:
                continue
            found[f] = amount = min(have[length] / n for length, n in f)
            for length, n in f:
                covered[length] += n * amount
        share = covered[lengths] / have[lengths]
        scale = 1.0 / share.max()
        for f, amount in found.items():
            total[f] = total.get(f, 0.0) + amount * scale
        price[lengths] *= np.exp(-STEP * share * scale)
    volume = sum(a * sum(length * n for length, n in f) for f, a in total.items())
    scale = float((lengths * have[lengths]).sum()) / volume
    return {f: a * scale for f, a in total.items()}, bound


def best_fit(left: np.ndarray, open_: dict[int, list[list]], capacity: int) -> list[tuple[int, Filling]]:
    """Every length of ``left``, longest first, into the open sequence with the smallest gap that
    takes it, or a new one. Sequences that are alike are kept as one entry [count, filling], so that
    the work depends on the lengths, not on the corpus."""
    open_ = {gap: [list(e) for e in entries] for gap, entries in open_.items()}
    some = np.zeros(capacity + 1, bool)
    some[[gap for gap, entries in open_.items() if entries]] = True

    def put(gap: int, count: int, f: Filling) -> None:
        open_.setdefault(gap, []).append([count, f])
        some[gap] = True

    for length in np.nonzero(left)[0][::-1]:
        length, n = int(length), int(left[length])
        while n:
            at = int(some[length:].argmax()) + length
            if not some[at]:
                at, entry = capacity, [-(-n // (capacity // length)), ()]
            else:
                entry = open_[at][-1]
            each = at // length
            count, each = (min(entry[0], n // each), each) if n >= each else (1, n)
            put(at - each * length, count, (*entry[1], (length, each)))
            n -= count * each
            if entry[1]:
                entry[0] -= count
                if not entry[0]:
                    open_[at].pop()
                    some[at] = bool(open_[at])
    return [(count, f) for entries in open_.values() for count, f in entries]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, Filling]], int]:
    """(count, filling) of all sequences for a histogram, and a lower bound on their number. A full
    piece is a sequence of its own. A filling lists (length, how many) in the order of the sequence."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        have[length] = n
    out: list[tuple[int, Filling]] = [(int(have[capacity]), ((capacity, 1),))] if have[capacity] else []
    proven, left = 0.0, have.copy()
    left[capacity] = 0
    open_: dict[int, list[list]] = {}
    for turn in range(SOLUTIONS):
        if not left.any():
            break
        solution, bound = solve(left, capacity)
        proven = proven if turn else bound
        placed = 0
        room = lambda f: capacity - sum(length * n for length, n in f)
        ranked = sorted(solution.items(), key=lambda x: (room(x[0]), -x[1], x[0]))
        for up in (False, True):
            for f, amount in ranked:
                count = min(int(np.ceil(amount)) if up else int(amount), *(int(left[length]) // n for length, n in f))
                if count > 0 and room(f) <= NEAR * capacity:
                    for length, n in f:
                        left[length] -= n * count
                    placed += count * (capacity - room(f))
                    open_.setdefault(room(f), []).append([count, f])
        if placed * 20 < placed + int((left * np.arange(capacity + 1)).sum()):
            break  # what is left shares hardly any filling
    full = open_.pop(0, [])
    out += [(count, f) for count, f in full] + best_fit(left, open_, capacity)
    return out, int(have[capacity]) + int(np.ceil(proven - 1e-6))


class Places:
    """Where the i-th piece goes, pieces numbered by length first: runs of numbers that fill the same slot."""

    def __init__(self, lengths: dict[int, int], sequences: list[tuple[int, Filling]]):
        before, so_far = {}, 0
        for length in sorted(lengths):
            before[length] = so_far
            so_far += lengths[length]
        rows, first = [], 0
        for count, f in sequences:
            offset = 0
            for length, each in f:
                rows.append((before[length], length, each, first, offset))
                before[length] += count * each
                offset += length * each
            first += count
        rows.sort()
        self.start, self.length, self.each, self.first, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = first

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces by number."""
        at = np.searchsorted(self.start, number, "right") - 1
        i, each = number - self.start[at], self.each[at]
        return self.first[at] + i // each, self.offset[at] + i % each * self.length[at]


# ---------------------------------------------------------------- pieces and sequences


_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit integers: the library's own merges, asked
    for one pre-token at a time, so that a frequent one is asked for once."""

    _pieces = Codec._pieces

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: pack_ids([i]) for i, t in self.library.get_added_tokens_decoder().items()}
        self.parts = re.compile("|".join(f"({re.escape(s)})" for s in self.special))
        model = self.library.model

        class Ids(dict):
            def __missing__(self, piece: str) -> bytes:
                got = pack_ids([t.id for t in model.tokenize(as_bytes_shown(piece))])
                if len(piece) <= 40 and len(self) < CACHE:
                    self[piece] = got
                return got

        self.ids = Ids()

    def encoded(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.special)):
            return b"".join(map(self.ids.__getitem__, self._pieces(text)))
        return b"".join(self.special.get(p) or b"".join(map(self.ids.__getitem__, self._pieces(p))) for p in self.parts.split(text) if p)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int | None = END, name: str = TOKENIZER, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32: each document's tokens with ``end`` after them, cut only
    where they pass ``capacity``. A null text is empty: one piece of the end token. Without ``ids`` that column
    is null, only its checksum is there. What is made is sent on text by text, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(name)
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        own, last = _ENCODERS[path], b"" if end is None else pack_ids([end])
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    whole = own.encoded(text or "") + last
                    for i in range(0, len(whole), capacity * 4):
                        cut = whole[i : i + capacity * 4]
                        rows.append((doc_id, i // (capacity * 4), i // 4, len(cut) // 4, cut if ids else None, crc32(cut)))
                        size += len(cut) if ids else 64
                        if size > BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (length and any further columns) with sequence_id and offset. Reruns agree: pieces of
    one length are ordered by id, piece and the other columns.

    A null doc_id comes last. Rows that repeat are pieces of their own. No pieces give no rows.
    """
    others = [c for c in parts.columns if c not in ("length", "doc_id", "piece")]
    order = ["length", rank_id(F.col("doc_id")), "piece", *others]
    lined = numbered(parts, order, "__n")
    lengths = {int(length): n for length, n in lined.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = Places(lengths, plan(lengths, capacity)[0])

    @F.arrow_udf("sequence_id long, offset long")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for numbers in batches:
            got = places.of(numbers.to_numpy(zero_copy_only=False))
            yield pa.StructArray.from_arrays([pa.array(x) for x in got], ["sequence_id", "offset"])

    return lined.withColumn("__p", place(F.col("__n"))).select(*parts.columns, "__p.sequence_id", "__p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids of whole sequences from packed pieces with their ids; a sequence is as
    small as its capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("x"))
    return joined.select("sequence_id", "n_tokens", F.aggregate("x", F.lit(b""), lambda a, e: F.concat(a, e["ids"])).alias("ids"))


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; see pieces and pack."""
    return pack(pieces(documents(spark, sf_dir), ids=False).drop("ids"))
