"""Byte-pair merges over symbol ids, with exact tree concatenation of long unsplit text.

A BPE encoding is valid exactly when every adjacent pair of its tokens is what the
merges give for that pair's own text. So two valid encodings may be joined by
re-encoding a window around the seam and widening it until its outermost tokens are
the ones that both sides already had there.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np

#: Symbols of a leaf of the tree: what is longer is halved, level by level.
LEAF = 64
#: Leaves merged side by side.
LANES = 1024
#: Symbols up to which a plain list is quicker than a heap.
SHORT = 64
NEVER = 1 << 60
#: Tokens taken from either side of a seam at first.
WINDOW = 4


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_SHOWN = dict(enumerate(byte_alphabet()))
_BYTE_OF = {c: b for b, c in _SHOWN.items()}


def as_bytes_shown(piece: str) -> str:
    """A pre-token as the byte-level vocabularies spell it."""
    return piece.encode("utf-8").decode("latin-1").translate(_SHOWN)


def as_read(shown: str) -> str:
    return bytes(_BYTE_OF[c] for c in shown).decode("utf-8")


class Merges:
    """Vocabulary and merges of a ``tokenizers`` JSON file with a BPE model."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            self.rank[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.parts: dict[int, tuple[int, ...]] = {}
        self.leaf = leaf
        for (a, b), (_, new) in self.rank.items():
            self.parts.setdefault(new, (*self.symbols_of(a), *self.symbols_of(b)))
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.rank.items())
        self.pair, self.place, self.makes = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        # whether no merge makes a token that an earlier merge takes: then a lane may merge all
        # occurrences of its best pair at once
        made = {}
        for rank, new in self.rank.values():
            made[new] = max(rank, made.get(new, rank))
        self.place_of = {pair: rank for pair, (rank, _) in self.rank.items()}
        self.made_by = {rank: new for rank, new in self.rank.values()}
        self.ordered = all(made.get(a, -1) < rank and made.get(b, -1) < rank for (a, b), (rank, _) in self.rank.items())

    def symbols_of(self, token: int) -> tuple[int, ...]:
        return self.parts.get(token, (token,))

    def symbols(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece]
        if ids:
            ids[-1] = self.last[piece[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        rank, place = self.rank, self.place_of.get
        if len(ids) <= SHORT:
            ids = list(ids)
            ranks = [place(pair, NEVER) for pair in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best == NEVER:
                    break
                i = ranks.index(best)
                ids[i] = new = self.made_by[best]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = place((ids[i - 1], new), NEVER)
                if i < len(ranks):
                    ranks[i] = place((new, ids[i + 1]), NEVER)
            return ids
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((new, ids[k])):
                    heappush(heap, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], new))):
                heappush(heap, (r[0], h, r[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Exact encoding of the concatenation, from the exact encodings of its halves."""
        m = WINDOW
        while True:
            a, b = left[-m:], right[:m]
            middle = self.merge([s for t in (*a, *b) for s in self.symbols_of(t)])
            if (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            m *= 2

    def merge_lanes(self, leaves: list[list[int]]) -> list[list[int]]:
        """merge() of many short pieces in lock-step: a row of the array each, -1 after its end."""
        ids = np.full((len(leaves), max(map(len, leaves)) + 1), -1, np.int64)
        for lane, leaf in enumerate(leaves):
            ids[lane, : len(leaf)] = leaf
        never = np.iinfo(np.int64).max
        while True:
            key = ids[:, :-1] << 32 | np.maximum(ids[:, 1:], 0)
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            known = (self.pair[at] == key) & (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
            rank = np.where(known, self.place[at], never)
            best = rank.min(1)
            if (best == never).all():
                return [row[row >= 0].tolist() for row in ids]
            hit = (rank == best[:, None]) & known
            if self.ordered:  # of overlapping occurrences every other one, from the left
                column = np.arange(hit.shape[1])
                before = np.maximum.accumulate(np.where(hit, -1, column), axis=1)
                hit &= (column - before) % 2 == 1
            else:
                hit &= np.cumsum(hit, axis=1) == 1
            lane, i = np.nonzero(hit)
            ids[lane, i], ids[lane, i + 1] = self.makes[at[lane, i]], -1
            ids = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)

    def encode(self, symbols: list[int]) -> list[int]:
        """Ids of one pre-token. One of up to LEAF symbols is a tree of one leaf. Long ones: halves of
        halves down to the leaves, which are merged side by side, then joined pairwise, level by
        level, so no merge queue ever spans the whole text."""
        if len(symbols) <= self.leaf:
            return self.merge(symbols)
        leaves = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        level = [ids for i in range(0, len(leaves), LANES) for ids in self.merge_lanes(leaves[i : i + LANES])]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def whole_tokens(self) -> set[str]:
        """Vocabulary strings whose own text encodes to just that token: a pre-token equal
        to one of them needs no merging. Proven by merging each of them once."""
        alone = set()
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        for token, i in self.vocab.items():
            if self.suffix and not token.endswith(self.suffix):
                continue
            shown = token.removesuffix(self.suffix) if self.suffix else token
            raw = bytes(byte_of[c] for c in shown)
            if raw and self.merge(self.symbols(raw)) == [i]:
                try:
                    alone.add(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    continue  # part of a character: never a pre-token of its own
        return alone
