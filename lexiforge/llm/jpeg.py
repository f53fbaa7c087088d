"""Baseline JPEG: a payload stored losslessly as flat luminance blocks, and a general
DC-only reader that decodes the scans of many images in lock-step with numpy.

Writing: each payload byte is one 8x8 block whose only coefficient is DC with quantiser 8,
so the block's every sample is that byte and nothing is rounded. 24 blocks are a restart interval,
so all of all images are written and read side by side. An image is 24 blocks across, or as many
times 24 as keep its sides within the format; a comment segment holds the payload's length,
what the last block row has beyond it is 255.
Reading: markers are parsed, byte stuffing is undone, and restart intervals are the lanes of
a vectorised Huffman decoder. AC coefficients are decoded only to be skipped. Frames of
several components or with sampling factors are read too; the luminance (first) component is kept.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

#: Bytes of a payload tile: 24 x 24 blocks.
TILE = 576
ACROSS = 24
#: Blocks of a side of an image (a JPEG side is below 65536 samples).
SIDE = 8191
#: Blocks of an image: payloads beyond these 67 MB go on in further images of the same file.
BLOCKS = SIDE // ACROSS * ACROSS * SIDE // TILE * TILE

#: Order in which a scan stores the coefficients matters only to skip them, so no table is needed.
_DC_LENGTHS = {2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 0: 4, 1: 5}
_AC_LENGTHS = {0: 1}


def _canonical(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Codes by symbol, and the table's DHT body (16 counts, then symbols)."""
    order = sorted(lengths, key=lambda s: lengths[s])
    codes, code, size = {}, 0, 0
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s] = (code, size)
        code += 1
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    return codes, counts + bytes(order)


_DC_CODES, _DC_BODY = _canonical(_DC_LENGTHS)
_AC_CODES, _AC_BODY = _canonical(_AC_LENGTHS)


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255: code, value, end of block."""
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = _DC_CODES[n]
        value = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = ((code << n | value) << 1) | _AC_CODES[0][0]
        size[d + 255] = length + n + 1
    return bits, size


_BITS, _SIZE = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape_of(blocks: int, side: int = SIDE) -> tuple[int, int]:
    """Blocks across and down of the narrowest image that holds ``blocks``."""
    across = ACROSS * -(-blocks // (ACROSS * side))
    return across, -(-blocks // across)


def _head(blocks: int) -> bytes:
    across, down = shape_of(blocks)
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, b"bytes=%d" % blocks),
        _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + _DC_BODY),
        _segment(0xC4, b"\x10" + _AC_BODY),
        _segment(0xDD, struct.pack(">H", ACROSS)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def pad(text: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of TILE."""
    return text + b"\xff" * (-len(text) % TILE if text else TILE)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file of each padded payload."""
    parts = [[p[i : i + BLOCKS] for i in range(0, len(p), BLOCKS)] for p in payloads]
    images = [x for own in parts for x in own]
    whole = [np.prod(shape_of(len(x))) for x in images]
    rows = np.frombuffer(b"".join(x.ljust(n, b"\xff") for x, n in zip(images, whole)), np.uint8).reshape(-1, ACROSS)
    n = len(rows)
    level = rows.astype(np.int16) - 128
    step = level.copy()
    step[:, 1:] -= level[:, :-1]
    step += 255
    bits, size = _BITS[step.T], _SIZE[step.T].astype(np.uint32)  # block, row: rows lie side by side
    pair, both = bits[::2] << size[1::2] | bits[1::2], size[::2] + size[1::2]
    ends = np.cumsum(both, axis=0, dtype=np.uint32)
    flat, base, lane = np.zeros(n * 40, np.uint8), np.arange(n, dtype=np.int64) * 40, np.arange(n)
    for j in range(ACROSS // 2):
        at = ends[j] - both[j]
        word = (pair[j] << (32 - both[j] - (at & 7))).astype(">u4").view(np.uint8).reshape(n, 4)
        byte = base + (at >> 3)
        flat[byte] |= word[:, 0]
        for k in (1, 2, 3):
            flat[byte + k] = word[:, k]  # still zero there
    out = flat.reshape(n, 40)
    total = ends[-1]
    length = (total + 7) >> 3
    out[lane, length - 1] |= ((1 << (length * 8 - total)) - 1).astype(np.uint8)
    keep = np.arange(40) < length[:, None]
    flat, row = out[keep], np.repeat(lane, length)
    full = flat == 0xFF
    place = np.arange(len(flat)) + np.cumsum(full) - full + 2 * row
    row_start = np.concatenate(([0], np.cumsum(length + np.bincount(row[full], minlength=n) + 2)))
    data = np.zeros(row_start[-1], np.uint8)
    data[place] = flat
    frame_row = np.concatenate([np.arange(n // ACROSS) for n in whole])
    data[row_start[1:] - 2] = 0xFF
    data[row_start[1:] - 1] = 0xD0 + frame_row % 8
    files, at = [], 0
    for x, n in zip(images, whole):
        end = at + int(n) // ACROSS
        files.append(_head(len(x)) + data[row_start[at] : row_start[end] - 2].tobytes() + b"\xff\xd9")
        at = end
    found = iter(files)
    return [b"".join(next(found) for _ in own) for own in parts]


@dataclass
class Frame:
    width: int
    height: int
    scan: np.ndarray
    interval: int
    key: tuple
    comment: bytes = b""


def _lookup(body: bytes) -> np.ndarray:
    """Entry for each 16-bit peek: code length << 8 | symbol; 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _fused(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Entry for each 16-bit peek that holds a whole DC-only block: bits used << 16 | difference
    + 32768; 0 where the block is longer or has AC coefficients."""
    peek = np.arange(1 << 16, dtype=np.int64)
    code, n = (dc >> 8).astype(np.int64), (dc & 255).astype(np.int64)
    value = (peek << code & 0xFFFF) >> (16 - np.minimum(n, 16))
    value -= np.where(value < (1 << n >> 1), (1 << n) - 1, 0)
    end = ac[peek << np.minimum(code + n, 16) & 0xFFFF]
    used = code + n + (end >> 8)
    return np.where((dc > 0) & (n < 12) & (end > 0) & (end & 255 == 0) & (used <= 16), used << 16 | value + 32768, 0).astype(np.int32)


def parse(file: bytes) -> list[Frame]:
    """Frames of one or more baseline JPEG streams end to end. Other JPEG processes raise."""
    frames, at, n = [], 0, len(file)
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    interval, shape, comment = 0, None, b""
    while at < n:
        if file[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = file[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD8:
            quant, tables, interval, shape, comment = {}, {}, 0, None, b""
        if marker in (0xD8, 0xD9, 0x01):
            at += 2
            continue
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                count = sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 17 + count]
                i += 17 + count
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            shape = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
        elif 0xC0 < marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDA:
            width, height, parts = shape
            raw = np.frombuffer(file, np.uint8, offset=at)
            ff = np.flatnonzero(raw[:-1] == 0xFF)
            after = raw[ff + 1]
            end = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
            stop = int(end[0]) if len(end) else len(raw)
            own = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            blocks = tuple((c == parts[0][0], h, v, quant[q], tables[own[c] >> 4], tables[16 | own[c] & 15]) for c, h, v, q in parts if c in own)
            if parts[0][0] in own:
                frames.append(Frame(width, height, raw[:stop], interval, blocks, comment))
            at += stop
    return frames


def _lanes(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers; where each restart interval starts."""
    raw = frame.scan
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    kept = np.cumsum(~drop)
    starts = np.concatenate(([0], kept[restart + 1])).astype(np.int64)
    return raw[~drop], starts


def _peek(wide: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The 16 bits from bit position p on."""
    return wide[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF


def _long_block(wide: np.ndarray, p: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC difference of any block, and where the next one starts; AC is decoded to be skipped."""
    entry = dc[_peek(wide, p)].astype(np.int32)
    if (entry == 0).any():
        raise ValueError("a Huffman code is damaged")
    n = entry & 255
    p = p + (entry >> 8)
    value = (_peek(wide, p) >> (16 - n).astype(np.uint32)).astype(np.int32)
    value -= np.where(value < (1 << n >> 1), (1 << n) - 1, 0).astype(np.int32)
    p = p + n
    at, todo = np.ones(len(p), np.int32), np.arange(len(p))
    while len(todo):
        q = p[todo]
        entry = ac[_peek(wide, q)].astype(np.int32)
        if (entry == 0).any():
            raise ValueError("a Huffman code is damaged")
        run, n = entry >> 4 & 15, entry & 15
        p[todo] = q + (entry >> 8) + n
        at[todo] += np.where((n == 0) & (run < 15), 64, run + 1)
        todo = todo[at[todo] < 64]
    return value, p


def luminance(frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance thumbnail of each frame: one sample per 8x8 block."""
    planes: list = [None] * len(frames)
    groups = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.key, f.interval].append(i)
    for (blocks, interval), members in groups.items():
        single = len(blocks) == 1
        hmax, vmax = max(b[1] for b in blocks), max(b[2] for b in blocks)
        lum_h, lum_v = (1, 1) if single else blocks[0][1:3]
        unit_w, unit_h = (8, 8) if single else (8 * hmax, 8 * vmax)
        data, start, mcus, owner, first = [], [], [], [], []
        base = 0
        for i in members:
            bytes_, at = _lanes(frames[i])
            across, down = -(-frames[i].width // unit_w), -(-frames[i].height // unit_h)
            total, step = across * down, interval or across * down
            n = -(-total // step)
            if len(at) < n:
                raise ValueError("a restart interval is missing")
            data += [bytes_, np.full(4, 255, np.uint8)]
            start.append(at[:n] + base)
            mcus.append(np.minimum(step, total - step * np.arange(n)))
            first.append(step * np.arange(n))
            owner.append(np.full(n, i))
            base += len(bytes_) + 4
            planes[i] = np.zeros(total * lum_h * lum_v, np.int32)
        d = np.concatenate(data).astype(np.uint32)
        wide = np.concatenate((d[:-2] << 16 | d[1:-1] << 8 | d[2:], np.full(2, 0xFFFFFF, np.uint32)))
        pos, mcus = np.concatenate(start) * 8, np.concatenate(mcus)
        pos = pos.astype(np.int32 if len(d) < 1 << 28 else np.int64)
        most, per = int(mcus.max()), lum_h * lum_v
        samples = np.zeros((most * per, len(pos)), np.int32)
        tables = [(dc := _lookup(b[4]), ac := _lookup(b[5]), _fused(dc, ac)) for b in blocks]
        before = [np.zeros(len(pos), np.int32) for _ in blocks]
        for m in range(most):
            live = slice(None) if m < mcus.min() else np.flatnonzero(mcus > m)
            p = pos[live]
            for b, (block, (dc, ac, fused)) in enumerate(zip(blocks, tables)):
                for k in range(1 if single else block[1] * block[2]):
                    entry = fused[_peek(wide, p)]
                    step = (entry & 0xFFFF) - 32768
                    p = p + (entry >> 16)
                    if len(slow := np.flatnonzero(entry == 0)):
                        step[slow], p[slow] = _long_block(wide, p[slow], dc, ac)
                    before[b][live] += step
                    if block[0]:
                        samples[m * per + k, live] = before[b][live]
            pos[live] = p
        scale = blocks[0][3]
        samples = np.ascontiguousarray(np.clip((samples * scale + 1028) >> 3, 0, 255).astype(np.uint8).T)
        lane = 0
        for i, own, firsts in zip(members, owner, first):
            for f in firsts if len(firsts) < 2 or interval == 0 else ():
                planes[i][: mcus[lane] * per] = samples[lane, : mcus[lane] * per]
            if interval and len(firsts) > 1:
                got = samples[lane : lane + len(own)].reshape(-1)
                planes[i][:] = got[: len(planes[i])]
            lane += len(own)
            across, down = -(-frames[i].width // unit_w), -(-frames[i].height // unit_h)
            grid = planes[i].reshape(down, across, lum_v, lum_h).transpose(0, 2, 1, 3).reshape(down * lum_v, across * lum_h)
            planes[i] = grid[: -(-frames[i].height * lum_v // unit_h) or 1, : -(-frames[i].width * lum_h // unit_w) or 1].astype(np.uint8)
    return planes


def thumbnail_hash(plane: np.ndarray) -> str:
    """64-bit average hash: which cells of an 8x8 grid lie above the grid's mean."""
    plane = plane.astype(np.float64)
    for axis in (0, 1):
        n = plane.shape[axis]
        if n < 8:
            plane = np.repeat(plane, -(-8 // n), axis=axis)
            n = plane.shape[axis]
        cut = np.arange(8) * n // 8
        plane = np.add.reduceat(plane, cut, axis=axis) / np.diff(np.append(cut, n)).reshape((-1, 1) if axis == 0 else (1, -1))
    return f"{int.from_bytes(np.packbits(plane > plane.mean()).tobytes(), 'big'):016x}"
