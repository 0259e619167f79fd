"""Media columns: baseline JPEG.

`decode` parses the markers of a baseline JPEG, Huffman-decodes its scans and returns the quantised luminance
coefficients; `dc_thumbnail` makes a luminance thumbnail from the DC coefficients alone, without an inverse
transform. `store` keeps any bytes losslessly in JPEG form: each byte less 128 is one coefficient in zigzag order, and
the scan is an ordinary one of size categories, runs of zeros and ends of blocks, by Huffman tables that this module
makes from weights. Each block is a restart interval.

One decoder reads all scans, stored ones and others. It takes a code's length and value from a table of 16 bits, and
has two loops: scans of many restart intervals are decoded in step by numpy, an interval a lane; those of few intervals,
such as photographs, code by code.

A payload is cut into frames of at most 2730 units of 576 bytes (24 by 24 samples, nine blocks); a stored text is
the concatenation of its frames. Frames are encoded, read back and measured about `CHUNK` bytes at a time and only
digests and thumbnails (a 64th) are kept of them, unless the media itself is asked for.

Nulls and odd rows: a null text counts as empty and its payload is 576 bytes of 255; equal texts give equal values;
media that is null or no baseline JPEG gives null columns and an error text in `media_features`; a file of several
scans, one for each component, is one picture; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, UNITS = 576, 2730
STORED_QUANT = 4  # of DC: thumbnail pixel = 128 + v / 2
CHUNK = 1 << 19
LANES = 64  # restart intervals from which a scan is decoded in step
END, ZEROS = 0x00, 0xF0  # fixed values of the format: symbols of an end of block and of 16 zeros


class BadJpeg(ValueError):
    """No baseline JPEG, or a damaged one."""


# Tables -----------------------------------------------------------------------------------------------------------

def huffman(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """Numbers of codes by length (16) and values in code order, for symbols of these weights; no code is all ones."""
    heap = [(w, s, (s,)) for s, w in weights.items()] + [(min(weights.values()) / 4, 256, (256,))]  # 256 takes the code of all ones
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, 256], 0)
    while len(heap) > 1:
        (w1, s1, a), (w2, s2, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            length[s] += 1
        heapq.heappush(heap, (w1 + w2, min(s1, s2), a + b))
    length[256] = max(length.values())
    order = sorted(weights, key=lambda s: (length[s], s))
    return bytes(sum(length[s] == n for s in order) for n in range(1, 17)), bytes(order)


@lru_cache(64)
class Table:
    """A Huffman table: size and value of the code that 16 bits begin with, and code and size of each value."""

    def __init__(self, lengths: bytes, values: bytes):
        self.size = np.zeros(1 << 16, dtype=np.uint8)
        self.value = np.zeros(1 << 16, dtype=np.uint8)
        self.code, self.bits = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
        code, k = 0, 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                lo = code << (16 - n)
                if lo + (1 << (16 - n)) > 1 << 16 or k >= len(values):
                    raise BadJpeg("bad Huffman table")
                self.size[lo : lo + (1 << (16 - n))] = n
                self.value[lo : lo + (1 << (16 - n))] = values[k]
                self.code[values[k]], self.bits[values[k]] = code, n
                code, k = code + 1, k + 1
            code <<= 1
        self.both = (self.size.astype(np.int32) << 8 | self.value).tolist()


# Stored bytes are mostly letters, 20 to 60 below 128, so that categories 5 and 6 come first and zeros are rare.
DC_CODES = huffman({n: 0.5 ** abs(n - 6) for n in range(9)})
AC_CODES = huffman({**{run << 4 | n: 0.3**run * 0.4 ** abs(n - 6) + 1e-4 for run in range(16) for n in range(1, 9)}, END: 0.02, ZEROS: 0.02})
CATEGORY = np.array([abs(v).bit_length() for v in range(-128, 128)])  # by byte


# Writing ----------------------------------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(units: int) -> bytes:
    head = b"\xff\xd8" + _segment(0xDB, bytes([0, STORED_QUANT]) + bytes([1] * 63))
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, units * 24, 24, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\x00" + b"".join(DC_CODES) + b"\x10" + b"".join(AC_CODES))
    return head + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _coded(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each coefficient (columns 0 to 63), the end of the block and the padding of each row."""
    dc, ac = Table(*DC_CODES), Table(*AC_CODES)
    n = CATEGORY[blocks]
    v = blocks.astype(np.int64) - 128
    extra = np.where(v >= 0, v, v + (1 << n) - 1).astype(np.uint64)
    bits, size = np.zeros((len(blocks), 66), dtype=np.uint64), np.zeros((len(blocks), 66), dtype=np.int64)
    bits[:, 0], size[:, 0] = dc.code[n[:, 0]] << n[:, 0].astype(np.uint64) | extra[:, 0], dc.bits[n[:, 0]] + n[:, 0]
    row, col = np.nonzero(v[:, 1:])
    before = np.where(np.diff(row, prepend=-1) == 0, np.roll(col, 1), -1)
    run, k = col - before - 1, col + 1
    symbol = (run & 15) << 4 | n[row, k]
    code, long = ac.code[symbol] << n[row, k].astype(np.uint64) | extra[row, k], ac.bits[symbol] + n[row, k]
    for more in (1, 2, 3):  # 16 zeros each
        far = run >= 16 * more
        code[far] |= ac.code[ZEROS] << long[far].astype(np.uint64)
        long[far] += ac.bits[ZEROS]
    bits[row, k], size[row, k] = code, long
    short = v[:, 63] == 0
    bits[short, 64], size[short, 64] = ac.code[END], ac.bits[END]
    size[:, 65] = -size.sum(1) % 8
    bits[:, 65] = (1 << size[:, 65]) - 1
    return bits, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (a multiple of UNIT, at most UNITS of them), whose coefficients are the payload's bytes."""
    units = np.array([len(p) // UNIT for p in payloads])
    bits, size = _coded(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, 64))
    ends = size.sum(1) // 8
    start = np.cumsum(ends) - ends
    at = (start[:, None] * 8 + np.cumsum(size, axis=1) - size)[size > 0]
    bits, size = bits[size > 0], size[size > 0]
    shifted = bits << (64 - size - (at & 7)).astype(np.uint64)
    total = int(ends.sum())
    raw = np.zeros(total + 8)
    for j in range(int(((at & 7) + size).max() + 7) // 8):
        raw += np.bincount((at >> 3) + j, weights=(shifted >> np.uint64(56 - 8 * j) & np.uint64(255)).astype(float), minlength=total + 8)[: total + 8]
    raw = raw[:total].astype(np.uint8)
    last = np.cumsum(units * (UNIT // 64)) - 1  # block of each payload
    number = np.arange(len(ends)) - np.repeat(np.append(0, last[:-1] + 1), units * (UNIT // 64))
    marked = np.setdiff1d(np.arange(len(ends)), last)
    stuffed = np.flatnonzero(raw == 255) + 1
    put = np.concatenate([stuffed, np.repeat(start[marked] + ends[marked], 2)])
    what = np.concatenate([np.zeros(len(stuffed)), np.stack([np.full(len(marked), 255), 0xD0 + number[marked] % 8], 1).reshape(-1)])
    whole = np.insert(raw, put, what).tobytes()
    stop = start[last] + ends[last]
    stop = stop + np.searchsorted(np.sort(put), stop, side="right")
    return [_header(int(u)) + whole[i:j] + b"\xff\xd9" for u, i, j in zip(units, np.append(0, stop[:-1]), stop, strict=True)]


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def cut(payload: bytes) -> list[bytes]:
    """The payloads of its frames."""
    return [payload[i : i + UNIT * UNITS] for i in range(0, len(payload), UNIT * UNITS)]


def store(payload: bytes) -> bytes:
    """Frames one after another."""
    return b"".join(m for p in cut(payload) for m in encode([p]))


# Reading ----------------------------------------------------------------------------------------------------------

def images(data: bytes) -> Iterator[dict]:
    """The header of each image in data, with its scans: components, tables, restart interval, bytes. Raises BadJpeg."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise BadJpeg("no start of image")
        at += 2
        head: dict = {"quant": {}, "parts": None, "scans": []}
        huff, restart = {}, 0
        while True:
            if data[at : at + 1] != b"\xff" or at + 2 > len(data):
                raise BadJpeg("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    head["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(int)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                _, head["height"], head["width"], n = struct.unpack_from(">BHHB", body)
                head["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise BadJpeg("not a baseline file")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if not head["parts"] or not head["height"] or not head["width"]:
                    raise BadJpeg("scan before frame")
                spec = tuple((body[1 + 2 * i], huff[body[2 + 2 * i] >> 4], huff[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0]))
                end = _scan_end(data, at)
                head["scans"].append((spec, restart, data[at:end]))
                at = end
        yield head


def _scan_end(data: bytes, at: int) -> int:
    """Where the marker after a scan is: none of a stuffed byte or a restart."""
    step = 1 << 13
    while True:
        raw = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(step, len(data) - at))
        mark = np.flatnonzero(raw[:-1] == 255)
        after = raw[mark + 1]
        stop = mark[(after != 0) & (after & 0xF8 != 0xD0)]
        if len(stop):
            return at + int(stop[0])
        if at + step >= len(data):
            raise BadJpeg("scan without end")
        step *= 8


class Scan:
    """The scan of an image's first component: its restart intervals and where its blocks go."""

    def __init__(self, head: dict):
        first = head["parts"][0][0]
        found = [s for s in head["scans"] if any(c[0] == first for c in s[0])]
        if not found:
            raise BadJpeg("no luminance scan")
        spec, restart, coded = found[0]
        parts = {c[0]: c for c in head["parts"]}
        hs, vs = max(c[1] for c in head["parts"]), max(c[2] for c in head["parts"])
        if len(spec) == 1:
            self.h = self.v = 1
            self.wide, self.high = (-(-(-(-head[x] * parts[first][k] // most)) // 8) for x, k, most in (("width", 1, hs), ("height", 2, vs)))
        else:
            self.h, self.v = parts[first][1:3]
            self.wide, self.high = -(-head["width"] // (8 * hs)), -(-head["height"] // (8 * vs))
        self.plan = []  # for each block of a unit: tables and component
        self.own = []  # the first component's blocks
        for k, (ident, dc, ac) in enumerate(spec):
            n = 1 if len(spec) == 1 else parts[ident][1] * parts[ident][2]
            if ident == first:
                self.own = list(range(len(self.plan), len(self.plan) + n))
            self.plan += [(dc, ac, k)] * n
        raw = np.frombuffer(coded, dtype=np.uint8)
        mark = np.flatnonzero(raw[:-1] == 255)
        after = raw[mark + 1]
        keep = np.ones(len(raw), dtype=bool)
        keep[mark[after == 0] + 1] = False
        restarts = mark[after != 0]
        keep[restarts] = keep[restarts + 1] = False
        self.bytes = raw[keep]
        self.start = np.append(0, np.cumsum(keep)[restarts])
        self.end = np.append(self.start[1:], len(self.bytes))
        units = self.wide * self.high
        step = restart or units
        if len(self.start) < -(-units // step):
            raise BadJpeg("scan too short")
        self.start, self.end = self.start[: -(-units // step)], self.end[: -(-units // step)]
        self.units = np.minimum(step, units - step * np.arange(len(self.start)))

    def placed(self, coefficients: np.ndarray) -> np.ndarray:
        """(rows, columns, 64) of the first component, from all blocks in the order of the scan."""
        own = coefficients.reshape(self.high, self.wide, len(self.plan), 64)[:, :, self.own]
        own = own.reshape(self.high, self.wide, self.v, self.h, 64).transpose(0, 2, 1, 3, 4)
        return own.reshape(self.high * self.v, self.wide * self.h, 64)


def decode_in_step(scans: list[Scan]) -> np.ndarray:
    """Coefficients in zigzag order of all blocks of scans of one plan, an interval a lane."""
    plan = scans[0].plan
    kinds = sorted({t for dc, ac, _ in plan for t in (dc, ac)})
    codes = np.concatenate([Table(*t).size.astype(np.int64) << 8 | Table(*t).value for t in kinds])
    dc, ac, part = (np.array(x) for x in ([kinds.index(p[0]) for p in plan], [kinds.index(p[1]) for p in plan], [p[2] for p in plan]))
    raw = np.concatenate([*[s.bytes for s in scans], np.full(16, 255, np.uint8)])
    window = np.zeros(len(raw) - 8, dtype=np.int64)  # the 40 bits from each byte on
    for j in range(5):
        window |= raw[j : j + len(window)].astype(np.int64) << (32 - 8 * j)
    base = np.cumsum([0, *[len(s.bytes) for s in scans[:-1]]])
    at = np.concatenate([b + s.start for b, s in zip(base, scans, strict=True)]) * 8
    end = np.concatenate([b + s.end for b, s in zip(base, scans, strict=True)]) * 8
    left = np.concatenate([s.units for s in scans]) * len(plan)  # blocks
    out = np.zeros((int(left.sum()), 64), dtype=np.int16)
    block = np.cumsum(left) - left
    stop, first = block + left, block.copy()
    k = np.zeros(len(at), dtype=np.int64)
    last = np.zeros((len(at), int(part.max()) + 1), dtype=np.int64)
    lane = np.arange(len(at))
    while len(lane):
        p, kk, turn = at[lane], k[lane], (block[lane] - first[lane]) % len(plan)
        is_dc = kk == 0
        x = window[np.minimum(p >> 3, len(window) - 1)]
        free = 40 - (p & 7)
        both = codes[np.where(is_dc, dc[turn], ac[turn]) << 16 | x >> free - 16 & 0xFFFF]
        n, symbol = both >> 8, both & 255
        run, bits = np.where(is_dc, 0, symbol >> 4), np.where(is_dc, symbol, symbol & 15)
        if not n.all() or (bits > 15).any():
            raise BadJpeg("unknown code")
        extra = x >> free - n - bits & (1 << bits) - 1
        v = np.where(extra >> np.maximum(bits - 1, 0) & 1, extra, extra - (1 << bits) + 1)
        p = p + n + bits
        if (p > end[lane]).any():
            raise BadJpeg("scan too short")
        at[lane] = p
        who = lane[is_dc]
        last[who, part[turn[is_dc]]] += v[is_dc]
        v[is_dc] = last[who, part[turn[is_dc]]]
        place = kk + run
        closed = ~is_dc & (bits == 0) & (run != 15)
        put = is_dc | (bits > 0)
        if (place[~closed] > 63).any():
            raise BadJpeg("run beyond block")
        out[block[lane[put]], place[put]] = v[put]
        kk = np.where(closed, 64, place + 1)
        full = kk >= 64
        k[lane] = np.where(full, 0, kk)
        block[lane[full]] += 1
        lane = lane[block[lane] < stop[lane]]
    return out


def decode_by_code(scan: Scan) -> np.ndarray:
    """The same of one scan, code by code, through a window of whole bytes."""
    out = np.zeros((int(scan.units.sum()) * len(scan.plan), 64), dtype=np.int32)
    plan = [(Table(*dc).both, Table(*ac).both, k) for dc, ac, k in scan.plan]
    block = 0
    for lo, hi, units in zip(scan.start.tolist(), scan.end.tolist(), scan.units.tolist(), strict=True):
        raw = scan.bytes[lo:hi].tobytes() + b"\xff" * 16
        at = have = window = 0
        last = [0] * (1 + max(p[2] for p in plan))
        for _ in range(units):
            for dc, ac, part in plan:
                found, k, table = {}, 0, dc
                while k < 64:
                    if have < 32:
                        window = (window & (1 << have) - 1) << 48 | int.from_bytes(raw[at : at + 6].ljust(6, b"\xff"), "big")
                        at, have = at + 6, have + 48
                    both = table[window >> have - 16 & 0xFFFF]
                    if not both:
                        raise BadJpeg("unknown code")
                    symbol = both & 255
                    have -= both >> 8
                    if k:
                        run, n = symbol >> 4, symbol & 15
                        if not n:
                            if run != 15:
                                break
                            k += 16
                            if k > 63:
                                raise BadJpeg("run beyond block")
                            continue
                        k += run
                        if k > 63:
                            raise BadJpeg("run beyond block")
                    else:
                        n, table = symbol, ac
                        if n > 15:
                            raise BadJpeg("unknown code")
                    have -= n
                    v = window >> have & (1 << n) - 1
                    if n and not v >> n - 1:
                        v -= (1 << n) - 1
                    if not k:
                        v = last[part] = last[part] + v
                    found[k] = v
                    k += 1
                if 8 * at - have > 8 * (hi - lo):
                    raise BadJpeg("scan too short")
                out[block, list(found)] = list(found.values())
                block += 1
    return out


def decode_all(heads: list[dict]) -> list[np.ndarray]:
    """Luminance coefficients (rows, columns, 64) in zigzag order of each image; images of one plan are decoded together."""
    scans = [Scan(h) for h in heads]
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        groups.setdefault(tuple(s.plan), []).append(i)
    out: list = [None] * len(heads)
    for members in groups.values():
        of = [scans[i] for i in members]
        if sum(len(s.start) for s in of) < LANES:
            found = [decode_by_code(s) for s in of]
        else:
            whole, at = decode_in_step(of), np.cumsum([int(s.units.sum()) * len(s.plan) for s in of])
            found = np.split(whole, at[:-1])
        for i, coefficients in zip(members, found, strict=True):
            out[i] = scans[i].placed(coefficients)
    return out


def decode(data: bytes) -> list[tuple[dict, np.ndarray]]:
    """(header, luminance coefficients) of each image in data."""
    return [(head, decode_all([head])[0]) for head in images(data)]


def bytes_of(blocks: np.ndarray) -> bytes:
    """The bytes that stored coefficients stand for."""
    return (blocks + 128).astype(np.uint8).tobytes()


def load(data: bytes) -> bytes:
    """The payload that `store` has kept."""
    return b"".join(bytes_of(blocks) for _, blocks in decode(data))


# Features ---------------------------------------------------------------------------------------------------------

def dc_thumbnail(head: dict, blocks: np.ndarray) -> np.ndarray:
    """One luminance pixel for each block: the block's mean, 0 to 255."""
    quant = head["quant"][head["parts"][0][3]][0]
    rows, cols = -(-head["height"] // 8), -(-head["width"] // 8)
    return np.clip(128 + blocks[:rows, :cols, 0].astype(float) * quant / 8, 0, 255)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8 by 9 mean cells is brighter than its right neighbour."""
    rows = np.minimum(np.arange(8) * len(thumb) // 8, len(thumb) - 1)
    cols = np.minimum(np.arange(9) * thumb.shape[1] // 9, thumb.shape[1] - 1)
    sums = np.zeros((len(thumb) + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.cumsum(0).cumsum(1)
    r1, c1 = np.maximum(np.append(rows[1:], len(thumb)), rows + 1), np.maximum(np.append(cols[1:], thumb.shape[1]), cols + 1)
    cell = (sums[r1][:, c1] - sums[rows][:, c1] - sums[r1][:, cols] + sums[rows][:, cols]) / ((r1 - rows)[:, None] * (c1 - cols)[None, :])
    return np.packbits((cell[:, :-1] > cell[:, 1:]).reshape(-1)).tobytes().hex()


def describe(heads: list[dict], thumbs: list[np.ndarray]) -> tuple[int, int, int, str]:
    """Width, height, frames and hash. Frames of one width are one tall picture."""
    if len({h["width"] for h in heads}) == 1:
        return heads[0]["width"], sum(h["height"] for h in heads), len(heads), thumbnail_hash(np.concatenate(thumbs))
    return heads[0]["width"], heads[0]["height"], len(heads), thumbnail_hash(thumbs[0])


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int, thumbnail_hash string"


class _Measured:
    """What is kept of a text while its frames go by."""

    def __init__(self, n_bytes: int, keep: bool):
        self.n_bytes, self.payload_bytes, self.media_bytes, self.tail = n_bytes, 0, 0, b""
        self.payload, self.stored = hashlib.sha256(), hashlib.sha256()
        self.heads, self.thumbs, self.media = [], [], [] if keep else None

    def add(self, media: bytes, head: dict, blocks: np.ndarray) -> None:
        raw = bytes_of(blocks)
        self.payload.update(raw)
        self.stored.update(media)
        self.payload_bytes, self.media_bytes, self.tail = self.payload_bytes + len(raw), self.media_bytes + len(media), raw[-32:]
        self.heads.append({"width": head["width"], "height": head["height"]})
        self.thumbs.append(dc_thumbnail(head, blocks))
        if self.media is not None:
            self.media.append(media)

    def row(self) -> tuple:
        width, height, n, mark = describe(self.heads, self.thumbs)
        out = (self.n_bytes, self.payload_bytes, self.payload.hexdigest(), crc32(self.tail), self.media_bytes, self.stored.hexdigest(), f"{width}x{height}:{n}:{mark}", width, height, n, mark)
        return out if self.media is None else (*out, b"".join(self.media))


def measured(texts, keep: bool = False) -> list[tuple]:
    """The media columns of each text: stored, read back from the stored bytes and measured, CHUNK bytes at a time."""
    held, waiting, size = [], [], 0

    def flush() -> None:
        stored = encode([p for _, p in waiting])
        heads = [next(images(m)) for m in stored]
        for (owner, _), media, head, blocks in zip(waiting, stored, heads, decode_all(heads), strict=True):
            owner.add(media, head, blocks)
        waiting.clear()

    for text in texts:
        raw = (text or "").encode()
        held.append(_Measured(len(raw), keep))
        for part in cut(padded(raw)):
            waiting.append((held[-1], part))
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    if waiting:
        flush()
    return [m.row() for m in held]


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id and the media columns of every whole text; with keep_media also the stored bytes."""
    schema = MEDIA + (", media binary" if keep_media else "")

    @F.pandas_udf(schema)
    def media(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(measured(texts, keep_media), columns=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", media("text").alias("m")).select("doc_id", "m.*")


def media_features(df: DataFrame, column: str) -> DataFrame:
    """Adds struct `jpeg` (width, height, frames, thumbnail_hash, error) of a column of JPEG bytes to df."""
    @F.pandas_udf("width int, height int, frames int, thumbnail_hash string, error string")
    def measure(media: pd.Series) -> pd.DataFrame:
        rows = []
        for data in media:
            try:
                decoded = decode(bytes(data)) if data is not None else []
                rows.append((*describe([h for h, _ in decoded], [dc_thumbnail(*d) for d in decoded]), None) if decoded else (None, None, None, None, "no image"))
            except (BadJpeg, KeyError, IndexError, ValueError, struct.error) as e:
                rows.append((None, None, None, None, str(e) or "damaged"))
        out = pd.DataFrame(rows, columns=["width", "height", "frames", "thumbnail_hash", "error"])
        return out.astype({"width": "Int32", "height": "Int32", "frames": "Int32"})

    return df.withColumn("jpeg", measure(F.col(column)))
