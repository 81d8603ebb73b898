"""Baseline JPEG: eight bits a channel, Huffman codes, grey or colour.

Everything but the entropy code of the decoder works on whole arrays.  The
encoder makes its Huffman codes from the image's own symbols.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The quantization tables of the standard's annex K, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
)
#: Places of the 64 coefficients in the order in which they are written.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Blocks that are encoded at once.
_BLOCKS = 1 << 14

_N = np.arange(8)
_DCT = np.where(_N[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16))


class Damaged(ValueError):
    """Bytes that are no JPEG of this kind."""


def _tables(quality: float) -> list[np.ndarray]:
    q = max(1, min(100, int(quality)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (LUMA, CHROMA)]


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of at most 16; the code of ones only stays free."""
    heap = [(int(n), int(s), (int(s),)) for s, n in enumerate(counts) if n] + [(0, 256, (256,))]
    heapq.heapify(heap)
    length = dict.fromkeys((s for _, s, _ in heap), 0)
    if len(heap) == 2:
        return {s: 1 for s in length if s < 256}
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, min(i, j), x + y))
    bits = np.bincount(list(length.values()), minlength=64)
    for n in range(len(bits) - 1, 16, -1):  # shorten codes that are too long, as annex K has it
        while bits[n] > 0:
            m = n - 2
            while not bits[m]:
                m -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[m + 1] += 2
            bits[m] -= 1
    order = sorted(length, key=lambda s: (length[s], s == 256, s))
    sizes = [n for n in range(1, 17) for _ in range(bits[n])]
    return {s: n for s, n in zip(order, sizes) if s < 256}


def _huffman(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is written, and code and length of each symbol."""
    length = _code_lengths(counts)
    order = sorted(length, key=lambda s: (length[s], s))
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        at <<= length[s] - last
        last = length[s]
        code[s], size[s] = at, last
        at += 1
    bits = np.bincount(list(length.values()), minlength=17)[1:17]
    return bytes(bits.tolist()) + bytes(order), code, size


def _category(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _extra(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that tell a value of its category."""
    return np.where(x < 0, x + (1 << size) - 1, x)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of blocks (first column: differences) in order: block, is DC, symbol, extra bits and their number."""
    m = len(blocks)
    dc = blocks[:, 0]
    dc_size = _category(dc)
    row, col = np.nonzero(blocks[:, 1:])
    col = col + 1
    value = blocks[row, col]
    new = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    run = col - np.where(new, 0, np.r_[0, col[:-1]]) - 1
    size = _category(value)
    long = run // 16
    last = np.zeros(m, np.int64)
    last[row] = col  # the last assignment stands, which is the greatest
    ends = np.flatnonzero(last < 63)
    parts = [
        (np.arange(m) * 256, np.ones(m, bool), dc_size, _extra(dc, dc_size), dc_size),
        (np.repeat(row * 256 + 2 * col, long), np.zeros(long.sum(), bool), np.full(long.sum(), 0xF0), np.zeros(long.sum(), np.int64), np.zeros(long.sum(), np.int64)),
        (row * 256 + 2 * col + 1, np.zeros(len(row), bool), (run % 16 << 4) | size, _extra(value, size), size),
        (ends * 256 + 255, np.zeros(len(ends), bool), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)),
    ]
    key, is_dc, symbol, extra, bits = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    return key[order] // 256, is_dc[order], symbol[order], extra[order], bits[order]


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def encode(pixels: np.ndarray, quality: float = 80) -> bytes:
    """Pixels (height, width, channels) as a JPEG; alpha is laid over black."""
    height, width, channels = pixels.shape
    if max(height, width) > 65_535:
        raise Damaged("an image too large for JPEG")
    x = pixels.astype(np.float64)
    if channels in (2, 4):
        x = x[:, :, :-1] * (x[:, :, -1:] / 255)
    if x.shape[2] == 3:
        r, g, b = np.moveaxis(x, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], 2)
    x = np.pad(x, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") - 128
    n = x.shape[2]
    # (blocks, components, 8, 8), blocks by line
    x = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8, n).transpose(0, 2, 4, 1, 3).reshape(-1, n, 8, 8)
    tables = _tables(quality)
    scale = np.stack([tables[min(c, 1)].reshape(8, 8) for c in range(n)])
    blocks = np.concatenate([np.rint(_DCT @ x[i : i + _BLOCKS] @ _DCT.T / scale).astype(np.int64) for i in range(0, len(x), _BLOCKS)])
    blocks = blocks.reshape(-1, n, 64)[:, :, ZIGZAG]
    blocks[:, :, 0] = np.diff(blocks[:, :, 0], axis=0, prepend=0)
    blocks = blocks.reshape(-1, 64)
    block, is_dc, symbol, extra, bits = _symbols(blocks)
    chroma = block % n > 0
    tables_out, code, size = [], np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for klass, dc in ((0, True), (1, False)):
        for number in range(min(n, 2)):
            here = (is_dc == dc) & (chroma == bool(number))
            written, codes, sizes = _huffman(np.bincount(symbol[here], minlength=256))
            tables_out.append(_segment(0xC4, bytes([klass << 4 | number]) + written))
            code[here], size[here] = codes[symbol[here]], sizes[symbol[here]]
    stream = _packed((code << bits) | extra, size + bits).replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n))
    scan = bytes([n]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(n)) + b"\x00\x3f\x00"
    head = _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    quant = b"".join(_segment(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].tolist())) for i in range(min(n, 2)))
    return b"\xff\xd8" + head + quant + _segment(0xC0, frame) + b"".join(tables_out) + _segment(0xDA, scan) + stream + b"\xff\xd9"


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Values of so many bits each, one after another, filled up with ones."""
    out, rest = [], np.zeros(0, np.uint8)
    for i in range(0, len(value), 1 << 18):
        v, n = value[i : i + (1 << 18)], size[i : i + (1 << 18)]
        at = np.cumsum(n) - n
        left = np.repeat(n, n) - 1 - (np.arange(n.sum()) - np.repeat(at, n))
        bits = np.concatenate([rest, ((np.repeat(v, n) >> left) & 1).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        out.append(np.packbits(np.r_[rest, np.ones(8 - len(rest), np.uint8)]).tobytes())
    return b"".join(out)


def _lookup(body: bytes) -> tuple[list[int], list[int]]:
    """Symbol and length of the code at the head of each run of 16 bits."""
    symbols, at, code = body[16:], 0, 0
    symbol, size = [0] * 65_536, [0] * 65_536
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            if at >= len(symbols) or (code + 1) << (16 - n) > 65_536:
                raise Damaged("a damaged table of codes")
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            symbol[lo:hi], size[lo:hi] = [symbols[at]] * (hi - lo), [n] * (hi - lo)
            at, code = at + 1, code + 1
        code <<= 1
    return symbol, size


class _Scan:
    """The decoder of one run of entropy-coded bytes, up to a restart."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data + b"\xff" * 64, 0, 0, 0

    def blocks(self, plan: list[tuple[int, tuple, tuple, list[int]]], zigzag: list[int], places: list[int], values: list[int]) -> None:
        """Read one block for each entry of the plan: base place, DC table, AC table, the component's last DC."""
        data, at, held, n = self.data, self.at, self.held, self.n
        for base, (dc_symbol, dc_size), (ac_symbol, ac_size), last in plan:
            k = 0
            while k < 64:
                if n < 32:
                    held = (held & ((1 << n) - 1)) << 48 | int.from_bytes(data[at : at + 6], "big")
                    at, n = at + 6, n + 48
                    if at > len(data):
                        raise Damaged("entropy-coded bytes end early")
                code = (held >> (n - 16)) & 0xFFFF
                symbol, size = (ac_symbol[code], ac_size[code]) if k else (dc_symbol[code], dc_size[code])
                if not size:
                    raise Damaged("an unknown code")
                n -= size
                bits = symbol & 15
                if k:
                    if not bits:
                        if symbol != 0xF0:
                            break
                        k += 16
                        continue
                    k += symbol >> 4
                    if k > 63:
                        raise Damaged("a run beyond its block")
                value = 0
                if bits:
                    n -= bits
                    value = (held >> n) & ((1 << bits) - 1)
                    if value < 1 << (bits - 1):
                        value -= (1 << bits) - 1
                if not k:
                    last[0] = value = last[0] + value
                places.append(base + zigzag[k])
                values.append(value)
                k += 1
        self.at, self.held, self.n = at, held, n


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 or 3) of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("not a JPEG")
    quant, codes, frame, restart, adobe, at = {}, {}, None, 0, None, 2
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise Damaged("no marker where one is due")
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    table = np.zeros(64, np.int64)
                    table[ZIGZAG] = raw
                    quant[body[0] & 15], body = table, body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    codes[body[0]], body = _lookup(body[1:n]), body[n:]
            elif kind in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack(">BHHB", body[:6])
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8 or n not in (1, 3) or not height or not width or not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in frame):
                    raise Damaged("a JPEG of a kind that is not supported")
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise Damaged("a JPEG that is not baseline")
            elif kind == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif kind == 0xDA:
                break
        if frame is None or body[0] != len(frame):
            raise Damaged("a JPEG in several scans")
        picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        planes = _planes(data[at:], frame, picked, codes, quant, height, width, restart)
    except (IndexError, KeyError, struct.error, ValueError) as e:
        raise e if isinstance(e, Damaged) else Damaged(f"a damaged JPEG: {e}") from None
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[:, :, None]
    y, cb, cr = planes
    if adobe == 0:
        rgb = planes
    else:
        cb, cr = cb - 128, cr - 128
        rgb = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(rgb, 2)), 0, 255).astype(np.uint8)


def _runs(stream: bytes) -> list[bytes]:
    """The entropy-coded bytes between restart marks, without stuffing."""
    out, start, at = [], 0, 0
    while True:
        at = stream.find(b"\xff", at)
        if at < 0 or at + 1 >= len(stream):
            out.append(stream[start:])
            break
        mark = stream[at + 1]
        if mark in (0x00, 0xFF):
            at += 2 - (mark == 0xFF)
            continue
        out.append(stream[start:at])
        if not 0xD0 <= mark <= 0xD7:
            break
        start = at = at + 2
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _planes(stream: bytes, frame: list[tuple], picked: dict[int, int], codes: dict, quant: dict, height: int, width: int, restart: int) -> list[np.ndarray]:
    """The samples of each component, at the size of the image."""
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    zigzag = ZIGZAG.tolist()
    coders = [(codes[picked[c] >> 4], codes[0x10 | picked[c] & 15]) for c, *_ in frame]
    lasts = [[0] for _ in frame]
    held = [([], []) for _ in frame]
    runs = iter(_runs(stream))
    scan = _Scan(next(runs))
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            scan = _Scan(next(runs, b""))
            for last in lasts:
                last[0] = 0
        row, col = divmod(unit, across)
        for i, (_, h, v, _) in enumerate(frame):
            plan = [((((row * v + y) * across * h) + col * h + x) * 64, *coders[i], lasts[i]) for y in range(v) for x in range(h)]
            scan.blocks(plan, zigzag, *held[i])
    out = []
    for i, (_, h, v, table) in enumerate(frame):
        flat = np.zeros(across * h * down * v * 64, np.float64)
        flat[np.array(held[i][0], np.int64)] = held[i][1]
        blocks = flat.reshape(-1, 64) * quant[table]
        blocks = _DCT.T @ blocks.reshape(-1, 8, 8) @ _DCT + 128
        plane = blocks.reshape(down * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        plane = np.repeat(np.repeat(plane, most_v // v, 0), most_h // h, 1)
        out.append(plane[:height, :width])
    return out
