"""GIF: the first frame of a file, and one frame written."""

from __future__ import annotations

import struct

import numpy as np


class Damaged(ValueError):
    """Bytes that are no GIF that can be read."""


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a run of sub-blocks, and where it ends."""
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _expand(data: bytes, least: int, total: int) -> bytes:
    """Undo the LZW code."""
    clear, stop = 1 << least, (1 << least) + 1
    words = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, before = list(words), least + 1, None
    out, done, held, n = [], 0, 0, 0
    for byte in data:
        held |= byte << n
        n += 8
        while n >= size:
            code = held & ((1 << size) - 1)
            held >>= size
            n -= size
            if code == clear:
                table, size, before = list(words), least + 1, None
                continue
            if code == stop or done >= total:
                return b"".join(out)
            if before is None:
                if code >= clear:
                    raise Damaged("an unknown code")
                word = table[code]
            else:
                if code > len(table):
                    raise Damaged("an unknown code")
                word = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + word[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
            out.append(word)
            done += len(word)
            before = word
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3, or 4 where a colour is transparent) of the first frame."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Damaged("not a GIF")
    try:
        width, height, flags = struct.unpack("<HHB", data[6:11])
        at, palette, clear = 13, None, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n
        while data[at] != 0x2C:
            if data[at] != 0x21:
                raise Damaged("no frame")
            kind = data[at + 1]
            body, at = _blocks(data, at + 2)
            if kind == 0xF9 and body[0] & 1:
                clear = body[3]
        x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n
        if palette is None or not w or not h or x + w > width or y + h > height or not 2 <= data[at] <= 8:
            raise Damaged("a GIF of a kind that is not supported")
        flat = np.frombuffer(_expand(_blocks(data, at + 1)[0], data[at], w * h)[: w * h], np.uint8)
        frame = flat.reshape(h, w)
        if flags & 0x40:
            order = [i for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(first, h, step)]
            frame = frame[np.argsort(order)]
        if frame.max() >= len(palette):
            raise Damaged("a colour that the palette lacks")
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, Damaged) else Damaged(f"a damaged GIF: {e}") from None
    alpha = clear is not None or (w, h) != (width, height)
    out = np.zeros((height, width, 4 if alpha else 3), np.uint8)
    out[y : y + h, x : x + w, :3] = palette[frame]
    if alpha:
        out[y : y + h, x : x + w, 3] = np.where(frame == clear, 0, 255) if clear is not None else 255
    return out


def _indexed(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Palette, places in it, and the transparent place: exact up to 256 colours, else six, seven and six levels."""
    channels = pixels.shape[2]
    rgb = np.repeat(pixels[:, :, :1], 3, 2) if channels < 3 else pixels[:, :, :3]
    hidden = pixels[:, :, -1] < 128 if channels in (2, 4) else np.zeros(pixels.shape[:2], bool)
    code = (rgb.astype(np.int64) << [16, 8, 0]).sum(2)
    code[hidden] = -1
    colours, place = np.unique(code, return_inverse=True)
    if len(colours) > 256:
        levels = np.array([6, 7, 6])
        steps = np.rint(rgb.astype(np.float64) * (levels - 1) / 255).astype(np.int64)
        place = (steps * [42, 6, 1]).sum(2)
        grid = np.stack(np.meshgrid(*[np.arange(n) for n in levels], indexing="ij"), 3).reshape(-1, 3)
        palette = np.rint(grid * 255 / (levels - 1)).astype(np.uint8)
        clear = len(palette) if hidden.any() else None
        place[hidden] = len(palette)
        return np.vstack([palette, [[0, 0, 0]]]) if clear is not None else palette, place, clear
    palette = np.stack([np.maximum(colours, 0) >> s & 255 for s in (16, 8, 0)], 1).astype(np.uint8)
    return palette, place.reshape(code.shape), 0 if colours[0] < 0 else None


def _compress(flat: bytes, least: int) -> bytes:
    """The LZW code of a run of places."""
    clear, stop = 1 << least, (1 << least) + 1
    out, held, n = bytearray(), clear, least + 1
    size, table, word = least + 1, {}, flat[0]
    for byte in flat[1:]:
        key = word << 8 | byte
        if key in table:
            word = table[key]
            continue
        held |= word << n
        n += size
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8
        code = stop + 1 + len(table)
        if code < 4096:
            table[key] = code
            if code == 1 << size:
                size += 1
        else:
            held |= clear << n
            n += size
            table, size = {}, least + 1
        word = byte
    held |= word << n
    n += size
    if stop + 1 + len(table) == 1 << size and size < 12:
        size += 1
    held |= stop << n
    n += size
    return bytes(out) + held.to_bytes(-(-n // 8), "little")


def encode(pixels: np.ndarray, quality: float = 80) -> bytes:
    """One frame; quality plays no part."""
    height, width, _ = pixels.shape
    if max(height, width) > 65_535:
        raise Damaged("an image too large for GIF")
    palette, place, clear = _indexed(pixels)
    bits = max(1, (len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    shown = b"" if clear is None else struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1, 0, clear, 0)
    least = max(2, bits)
    coded = _compress(place.astype(np.uint8).tobytes(), least)
    parts = b"".join(bytes([len(x)]) + x for x in (coded[i : i + 255] for i in range(0, len(coded), 255)))
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits - 1, 0, 0) + table.tobytes()
    return head + shown + struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0) + bytes([least]) + parts + b"\0;"
