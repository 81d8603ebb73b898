"""Image codecs, and the step that applies them.

A codec turns the bytes of an image into the bytes of another format.  The
registry holds those that need nothing but this package (PNG, TIFF, baseline
JPEG and GIF); others can be registered.  A format that is known but has no
codec here fails each file with a clear message, and never turns into another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gif, jpeg

Codec = Callable[[bytes, float], bytes]

#: Output formats that are known by name.
FORMATS = ("webp", "jpeg", "jpg", "png", "avif", "tiff", "gif", "heif")
PNG_MARK = b"\x89PNG\r\n\x1a\n"


class UnsupportedImage(Exception):
    """Bytes that cannot be read as an image: the file fails, nothing else."""


class UnknownFormat(Exception):
    """A format that no codec can have: the whole run fails."""


class CodecUnavailable(Exception):
    """A known format without a codec in this installation."""


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG, as eight bits a channel (of sixteen the upper)."""
    if not data.startswith(PNG_MARK):
        raise UnsupportedImage("not a PNG")
    at, raw, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and size == len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: size // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            raw.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    depths = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(head[3], (8, 16)) if head else ()
    if not channels or head[2] not in depths or head[6] > 1 or not head[0] or not head[1] or head[3] == 3 and palette is None:
        raise UnsupportedImage("a PNG of a kind that is not supported")
    width, height, bits, colour = head[:4]
    # (first column, first line, column step, line step) of each pass
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if head[6] else [(0, 0, 1, 1)]
    out, at = np.zeros((height, width, channels), np.uint8), 0
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(raw)), np.uint8)
        for x, y, dx, dy in passes:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                line = -(-w * channels * bits // 8)
                rows = flat[at : at + h * (1 + line)].reshape(h, 1 + line)
                out[y::dy, x::dx] = _samples(_unfiltered(rows, max(1, channels * bits // 8)), w, channels, bits, colour == 3)
                at += h * (1 + line)
    except (zlib.error, ValueError) as e:
        raise UnsupportedImage(f"a damaged PNG: {e}") from None
    if colour != 3:
        return out
    if out.max() >= len(palette):
        raise UnsupportedImage("a damaged PNG: a colour that the palette lacks")
    if not clear:
        return palette[out[:, :, 0]]
    alpha = np.full(256, 255, np.uint8)
    alpha[: len(clear)] = np.frombuffer(clear[:256], np.uint8)
    return np.concatenate([palette[out[:, :, 0]], alpha[out]], 2)


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y in range(len(rows)):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    return out


def _samples(lines: np.ndarray, width: int, channels: int, bits: int, indexed: bool) -> np.ndarray:
    """Packed lines as samples of eight bits; places in a palette stay as they are."""
    if bits == 16:
        return lines[:, ::2].reshape(len(lines), width, channels)
    if bits < 8:
        each = np.unpackbits(lines, axis=1).reshape(len(lines), -1, bits)
        lines = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : width * channels]
        if not indexed:
            lines = lines * (255 // ((1 << bits) - 1))
    return lines.reshape(len(lines), width, channels)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        whole = np.pad(line, (0, -len(line) % step)).reshape(-1, step)
        return np.cumsum(whole, axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (3, 4):
        raise UnsupportedImage("a PNG with an unknown filter")
    got = [0] * step + [0] * len(line)
    up = [0] * step + above.tolist()
    for i, x in enumerate(line.tolist(), step):
        a, b, c = got[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        got[i] = (x + guess) & 255
    return np.array(got[step:], np.uint8)


def encode_png(pixels: np.ndarray, quality: float = 80) -> bytes:
    """PNG loses nothing; quality sets how hard the bytes are compressed."""
    height, width, channels = pixels.shape
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 0] = 2
    flat = pixels.reshape(height, -1)
    lines[:, 1:] = flat - np.vstack([np.zeros((1, width * channels), np.uint8), flat[:-1]])
    level = max(1, min(9, 1 + int(quality) * 8 // 100))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


#: Of a TIFF directory: the tags that are read and written.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _COLOUR, _OFFSETS, _CHANNELS, _ROWS, _COUNTS, _EXTRA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 338


def encode_tiff(pixels: np.ndarray, quality: float = 80) -> bytes:
    """One deflated strip of eight bits a channel."""
    height, width, channels = pixels.shape
    body = zlib.compress(pixels.tobytes(), max(1, min(9, 1 + int(quality) * 8 // 100)))
    bits = struct.pack(f"<{channels}H", *[8] * channels)
    bits_at = 8 + len(body) + len(body) % 2
    entries = [
        (_WIDTH, 4, 1, width),
        (_HEIGHT, 4, 1, height),
        (_BITS, 3, channels, bits_at if channels > 2 else int.from_bytes(bits, "little")),
        (_COMPRESSION, 3, 1, 8),
        (_COLOUR, 3, 1, 2 if channels > 2 else 1),
        (_OFFSETS, 4, 1, 8),
        (_CHANNELS, 3, 1, channels),
        (_ROWS, 4, 1, height),
        (_COUNTS, 4, 1, len(body)),
    ]
    if channels in (2, 4):
        entries.append((_EXTRA, 3, 1, 2))
    at = bits_at + len(bits) + len(bits) % 2
    out = struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + bits + b"\0" * (len(bits) % 2)
    return out + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)


def decode_tiff(data: bytes) -> np.ndarray:
    """Pixels of a TIFF in strips, plain or deflated, of one, eight or sixteen bits a channel."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise UnsupportedImage("not a TIFF")
    try:
        at = struct.unpack(order + "I", data[4:8])[0]
        tags = {}
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            place = at + 10 + 12 * i
            if size * count > 4:
                place = struct.unpack(order + "I", data[place : place + 4])[0]
            tags[tag] = struct.unpack(f"{order}{count}{code}", data[place : place + size * count])
        bits = set(tags.get(_BITS, (1,)))
        if len(bits) != 1 or not bits <= {1, 8, 16} or tags.get(_COMPRESSION, (1,))[0] not in (1, 8, 32946):
            raise UnsupportedImage("a TIFF of a kind that is not supported")
        strips = [data[a : a + n] for a, n in zip(tags[_OFFSETS], tags[_COUNTS])]
        raw = b"".join(strips if tags.get(_COMPRESSION, (1,))[0] == 1 else map(zlib.decompress, strips))
        height, width, channels = tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_CHANNELS, (1,))[0]
        if bits == {1}:
            lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
            pixels = np.unpackbits(lines, axis=1)[:, : width * channels] * np.uint8(255)
        else:
            pixels = np.frombuffer(raw, order + "u2") >> 8 if bits == {16} else np.frombuffer(raw, np.uint8)
        pixels = pixels.astype(np.uint8).reshape(height, width, channels)
        return 255 - pixels if tags.get(_COLOUR, (1,))[0] == 0 else pixels
    except (struct.error, KeyError, ValueError, zlib.error) as e:
        raise UnsupportedImage(f"a damaged TIFF: {e}") from None


def decode(data: bytes) -> np.ndarray:
    """Pixels of an image in any format that can be read here."""
    if data.startswith(PNG_MARK):
        return decode_png(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return decode_tiff(data)
    try:
        if data[:2] == b"\xff\xd8":
            return jpeg.decode(data)
        if data[:4] == b"GIF8":
            return gif.decode(data)
    except (jpeg.Damaged, gif.Damaged) as e:
        raise UnsupportedImage(str(e)) from None
    raise UnsupportedImage("input buffer contains an image format that is not supported")


def _codec(encode: Callable[[np.ndarray, float], bytes]) -> Codec:
    def convert(data: bytes, quality: float) -> bytes:
        try:
            return encode(decode(data), quality)
        except (jpeg.Damaged, gif.Damaged) as e:
            raise UnsupportedImage(str(e)) from None

    return convert


BUILT_IN: dict[str, Codec] = {"png": _codec(encode_png), "tiff": _codec(encode_tiff), "jpeg": _codec(jpeg.encode), "jpg": _codec(jpeg.encode), "gif": _codec(gif.encode)}


def identity(data: bytes, quality: float) -> bytes:
    """The bytes as they are, for tests and for dry runs."""
    return data


def failing(message: str) -> Codec:
    """A codec that fails every file."""

    def fail(data: bytes, quality: float) -> bytes:
        raise UnsupportedImage(message)

    return fail


def check_formats(formats: list[str], codecs: Mapping[str, Codec]) -> None:
    """Refuse formats that nobody knows."""
    unknown = sorted({f for f in formats if f.lower() not in FORMATS and f.lower() not in codecs})
    if unknown:
        raise UnknownFormat(f"unknown output formats: {', '.join(unknown)}")


def convert_one(data: bytes, fmt: str, quality: float, codecs: Mapping[str, Codec]) -> tuple[bytes | None, str | None]:
    """The converted bytes, or what is wrong; errors that a codec does not declare go on."""
    codec = codecs.get(fmt.lower())
    try:
        if codec is None:
            raise CodecUnavailable(f"no codec for {fmt.lower()} is installed")
        return codec(data, quality), None
    except (UnsupportedImage, CodecUnavailable) as e:
        return None, str(e)


def convert_content(files: DataFrame, codecs: Mapping[str, Codec] | None = None, content_col: str = "content", format_col: str = "format", quality_col: str = "quality") -> DataFrame:
    """Add ``converted`` and ``convert_error``; only one of them is set.

    Only the bytes to convert cross to Python, once.  Errors that a codec does
    not declare fail the task, and so the run.
    """
    codecs = BUILT_IN if codecs is None else codecs

    @F.arrow_udf("struct<converted:binary,convert_error:string>")
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("converted", pa.binary()), ("convert_error", pa.string())])
        for batch in batches:
            found = (convert_one(r["c"] or b"", r["f"], r["q"], codecs) for r in (row.as_py() for row in batch))
            yield pa.array([{"converted": out, "convert_error": error} for out, error in found], kind)

    need = F.struct(F.col(content_col).alias("c"), F.col(format_col).alias("f"), F.col(quality_col).cast("double").alias("q"))
    done = files.withColumn("_done", converted.asNondeterministic()(need))
    return done.select(*files.columns, "_done.converted", "_done.convert_error")
