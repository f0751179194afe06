"""Payloads as PNG images in binary columns, and low-frequency cosine-transform hashes of the images.

The writer makes 8-bit greyscale images of `WIDTH` columns under the filter (None, Sub or Up) that leaves
the least absolute values; the reader takes any 8-bit greyscale image without interlacing, tests the checksum
of every chunk, inflates the data and undoes the five filters with numpy."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 24
UNIT = 576
#: Fixed by the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class BadImage(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data and as many bytes 255 as make it a positive multiple of UNIT."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """The image whose samples, row by row, are the payload (a multiple of width)."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    options = [rows, rows - left, rows - above]  # None, Sub, Up; differences are modulo 256
    kind = min(range(3), key=lambda i: int(np.abs(options[i].view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = options[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines, width: int):
    """Samples from filtered rows of one byte a pixel; lines[:, 0] has the filters."""
    import numpy as np

    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    zero, y = np.zeros(width, np.uint8), 0
    while y < len(out):
        kind, above = kinds[y], out[y - 1] if y else zero
        if kind == 2:
            end = y + 1
            while end < len(out) and kinds[end] == 2:
                end += 1
            run = np.cumsum(out[y:end], axis=0, dtype=np.uint8)
            out[y:end] = run + above
            y = end
            continue
        if kind == 3:
            line, last = out[y], 0
            for x in range(width):
                last = line[x] = (int(line[x]) + (int(last) + int(above[x])) // 2) & 255
        elif kind == 4:
            line, a, c = out[y], 0, 0
            for x in range(width):
                b = int(above[x])
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                a = line[x] = (int(line[x]) + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
                c = b
        y += 1
    return out


def read_png(media: bytes):
    """The samples as an array of rows; BadImage if a checksum, a length or the format is wrong."""
    import numpy as np

    if media[:8] != SIGNATURE:
        raise BadImage("no signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise BadImage("cut short")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadImage(f"chunk {kind!r} is needed, but not known")
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise BadImage("not an 8-bit greyscale image without interlacing")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadImage("data") from e
    if len(raw) != head[1] * (head[0] + 1):
        raise BadImage("length of the data")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1), head[0])


def _cosines(n: int, k: int):
    import numpy as np

    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


def cosine_hash(pixels, k: int = 8) -> bytes:
    """A bit for each of the k * k lowest frequencies: whether it is over their median (the mean aside).

    The image is first averaged to 32 * 32 cells, in integers over a common denominator, so that equal
    images give equal bits anywhere."""
    import numpy as np

    side = 32
    h, w = pixels.shape
    up = np.repeat(pixels, side, axis=1).reshape(h, side, w).sum(2, dtype=np.int64) if w < 1024 else _bins(pixels, side)
    rows = np.concatenate([np.zeros((1, side), np.int64), np.cumsum(up, axis=0)])
    edge = np.arange(side + 1) * h
    whole, part = edge // side, edge % side
    more = np.concatenate([up, np.zeros((1, side), np.int64)])
    total = rows[whole] * side + more[whole] * part[:, None]
    small = np.diff(total, axis=0) / (h * w)
    c = _cosines(side, k)
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _bins(pixels, side: int):
    import numpy as np

    w = pixels.shape[1]
    sums = np.concatenate([np.zeros((len(pixels), 1), np.int64), np.cumsum(pixels, axis=1, dtype=np.int64)], axis=1) * side
    edge = np.arange(side + 1) * w
    ext = np.concatenate([pixels.astype(np.int64), np.zeros((len(pixels), 1), np.int64)], axis=1)
    return np.diff(sums[:, edge // side] + ext[:, edge // side] * (edge % side), axis=1)


def to_png(data: Column) -> Column:
    """Binary or string column to PNG; null counts as empty."""

    @F.arrow_udf("binary")
    def of(values):
        import pyarrow as pa

        return pa.array([write_png(padded(v.as_py() or b"")) for v in values], pa.binary())

    return of(data.cast("binary"))


def from_png(media: Column) -> Column:
    """A struct (payload, hash, error) read from PNG bytes; a bad or null image gives only the error."""

    @F.arrow_udf("payload binary, hash binary, error string")
    def of(values):
        import pyarrow as pa

        out = []
        for v in values:
            try:
                pixels = read_png(v.as_py() or b"")
                out.append((pixels.tobytes(), cosine_hash(pixels), None))
            except BadImage as e:
                out.append((None, None, str(e)))
        columns = [*zip(*out, strict=True)] or [(), (), ()]
        types = (pa.binary(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["payload", "hash", "error"])

    return of(media)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, hash, error) for each row of docs: the text's UTF-8 bytes as an
    image, and what is read back from the image.

    A null text is an empty one (one tile of bytes 255). Null and repeated doc_ids are rows like others;
    equal texts give equal images. An empty table gives no rows; other columns are not read."""
    data = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), to_png(data).alias("media"))
    return rows.withColumn("read", from_png(F.col("media"))).select("doc_id", "n_bytes", "media", "read.*")
