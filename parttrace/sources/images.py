"""Image fingerprints: byte and pixel digests and two 64-bit perceptual hashes, computed where the bytes are read.

The decoder is an argument: a function from bytes to (format, width, height, RGB array), raising ValueError for bytes
it can't read. The one here reads PNG (all colour types of 8 and 16 bits, not interlaced) and uncompressed BMP with
numpy and zlib alone, and uses Pillow for the other formats where it is installed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 25_000_000
FORMATS = ("PNG", "JPEG", "TIFF", "BMP", "WEBP")
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"II*\x00", "TIFF"), (b"MM\x00*", "TIFF"), (b"BM", "BMP"), (b"GIF8", "GIF"))


def kind_of(content: bytes) -> str | None:
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "WEBP"
    return next((k for m, k in _MAGIC if content.startswith(m)), None)


def size_of(content: bytes, kind: str) -> tuple[int, int] | None:
    """Width and height from the header alone, before anything is decoded."""
    if kind == "PNG" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if kind == "BMP" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return abs(w), abs(h)
    reader = {"JPEG": _jpeg_size, "TIFF": _tiff_size, "WEBP": _webp_size}.get(kind)
    try:
        return reader(content) if reader else None
    except (struct.error, IndexError):
        return None


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    """From the first frame header among the segments."""
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            return None
        mark = content[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1:  # filling, and marks without a body
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", content[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def _tiff_size(content: bytes) -> tuple[int, int] | None:
    """From the first directory's tags of width and height."""
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack(f"{order}I", content[4:8])
    (n,) = struct.unpack(f"{order}H", content[at : at + 2])
    found = {}
    for k in range(n):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        if tag in (256, 257):
            found[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _webp_size(content: bytes) -> tuple[int, int] | None:
    """From the first chunk: lossy, lossless or extended."""
    kind = content[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(content[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", content[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _png(content: bytes) -> np.ndarray:
    at, data, palette = 8, [], None
    width = height = depth = color = 0
    while at + 8 <= len(content):
        n, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if interlace or depth not in (8, 16):
                raise ValueError("this form of PNG isn't decoded here")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = channels * depth // 8
    size = height * (1 + width * step)  # no more than the header says is ever inflated
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), size), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 2:
            line = line + above
        elif rule == 1:
            line = np.cumsum(line.reshape(width, step), 0).ravel()
        elif rule in (3, 4):
            line = np.frombuffer((_averaged if rule == 3 else _paeth)(raw[y, 1:].tobytes(), above.astype(np.uint8).tobytes(), step), np.uint8).astype(np.int64)
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, step)
    if depth == 16:
        pixels = pixels[:, :, ::2]
    if color == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, 2)


def _averaged(line: bytes, above: bytes, step: int) -> bytes:
    """Each byte plus the mean of the one before it and the one above."""
    out = bytearray(line)
    for x, up in enumerate(above):
        out[x] = (out[x] + ((out[x - step] if x >= step else 0) + up >> 1)) & 255
    return bytes(out)


def _paeth(line: bytes, above: bytes, step: int) -> bytes:
    """Each byte plus whichever of left, above and above left is nearest to left + above - above left, in that order."""
    out = bytearray(line)
    left = corner = 0
    for x, up in enumerate(above):
        if x >= step:
            left, corner = out[x - step], above[x - step]
        a, b = up - corner, left - corner
        by_left, by_up, by_corner = abs(a), abs(b), abs(a + b)
        out[x] = (out[x] + (left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner)) & 255
    return bytes(out)


def _bmp(content: bytes) -> np.ndarray:
    start, = struct.unpack("<I", content[10:14])
    w, h, _, bits, packed = struct.unpack("<iiHHI", content[18:34])
    if packed or bits not in (24, 32):
        raise ValueError("this form of BMP isn't decoded here")
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def decode(content: bytes) -> np.ndarray:
    """RGB pixels, turned upright where the file says so."""
    kind = kind_of(content)
    try:
        if kind == "PNG":
            return np.ascontiguousarray(_png(content))
        if kind == "BMP":
            return np.ascontiguousarray(_bmp(content))
    except (ValueError, KeyError, struct.error, zlib.error, TypeError, IndexError) as e:
        refused: Exception = e
    else:
        refused = ValueError("no decoder for this format")
    try:
        import io

        from PIL import Image, ImageOps
    except ImportError:
        raise ValueError(str(refused)) from refused
    try:
        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB"))
    except OSError as e:
        raise ValueError(str(e)) from e


def _shrunk(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Grey levels averaged over equal areas."""
    grey = rgb @ np.array([299, 587, 114]) / 1000
    for axis, n in ((0, height), (1, width)):
        edges = np.linspace(0, grey.shape[axis], n + 1)
        sums = np.concatenate([np.zeros_like(np.take(grey, [0], axis)), np.cumsum(grey, axis)], axis)
        low = np.minimum(edges.astype(int), grey.shape[axis])
        part = edges - low
        at = np.take(sums, low, axis) + np.take(grey, np.minimum(low, grey.shape[axis] - 1), axis) * np.expand_dims(part, 1 - axis)
        grey = np.diff(at, axis=axis) / np.expand_dims(np.diff(edges), 1 - axis)
    return grey


def phash(rgb: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest cosine coefficients of a 32 x 32 image against their median."""
    small = _shrunk(rgb, 32, 32)
    k = np.arange(32)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * np.arange(8)[:, None] / 64)
    low = cosine @ small @ cosine.T
    return _number(low > np.median(low))


def dhash(rgb: np.ndarray) -> int:
    """Whether each of 9 x 8 cells is darker than the next."""
    small = _shrunk(rgb, 9, 8)
    return _number(small[:, 1:] > small[:, :-1])


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big", signed=True)


def fingerprint(content: bytes, max_pixels: int = MAX_PIXELS, decoder=decode) -> dict:
    """Status and hashes of one image's bytes."""
    import hashlib

    out = {"status": "resolved", "image_format": None, "width": None, "height": None, "pixel_sha256": None, "phash": None, "dhash": None, "error_code": None}
    kind = kind_of(content)
    if kind is None:
        return out | {"status": "unreadable", "error_code": "image_unreadable"}
    if kind not in FORMATS:
        return out | {"status": "unsupported_format", "error_code": "unsupported_format", "image_format": kind}
    size = size_of(content, kind)
    if size and size[0] * size[1] > max_pixels:
        return out | {"status": "unsafe_image", "error_code": "image_too_large", "image_format": kind, "width": size[0], "height": size[1]}
    try:
        rgb = decoder(content)
    except ValueError:
        return out | {"status": "unreadable", "error_code": "image_unreadable", "image_format": kind}
    h, w = rgb.shape[:2]
    if h * w > max_pixels:
        return out | {"status": "unsafe_image", "error_code": "image_too_large", "image_format": kind, "width": w, "height": h}
    head = f"mode=RGB\nwidth={w}\nheight={h}\n".encode()
    return out | {"image_format": kind, "width": w, "height": h, "pixel_sha256": hashlib.sha256(head + rgb.tobytes()).hexdigest(), "phash": phash(rgb), "dhash": dhash(rgb)}


def fingerprints(records: DataFrame, root: str | None, max_pixels: int = MAX_PIXELS, decoder=decode) -> DataFrame | None:
    """Fingerprints of the records' images below a root; None without one.

    Paths are taken below the root, with / for a backslash; those that leave it are outside_root and never opened, nor are
    links that lead out of a local root.
    """
    if root is None:
        return None
    spark = records.sparkSession
    wanted = records.where("image_path is not null").select("record_id", "partition", "manifest_id", "source_row_number", F.col("image_path").alias("source_image_path"))
    slashed = F.translate("source_image_path", "\\", "/")
    outside = slashed.startswith("/") | slashed.rlike(r"\A[A-Za-z]:") | F.concat(F.lit("/"), slashed, F.lit("/")).contains("/../")
    wanted = wanted.withColumns({"relative": F.regexp_replace(F.regexp_replace(slashed, r"\A(\./)+", ""), "/+", "/"), "outside": outside})
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    schema = "relative string, byte_sha256 string, status string, image_format string, width int, height int, pixel_sha256 string, phash long, dhash long, error_code string"

    def leaves(relative: str) -> bool:
        import os

        if not full.startswith("file:"):
            return False
        top = os.path.realpath(full.removeprefix("file:").replace("//", "/"))
        return os.path.commonpath([top, os.path.realpath(os.path.join(top, relative))]) != top

    def rows(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            made = []
            for r, c in zip(pdf["relative"], pdf["content"], strict=True):
                if leaves(r):
                    made.append({"relative": r, "status": "outside_root", "error_code": "outside_root"})
                else:
                    made.append({"relative": r, "byte_sha256": hashlib.sha256(c).hexdigest()} | fingerprint(bytes(c), max_pixels, decoder))
            yield pd.DataFrame(made, columns=[x.split()[0] for x in schema.split(", ")]).astype({k: "Int64" for k in ("width", "height", "phash", "dhash")})

    relative = F.regexp_replace(F.expr(f"substring(path, {len(full) + 2})"), "%20", " ")
    # each file once, however many records name it, and only files that are named
    named = files.select(relative.alias("relative"), "content").join(wanted.where("not outside").select("relative").distinct(), "relative", "left_semi")
    got = named.mapInPandas(rows, schema)
    out = wanted.join(got, "relative", "left")
    status = F.when(F.col("outside"), "outside_root").otherwise(F.coalesce("status", F.lit("missing")))
    return out.withColumns({"status": status, "error_code": F.coalesce("error_code", F.when(status != "resolved", status))}).drop("relative", "outside")


def collection(prints: DataFrame) -> DataFrame:
    """One row of counts by status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return prints.agg(n("resolved").alias("resolved"), n("missing").alias("missing"), n("unreadable", "unsupported_format").alias("unreadable"), n("unsafe_image", "outside_root").alias("unsafe"))
