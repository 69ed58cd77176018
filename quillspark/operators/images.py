"""Image headers: kind, size and animation by walking a file's own structure, and a verdict on uploads.

PNG files are walked chunk by chunk, JPEG files segment by segment, WebP files by their first chunk. Only headers are looked at, nothing is decoded; all
rows of an Arrow batch are walked in one pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Limits of uploads, and the types that are taken or refused.
MOST_SIDE, MOST_DECODED, MOST_ENCODED = 8192, 128 * 1024 * 1024, 128 * 1024 * 1024
MEDIA = {"image/png": "png", "image/jpeg": "jpeg", "image/webp": "webp"}
EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp"}
REFUSED = frozenset("apng avif bmp gif heic heif ico jfif jxl psd svg svgz tif tiff".split())

PNG_MAGIC, JPEG_MAGIC = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
#: Markers of frames, which tell the size; the others of that range are tables.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def kind_of(data: bytes) -> str | None:
    if data.startswith(PNG_MAGIC):
        return "png"
    if data.startswith(JPEG_MAGIC):
        return "jpeg"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def png_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Type, begin and length of each chunk, up to where the file ends."""
    at = len(PNG_MAGIC)
    while at + 8 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], at + 8, length
        at += 12 + length


def png_size(data: bytes) -> tuple[int, int] | None:
    kind, at, length = next(png_chunks(data), (b"", 0, 0))
    return struct.unpack(">II", data[at : at + 8]) if kind == b"IHDR" and length == 13 and at + 13 <= len(data) else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:  # without a length
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return None
        if marker in FRAMES:
            return struct.unpack(">HH", data[at + 5 : at + 9])[::-1] if at + 9 <= len(data) else None
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def webp_size(data: bytes) -> tuple[int, int] | None:
    kind, body = data[12:16], data[20:30]
    if kind == b"VP8X" and len(body) == 10:
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    if kind == b"VP8 " and len(body) == 10 and body[3:6] == b"\x9d\x01\x2a":
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10]))
    if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


SIZES = {"png": png_size, "jpeg": jpeg_size, "webp": webp_size}


def animated(data: bytes, kind: str | None) -> bool:
    """A PNG's animation chunk comes before its data; a WebP has the flag or an animation chunk."""
    if kind == "png":
        return next((name == b"acTL" for name, _, _ in png_chunks(data) if name in (b"acTL", b"IDAT")), False)
    return kind == "webp" and (len(data) >= 21 and data[12:16] == b"VP8X" and bool(data[20] & 2) or b"ANIM" in data)


def declared(name: str | None, media: str | None) -> tuple[str | None, str | None]:
    """The kind that a file's name and media type say, or why they don't."""
    media = (media or "").strip().lower()
    extension = (name or "").rpartition(".")[2].strip().lower() if "." in (name or "") else None
    by_media, by_name = MEDIA.get(media), EXTENSIONS.get(extension)
    if media.startswith("image/") and by_media is None or extension in REFUSED:
        return None, "unsupported"
    if by_media and by_name and by_media != by_name:
        return None, "disagree"
    kind = by_media or by_name
    return kind, None if kind else "unsupported"


def verdict(name: str | None, media: str | None, data: bytes | None, most_encoded: int = MOST_ENCODED) -> tuple[str | None, int | None, int | None, bool, str]:
    """Kind, width, height, whether it is animated, and ok or the first thing that is wrong."""
    if not data:
        return None, None, None, False, "empty"
    kind = kind_of(data)
    size = SIZES[kind](data) if kind else None
    width, height = size or (None, None)
    moves = animated(data, kind)
    says, wrong = declared(name, media)
    if len(data) > most_encoded:
        wrong = "too_large"
    elif wrong is None:
        checks = [
            ("no_image", kind is None), ("other_kind", kind != says), ("animated", moves), ("bad_header", size is None), ("no_pixels", size is not None and 0 in size),
            ("too_wide", size is not None and max(size) > MOST_SIDE), ("too_many_pixels", size is not None and size[0] * size[1] * 4 > MOST_DECODED),
        ]
        wrong = next((what for what, is_so in checks if is_so), "ok")
    return kind, width, height, moves, wrong


def image_verdicts(df: DataFrame, id_col: str, content_col: str, name_col: str, media_col: str, most_encoded: int = MOST_ENCODED) -> DataFrame:
    """id, kind, width, height, animated and verdict of every row: ok, empty, too_large, unsupported, disagree (name and media type), no_image, other_kind (than declared), animated,
    bad_header (too short or not as its kind), no_pixels, too_wide or too_many_pixels, the first that holds. A null content is empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(name.as_py(), media.as_py(), data.as_buffer().to_pybytes() if data.is_valid else None, most_encoded) for data, name, media in zip(*batch.columns[1:], strict=True)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["id", "kind", "width", "height", "animated", "verdict"])

    rows = df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"), F.col(name_col).cast("string").alias("name"), F.col(media_col).cast("string").alias("media"))
    return rows.mapInArrow(run, f"id {kind}, kind string, width long, height long, animated boolean, verdict string").withColumnRenamed("id", id_col)
