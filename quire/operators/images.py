"""Text in images: which images count, and clean-up of what a vision model reads."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.functions.text import left_trim, lines, right_trim, trim

#: Least width and height; a loop has 6 lines or more, over 0.7 of which are one; lines of 2 characters always stay.
LEAST_SIDE, LOOP_LINES, LOOP_SHARE, SHORT_LINE = 100, 6, 0.7, 2


def image_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def usable(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source that are large enough; one that cannot be decoded has width and height -1."""
    return images.where((F.col("image.width") >= LEAST_SIDE) & (F.col("image.height") >= LEAST_SIDE))


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, JPEG, WebP or TIFF; None if there is no such header."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            return _jpeg_size(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_size(data)
    except (struct.error, IndexError):
        pass
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """From the frame header, which any number of other segments may precede."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 1 or 0xD0 <= marker <= 0xD8:  # fill bytes and markers without a length
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
        if tag in (256, 257):
            value = data[at + 10 + 12 * k : at + 14 + 12 * k]
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return (found[256], found[257]) if len(found) == 2 else None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def dimensions(content: pd.Series) -> pd.DataFrame:
    """Struct (width, height) from an image's header; null in both where there is none."""
    return pd.DataFrame([size_of(bytes(c)) or (None, None) if c is not None else (None, None) for c in content], columns=["width", "height"], dtype="Int64")


def discard(content: Column) -> Column:
    """Whether an image is too small, or no image whose header can be read."""
    d = dimensions(content)
    return F.coalesce((d["width"] < LEAST_SIDE) | (d["height"] < LEAST_SIDE), F.lit(True))


def is_loop(text: Column) -> Column:
    """Whether one line makes up most of a text."""
    own = F.filter(F.transform(lines(text), trim), lambda x: x != "")

    def judge(ls: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("top"))

        def step(a: Column, x: Column) -> Column:
            now = F.when(x.eqNullSafe(a["last"]), a["now"] + 1).otherwise(1)
            return F.struct(x.alias("last"), now.alias("now"), F.greatest(a["top"], now).alias("top"))

        top = F.aggregate(F.array_sort(ls), start, step, lambda a: a["top"])
        return (F.size(ls) >= LOOP_LINES) & (top / F.size(ls) > F.lit(LOOP_SHARE))

    return F.transform(F.array(own), judge)[0]


def clean_lines(text: Column) -> Column:
    """Without lines that repeat an earlier one; short lines stay, blank lines follow only a line with text, none ends the text.

    Lines are sorted with their places, so that the first of each kind is the one whose left neighbour differs; a blank line stays where
    the line kept before it is not blank.
    """

    def firsts(own: Column) -> Column:
        return F.filter(own, lambda x, i: (F.length(x["k"]) <= SHORT_LINE) | (i == 0) | (F.get(own, i - 1)["k"] != x["k"]))

    def solid(own: Column) -> Column:
        return F.filter(own, lambda x, i: (x["k"] != "") | ((i > 0) & (F.get(own, i - 1)["k"] != "")))

    def ended(own: Column) -> Column:
        return F.when((F.size(own) > 0) & (F.get(own, F.size(own) - 1)["k"] == ""), F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)

    keyed = F.transform(F.transform(lines(text), right_trim), lambda x, i: F.struct(left_trim(x).alias("k"), i.alias("i"), x.alias("x")))
    placed = lambda own: F.array_sort(F.transform(own, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["x"].alias("x"))))
    out = F.array(F.array_sort(keyed))
    for step in (firsts, placed, solid, ended):
        out = F.array(F.transform(out, step)[0])
    return F.array_join(out[0]["x"], "\n")


def image_text(raw: Column) -> Column:
    """A model's reading, cleaned; null where it is empty, a loop, or empty once cleaned."""
    return F.when((trim(raw) == "") | is_loop(raw), None).otherwise(F.nullif(clean_lines(raw), F.lit("")))


def translate_images(images: DataFrame, read, slots: int = 4, attempts: int = 3) -> DataFrame:
    """images (content, ...) with image_hash, translation (null: none) and status (text, none, error, small).

    ``read(content) -> str`` is called once for each distinct image that is large enough; ``translate.image_reader`` makes one of a
    provider. Headers are read once, and only usable images' bytes are sent on.
    """
    hashed = images.withColumn("image_hash", image_hash(F.col("content"))).withColumn("_small", discard(F.col("content")))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, errors = [], []
            for content in batch["content"]:
                text, error = None, None
                for _ in range(attempts):
                    try:
                        text, error = read(bytes(content)), None
                        break
                    except Exception as e:  # the row keeps the reason
                        error = str(e)[:500]
                raw.append(text)
                errors.append(error)
            yield pd.DataFrame({"image_hash": batch["image_hash"], "raw": raw, "error": errors})

    asked = hashed.where("not _small").select("image_hash", "content").dropDuplicates(["image_hash"]).repartition(slots, "image_hash").mapInPandas(run, "image_hash string, raw string, error string").checkpoint()
    out = hashed.join(asked.withColumn("translation", image_text(F.col("raw"))), "image_hash", "left")
    status = F.when(F.col("_small"), "small").when(F.col("error").isNotNull(), "error").when(F.col("translation").isNull(), "none").otherwise("text")
    return out.withColumn("status", status).drop("_small", "raw")


def image_counts(done: DataFrame, by: list[str]) -> DataFrame:
    return done.groupBy(*by).agg(F.count_if(F.col("status") == "text").alias("with_text"), F.count_if(F.col("status").isin("none", "small")).alias("without_text"), F.count_if(F.col("status") == "error").alias("errors"))
