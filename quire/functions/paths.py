"""Paths inside archives and on hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that can be read, and starts of addresses that stay as they are.
SUFFIXES = (".docx", ".pdf", ".rtf", ".doc", ".odt", ".epub", ".html", ".htm")
OUTSIDE = ("http://", "https://", "data:")
KEPT = (*OUTSIDE, "#", "mailto:")


def suffix(path: Column) -> Column:
    """The lower-cased last suffix, with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def route(path: Column) -> Column:
    """How a file is read: epub, html, docx, convert (others that a converter turns into docx), or null."""
    s = suffix(path)
    return F.when(s == ".epub", "epub").when(s.isin(".html", ".htm"), "html").when(s == ".docx", "docx").when(s.isin(*SUFFIXES), "convert")


def normalize(path: Column) -> Column:
    """'.', '..' and doubled slashes resolved; an empty result is '.'."""
    absolute = path.startswith("/")
    double = path.startswith("//") & ~path.startswith("///")

    def step(kept: Column, part: Column) -> Column:
        up = part == ".."
        blocked = (F.size(kept) == 0) | (F.element_at(F.concat(F.array(F.lit("")), kept), -1) == "..")
        return (
            F.when(part.isin("", "."), kept)
            .when(up & blocked & absolute & (F.size(kept) == 0), kept)
            .when(up & ~blocked, F.slice(kept, F.lit(1), F.size(kept) - 1))
            .otherwise(F.concat(kept, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    rooted = F.concat(F.when(double, "//").when(absolute, "/").otherwise(""), joined)
    return F.when(rooted == "", ".").otherwise(rooted)


def parent(path: Column) -> Column:
    """The directory of a relative path, '.' at the top."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def resolve(item: Column, href: Column) -> Column:
    """The path that a reference without fragment means, seen from an item of the archive."""
    clean, d = F.substring_index(href, "#", 1), parent(item)
    return normalize(F.when((d == ".") | clean.startswith("/"), clean).otherwise(F.concat_ws("/", d, clean)))


def relative(path: Column, start: Column) -> Column:
    """A relative path seen from a relative directory, both normalised."""
    a, b = F.filter(F.split(normalize(start), "/"), lambda x: ~x.isin("", ".")), F.filter(F.split(normalize(path), "/"), lambda x: ~x.isin("", "."))
    shared = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(F.when(s["on"] & p["a"].eqNullSafe(p["b"]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & p["a"].eqNullSafe(p["b"])).alias("on")), lambda s: s["n"])
    n = F.size(b)
    out = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.greatest(n - shared, F.lit(0)))), "/")
    return F.when(out == "", ".").otherwise(out)


def host_path(path: Column, host: str) -> Column:
    """A drive path in the form of the host: 'wsl' has /mnt/c/..., 'windows' has C:\\..., others keep it."""
    if host == "wsl":
        pattern = r"^([A-Za-z]):[\\/](.*)$"
        return F.when(path.rlike(pattern), F.concat(F.lit("/mnt/"), F.lower(F.regexp_extract(path, pattern, 1)), F.lit("/"), F.replace(F.regexp_extract(path, pattern, 2), F.lit("\\"), F.lit("/")))).otherwise(path)
    if host == "windows":
        pattern = r"^/mnt/([A-Za-z])/(.*)$"
        return F.when(path.rlike(pattern), F.concat(F.upper(F.regexp_extract(path, pattern, 1)), F.lit(":\\"), F.replace(F.regexp_extract(path, pattern, 2), F.lit("/"), F.lit("\\")))).otherwise(path)
    return path


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]+$", "")


def output_name(path: Column, target: Column) -> Column:
    """stem_target.epub for an EPUB, else stem_target.docx, beside the source."""
    d = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(d, stem(path), F.lit("_"), target, F.when(suffix(path) == ".epub", ".epub").otherwise(".docx"))


def cache_name(output: Column) -> Column:
    return F.concat(output, F.lit(".cache.json"))


def report_name(output: Column) -> Column:
    d = F.regexp_extract(output, r"^(.*/)?[^/]*$", 1)
    return F.concat(d, stem(output), F.lit("_sospechosos.txt"))
