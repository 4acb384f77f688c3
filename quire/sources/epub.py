"""EPUB archives: entries, chapters, writing with changed chapters only, and review folders."""

from __future__ import annotations

import html as entities
import io
import json
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators import structure
from quire.sources import html as H
from quire.sources.files import read_files

#: An EPUB's first entry, and the media types of chapters.
MIME = b"application/epub+zip"
DOCUMENTS = ("application/xhtml+xml", "text/html")
MANIFEST = "manifiesto.json"
ENTRY = "path string, zip_name string, media string, entry_no int, content binary"


def entries_of(data: bytes) -> list[tuple[str, str, bytes]]:
    """(name, media type or '', bytes) of an archive's files in order; media types come from the package document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        media: dict[str, str] = {}
        for name in z.namelist():
            if name.lower().endswith(".opf"):
                base = posixpath.dirname(name)
                for item in ElementTree.fromstring(z.read(name)).iter("{http://www.idpf.org/2007/opf}item"):
                    media[posixpath.normpath(posixpath.join(base, item.get("href", "")))] = item.get("media-type", "")
        return [(n, media.get(n, ""), z.read(n)) for n in z.namelist() if not n.endswith("/")]


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, zip_name, media, entry_no, content) of the entries of all EPUB files under a path."""
    return entries(read_files(spark, path, ".epub"))


def entries(files: DataFrame) -> DataFrame:
    """The entries of EPUB files (path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = entries_of(bytes(row.content))
                yield pd.DataFrame({"path": row.path, "zip_name": [n for n, _, _ in found], "media": [m for _, m, _ in found], "entry_no": range(len(found)), "content": [c for _, _, c in found]})

    return files.select("path", "content").mapInPandas(run, ENTRY)


def chapters(entries: DataFrame) -> DataFrame:
    """(path, item_name, html, title, h1, pos) of the entries that are documents and have text."""
    is_doc = F.col("media").isin(*DOCUMENTS) | ((F.col("media") == "") & F.lower("zip_name").rlike(r"\.x?html?$"))

    @F.pandas_udf("html string, title string, h1 string, n int")
    def look(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            pieces = H.parse(bytes(c))
            title, h1 = H.title_of(pieces)
            rows.append((bytes(c).decode("utf-8", "replace"), title, h1, len(H.text_nodes(pieces))))
        return pd.DataFrame(rows, columns=["html", "title", "h1", "n"])

    seen = entries.where(is_doc).select("path", F.col("zip_name").alias("item_name"), F.col("entry_no").alias("pos"), look("content").alias("x"))
    return seen.where("x.n > 0").select("path", "item_name", "pos", "x.html", "x.title", "x.h1")


def build(entries: list[tuple[str, bytes]], changed: dict[str, bytes]) -> bytes:
    """An archive with the given files, some replaced; the media type comes first, stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        first = zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0))
        first.compress_type = zipfile.ZIP_STORED
        z.writestr(first, MIME)
        for name, content in entries:
            if name != "mimetype":
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, changed.get(name, content))
    return out.getvalue()


def rebuilt(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, epub): each archive with the chapters of changed (path, zip_name, html) in place of its own.

    An archive is built from all its entries in one group; archives bound that group's size.
    """
    new = changed.select("path", "zip_name", F.col("html").alias("_new"))
    merged = entries.join(new, ["path", "zip_name"], "left").select("path", "entry_no", "zip_name", "content", "_new")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry_no")
        new = {n: H.to_xhtml(x).encode() for n, x in zip(rows["zip_name"], rows["_new"], strict=True) if isinstance(x, str)}
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "epub": [build([(n, bytes(c)) for n, c in zip(rows["zip_name"], rows["content"], strict=True)], new)]})

    return merged.groupBy("path").applyInPandas(one, "path string, epub binary")


def resources(entries: DataFrame) -> DataFrame:
    """Entries that pages refer to: images, styles and fonts."""
    return entries.where(F.col("media").rlike(r"^(image/|font/|text/css|application/(x-font|font|vnd\.ms-opentype))"))


def chapter_images(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, item_name, n, src, content) of the images of chapters, by a join on resolved paths; missing ones are left out."""
    images = H.image_sources(found, ["path", "item_name"]).withColumn("zip_name", paths.resolve(F.col("item_name"), F.col("src")))
    return images.join(entries.select("path", "zip_name", "content"), ["path", "zip_name"]).drop("zip_name")


def export_review(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, file, content): numbered pages with addresses that work in one folder, their resources, the manifest and an index."""
    numbered = structure.chapter_manifest(found, ["path"]).join(found.select("path", "item_name", "html"), ["path", "item_name"])
    names = numbered.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("item_name", "file"))).alias("names"))

    @F.pandas_udf("binary")
    def page(html: pd.Series, item: pd.Series, names: pd.Series) -> pd.Series:
        def one(text: str, name: str, files: dict) -> bytes:
            base = posixpath.dirname(name)

            def change(url: str) -> str:
                if not url or url.startswith(paths.KEPT):
                    return url
                path, mark, fragment = url.partition("#")
                target = posixpath.normpath(posixpath.join(base, path))
                return files.get(target, target) + (mark + fragment if fragment else "")

            return H.to_xhtml(H.map_urls(text, change)).encode()

        return pd.Series([one(t, i, dict(n)) for t, i, n in zip(html, item, names, strict=True)])

    pages = numbered.join(names, "path").select("path", "file", page("html", "item_name", "names").alias("content"))

    def about(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("file")
        made = review_files(posixpath.basename(rows["path"].iloc[0]), [{"archivo": f, "item_name": i, "titulo": t} for f, i, t in zip(rows["file"], rows["item_name"], rows["title"], strict=True)])
        return pd.DataFrame({"path": rows["path"].iloc[0], "file": list(made), "content": [x.encode() for x in made.values()]})

    index = numbered.select("path", "file", "item_name", "title").groupBy("path").applyInPandas(about, "path string, file string, content binary")
    return pages.unionByName(index).unionByName(resources(entries).select("path", F.col("zip_name").alias("file"), "content"))


def review_files(title: str, manifest: list[dict]) -> dict[str, str]:
    """The manifest and the index page of a review folder. The manifest's names and the index's words are fixed values."""
    links = "\n".join(f'    <li><a href="{m["archivo"]}">{entities.escape(m["titulo"])}</a></li>' for m in manifest)
    safe = entities.escape(title)
    index = f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'/><title>Revisión — {safe}</title></head><body>\n<h1>Revisión: {safe}</h1>\n<p>{len(manifest)} capítulos traducidos</p>\n<ol>\n{links}\n</ol>\n</body></html>"
    return {MANIFEST: json.dumps(manifest, ensure_ascii=False, indent=2), "index.html": index}


def with_body(original: str, reviewed: str) -> str:
    """The original page with the reviewed page's body; head and the body's attributes stay. Without a body in either: the reviewed one."""

    def span(pieces: list[H.Piece]) -> tuple[int, int] | None:
        start = next((i for i, p in enumerate(pieces) if p.kind == "open" and p.name == "body"), None)
        if start is None:
            return None
        return start, next((i for i in range(len(pieces) - 1, start, -1) if pieces[i].kind == "close" and pieces[i].name == "body"), len(pieces))

    a, b = H.parse(original), H.parse(reviewed)
    x, y = span(a), span(b)
    if not (x and y):
        return H.to_xhtml(reviewed)
    return H.to_xhtml(H.serialize(a[: x[0] + 1]) + H.serialize(b[y[0] + 1 : y[1]]) + H.serialize(a[x[1] :]))


def restored(page: str, item: str, files: dict[str, str]) -> str:
    """A reviewed page with the addresses that its item had: files maps a review folder's pages to items."""
    base = posixpath.dirname(item)

    def change(url: str) -> str:
        if not url or url.startswith(paths.KEPT):
            return url
        path, mark, fragment = url.partition("#")
        target = files.get(path, path)
        return (posixpath.relpath(target, base) if base else target) + (mark + fragment if fragment else "")

    return H.map_urls(page, change)


def read_review(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, files) of a review folder for import_review; FileNotFoundError without a manifest. Rows belong to the path ''."""
    files = read_files(spark, folder, ".html", ".json").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("archivo"), F.decode("content", "UTF-8").alias("html"), F.lit("").alias("path"))
    found = files.where(F.col("archivo") == MANIFEST).select("html").collect()  # one file, or none
    if not found:
        raise FileNotFoundError(f"{folder} holds no {MANIFEST}: it is no review folder")
    rows = [("", x["archivo"], x["item_name"]) for x in json.loads(found[0].html)]
    return spark.createDataFrame(rows, "path string, archivo string, item_name string"), files.where(F.col("archivo") != MANIFEST)


def import_review(manifest: DataFrame, files: DataFrame, originals: DataFrame) -> DataFrame:
    """(path, item_name, html) from manifest (path, archivo, item_name), files (path, archivo, html) and originals (path, item_name, html).

    Addresses become those of the archive again, and the reviewed body goes into the original page. Chapters whose file is missing are
    left out; one whose original is missing is taken as it was reviewed.
    """
    names = manifest.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("archivo", "item_name"))).alias("_names"))
    found = manifest.join(files.withColumnRenamed("html", "_reviewed"), ["path", "archivo"]).join(originals.withColumnRenamed("html", "_original"), ["path", "item_name"], "left").join(names, "path")

    @F.pandas_udf("string")
    def merge(original: pd.Series, reviewed: pd.Series, item: pd.Series, names: pd.Series) -> pd.Series:
        pages = [restored(r, i, dict(n)) for r, i, n in zip(reviewed, item, names, strict=True)]
        return pd.Series([with_body(o, r) if isinstance(o, str) else H.to_xhtml(r) for o, r in zip(original, pages, strict=True)])

    return found.select("path", "item_name", merge("_original", "_reviewed", "item_name", "_names").alias("html"))
