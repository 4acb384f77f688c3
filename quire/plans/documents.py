"""Whole runs over files: options, early checks, and the dataflow of each format."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import paths
from quire.functions.languages import NAMES
from quire.operators import images, regroup, translate
from quire.sources import convert, docx, epub
from quire.sources import html as H
from quire.sources.files import read_files, write_files

#: Suffixes of image files beside HTML pages.
IMAGES = (".png", ".gif", ".bmp", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")


@dataclass(frozen=True)
class Options:
    """limit cuts each document to its first units; font is a name and a size in points; merge joins paragraphs cut by line breaks;
    images has the text in images read and put below them; tools names converters for formats that are converted first."""

    source: str = "en"
    target: str = "es"
    limit: int | None = None
    font: tuple[str, int] | None = None
    merge: bool = False
    images: bool = False
    slots: int = 8
    cache_path: str | None = None
    reset_cache: bool = False
    tools: dict[str, str] | None = None

    def check(self, path: str) -> str:
        """The format's route; raises before any job if the run cannot work."""
        for code in (self.source, self.target):
            if code not in NAMES:
                raise ValueError(f"unknown language {code!r}; known: {', '.join(NAMES)}")
        if self.source == self.target:
            raise ValueError("source and target are the same language")
        if self.limit is not None and self.limit < 1:
            raise ValueError("the limit must be 1 or more")
        found = path.lower().rsplit("/", 1)[-1].rpartition(".")
        suffix = "." + found[2]
        if not found[0] or suffix not in paths.SUFFIXES:
            raise ValueError(f"{path} has none of the suffixes {', '.join(paths.SUFFIXES)}")
        return {".epub": "epub", ".html": "html", ".htm": "html", ".docx": "docx"}.get(suffix, "convert")

    @property
    def names(self) -> tuple[str, str]:
        return NAMES[self.source][0], NAMES[self.target][0]


def _translated(units: DataFrame, options: Options, provider: translate.Provider, pos: str = "pos") -> DataFrame:
    provider.ensure_ready()
    spark, cache = units.sparkSession, None
    if options.cache_path and not options.reset_cache:
        try:
            cache = spark.read.schema("chunk_hash string, translation string").parquet(options.cache_path)
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    kept = units if options.limit is None else regroup.first_units(units, options.limit, pos)
    done, fresh = translate.translate_units(kept, cache, provider, options.source, options.target, options.names, options.slots)
    done = done.checkpoint()
    if options.cache_path:
        fresh.write.mode("overwrite" if options.reset_cache else "append").parquet(options.cache_path)
    return done


def _captions(found: DataFrame, options: Options, provider: translate.Provider) -> DataFrame:
    """The rows of images whose text was read, with its translation."""
    return images.translate_images(found, translate.image_reader(provider, options.names), options.slots).where("status = 'text'")


def translate_pages(pages: DataFrame, options: Options, provider: translate.Provider, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pages with translated_html, units with translations and checks). Citations are repaired first; page breaks leave the texts and
    come back after them."""
    ready = H.cleared(H.repaired(pages, key)).checkpoint()
    done = _translated(H.html_units(ready, key), options, provider)
    return H.rebuild(ready, done.where("status = 'ok'").select(key, "node", "text", "translation"), key), done


def translate_epubs(spark: SparkSession, path: str, options: Options, provider: translate.Provider) -> tuple[DataFrame, DataFrame]:
    """((path, epub), units): every archive under a path with its chapters translated; other entries are copied through."""
    entries = epub.read_epubs(spark, path).checkpoint()
    pages = epub.chapters(entries).withColumn("_key", F.concat_ws("\x1f", "path", "item_name"))
    out, done = translate_pages(pages, options, provider, "_key")
    if options.images:
        found = _captions(epub.chapter_images(pages, entries), options, provider).withColumn("_key", F.concat_ws("\x1f", "path", "item_name"))
        out = H.captioned(out, found.select("_key", "src", "translation"), "_key", "translated_html")
    changed = out.select("path", F.col("item_name").alias("zip_name"), F.col("translated_html").alias("html"))
    return epub.rebuilt(entries, changed), done


def translate_html(spark: SparkSession, path: str, options: Options, provider: translate.Provider) -> tuple[DataFrame, DataFrame]:
    """((path, html, docx, error), units): HTML files under a path, translated, images kept inside a page; docx is the converter's
    output where options.tools names one, else null."""
    files = read_files(spark, path, ".html", ".htm").select("path", F.decode("content", "UTF-8").alias("html"))
    out, done = translate_pages(files, options, provider, "path")
    if options.images:
        sources = H.image_sources(files, ["path"])
        # Every page's images lie beside it; the files under the folder are joined by path, none is opened by name.
        seen = read_files(spark, path, *IMAGES).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("_file"), "content")
        beside = sources.withColumn("_file", paths.resolve(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.col("src"))).join(seen, "_file")
        out = H.captioned(out, _captions(beside, options, provider).select("path", "src", "translation"), "path", "translated_html")

    @F.pandas_udf("string")
    def styled(pages: pd.Series) -> pd.Series:
        return pages.map(H.with_image_style)

    out = out.select("path", styled("translated_html").alias("html"))
    if options.tools is None:
        return out.withColumns({"docx": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}), done
    made = convert.converted(out.select("path", F.encode("html", "UTF-8").alias("content")), options.tools)
    return out.join(made.withColumnRenamed("content", "docx"), "path"), done


def translate_docx(spark: SparkSession, path: str, options: Options, provider: translate.Provider) -> tuple[DataFrame, DataFrame]:
    """((path, docx, fallbacks, captions), units). Where options.tools names converters, files of other formats are converted first."""
    if options.tools is None:
        files = read_files(spark, path, ".docx")
    else:
        files = convert.converted(read_files(spark, path, *(x for x in paths.SUFFIXES if x not in (".epub", ".html", ".htm"))), options.tools).where("content is not null")
    files = files.checkpoint()
    if options.merge:
        files = docx.merged(files).checkpoint()
    units = docx.formatted(docx.units(files))
    done = _translated(units, options, provider, "unit")
    captions = None
    if options.images:
        number = F.row_number().over(Window.partitionBy("path").orderBy("pos", "image_hash")) - 1
        captions = _captions(docx.images(files), options, provider).select("path", "pos", number.alias("n"), "translation")
    return docx.rewritten(files, done.where("status = 'ok'").select("path", "pos", "translation", "run_idx"), captions, options.font), done


def _numbered(done: DataFrame, path: str) -> DataFrame:
    """done with its document as ``path`` and ``chunk``, the number from 1 of a unit in its document."""
    order = [c for c in ("_key", "unit", "pos") if c in done.columns]
    return done.withColumn("path", F.col(path)).withColumn("chunk", F.row_number().over(Window.partitionBy("path").orderBy(*order)))


def outcome(done: DataFrame, target: str, path: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, failures, report): counts by document, numbers of failed units, and the report's lines with the name of their file."""
    rows = _numbered(done, path)
    title = paths.output_name(F.col("path"), F.lit(target))
    lines = translate.report(translate.suspicious(rows, F.col("chunk"), extra=("path",)), ["path"], F.regexp_extract(title, "([^/]*)$", 1))
    failed = rows.where("status = 'error'").select("path", "chunk")
    return translate.summary(rows, ["path"]), failed, lines.withColumn("file", paths.report_name(title))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def run(spark: SparkSession, path: str, kind: str, options: Options, provider: translate.Provider, folder: str) -> DataFrame:
    """Translates the files of a kind (epub, docx or html) under a path into a folder: outputs, reports of suspicious units, and the tables
    ``_summary`` and ``_failures``. Returns (name, n_bytes) of what was written."""
    out, done = {"epub": translate_epubs, "docx": translate_docx, "html": translate_html}[kind](spark, path, options, provider)
    if "path" not in done.columns:
        done = done.withColumn("path", F.substring_index("_key", "\x1f", 1))
    content = F.coalesce("docx", F.encode("html", "UTF-8")) if kind == "html" else F.col(kind)
    name = _name(paths.output_name(F.col("path"), F.lit(options.target)))
    if kind == "html":
        name = F.when(F.col("docx").isNull(), F.regexp_replace(name, r"\.docx$", ".html")).otherwise(name)
    counts, failed, lines = outcome(done, options.target)
    counts.write.mode("overwrite").parquet(f"{folder}/_summary")
    failed.write.mode("overwrite").parquet(f"{folder}/_failures")
    # A report is at most its document's units, which one group holds as it did when they were packed.
    reports = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("section", "chunk", "entry"))).alias("u")).select(_name(F.col("file")).alias("name"), F.encode(F.array_join("u.entry", "\n"), "UTF-8").alias("content"))
    return write_files(out.select(name.alias("name"), content.alias("content")).unionByName(reports), folder)


def export_review(spark: SparkSession, path: str, options: Options, provider: translate.Provider, folder: str) -> DataFrame:
    """Writes the review folder of one translated EPUB: numbered pages, resources, manifest and index."""
    books, _ = translate_epubs(spark, path, options, provider)
    entries = epub.entries(books.withColumnRenamed("epub", "content")).checkpoint()
    return write_files(epub.export_review(epub.chapters(entries), entries).select(F.col("file").alias("name"), "content"), folder)


def import_review(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(path, epub): the EPUB at a path with the chapters of a reviewed folder."""
    manifest, files = epub.read_review(spark, folder)
    entries = epub.read_epubs(spark, path).checkpoint()
    books = [r.path for r in entries.select("path").distinct().limit(2).collect()]
    if len(books) != 1:
        raise ValueError(f"{path} must hold one EPUB, which the review folder belongs to")
    originals = epub.chapters(entries).select("path", "item_name", "html")
    changed = epub.import_review(manifest.withColumn("path", F.lit(books[0])), files.withColumn("path", F.lit(books[0])), originals)
    return epub.rebuilt(entries, changed.withColumnRenamed("item_name", "zip_name"))
