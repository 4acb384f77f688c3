"""Queries over files of formats that the tables do not hold. What each must give is stated as a table, worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import images, translate
from quire.plans import samples
from quire.plans.registry import query, sql_values
from quire.sources import docx, epub
from quire.sources import html as H


def _files(spark: SparkSession, **files: bytes) -> DataFrame:
    return spark.createDataFrame([(name, bytearray(data)) for name, data in files.items()], "path string, content binary")


def _expected(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM {sql_values(list(rows), columns)}"


_SIZES = [(120, 140), (99, 300), (300, 99)]


@query(_expected("name, width, height, small", *((f"{kind}{w}", w, h, w < 100 or h < 100) for w, h in _SIZES for kind in samples.headers(1, 1)), ("broken", None, None, True), ("empty", None, None, True), ("cut", None, None, True)))
def image_discard(spark, sf_dir):
    rows = [(f"{kind}{w}", bytearray(data)) for w, h in _SIZES for kind, data in samples.headers(w, h).items()]
    rows += [("broken", bytearray(b"no image at all")), ("empty", bytearray()), ("cut", bytearray(samples.headers(200, 200)["jpeg"][:30]))]
    seen = spark.createDataFrame(rows, "name string, content binary").withColumn("d", images.dimensions("content"))
    return seen.select("name", F.col("d.width").cast("int").alias("width"), F.col("d.height").cast("int").alias("height"), images.discard(F.col("content")).alias("small"))


@query(_expected("item_name, media, is_chapter, title, h1", ("mimetype", "", False, None, None), ("OEBPS/content.opf", "", False, None, None), ("OEBPS/x/c1.xhtml", "application/xhtml+xml", True, "First", "One"), ("OEBPS/x/c2.xhtml", "application/xhtml+xml", True, "", "Two"), ("OEBPS/x/c3.xhtml", "application/xhtml+xml", False, None, None), ("OEBPS/i/a.png", "image/png", False, None, None), ("OEBPS/s.css", "text/css", False, None, None)))
def epub_chapters(spark, sf_dir):
    entries = epub.entries(_files(spark, book=samples.BOOK))
    found = epub.chapters(entries).select("item_name", "title", "h1", F.lit(True).alias("is_chapter"))
    return entries.select(F.col("zip_name").alias("item_name"), "media").join(found, "item_name", "left").withColumn("is_chapter", F.coalesce("is_chapter", F.lit(False)))


@query(_expected("item_name, n, src, n_bytes", ("OEBPS/x/c1.xhtml", 0, "../i/a.png", len(samples.png(120, 140)))))
def epub_images(spark, sf_dir):
    entries = epub.entries(_files(spark, book=samples.BOOK))
    return epub.chapter_images(epub.chapters(entries), entries).select("item_name", "n", "src", F.octet_length("content").alias("n_bytes"))


@query(_expected("file, is_text, addresses", ("cap_01.html", True, "cap_02.html#n cap_02.html OEBPS/i/a.png"), ("cap_02.html", True, "cap_01.html#t http://e.org/x"), ("index.html", True, "cap_01.html cap_02.html"), ("manifiesto.json", True, ""), ("OEBPS/i/a.png", False, ""), ("OEBPS/s.css", False, "")))
def review_files(spark, sf_dir):
    entries = epub.entries(_files(spark, book=samples.BOOK))
    files = epub.export_review(epub.chapters(entries), entries).withColumn("is_text", F.col("file").rlike("[.](html|json)$"))
    found = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit('(?:src|href)="([^"]*)"'), F.lit(1))
    return files.select("file", "is_text", F.when(F.col("is_text"), F.array_join(found, " ")).otherwise("").alias("addresses"))


@query(_expected("item_name, addresses, has_title", ("OEBPS/x/c1.xhtml", "c2.xhtml#n c2.xhtml ../i/a.png", True), ("OEBPS/x/c2.xhtml", "c1.xhtml#t http://e.org/x", False)))
def review_round_trip(spark, sf_dir):
    entries = epub.entries(_files(spark, book=samples.BOOK))
    pages = epub.chapters(entries)
    files = epub.export_review(pages, entries).where("file like '%.html'").select("path", F.col("file").alias("archivo"), F.decode("content", "UTF-8").alias("html"))
    manifest = epub.structure.chapter_manifest(pages, ["path"]).select("path", F.col("file").alias("archivo"), "item_name")
    back = epub.import_review(manifest, files, pages.select("path", "item_name", "html"))
    found = F.regexp_extract_all("html", F.lit('(?:src|href)="([^"]*)"'), F.lit(1))
    return back.select("item_name", F.array_join(found, " ").alias("addresses"), F.col("html").contains("<title>First</title>").alias("has_title"))


@query(_expected("entry_no, zip_name, text", (0, "mimetype", "application/epub+zip"), (1, "OEBPS/content.opf", ""), (2, "OEBPS/x/c1.xhtml", ""), (3, "OEBPS/x/c2.xhtml", "ZWEI"), (4, "OEBPS/x/c3.xhtml", ""), (5, "OEBPS/i/a.png", ""), (6, "OEBPS/s.css", "p{}")))
def epub_rewrite(spark, sf_dir):
    entries = epub.entries(_files(spark, book=samples.BOOK))
    changed = epub.chapters(entries).where("item_name like '%c2.xhtml'").select("path", F.col("item_name").alias("zip_name"), F.replace("html", F.lit("Two"), F.lit("ZWEI")).alias("html"))
    again = epub.entries(epub.rebuilt(entries, changed).withColumnRenamed("epub", "content"))
    text = F.when(F.col("zip_name").endswith(".png"), "").otherwise(F.decode("content", "UTF-8"))
    return again.select("entry_no", "zip_name", F.when(text.contains("ZWEI"), "ZWEI").when(F.col("zip_name").isin("mimetype", "OEBPS/s.css"), text).otherwise("").alias("text"))


_CITED = "<p>Some said so (<a>Miller, 2001</a>, p. 12 and more</p>"


@query(_expected("page_id, paragraph", (1, _CITED), (2, '<p>UNO DOS<span role="doc-pagebreak" id="q"></span> TRES</p>'), (3, '<p>A<span role="doc-pagebreak"/> B<span role="doc-pagebreak"/> C</p>'), (4, '<p>keep <span role="doc-pagebreak"/>me</p>'), (5, '<p><b>x</b><span role="doc-pagebreak"/>Y</p>')))
def page_repair(spark, sf_dir):
    """Citations repaired, page breaks taken out and put back into translations; page 4 stays untranslated, 5 has none between texts."""
    rows = [(1, '<p>Some said so.<a role="doc-biblioref">Miller, 2001.</a>.(p. 12) and more</p>'), (2, '<p>one two <span role="doc-pagebreak" id="q"></span>three</p>'), (3, '<p>a<span role="doc-pagebreak"/> b <span role="doc-pagebreak"/>c</p>'), (4, '<p>keep <span role="doc-pagebreak"/>me</p>'), (5, '<p><b>x</b><span role="doc-pagebreak"/>y</p>')]
    pages = H.cleared(H.repaired(spark.createDataFrame(rows, "page_id int, html string")))
    words = F.create_map(*(F.lit(x) for p in (("one two three", "UNO DOS TRES"), ("a b c", "A B C"), ("y", "Y")) for x in p))
    units = H.html_units(pages).withColumn("translation", F.try_element_at(words, F.trim("text"))).where("translation is not null")
    return H.rebuild(pages, units).select("page_id", F.replace("translated_html", F.lit('<a role="doc-biblioref">'), F.lit("<a>")).alias("paragraph"))


@query(_expected("page_id, n_captions, in_figures, texts", (1, 2, 2, "p"), (2, 0, 0, "q")))
def html_captions(spark, sf_dir):
    pages = spark.createDataFrame([(1, '<div><p>p<img src="a"></p><figure><img src="b"/></figure></div>'), (2, '<div>q<img src="c"></div>')], "page_id int, html string")
    captions = spark.createDataFrame([(1, "a", "A&"), (1, "b", "B"), (2, "none", "N"), (2, "c", None)], "page_id int, src string, translation string")
    out = H.captioned(pages, captions)
    texts = H.html_units(out).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("texts"))
    count = lambda p: F.regexp_count("html", F.lit(p)).alias
    return out.join(texts, "page_id").select("page_id", count("<figcaption")("n_captions"), count("</figcaption></figure>")("in_figures"), "texts")


@query(_expected("page_id, texts", (1, "yes|one|two"), (2, ""), (3, "a<b|é")))
def html_skipped(spark, sf_dir):
    skipped = "".join(f"<{t}>no</{t}>" for t in ("script", "style", "code", "pre", "kbd", "samp", "var", "math", "svg"))
    rows = [(1, f"<html><head><title>no</title></head><body><p>yes</p>{skipped}<mml:math>no</mml:math><a role='doc-biblioref'>no</a><p data-translated-caption='1'>no</p><ul><li>one<li>two</ul></body></html>"), (2, "no element"), (3, "<p>a&lt;b</p><!-- no --><p> </p><p>&eacute;</p>")]
    units = H.html_units(spark.createDataFrame(rows, "page_id int, html string")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("u"))
    return spark.range(1, 4).select(F.col("id").cast("int").alias("page_id")).join(units, "page_id", "left").select("page_id", F.coalesce(F.array_join("u.text", "|"), F.lit("")).alias("texts"))


@query(_expected("pos, container, text, links, notes", (0, "body", "Plain start bold part plain end", "", ""), (1, "body", "See ⟦1⟧ and ⟦2⟧", "1=http://e.org/a", "2=footnote 4"), (2, "body", "A line that was", "", ""), (3, "body", "cut in two.", "", ""), (6, "body/t0r0c0", "In a cell", "", ""), (7, "body/t0r0c0/t0r0c0", "deeper", "", "")))
def docx_units(spark, sf_dir):
    join = lambda c, x: F.array_join(F.transform(F.map_entries(c), x), ";")
    return docx.units(_files(spark, letter=samples.LETTER)).select("pos", "container", "text", join("links", lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]["url"])).alias("links"), join("notes", lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]["kind"], F.lit(" "), e["value"]["note_id"])).alias("notes"))


@query(_expected("pos, n_bytes, width_emu, align", (4, len(samples.png(150, 120)), 914400, "right")))
def docx_images(spark, sf_dir):
    return docx.images(_files(spark, letter=samples.LETTER)).select("pos", F.octet_length("content").alias("n_bytes"), F.col("width_emu").cast("int").alias("width_emu"), "align")


@query(_expected("unit, pos, text, run_idx", (0, 0, "Plain start", "0"), (1, 0, "bold part", "1"), (2, 0, "plain end", "3"), (3, 1, "See ⟦1⟧ and ⟦2⟧", None), (4, 2, "A line that was cut in two.", None), (5, 5, "In a cell", None), (6, 6, "deeper", None)))
def docx_formats(spark, sf_dir):
    """Paragraphs merged in the file, then cut where their format changes."""
    files = docx.merged(_files(spark, letter=samples.LETTER))
    return docx.formatted(docx.units(files)).select("unit", "pos", "text", F.array_join(F.col("run_idx").cast("array<string>"), ",").alias("run_idx"))


@query(_expected("pos, text, links, n_runs, fallbacks, captions", (0, "Llano fuerte final", 0, 4, 1, 1), (1, "Ver ⟦1⟧ y ⟦2⟧", 1, 3, 1, 1), (2, "A line that was", 0, 1, 1, 1), (3, "cut in two.", 0, 1, 1, 1), (5, "pie", 0, 1, 1, 1), (7, "In a cell", 0, 1, 1, 1), (8, "hondo", 0, 1, 1, 1)))
def docx_apply(spark, sf_dir):
    """Translations by run and by paragraph put in place: one rebuilt with its link and note, one that broke its tokens left, a caption."""
    files = _files(spark, letter=samples.LETTER)
    rows = [("letter", 0, "Llano ", [0]), ("letter", 0, "fuerte ⟦1⟧", [1]), ("letter", 0, "final", [3]), ("letter", 1, "Ver ⟦1⟧ y ⟦2⟧", None), ("letter", 7, "hondo", None), ("letter", 1, "Ver ⟦1⟧", None)]
    done = spark.createDataFrame(rows, "path string, pos int, translation string, run_idx array<int>")
    captions = spark.createDataFrame([("letter", 4, 0, "pie")], "path string, pos int, n int, translation string")
    out = docx.rewritten(files, done, captions, ("Georgia", 12))
    counts = out.select("path", "fallbacks", "captions")
    units = docx.units(out.select("path", F.col("docx").alias("content")))
    joined = F.array_join(F.filter("runs.text", lambda t: F.trim(t) != ""), " ")
    text = F.when(F.size("links") == 0, F.regexp_replace(joined, " +", " ")).otherwise(F.col("text"))
    return units.join(counts, "path").select("pos", text.alias("text"), F.size("links").alias("links"), F.size("runs").alias("n_runs"), F.col("fallbacks").cast("int").alias("fallbacks"), F.col("captions").cast("int").alias("captions"))


@query(_expected("signature, n_runs", ('<w:b/><w:rFonts w:ascii="Georgia" w:hAnsi="Georgia"/><w:sz w:val="24"/>', 1), ('<w:rFonts w:ascii="Georgia" w:hAnsi="Georgia"/><w:sz w:val="24"/>', 10)))
def docx_font(spark, sf_dir):
    out = docx.rewritten(_files(spark, letter=samples.LETTER), spark.createDataFrame([], "path string, pos int, translation string, run_idx array<int>"), None, ("Georgia", 12))
    runs = docx.units(out.select("path", F.col("docx").alias("content"))).select(F.explode("runs").alias("r"))
    form = F.regexp_replace(F.regexp_replace("r.signature", "</?w:rPr[^>]*>", ""), " />", "/>")
    return runs.groupBy(form.alias("signature")).agg(F.count("*").cast("int").alias("n_runs"))


_READ = {"text": "uno\nuno\ndos", "loop": "la\n" * 9, "blank": "  "}


@query(_expected("name, status, translation", ("a", "text", "uno\ndos"), ("b", "none", None), ("c", "none", None), ("d", "error", None), ("e", "small", None), ("f", "small", None), ("g", "text", "uno\ndos")))
def image_texts(spark, sf_dir):
    return _read_images(spark).select("name", "status", "translation")


@query(_expected("n_images, with_text, without_text, errors", (7, 2, 4, 1)))
def image_counts(spark, sf_dir):
    counts = images.image_counts(_read_images(spark).withColumn("one", F.lit(7)), ["one"])
    return counts.select(F.col("one").alias("n_images"), *(F.col(c).cast("int").alias(c) for c in ("with_text", "without_text", "errors")))


def _read_images(spark: SparkSession) -> DataFrame:
    def seen(content: bytes) -> str:
        kind = {101: "text", 102: "loop", 103: "blank"}[content[19]]  # by the width in the header; others fail
        return _READ[kind]

    sizes = {"a": (101, 100), "b": (102, 100), "c": (103, 100), "d": (104, 100), "e": (99, 100), "g": (101, 100)}
    rows = [(n, bytearray(samples.png(*s))) for n, s in sizes.items()] + [("f", bytearray(b"broken"))]
    read = translate.image_reader(translate.Stub(seen=seen), ("English", "Spanish"))
    return images.translate_images(spark.createDataFrame(rows, "name string, content binary"), read, slots=2)
