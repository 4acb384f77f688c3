import io
import zipfile

from pyspark.sql import functions as F

from quire.operators import translate
from quire.sources import docx, epub
from quire.sources import html as H

PAGE = '<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style></head><body><!-- c --><h1>One</h1><p> Hi <b>there</b>&copy;<br>x &lt; y</p><pre>no</pre><a role="doc-biblioref">Cite</a><img src="a.png"><p>end'


def texts(page):
    pieces = H.parse(page)
    return [pieces[i].text for i in H.text_nodes(pieces)]


def test_html_nodes_and_round_trip():
    assert texts(PAGE) == ["One", " Hi ", "there", "©", "x < y", "end"]
    assert H.serialize(H.parse(PAGE)) == PAGE
    pieces = H.parse(PAGE)
    nodes = H.text_nodes(pieces)
    out = H.apply(pieces, {nodes[1]: " Hola ", nodes[4]: "x < z", nodes[5]: "end"}, {nodes[4]: [(1, "<i/>")]})
    assert "<p> Hola <b>" in out and "x<i/> &lt; z" in out and out.endswith("<p>end")
    assert H.title_of(pieces) == ("T & t", "One")
    assert len(H.text_nodes(pieces, comments=True)) == 7


def test_html_quirks():
    assert texts("") == [] and texts("plain") == [] and texts("<p>a < b</p>") == ["a < b"]
    assert texts('<p title="a>b">x</p>') == ["x"] and texts("<script>var t='</p>';</script><p>y</p>") == ["y"] and texts("<mml:math>q</mml:math><p>z</p>") == ["z"]
    x = H.to_xhtml("<html><body><br><img src='a'/></body></html>")
    assert x.startswith("<?xml") and "<br/>" in x and 'xmlns="http://www.w3.org/1999/xhtml"' in x and "<img src='a'/>" in x


def test_references_without_semicolon():
    raw = "a&amp &amp; &ampx; &amp;lt; &#65; &#65 &#x42; &nosuch; &copy"
    assert H.unescape(raw) == "a& & &x; &lt; A A B &nosuch; ©"
    assert H.unescape(raw, closed=True) == "a&amp & &ampx; &lt; A &#65 B &nosuch; &copy"
    pieces = H.parse(f"<p>{raw}</p>", closed=True)
    assert pieces[1].text == H.unescape(raw, closed=True) and H.serialize(pieces) == f"<p>{raw}</p>"
    again = H.parse(H.apply(pieces, {1: pieces[1].text}), closed=True)
    assert again[1].text == pieces[1].text


def test_captions():
    out, n = H.with_captions('<p><img src="a"></p><figure><img src="b"/></figure><img src="c">', {"a": "A&", "b": "B"})
    assert n == 2 and out.count("<figcaption") == 2 and 'B</figcaption></figure><img src="c">' in out and "A&amp;</figcaption></figure></p>" in out
    assert texts(f"<div>{out}</div>") == []


def test_html_units_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    units = H.html_units(pages)
    native = sum(len(texts(r.html)) for r in pages.collect())
    assert units.count() == native
    back = H.rebuild(pages, units.withColumn("translation", F.upper(F.trim("text"))))
    row = back.first()
    assert [t.strip().upper() for t in texts(row.html)] == [t.strip() for t in texts(row.translated_html)]


def make_epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="x/c1.xhtml" media-type="application/xhtml+xml"/><item href="x/c2.xhtml" media-type="application/xhtml+xml"/><item href="s.css" media-type="text/css"/></manifest></package>')
        z.writestr("OEBPS/x/c1.xhtml", "<html><head><title>Uno</title></head><body id='b'><p>Hello</p></body></html>")
        z.writestr("OEBPS/x/c2.xhtml", "<html><body></body></html>")
        z.writestr("OEBPS/s.css", "p{}")
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(make_epub())
    entries = epub.read_epubs(spark, str(tmp_path))
    found = epub.chapters(entries)
    assert [(r.item_name, r.title) for r in found.collect()] == [("OEBPS/x/c1.xhtml", "Uno")]
    changed = found.select("path", F.col("item_name").alias("zip_name"), F.replace("html", F.lit("Hello"), F.lit("Hola")).alias("html"))
    with zipfile.ZipFile(io.BytesIO(bytes(epub.rebuilt(entries, changed).first().epub))) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert b"Hola" in z.read("OEBPS/x/c1.xhtml") and z.read("OEBPS/s.css") == b"p{}" and len(z.namelist()) == 5


def test_review(spark):
    files = epub.review_files("L", [{"archivo": "cap_01.html", "item_name": "x", "titulo": "T"}])
    assert '<a href="cap_01.html">T</a>' in files["index.html"] and "manifiesto.json" in files
    manifest = spark.createDataFrame([("p", "cap_01.html", "x"), ("p", "cap_02.html", "y")], "path string, archivo string, item_name string")
    got = epub.import_review(manifest, spark.createDataFrame([("p", "cap_01.html", "<html><body><p>new</p></body></html>")], "path string, archivo string, html string"), spark.createDataFrame([("p", "x", "<html><head><title>k</title></head><body id='b'><p>old</p></body></html>")], "path string, item_name string, html string")).collect()
    assert len(got) == 1 and "<title>k</title>" in got[0].html and "<body id='b'><p>new</p></body>" in got[0].html


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_docx():
    body = (
        "<w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p>"
        '<w:p><w:r><w:t xml:space="preserve">See </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t xml:space="preserve"> and </w:t></w:r><w:r><w:footnoteReference w:id="4"/></w:r></w:p>'
        "<w:p><w:r><w:drawing/></w:r><w:r><w:t>with image</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="http://e.org"/></Relationships>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "d.docx").write_bytes(make_docx())
    units = {r.pos: r for r in docx.read_docx(spark, str(tmp_path)).collect()}
    assert [units[k].text for k in sorted(units)] == ["Plain bold", "See ⟦1⟧ and ⟦2⟧", "cell"]
    assert units[1].links[1].url == "http://e.org" and units[1].links[1].text == "link" and units[1].notes[2].note_id == "4"
    assert len({r.signature for r in units[0].runs}) == 2
    data, counts = docx.rewrite(make_docx(), [(0, "Llano ⟦3⟧  x", None), (1, "Ver ⟦1⟧ y ⟦2⟧.", None), (4, "celda", None)], captions={2: ["pie"]}, font=("Bookman Old Style", 11))
    again = docx.units_of(data)
    assert [u["text"] for u in again if u["text"] != "pie"] == ["Llano x", "Ver ⟦1⟧ y ⟦2⟧.", "celda"] and "pie" in [u["text"] for u in again]
    assert counts == {"keep": 0, "fallback": 0, "rebuild": 1, "plain": 2, "caption": 1}
    assert docx.rewrite(make_docx(), [(1, "Ver ⟦1⟧", None)])[1]["fallback"] == 1


def test_translation_with_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def reply(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no")
        return text[::-1]

    units = spark.createDataFrame([(1, 0, "abc"), (1, 1, "abc"), (2, 0, "old"), (2, 1, "bad")], "doc_id int, pos int, text string")
    stub = translate.Stub(reply)
    cache = spark.createDataFrame([("old",)], "t string").select(translate.cache_key(F.col("t"), "stub", "en", "es").alias("chunk_hash"), F.lit("viejo...").alias("translation"))
    done, fresh = translate.translate_units(units, cache, stub, "en", "es", ("English", "Spanish"), slots=2, retry_pause=0, call_pause=0)
    rows = {(r.doc_id, r.pos): r for r in done.collect()}
    assert rows[1, 0].translation == rows[1, 1].translation == "cba" and not rows[1, 0].from_cache
    assert rows[2, 0].from_cache and rows[2, 0].translation == "viejo..." and len(rows[2, 0].anomalies) == 1
    assert rows[2, 1].status == "error" and rows[2, 1].attempts == 3 and rows[2, 1].translation is None
    assert [r.translation for r in fresh.collect()] == ["cba"]
    assert calls.value == 4  # one for the distinct text, three attempts for the failing one


def test_streamed_cache(spark, tmp_path):
    from quire.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("uno dos\n\nuno dos\n")
    run = lambda: ingest.fill_cache(ingest.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "chk"), translate.Stub(), "es", "en", ("Spanish", "English")).awaitTermination()
    run()
    (tmp_path / "in/b.txt").write_text("uno dos\ntres cuatro\n")
    run()
    assert sorted(r.translation for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["cuatro tres", "dos uno"]


def test_runs_over_files(spark, tmp_path):
    import pytest

    from quire.plans.documents import Options, translate_docx, translate_epubs, translate_pages

    options, stub = Options(slots=2, cache_path=str(tmp_path / "cache")), translate.Stub(str.upper)
    assert options.check("/a/b.PDF") == "convert" and options.check("x.htm") == "html"
    for bad, path in ((Options("xx", "es"), "a.epub"), (Options("es", "es"), "a.epub"), (Options(limit=0), "a.epub"), (Options(), "a.txt"), (Options(), "docx")):
        with pytest.raises(ValueError):
            bad.check(path)
    pages, done = translate_pages(spark.createDataFrame([(1, PAGE)], "page_id int, html string"), options, stub)
    assert "<p> HI <b>THERE</b>" in pages.first().translated_html and done.where("from_cache").count() == 0
    again, done = translate_pages(spark.createDataFrame([(1, PAGE)], "page_id int, html string"), options, translate.Stub(lambda t: 1 / 0))
    assert done.where("from_cache").count() == done.count() == 6 and "<p> HI <b>" in again.first().translated_html
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.epub").write_bytes(make_epub())
    (tmp_path / "in/d.docx").write_bytes(make_docx())
    books, _ = translate_epubs(spark, str(tmp_path / "in"), Options(slots=2), stub)
    with zipfile.ZipFile(io.BytesIO(bytes(books.first().epub))) as z:
        assert b"<p>HELLO</p>" in z.read("OEBPS/x/c1.xhtml")
    files, done = translate_docx(spark, str(tmp_path / "in"), Options(slots=2, limit=1), stub)
    assert [u["text"] for u in docx.units_of(bytes(files.first().docx))] == ["PLAINbold", "See ⟦1⟧ and ⟦2⟧", "cell"] and done.count() == 1
    files, done = translate_docx(spark, str(tmp_path / "in"), Options(slots=2), stub)
    runs = docx.units_of(bytes(files.first().docx))[0]["runs"]
    assert [r["text"] for r in runs] == ["PLAIN", "BOLD"] and runs[1]["signature"] != runs[0]["signature"]

    class Gone(translate.Stub):
        def ensure_ready(self):
            raise LookupError("no model")

    with pytest.raises(LookupError):
        translate_docx(spark, str(tmp_path / "in"), Options(slots=2), Gone())


def test_whole_run_of_an_epub(spark, tmp_path):
    from quire.plans import samples
    from quire.plans.documents import Options, export_review, import_review, run

    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.epub").write_bytes(samples.BOOK)
    stub = translate.Stub(lambda t: t.upper() + ("..." if t == "Two" else ""), lambda content: "READ")
    names = {r.name for r in run(spark, str(tmp_path / "in"), "epub", Options(slots=2, images=True), stub, str(tmp_path / "out")).collect()}
    assert names == {"book_es.epub", "book_es_sospechosos.txt"}
    with zipfile.ZipFile(tmp_path / "out/book_es.epub") as z:
        page = z.read("OEBPS/x/c1.xhtml").decode()
        assert "SOME SAID SO (<a" in page and ">Miller, 2001</a>, P. 12 AND MORE</p>" in page and "A PAGE THAT<span" in page and "</span> ENDS HERE" in page and ">READ</figcaption>" in page
        assert "<pre>stays</pre>" in z.read("OEBPS/x/c2.xhtml").decode() and z.namelist()[0] == "mimetype"
    report = (tmp_path / "out/book_es_sospechosos.txt").read_text()
    assert report.startswith("Reporte de traducciones sospechosas — book_es.epub\n" + "=" * 60 + "\n\n👁️  Chunk ") and report.endswith("...\n\nTotal: 1 bloque(s) sospechoso(s)")
    assert spark.read.parquet(str(tmp_path / "out/_summary")).first().n_suspicious == 1 and spark.read.parquet(str(tmp_path / "out/_failures")).count() == 0
    export_review(spark, str(tmp_path / "in"), Options(slots=2), stub, str(tmp_path / "review"))
    page = tmp_path / "review/cap_02.html"
    page.write_text(page.read_text().replace("TWO...", "ZWEI"))
    (back,) = import_review(spark, str(tmp_path / "in"), str(tmp_path / "review")).collect()
    with zipfile.ZipFile(io.BytesIO(bytes(back.epub))) as z:
        text = z.read("OEBPS/x/c2.xhtml").decode()
        assert "<h1>ZWEI</h1>" in text and 'href="c1.xhtml#t"' in text and 'src="../i/a.png"' in z.read("OEBPS/x/c1.xhtml").decode()
    import pytest

    with pytest.raises(FileNotFoundError):
        import_review(spark, str(tmp_path / "in"), str(tmp_path / "in"))


def test_whole_run_of_a_docx(spark, tmp_path):
    from quire.plans import samples
    from quire.plans.documents import Options, run

    (tmp_path / "in").mkdir()
    (tmp_path / "in/letter.docx").write_bytes(samples.LETTER)
    run(spark, str(tmp_path / "in"), "docx", Options(slots=2, merge=True, images=True, font=("Georgia", 12)), translate.Stub(str.upper, lambda content: "READ"), str(tmp_path / "out"))
    units = docx.units_of((tmp_path / "out/letter_es.docx").read_bytes())
    assert [u["text"] for u in units][1:] == ["SEE ⟦1⟧ AND ⟦2⟧", "A LINE THAT WAS CUT IN TWO.", "READ", "IN A CELL", "DEEPER"]
    assert [r["text"] for r in units[0]["runs"]] == ["PLAIN START", "BOLD PART", " ", "PLAIN END"] and "Georgia" in units[0]["runs"][1]["signature"]


def test_converters_and_html(spark, tmp_path):
    from quire.plans.documents import Options, run
    from quire.sources import convert, files

    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nwhile [ "$1" != "--outdir" ]; do shift; done\n[ -s "$3" ] || exit 1\ncp "$3" "$2/entrada.docx"\n')
    tool.chmod(0o755)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.html").write_text(PAGE)
    (tmp_path / "in/a.png").write_bytes(__import__("quire.plans.samples", fromlist=["x"]).png(120, 120))
    run(spark, str(tmp_path / "in"), "html", Options(slots=2, images=True), translate.Stub(str.upper, lambda content: "READ"), str(tmp_path / "out"))
    page = (tmp_path / "out/p_es.html").read_text()
    assert "<style>img { max-width" in page and "<p> HI <b>THERE</b>" in page and ">READ</figcaption>" in page
    run(spark, str(tmp_path / "in"), "html", Options(slots=2, tools={"": str(tool)}), translate.Stub(str.upper), str(tmp_path / "out"))
    assert "HI <b>THERE" in (tmp_path / "out/p_es.docx").read_text()
    rows = spark.createDataFrame([("x.docx", bytearray(b"1")), ("y.odt", bytearray(b"2")), ("z.rtf", bytearray()), ("q.pdf", bytearray(b"4"))], "path string, content binary")
    got = {r.path: r for r in convert.converted(rows, {"": str(tool), ".pdf": str(tmp_path / "none")}).collect()}
    assert bytes(got["x.docx"].content) == b"1" and bytes(got["y.odt"].content) == b"2" and got["z.rtf"].content is None and got["z.rtf"].error and got["q.pdf"].error
    import pytest

    with pytest.raises(Exception, match="no name inside"):
        files.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), str(tmp_path / "out")).count()


def test_addresses_and_resources(spark, tmp_path):
    assert H.map_urls('<a href="x&amp;y"><img src=\'b\'/></a>', lambda u: u + "!") == '<a href="x&amp;y!"><img src=\'b!\'/></a>'
    (tmp_path / "b.epub").write_bytes(make_epub())
    entries = epub.read_epubs(spark, str(tmp_path))
    found = epub.chapters(entries).withColumn("html", F.replace("html", F.lit("Hello"), F.lit('<img src="../s.css"/><a href="c1.xhtml#n">x</a>')))
    assert [(r.src, bytes(r.content)) for r in epub.chapter_images(found, entries).collect()] == [("../s.css", b"p{}")]
    files = {r.file: bytes(r.content) for r in epub.export_review(found, entries).collect()}
    assert set(files) == {"cap_01.html", "manifiesto.json", "index.html", "OEBPS/s.css"} and b'src="OEBPS/s.css"' in files["cap_01.html"] and b'href="cap_01.html#n"' in files["cap_01.html"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"1")
    pages = spark.createDataFrame([(1, '<p><img src="img/a.png#f"><img src="none.png"><img src="http://x/y"></p>')], "page_id int, html string")
    assert [bytes(r.content) for r in H.with_files(H.image_sources(pages, ["page_id"]), str(tmp_path)).collect()] == [b"1"]
