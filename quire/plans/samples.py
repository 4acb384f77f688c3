"""Small files made in memory, for queries over formats that the tables do not hold."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

_NAMES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
)


def png(width: int, height: int) -> bytes:
    """A white image."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + b"\xff" * 3 * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def headers(width: int, height: int) -> dict[str, bytes]:
    """The start of an image of each format, up to where its size stands; the JPEG's frame follows two other segments."""
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0"
    progressive = b"\xff\xc2" + frame[2:]
    comment = b"\xff\xe0" + struct.pack(">H", 18) + b"JFIF" + bytes(12) + b"\xff\xff\xfe" + struct.pack(">H", 6) + b"\xff\xc0ab"
    return {
        "png": png(width, height), "gif": b"GIF89a" + struct.pack("<HH", width, height) + bytes(3), "bmp": b"BM" + bytes(16) + struct.pack("<ii", width, -height),
        "jpeg": b"\xff\xd8" + comment + frame, "progressive": b"\xff\xd8" + comment + progressive, "webp": b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"),
        "lossy": b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + struct.pack("<HH", width, height), "lossless": b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14),
        "tiff": b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 4, 1, width, 257, 4, 1, height),
    }


def epub(chapters: dict[str, str], others: dict[str, tuple[str, bytes]]) -> bytes:
    """An archive of chapters, by path under OEBPS, and other entries (media type, bytes)."""
    items = [(p, "application/xhtml+xml", t.encode()) for p, t in chapters.items()] + [(p, m, d) for p, (m, d) in others.items()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest>' + "".join(f'<item href="{p}" media-type="{m}"/>' for p, m, _ in items) + "</manifest></package>")
        for p, _, d in items:
            z.writestr(f"OEBPS/{p}", d)
    return out.getvalue()


BOOK = epub(
    {
        "x/c1.xhtml": '<html><head><title>First</title></head><body id="b1"><h1>One</h1><p>Some said so.<a role="doc-biblioref" href="c2.xhtml#n">Miller, 2001.</a>.(p. 12) and more</p><p>A page that <span role="doc-pagebreak" id="p7"></span>ends here</p><p><a href="c2.xhtml">on</a><img src="../i/a.png"/></p></body></html>',
        "x/c2.xhtml": '<html><head></head><body><h1>Two</h1><p>See <a href="c1.xhtml#t">this</a> and <a href="http://e.org/x">that</a>.</p><pre>stays</pre></body></html>',
        "x/c3.xhtml": "<html><body></body></html>",
    },
    {"i/a.png": ("image/png", png(120, 140)), "s.css": ("text/css", b"p{}")},
)


def docx(body: str, rels: dict[str, str], media: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NAMES}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in rels.items()) + "</Relationships>")
        for name, data in media.items():
            z.writestr(f"word/{name}", data)
    return out.getvalue()


def run(text: str, form: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{form}</w:rPr>" if form else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def paragraph(*runs: str) -> str:
    return f"<w:p>{''.join(runs)}</w:p>"


LETTER = docx(
    paragraph(run("Plain start "), run("bold part", "<w:b/>"), run(" "), run("plain end"))
    + paragraph(run("See "), f'<w:hyperlink r:id="r1">{run("link")}</w:hyperlink>', run(" and "), '<w:r><w:footnoteReference w:id="4"/></w:r>')
    + paragraph(run("A line that was"))
    + paragraph(run("cut in two."))
    + '<w:p><w:pPr><w:jc w:val="right"/></w:pPr><w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="1"/><a:blip r:embed="r2"/></wp:inline></w:drawing></w:r></w:p>'
    + f"<w:tbl><w:tr><w:tc>{paragraph(run('In a cell'))}<w:tbl><w:tr><w:tc>{paragraph(run('deeper'))}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:p/>",
    {"r1": "http://e.org/a", "r2": "media/i.png"},
    {"media/i.png": png(150, 120)},
)
