"""HTML as a row of pieces: tags, comments and texts as they stand, so that a page can be put together again with other texts."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.functions.paths import OUTSIDE, normalize
from quire.operators import structure
from quire.operators.structure import DECLARATION, NAMESPACE, VOID

# Elements whose texts stay, and elements whose content is not markup.
SKIP = frozenset(("script", "style", "code", "pre", "kbd", "samp", "var", "math", "svg", "head"))
RAW = ("script", "style")
CAPTION = "data-translated-caption"

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}


def unescape(raw: str, closed: bool = False) -> str:
    """Character references read as HTML has them, where a semicolon may be missing (``&amp``); closed: as XML has them, the others stay as they stand."""
    if not closed or "&" not in raw:
        return entities.unescape(raw)
    return _CLOSED.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), raw)


@dataclass
class Piece:
    """kind: text, open, close, void, comment, declaration. ``skipped``: inside what stays untranslated. ``closed``: as in ``unescape``."""

    kind: str
    raw: str
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    parent: int = -1
    skipped: bool = False
    closed: bool = False

    @property
    def text(self) -> str:
        return unescape(self.raw, self.closed)


def parse(page: str | bytes, closed: bool = False) -> list[Piece]:
    """The pieces in order; ``parent`` is the place of the element that a piece stands in, -1 at the top. closed: texts as in ``unescape``."""
    if isinstance(page, bytes):
        page = page.decode("utf-8", "replace")
    pieces: list[Piece] = []
    stack: list[int] = []
    at = 0
    while at < len(page):
        m = _PIECE.match(page, at)
        raw, at = m.group(), m.end()
        inside = stack[-1] if stack else -1
        skip = inside >= 0 and pieces[inside].skipped
        if raw.startswith("<!--"):
            pieces.append(Piece("comment", raw, parent=inside, skipped=skip, closed=closed))
        elif raw.startswith(("<!", "<?")):
            pieces.append(Piece("declaration", raw, parent=inside, skipped=skip))
        elif raw.startswith("</"):
            name = raw[2:-1].strip().lower()
            if any(pieces[i].name == name for i in stack):
                while stack and pieces[stack[-1]].name != name:
                    stack.pop()
                stack.pop()
            pieces.append(Piece("close", raw, name, parent=stack[-1] if stack else -1))
        elif raw.startswith("<") and len(raw) > 1:
            name = re.match(r"<([^\s/>]+)", raw).group(1).lower()
            attrs = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw[1 + len(name) : -1])}
            local = name.split(":")[-1]
            own = skip or local in SKIP or (local == "a" and attrs.get("role") == "doc-biblioref") or attrs.get(CAPTION) == "1"
            void = local in VOID or raw.endswith("/>")
            pieces.append(Piece("void" if void else "open", raw, name, attrs, inside, own))
            if not void:
                stack.append(len(pieces) - 1)
                if local in RAW:
                    end = re.compile(rf"</{local}\s*>", re.IGNORECASE).search(page, at)
                    stop = end.start() if end else len(page)
                    if stop > at:
                        pieces.append(Piece("text", page[at:stop], parent=stack[-1], skipped=True, closed=closed))
                    at = stop
        elif pieces and pieces[-1].kind == "text" and pieces[-1].parent == inside:
            pieces[-1].raw += raw
        else:
            pieces.append(Piece("text", raw, parent=inside, skipped=skip, closed=closed))
    return pieces


def texts_of(pieces: list[Piece], comments: bool = False) -> list[tuple[int, str]]:
    """Places and texts to translate: inside an element, not skipped, not blank. Comments count only if asked for."""
    return [(i, text) for i, p in enumerate(pieces) if (p.kind == "text" or comments and p.kind == "comment") and p.parent >= 0 and not p.skipped and (text := p.text).strip()]


def text_nodes(pieces: list[Piece], comments: bool = False) -> list[int]:
    """The places that ``texts_of`` gives."""
    return [i for i, _ in texts_of(pieces, comments)]


def serialize(pieces: list[Piece]) -> str:
    return "".join(p.raw for p in pieces)


def apply(pieces: list[Piece], texts: dict[int, str], cuts: dict[int, list[tuple[int, str]]] | None = None) -> str:
    """The page with other texts at some places, and with markup put back into texts: (place in the text, markup), in order."""
    out, cuts = [], cuts or {}
    for i, p in enumerate(pieces):
        if i not in texts and i not in cuts:
            out.append(p.raw)
            continue
        text, at = texts.get(i, p.text), 0
        for place, raw in cuts.get(i, ()):
            out += [entities.escape(text[at:place], quote=False), raw]
            at = place
        out.append(entities.escape(text[at:], quote=False))
    return "".join(out)


def closing(pieces: list[Piece], i: int) -> int:
    """The place of the piece that ends the element that starts at i: its own if it has no content."""
    if pieces[i].kind != "open":
        return i
    return next((j for j in range(i + 1, len(pieces)) if pieces[j].kind == "close" and pieces[j].name == pieces[i].name and pieces[j].parent == pieces[i].parent), len(pieces) - 1)


def without_page_breaks(page: str) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The page without the page-break spans that stand between two texts, which become one; and, of each, the place of that text, its
    length up to the break and with the next text, and the span."""
    pieces, out, found, i = parse(page), [], [], 0
    into: dict[int, Piece] = {}
    while i < len(pieces):
        p = pieces[i]
        if p.name == "span" and p.kind in ("open", "void") and p.attrs.get("role") == "doc-pagebreak":
            j = closing(pieces, i)
            after = pieces[j + 1] if j + 1 < len(pieces) else None
            if out and out[-1].kind == "text" and out[-1].parent == p.parent and after is not None and after.kind == "text" and after.parent == p.parent:
                before = len(out[-1].text)
                out[-1] = Piece("text", out[-1].raw + after.raw, parent=p.parent)
                found.append((len(out) - 1, before, len(out[-1].text), serialize(pieces[i : j + 1])))
                i = j + 2
                continue
        out.append(p)
        i += 1
    return serialize(out), found


def citation_siblings(page: str) -> list[dict]:
    """The children, in order, of the elements that hold a bibliographic reference: parent, pos, node (the text's place, or -1), kind,
    role and text, of an element that of its only text."""
    pieces = parse(page)
    parents = {p.parent for p in pieces if p.name == "a" and p.kind == "open" and p.attrs.get("role") == "doc-biblioref"}
    rows, children = [], {}
    for i, p in enumerate(pieces):
        if p.kind != "close":
            children.setdefault(p.parent, []).append(i)
    for parent in sorted(parents):
        for pos, i in enumerate(children[parent]):
            p, own = pieces[i], children.get(i, [])
            node = i if p.kind == "text" else own[0] if len(own) == 1 and pieces[own[0]].kind == "text" else -1
            rows.append({"parent": parent, "pos": pos, "node": node, "kind": p.name or p.kind, "role": p.attrs.get("role"), "text": pieces[node].text if node >= 0 else None})
    return rows


def with_image_style(page: str) -> str:
    """The page with a style that keeps images inside a page once it is converted, in its head, which is made where there is none."""
    pieces = parse(page)
    style = "<style>img { max-width: 75%; height: auto; }</style>"  # fixed value
    for name, markup in (("head", style), ("html", f"<head>{style}</head>")):
        own = next((p for p in pieces if p.kind == "open" and p.name == name), None)
        if own is not None:
            own.raw += markup
            return serialize(pieces)
    return f"<head>{style}</head>{page}"


def to_xhtml(page: str) -> str:
    """Void elements closed, name space and declaration present."""
    pieces = parse(page)
    for p in pieces:
        if p.kind == "void" and not p.raw.endswith("/>"):
            p.raw = p.raw[:-1].rstrip() + "/>"
        elif p.kind == "open" and p.name == "html" and NAMESPACE not in page:
            p.raw = p.raw[:5] + f" {NAMESPACE}" + p.raw[5:]
    text = serialize(pieces)
    return text if text.lstrip().startswith("<?xml") else f"{DECLARATION}\n{text}"


def with_captions(page: str, captions: dict[str, str]) -> tuple[str, int]:
    """The page with a caption after each image whose src has one, inside its figure or in a new one; and their number."""
    pieces, n = parse(page), 0
    pending: dict[int, list[str]] = {}
    # Fixed value: the look of captions.
    style = "text-align: center; font-style: italic; font-size: 0.9em; padding-top: 0.3em;"
    for i, p in enumerate(pieces):
        text = captions.get(p.attrs.get("src", "")) if p.name == "img" and p.kind in ("void", "open") else None
        if not text:
            continue
        n += 1
        figure = p.parent
        while figure >= 0 and pieces[figure].name != "figure":
            figure = pieces[figure].parent
        table = "" if figure >= 0 else "display: table-caption; "
        caption = f'<figcaption class="img-caption-translated" {CAPTION}="1" style="caption-side: bottom; {table}{style}">{entities.escape(text, quote=False)}</figcaption>'
        if figure >= 0:
            pending.setdefault(figure, []).append(caption)
        else:
            pieces[i].raw = f'<figure style="display: table; margin: 0 auto;">{p.raw}{caption}</figure>'
    for figure, found in pending.items():
        depth = 0
        for p in pieces[figure:]:
            depth += (p.name == "figure") * ((p.kind == "open") - (p.kind == "close"))
            if p.name == "figure" and p.kind == "close" and depth == 0:
                p.raw = "".join(found) + p.raw
                break
    return serialize(pieces), n


# Attributes that hold addresses.
_URLS = re.compile(r"(?<=\s)(xlink:href|src|href)(\s*=\s*)(\"[^\"]*\"|'[^']*')", re.IGNORECASE)


def map_urls(page: str, change: Callable[[str], str]) -> str:
    """The page with every address in a src or href attribute changed."""

    def one(m: re.Match) -> str:
        quote, value = m.group(3)[0], entities.unescape(m.group(3)[1:-1])
        return m.group(1) + m.group(2) + quote + entities.escape(change(value), quote=False).replace(quote, "&quot;" if quote == '"' else "&#39;") + quote

    pieces = parse(page)
    for p in pieces:
        if p.kind in ("open", "void"):
            p.raw = _URLS.sub(one, p.raw)
    return serialize(pieces)


def image_sources(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, n, src) of the images of pages whose address lies inside, in order."""

    @F.pandas_udf("array<string>")
    def sources(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p.attrs["src"] for p in parse(t or "") if p.name == "img" and p.attrs.get("src") and not p.attrs["src"].startswith(OUTSIDE)])

    return pages.select(*key, F.posexplode(sources(F.col(html))).alias("n", "src"))


def with_files(images: DataFrame, base: str) -> DataFrame:
    """image_sources' rows with the content of the files under a folder; rows without a file are left out. Paths join, nothing is opened by name."""
    files = images.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    root = base.rstrip("/").removeprefix("file:").replace("//", "/")
    named = files.select(F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1).alias("_file"), "content")
    return images.withColumn("_file", normalize(F.concat(F.lit(f"{root}/"), F.substring_index("src", "#", 1)))).join(named, "_file").drop("_file")


def title_of(pieces: list[Piece]) -> tuple[str, str]:
    """The texts of the first <title> and the first <h1>, trimmed."""

    def first(name: str) -> str:
        own = next((i for i, p in enumerate(pieces) if p.kind == "open" and p.name == name), None)
        if own is None:
            return ""
        inside = {own}
        for i, p in enumerate(pieces[own + 1 :], own + 1):
            if p.parent in inside and p.kind == "open":
                inside.add(i)
        return "".join(p.text for p in pieces if p.kind == "text" and p.parent in inside).strip()

    return first("title"), first("h1")


NODES = ArrayType(StructType([StructField("node", IntegerType()), StructField("text", StringType())]))


def html_units(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """(key, pos, node, text): the texts of pages by position; node is the place to put a translation back to. closed: texts as in ``unescape``."""

    @F.pandas_udf(NODES)
    def nodes(texts: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[dict]:
            return [{"node": i, "text": text} for i, text in texts_of(parse(page or "", closed))]

        return texts.map(one)

    cut = pages.select(key, F.posexplode(nodes(F.col(html))).alias("pos", "n"))
    return cut.select(key, "pos", "n.node", "n.text")


def repaired(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with the texts around bibliographic references repaired (structure.repair_citations); only pages with one are parsed."""
    kind = "array<struct<parent:int,pos:int,node:int,kind:string,role:string,text:string>>"

    @F.pandas_udf(kind)
    def siblings(texts: pd.Series) -> pd.Series:
        return texts.map(citation_siblings)

    @F.pandas_udf("string")
    def put(texts: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([apply(parse(t), {x["node"]: x["text"] for x in c}) if c is not None else t for t, c in zip(texts, changes, strict=True)])

    rows = pages.where(F.col(html).contains("doc-biblioref")).select(key, F.explode(siblings(F.col(html))).alias("s")).select(key, "s.*").withColumn("_old", F.col("text"))
    changed = structure.repair_citations(rows, [key, "parent"]).where("node >= 0 and text <> _old")
    by_page = changed.groupBy(key).agg(F.collect_list(F.struct("node", "text")).alias("_c"))
    return pages.join(by_page, key, "left").withColumn(html, put(F.col(html), F.col("_c"))).drop("_c")


BREAKS = "array<struct<node:int,before:int,total:int,raw:string>>"


def cleared(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without page breaks inside texts, which ``breaks`` keeps for ``rebuild``."""

    @F.pandas_udf(f"html string, breaks {BREAKS}")
    def clear(texts: pd.Series) -> pd.DataFrame:
        rows = [without_page_breaks(t) if t is not None else (None, []) for t in texts]
        return pd.DataFrame({"html": [t for t, _ in rows], "breaks": [[dict(zip(("node", "before", "total", "raw"), b, strict=True)) for b in found] for _, found in rows]})

    return pages.withColumn("_x", clear(F.col(html))).withColumns({html: F.col("_x.html"), "breaks": F.col("_x.breaks")}).drop("_x")


def rebuild(pages: DataFrame, translated: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with ``translated_html``; translated has (key, node, text, translation), text as html_units gave it.

    A text's outer white space stays, and an empty translation keeps the text (structure.reinject). Page breaks that ``cleared`` took
    out go back at their share of the new text (structure.break_places), or where they stood if the text is untranslated. A page
    without rows and breaks stays as it is.
    """
    full = translated.select(key, "node", structure.reinject(F.col("text"), F.col("translation")).alias("full"))
    by_page = full.groupBy(key).agg(F.collect_list(F.struct("node", "full")).alias("_t"))
    rows = pages.join(by_page, key, "left")
    if "breaks" in pages.columns:
        each = pages.select(key, F.posexplode("breaks").alias("n", "b")).select(key, "n", "b.*")
        own = each.groupBy(key, "node").agg(F.array_sort(F.collect_list(F.struct("n", "before", "total", "raw"))).alias("b"))
        share = F.transform("b", lambda x: F.when(x["total"] > 0, x["before"] / x["total"]).otherwise(F.lit(0.5)))
        places = F.when(F.col("full").isNull(), F.transform("b", lambda x: x["before"])).otherwise(structure.break_places(F.col("full"), share))
        cuts = own.join(full, [key, "node"], "left").select(key, "node", F.arrays_zip(places.alias("place"), F.col("b.raw").alias("raw")).alias("cuts"))
        rows = rows.join(cuts.groupBy(key).agg(F.collect_list(F.struct("node", "cuts")).alias("_b")), key, "left").drop("breaks")
    else:
        rows = rows.withColumn("_b", F.lit(None).cast("array<struct<node:int,cuts:array<struct<place:int,raw:string>>>>"))

    @F.pandas_udf(StringType())
    def build(page: pd.Series, texts: pd.Series, breaks: pd.Series) -> pd.Series:
        def one(p: str | None, t: list | None, b: list | None) -> str | None:
            if p is None or t is None and b is None:
                return p
            given = {x["node"]: x["full"] for x in (t if t is not None else [])}
            cuts = {x["node"]: [(c["place"], c["raw"]) for c in x["cuts"]] for x in (b if b is not None else [])}
            return apply(parse(p), given, cuts)

        return pd.Series([one(*x) for x in zip(page, texts, breaks, strict=True)], dtype=object)

    return rows.withColumn("translated_html", build(F.col(html), F.col("_t"), F.col("_b"))).drop("_t", "_b")


def captioned(pages: DataFrame, captions: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with a caption after each image whose address has one; captions is (key, src, translation)."""
    by_page = captions.where("translation is not null").groupBy(key).agg(F.collect_set(F.struct("src", "translation")).alias("_c"))

    @F.pandas_udf(StringType())
    def put(page: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([with_captions(p, {x["src"]: x["translation"] for x in c})[0] if c is not None and p is not None else p for p, c in zip(page, found, strict=True)], dtype=object)

    return pages.join(by_page, key, "left").withColumn(html, put(F.col(html), F.col("_c"))).drop("_c")


@F.pandas_udf(StringType())
def xhtml(pages: pd.Series) -> pd.Series:
    """Pages as XHTML: to_xhtml of each."""
    return pages.map(lambda t: to_xhtml(t) if t is not None else None)
