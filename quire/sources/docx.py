"""DOCX: paragraphs as units with opaque tokens for links and notes, runs, images, and writing translations back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from copy import deepcopy
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import regroup
from quire.sources.files import read_files

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
for _prefix, _uri in (("w", _W), ("r", _R), ("a", _A), ("wp", _WP)):
    ET.register_namespace(_prefix, _uri)

UNIT = "path string, pos int, container string, text string, links map<int,struct<url:string,anchor:string,text:string>>, notes map<int,struct<kind:string,note_id:string>>, base_format string, runs array<struct<run_no:int,text:string,signature:string>>"
IMAGE = "path string, pos int, content binary, width_emu long, align string"
_MARK = re.compile(r"⟦(\d+)⟧")
#: Colour and underline of links, size of captions in half points.
LINK_COLOUR, LINK_LINE, CAPTION_SIZE = "0000FF", "single", "20"


def w(name: str) -> str:
    return f"{{{_W}}}{name}"


def body_of(data: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ET.fromstring(z.read("word/document.xml"))


def paragraphs(root: ET.Element) -> list[tuple[str, ET.Element]]:
    """(container, paragraph): those of the body first, then the tables' cells, row by row, and their tables in turn."""
    out: list[tuple[str, ET.Element]] = []

    def walk(holder: ET.Element, name: str) -> None:
        out.extend((name, p) for p in holder.findall(w("p")))
        for t, table in enumerate(holder.findall(w("tbl"))):
            for r, row in enumerate(table.findall(w("tr"))):
                for c, cell in enumerate(row.findall(w("tc"))):
                    walk(cell, f"{name}/t{t}r{r}c{c}")

    body = root.find(w("body"))
    walk(body if body is not None else root, "body")
    return out


def has_image(p: ET.Element) -> bool:
    return any(r.find(w("drawing")) is not None or r.find(w("pict")) is not None for r in p.findall(w("r")))


def _texts(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.findall(w("t")))


def _format(run: ET.Element) -> str:
    f = run.find(w("rPr"))
    return ET.tostring(f, encoding="unicode").strip() if f is not None else ""


def read_unit(p: ET.Element, rels: dict[str, str]) -> dict:
    """Text with one token for each link or note, numbered together; the first format of a run; and the plain runs."""
    parts, links, notes, base, n = [], {}, {}, None, 0
    for child in p:
        if child.tag == w("r"):
            ref = next((x for x in (child.find(w("footnoteReference")), child.find(w("endnoteReference"))) if x is not None), None)
            if ref is not None:
                n += 1
                notes[n] = {"kind": "footnote" if ref.tag == w("footnoteReference") else "endnote", "note_id": ref.get(w("id"), "")}
                parts.append(f"⟦{n}⟧")
            else:
                parts.append(_texts(child))
            base = base or _format(child) or None
        elif child.tag == w("hyperlink"):
            n += 1
            links[n] = {"url": rels.get(child.get(f"{{{_R}}}id", ""), ""), "anchor": child.get(w("anchor"), ""), "text": "".join(_texts(r) for r in child.findall(w("r")))}
            parts.append(f"⟦{n}⟧")
    runs = [{"run_no": k, "text": _texts(r), "signature": _format(r)} for k, r in enumerate(p.findall(w("r")))]
    return {"text": "".join(parts).strip(), "links": links, "notes": notes, "base_format": base, "runs": runs}


def _rels(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/_rels/document.xml.rels" not in z.namelist():
            return {}
        return {x.get("Id", ""): x.get("Target", "") for x in ET.fromstring(z.read("word/_rels/document.xml.rels"))}


def units_of(data: bytes) -> list[dict]:
    """The translatable paragraphs in order; those with images or without text are left out, but counted in pos."""
    rels, out = _rels(data), []
    for pos, (container, p) in enumerate(paragraphs(body_of(data))):
        # A picture's paragraph is no unit: its runs must stay.
        if has_image(p):
            continue
        unit = read_unit(p, rels)
        if unit["text"]:
            out.append({"pos": pos, "container": container, **unit})
    return out


def images_of(data: bytes) -> list[dict]:
    """Embedded pictures with their width and their paragraph's alignment, centred where it has none."""
    rels, out = _rels(data), []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        for pos, (_, p) in enumerate(paragraphs(ET.fromstring(z.read("word/document.xml")))):
            jc = p.find(f"{w('pPr')}/{w('jc')}")
            align = jc.get(w("val")) if jc is not None else None
            for drawing in (d for r in p.findall(w("r")) for d in r.findall(w("drawing"))[:1]):
                blip, extent = drawing.find(f".//{{{_A}}}blip"), drawing.find(f".//{{{_WP}}}extent")
                target = rels.get(blip.get(f"{{{_R}}}embed", ""), "") if blip is not None else ""
                if target and f"word/{target}" in names:
                    width = extent.get("cx", "0") if extent is not None else "0"
                    out.append({"pos": pos, "content": z.read(f"word/{target}"), "width_emu": int(width) if width.isdigit() else 0, "align": align if align in ("left", "center", "right") else "center"})
    return out


def _run(text: str, base: ET.Element | None = None) -> ET.Element:
    r = ET.Element(w("r"))
    if base is not None:
        r.append(deepcopy(base))
    t = ET.SubElement(r, w("t"), {_SPACE: "preserve"})
    t.text = text
    return r


def _set_text(r: ET.Element, text: str) -> None:
    for t in r.findall(w("t")):
        r.remove(t)
    t = ET.SubElement(r, w("t"), {_SPACE: "preserve"})
    t.text = text


def _styled(r: ET.Element) -> ET.Element:
    f = r.find(w("rPr"))
    if f is None:
        f = ET.Element(w("rPr"))
        r.insert(0, f)
    for name, value in (("color", LINK_COLOUR), ("u", LINK_LINE)):
        e = f.find(w(name))
        e = ET.SubElement(f, w(name)) if e is None else e
        e.set(w("val"), value)
    return r


def apply_to_paragraph(p: ET.Element, translation: str, run_idx: list[int] | None = None) -> str:
    """Puts a translation in place: keep, fallback, rebuild or plain, as structure.apply_action says."""
    if not translation:
        return "keep"
    marked: list[tuple[str, ET.Element]] = []
    for child in p:
        if child.tag == w("hyperlink"):
            marked.append(("link", child))
        elif child.tag == w("r") and (child.find(w("footnoteReference")) is not None or child.find(w("endnoteReference")) is not None):
            marked.append(("note", child))
    if not marked:
        text = re.sub("  +", " ", _MARK.sub("", translation)).strip()
        runs = p.findall(w("r"))
        own = [runs[i] for i in run_idx] if run_idx is not None else runs
        for k, r in enumerate(own):
            _set_text(r, "" if k else text)
        return "plain"
    if sorted(map(int, _MARK.findall(translation))) != list(range(1, len(marked) + 1)):
        return "fallback"
    first = next((r.find(w("rPr")) for r in p.findall(w("r")) if r.find(w("rPr")) is not None), None)
    new: list[ET.Element] = []
    for k, part in enumerate(_MARK.split(translation)):
        if k % 2 == 0:
            if part:
                new.append(_run(part, first))
            continue
        kind, old = marked[int(part) - 1]
        if kind == "note":
            new.append(old)
            continue
        text = "".join(_texts(r) for r in old.findall(w("r")))
        base = next((r.find(w("rPr")) for r in old.findall(w("r")) if r.find(w("rPr")) is not None), first)
        link = ET.Element(w("hyperlink"), {a: v for a, v in old.attrib.items() if a in (f"{{{_R}}}id", w("anchor")) and v})
        link.append(_styled(_run(text, base)))
        new.append(link)
    for child in list(p):
        if child.tag != w("pPr"):
            p.remove(child)
    p.extend(new)
    return "rebuild"


def caption(text: str) -> ET.Element:
    """A centred paragraph in italics."""
    p = ET.Element(w("p"))
    ET.SubElement(ET.SubElement(p, w("pPr")), w("jc"), {w("val"): "center"})
    r = _run(text)
    f = ET.Element(w("rPr"))
    ET.SubElement(f, w("i"))
    ET.SubElement(f, w("sz"), {w("val"): CAPTION_SIZE})
    r.insert(0, f)
    p.append(r)
    return p


def set_font(root: ET.Element, name: str, points: int) -> None:
    """Font and size of every run, tables included."""
    for _, p in paragraphs(root):
        for r in p.findall(w("r")):
            f = r.find(w("rPr"))
            if f is None:
                f = ET.Element(w("rPr"))
                r.insert(0, f)
            for tag, attrs in (("rFonts", {w("ascii"): name, w("hAnsi"): name}), ("sz", {w("val"): str(2 * points)})):
                e = f.find(w(tag))
                e = ET.SubElement(f, w(tag)) if e is None else e
                e.attrib.update(attrs)


def _stored(data: bytes, root: ET.Element) -> bytes:
    """The file with another body."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            new.writestr(info, ET.tostring(root, encoding="utf-8", xml_declaration=True) if info.filename == "word/document.xml" else old.read(info.filename))
    return out.getvalue()


def merge(data: bytes, groups: list[list[int]]) -> bytes:
    """The file with each group's paragraphs, by position, made one: the first takes the others' content, a blank between."""
    root = body_of(data)
    found = [p for _, p in paragraphs(root)]
    parents = {child: holder for holder in root.iter() for child in holder}
    for first, *rest in groups:
        for pos in rest:
            found[first].append(_run(" "))
            found[first].extend([child for child in found[pos] if child.tag != w("pPr")])
            parents[found[pos]].remove(found[pos])
    return _stored(data, root)


def rewrite(data: bytes, translations: list[tuple[int, str, list[int] | None]], captions: dict[int, list[str]] | None = None, font: tuple[str, int] | None = None) -> tuple[bytes, dict[str, int]]:
    """(file, counts of actions): translations as (pos, text, runs or None), captions by the position of their images' paragraph."""
    root = body_of(data)
    found, counts = [p for _, p in paragraphs(root)], {"keep": 0, "fallback": 0, "rebuild": 0, "plain": 0, "caption": 0}
    for pos, text, runs in translations:
        counts[apply_to_paragraph(found[pos], text, runs)] += 1
    if captions:
        parents = {child: holder for holder in root.iter() for child in holder}
        for pos, texts in captions.items():
            holder = parents[found[pos]]
            at = list(holder).index(found[pos]) + 1
            for text in reversed([t for t in texts if t]):
                holder.insert(at, caption(text))
                counts["caption"] += 1
    if font:
        set_font(root, *font)
    return _stored(data, root), counts


def _scan(files: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = make(bytes(row.content))
                if rows:
                    yield pd.DataFrame([{"path": row.path, **r} for r in rows])

    return files.select("path", "content").mapInPandas(run, schema)


def units(files: DataFrame) -> DataFrame:
    """Units of DOCX files (path, content)."""
    return _scan(files, units_of, UNIT)


def images(files: DataFrame) -> DataFrame:
    """Embedded pictures of DOCX files (path, content)."""
    return _scan(files, images_of, IMAGE)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Units of all DOCX files under a path."""
    return units(read_files(spark, path, ".docx"))


def read_docx_images(spark: SparkSession, path: str) -> DataFrame:
    return images(read_files(spark, path, ".docx"))


def merged(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """files (path, content) with paragraphs that a line break cut made one: regroup.merge_units inside each container decides."""
    parts = regroup.merge_units((found if found is not None else units(files)).select("path", "container", "pos", "text"), ["path", "container"], tight=True).where("n_parts > 1")
    groups = parts.groupBy("path").agg(F.collect_list("positions").alias("g"))

    @F.pandas_udf("binary")
    def run(content: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([merge(bytes(c), [[int(x) for x in own] for own in g]) if g is not None else c for c, g in zip(content, groups, strict=True)])

    return files.join(groups, "path", "left").select("path", run("content", "g").alias("content"))


def formatted(found: DataFrame) -> DataFrame:
    """(path, unit, pos, text, run_idx): units, those without links and notes cut where their runs' format changes; unit counts from 0."""
    plain = found.where((F.size("links") == 0) & (F.size("notes") == 0))
    runs = plain.select("path", "pos", F.explode("runs").alias("r")).select("path", "pos", "r.*")
    groups = regroup.split_formats(runs, ["path", "pos"]).where("n_groups > 1")
    whole = found.join(groups.select("path", "pos").distinct(), ["path", "pos"], "left_anti")
    both = whole.select("path", "pos", F.lit(0).alias("group_no"), "text", F.lit(None).cast("array<int>").alias("run_idx")).unionByName(groups.select("path", "pos", "group_no", "text", "run_idx"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos", "group_no")) - 1
    return both.select("path", number.alias("unit"), "pos", "text", "run_idx")


def rewritten(files: DataFrame, translated: DataFrame, captions: DataFrame | None = None, font: tuple[str, int] | None = None) -> DataFrame:
    """(path, docx, fallbacks, captions): files (path, content) with translated (path, pos, translation, run_idx) and captions (path, pos,
    n, translation) put in place."""
    rows = translated.groupBy("path").agg(F.collect_list(F.struct("pos", "translation", "run_idx")).alias("t"))
    every = files.select("path", "content").join(rows, "path", "left")
    if captions is None:
        every = every.withColumn("c", F.lit(None).cast("array<struct<pos:int,n:int,translation:string>>"))
    else:
        every = every.join(captions.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "translation"))).alias("c")), "path", "left")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                notes: dict[int, list[str]] = {}
                for x in row.c if row.c is not None else []:
                    notes.setdefault(x["pos"], []).append(x["translation"])
                texts = [(x["pos"], x["translation"], None if x["run_idx"] is None else [int(i) for i in x["run_idx"]]) for x in (row.t if row.t is not None else [])]
                data, counts = rewrite(bytes(row.content), texts, notes, font)
                out.append({"path": row.path, "docx": data, "fallbacks": counts["fallback"], "captions": counts["caption"]})
            yield pd.DataFrame(out, columns=["path", "docx", "fallbacks", "captions"])

    return every.mapInPandas(run, "path string, docx binary, fallbacks long, captions long")
