"""Putting translations back: white space, tokens, page breaks, citations, addresses and archive entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import paths, quality
from quire.functions.text import SPACE, lead, left_trim, tail, trim


def reinject(original: Column, translation: Column) -> Column:
    """The translation between the original's outer white space; an empty or missing translation keeps the original."""
    return F.when(F.coalesce(translation, F.lit("")) == "", original).otherwise(F.concat(lead(original), translation, tail(original)))


def apply_action(translation: Column, links: Column, notes: Column) -> Column:
    """keep (nothing to apply), fallback (tokens broken: the original stays), rebuild (with links or notes), or plain."""
    marked = (F.size(links) > 0) | (F.size(notes) > 0)
    empty = F.coalesce(translation, F.lit("")) == ""
    return F.when(empty, "keep").when(marked & ~quality.tokens_intact(translation, links, notes), "fallback").when(marked, "rebuild").otherwise("plain")


def plain_text(translation: Column) -> Column:
    """Without stray tokens, runs of blanks made one, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(translation, r"⟦\d+⟧", ""), "  +", " "))


def segments(translation: Column, links: Column, notes: Column) -> Column:
    """The pieces of a text with tokens, as structs (kind, text, idx): text, link or note. Unknown tokens are left out."""
    cut = F.split(translation, r"⟦\d+⟧", -1)
    ids = F.transform(F.regexp_extract_all(translation, F.lit(r"⟦(\d+)⟧"), F.lit(1)), lambda x: x.cast("int"))
    none = F.lit(None).cast("int")
    texts = F.transform(cut, lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), none.alias("idx")))
    marks = F.concat(F.transform(ids, lambda n: F.struct(F.when(F.array_contains(links, n), "link").when(F.array_contains(notes, n), "note").otherwise("unknown").alias("kind"), F.lit("").alias("text"), n.alias("idx"))), F.array(F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("text"), none.alias("idx"))))
    both = F.flatten(F.zip_with(texts, marks, lambda t, m: F.array(t, m)))
    return F.filter(both, lambda x: (x["kind"] != "unknown") & ((x["kind"] != "text") | (x["text"] != "")))


def pagebreaks(siblings: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """(by, pos, proportion, merged) of page breaks that stand between two text nodes; kind is 'text' or 'pagebreak' or another.

    Texts with breaks between them become one, from left to right: a break's proportion is the length of all that was joined before it
    over that length and the next text's, and ``merged`` is that whole.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    joined = (F.col("kind") == "pagebreak") & (F.lag("kind").over(w) == "text") & (F.lead("kind").over(w) == "text")
    near = siblings.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    near = near.withColumn("_new", F.when(F.col("_joined") | F.coalesce(F.lag("_joined").over(w), F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(*by, "_run").orderBy(pos)
    text = F.when(F.col("kind") == "text", F.coalesce("text", F.lit(""))).otherwise("")
    near = near.withColumn("_text", text).withColumn("_before", F.sum(F.length("_text")).over(run)).withColumn("_next", F.lead("_text").over(run))
    near = near.withColumn("merged", F.concat(F.array_join(F.collect_list("_text").over(run), ""), "_next"))
    total = F.length("merged")
    return near.where("_joined").select(*by, pos, F.when(total > 0, F.col("_before") / total).otherwise(0.5).alias("proportion"), "merged")


def break_places(text: Column, proportions: Column) -> Column:
    """Where several page breaks go back into a text, in order: the last one first, each earlier one in what stands before it."""

    def step(a: Column, share: Column) -> Column:
        at = break_at(a["text"], share)
        return F.transform(F.array(at), lambda p: F.struct(F.left(a["text"], p).alias("text"), F.concat(F.array(p), a["out"]).alias("out")))[0]

    return F.aggregate(F.reverse(proportions), F.struct(text.alias("text"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])


def break_at(text: Column, proportion: Column) -> Column:
    """Where a page break goes back: at the proportion's place, moved to the nearest blank, the left one on a tie."""
    p = F.floor(F.length(text) * proportion).cast("int")
    back = F.locate(" ", F.reverse(F.left(text, p)))
    before = F.when(back > 0, p - back).otherwise(-1)
    # Python's find starts at the place itself.
    ahead = F.instr(F.substr(text, p + 1), F.lit(" "))
    after = F.when(ahead > 0, p + ahead - 1).otherwise(-1)
    return F.when((before < 0) & (after < 0), p).when(before < 0, after).when(after < 0, before).when(p - before <= after - p, before).otherwise(after)


# Pages in parentheses of their own, and how the text after a citation goes on within the group.
_PAGES = (r"\.?\((pp?\.)\s*([^)]+)\)", r"\.?\((págs?\.)\s*([^)]+)\)")
_PAGE_OPEN = r"^[\s)>;]|^,?\s*\.?\(?pp?\.|^,?\s*\.?\(?págs?\."


def repaired_citation(text: Column) -> Column:
    """A citation's own text, without a full stop at the end."""
    return F.regexp_replace(text, r"\.\s*\z", "")


def repaired_before(text: Column) -> Column:
    """What stands before a citation: a full stop at its end opens a parenthesis instead."""
    return F.when(F.endswith(text, F.lit(".")), F.concat(F.left(text, F.length(text) - 1), F.lit(" ("))).otherwise(text)


def repaired_after(text: Column) -> Column:
    """What stands after a citation: pages in parentheses of their own join it, and a group that does not go on is closed."""
    t = text
    for pages in _PAGES:
        t = F.regexp_replace(t, pages, ", $1 $2")
    return F.when(t.rlike(_PAGE_OPEN), t).otherwise(F.concat(F.lit("). "), left_trim(t)))


def repair_citations(siblings: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """siblings (by, pos, kind 'text' or other, role, text) with the texts around links of role doc-biblioref repaired.

    A text between two citations is first what follows the left one, then what precedes the right one.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    cites = lambda c: F.coalesce(c == "doc-biblioref", F.lit(False))
    follows, precedes = cites(F.lag("role").over(w)), cites(F.lead("role").over(w))
    marked = siblings.withColumn("_after", follows).withColumn("_before", precedes)
    after = F.when(F.col("_after"), repaired_after(F.col("text"))).otherwise(F.col("text"))
    both = F.when(F.col("_before"), repaired_before(after)).otherwise(after)
    text = F.when(cites(F.col("role")), repaired_citation(F.col("text"))).when(F.col("kind") == "text", both).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop("_after", "_before")


def rewrite_url(item: Column, url: Column, chapter: Column) -> Column:
    """An address for a review folder: kept if outside, else resolved from the item; ``chapter`` replaces the resolved path if not null."""
    outside = F.lit(False)
    for s in paths.KEPT:
        outside = outside | url.startswith(s)
    fragment = F.when(url.contains("#"), F.regexp_extract(url, "(?s)#(.*)$", 1)).otherwise("")
    target = F.coalesce(chapter, paths.resolve(item, url))
    return F.when((url == "") | outside, url).when(fragment == "", target).otherwise(F.concat(target, F.lit("#"), fragment))


def restore_url(item: Column, url: Column, original: Column) -> Column:
    """The reverse: ``original`` is the item that a chapter's file name stands for, or null."""
    outside = F.lit(False)
    for s in paths.KEPT:
        outside = outside | url.startswith(s)
    fragment = F.when(url.contains("#"), F.regexp_extract(url, "(?s)#(.*)$", 1)).otherwise("")
    path, d = F.coalesce(original, F.substring_index(url, "#", 1)), paths.parent(item)
    back = F.when(d == ".", path).otherwise(paths.relative(path, d))
    return F.when((url == "") | outside, url).when(fragment == "", back).otherwise(F.concat(back, F.lit("#"), fragment))


def rewrite_urls(links: DataFrame, chapters: DataFrame) -> DataFrame:
    """links (item, url) with ``rewritten``; chapters (path, chapter) is looked up by resolved path."""
    resolved = links.withColumn("_path", paths.resolve(F.col("item"), F.col("url")))
    return resolved.join(chapters.select(F.col("path").alias("_path"), "chapter"), "_path", "left").withColumn("rewritten", rewrite_url(F.col("item"), F.col("url"), F.col("chapter"))).drop("_path", "chapter")


def match_entries(entries: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """(by, zip_name, item_name): the entry of each item, equal to its name or ending in a slash and it; exact names come first, then
    the shortest. Entries are spread by all their suffixes, so that the match is an equi-join rather than a comparison of all pairs."""
    parts = F.split("zip_name", "/")
    spread = entries.select(*by, "zip_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("item_name"))
    found = spread.join(items, [*by, "item_name"])
    best = Window.partitionBy(*by, "item_name").orderBy((F.col("zip_name") != F.col("item_name")).cast("int"), F.length("zip_name"), "zip_name")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def chapter_manifest(chapters: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """(by, file, item_name, title): numbered file names; the title is <title>, else <h1>, else the item's name."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    blank = lambda c: F.nullif(trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return chapters.select(*by, F.format_string("cap_%02d.html", n).alias("file"), "item_name", F.coalesce(blank("title"), blank("h1"), "item_name").alias("title"))


# Elements without content, the declaration and the name space of XHTML.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
DECLARATION, NAMESPACE = '<?xml version="1.0" encoding="utf-8"?>', 'xmlns="http://www.w3.org/1999/xhtml"'


def alignment(value: Column) -> Column:
    return F.when(value.isin("left", "center", "right"), value).otherwise("center")


def spaces_only(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]*\\z")
