"""Merging, splitting and packing of text units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import effective_words, left_trim, right_trim, trim

#: Values that one fold goes over.
PART = 64
#: What separates the texts of a group, and how many parts a reply may lack or have too many.
SEPARATOR, MARK, TOLERANCE = "\n||||\n", "||||", 2


def pack(words: Column, limit: int) -> Column:
    """Group numbers, from 0, for an array of word counts: a group takes texts while its words stay within the limit; a text over the
    limit is a group of its own. A fold, as a group's start depends on all before it; as a fold copies its result at each step, it goes
    over parts of PART counts, and inside each over its counts."""

    def state(g: Column, total: Column, out: Column) -> Column:
        return F.struct(g.alias("g"), total.cast("long").alias("sum"), out.alias("out"))

    def step(a: Column, w: Column) -> Column:
        opens = (a["g"] < 0) | (a["sum"] + w > limit)
        g = F.when(opens, a["g"] + 1).otherwise(a["g"])
        return state(g, F.when(opens, w.cast("long")).otherwise(a["sum"] + w), F.concat(a["out"], F.array(g)))

    def whole(a: Column, part: Column) -> Column:
        done = F.aggregate(part, state(a["g"], a["sum"], F.array().cast("array<int>")), step)
        return F.transform(F.array(done), lambda d: state(d["g"], d["sum"], F.concat(a["out"], F.array(d["out"]))))[0]

    def folded(ws: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / PART).cast("int")), lambda i: F.slice(ws, i * PART + 1, F.lit(PART)))
        start = state(F.lit(-1), F.lit(0), F.array().cast("array<array<int>>"))
        short = F.aggregate(ws, state(F.lit(-1), F.lit(0), F.array().cast("array<int>")), step, lambda a: a["out"])
        return F.when(F.size(ws) <= PART, short).otherwise(F.flatten(F.aggregate(parts, start, whole, lambda a: a["out"])))

    return F.transform(F.array(words), folded)[0]


def pack_units(units: DataFrame, limit: int, doc: str = "doc_id", pos: str = "pos", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """units with group_id, of other columns all or those in ``keep``. A document's units are gathered once, with their texts, so that these cross one shuffle; grouping by document
    and group afterwards needs no other."""
    rest = [c for c in units.columns if c not in (doc, pos)] if keep is None else list(keep)
    carried = [F.struct(*rest).alias("u")] if rest else []
    whole = units.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), effective_words(F.col(text)).alias("w"), *carried))).alias("u"))
    zipped = F.arrays_zip(F.col("u").alias("u"), pack(F.col("u.w"), limit).alias("g"))
    each = whole.select(doc, F.explode(zipped).alias("x"))
    return each.select(doc, F.col("x.u.p").alias(pos), *(F.col(f"x.u.u.{c}").alias(c) for c in rest), F.col("x.g").alias("group_id"))


def join_groups(grouped: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """One row per group: its texts in order with the separator between, and its number of texts."""
    return grouped.groupBy(doc, "group_id").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("u")).select(doc, "group_id", F.array_join("u.t", SEPARATOR).alias("text"), F.size("u").alias("n_units"))


def split_group(reply: Column, n: Column) -> Column:
    """Struct (parts, status) of a reply for n texts: ok; padded with the last part; cut; or error, with no parts, beyond 2 of difference."""
    parts = F.transform(F.split(reply, r"\|{4}"), trim)
    found = F.size(parts)
    status = F.when(found == n, "ok").when(F.abs(found - n) > TOLERANCE, "error").when(found < n, "padded").otherwise("cut")
    fixed = F.when(found == n, parts).when(F.abs(found - n) > TOLERANCE, None).when(found < n, F.concat(parts, F.array_repeat(F.element_at(parts, -1), n - found))).otherwise(F.slice(parts, F.lit(1), n))
    return F.struct(fixed.alias("parts"), status.alias("status"))


def ends_sentence(text: Column) -> Column:
    """Whether a text ends, but for white space, with one of . ! ? : and the ellipsis. Like Python's $, a line feed may follow."""
    return right_trim(text).rlike(r"[.!?:…]\z")


def starts_small(text: Column) -> Column:
    return left_trim(text).rlike(r"^\p{javaLowerCase}")


def merge_units(units: DataFrame, by: list[str], pos: str = "pos", text: str = "text", tight: bool = False) -> DataFrame:
    """Joins neighbours where the left one ends no sentence and the right one starts small: (by, unit_no, text, n_parts, positions).

    tight strips the texts at the seam. The rule looks at neighbours only, as a merged text ends like its last part, so runs are
    islands between breaks. Pass the container (body, cell) in ``by`` to keep merges inside it.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    before = F.lag(text).over(w)
    marked = units.withColumn("_break", F.when(before.isNull() | ends_sentence(before) | ~starts_small(F.col(text)), 1).otherwise(0))
    marked = marked.withColumn("unit_no", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = marked.groupBy(*by, "unit_no").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("u"))
    n = F.size("u")
    seam = F.transform("u", lambda x, i: F.when((i > 0) & (i < n - 1), trim(x["t"])).when(i > 0, left_trim(x["t"])).when(i < n - 1, right_trim(x["t"])).otherwise(x["t"])) if tight else F.col("u.t")
    return parts.select(*by, F.col("unit_no").cast("int").alias("unit_no"), F.array_join(seam, " ").alias("text"), n.alias("n_parts"), F.col("u.p").alias("positions"))


def split_formats(runs: DataFrame, para: list[str], pos: str = "run_no", text: str = "text", signature: str = "signature") -> DataFrame:
    """One row per group of neighbouring runs of equal format: (para, group_no, signature, text, run_idx).

    Blank runs are left out and break nothing; a null format equals an empty one. Paragraphs of one group are left as they are, which
    the caller sees by n_groups = 1.
    """
    w = Window.partitionBy(*para).orderBy(pos)
    solid = runs.withColumn("_sig", F.coalesce(F.col(signature), F.lit(""))).withColumn("_text", trim(F.coalesce(F.col(text), F.lit("")))).where("_text <> ''")
    marked = solid.withColumn("_new", F.when(F.lag("_sig").over(w).eqNullSafe(F.col("_sig")), 0).otherwise(1)).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    grouped = marked.groupBy(*para, "group_no").agg(F.first("_sig").alias("signature"), F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_text").alias("t")))).alias("u"))
    count = F.count("*").over(Window.partitionBy(*para))
    return grouped.select(*para, F.col("group_no").cast("int").alias("group_no"), "signature", F.array_join("u.t", " ").alias("text"), F.col("u.p").alias("run_idx"), count.cast("int").alias("n_groups"))


def totals(units: DataFrame, by: list[str], text: str = "text", seconds: int = 10) -> DataFrame:
    """Units, effective words and estimated minutes, at so many seconds a unit."""
    return units.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum(effective_words(F.col(text))).cast("long").alias("words")).withColumn("minutes", F.floor(F.col("n_units") * seconds / 60).cast("long"))


def first_units(units: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first n units of each document, by position."""
    return units.where(F.col(pos) < n)
