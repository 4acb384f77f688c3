"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import session, small_side, stored

WINDOW_WORDS, SHINGLE_WORDS = 13, 5
#: Word characters: digits, ASCII letters in either case, and everything beyond ASCII. Written as ranges to take, which Java's matcher
#: tests five times faster than the same ranges as exceptions.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does it where all is ASCII, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, pos, width, w0, w1 .., h): every run of words of each width in whole texts, with its hash, from one scan.

    The words of a run are columns beside each other, so that runs are made, hashed and probed without a string of their own.
    """
    most = max(widths)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    side = ", ".join(["w", *(f"slice(w, {k + 1}, greatest(size(w) - {k}, 0))" for k in range(1, most))])
    names = [f"w{k}" for k in range(most)]
    each = found.select("doc_id", "text_key", F.size("w").alias("n_words"), F.posexplode(F.expr(f"arrays_zip({side})")).alias("pos", "z"))
    each = each.select("doc_id", "text_key", "n_words", "pos", "z.*").toDF("doc_id", "text_key", "n_words", "pos", *names)
    runs = {k: F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*names[:k])) for k in widths}
    if len(runs) == 1:
        each = each.withColumns({"width": F.lit(most), "h": runs[most]})
    else:
        each = each.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("width"), h.alias("h")) for k, h in runs.items()))))
    return each.where("h is not null")


def item_windows(items: DataFrame, size: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): distinct windows as (window_id, n, width, run: their shingles in order), and (window_id, item_id)."""
    found = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(size)))
    each = found.select("item_id", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> slice(w, i + 1, n))")).alias("w"))
    owners = stored(each.select("item_id", "n", "w", F.array_join("w", " ").alias("window_id")).distinct(), "owners")
    windows = owners.select("window_id", "n", "w").dropDuplicates(["window_id"]).withColumn("width", F.least("n", F.lit(shingle)))
    run = F.expr("transform(sequence(0, n - width), i -> array_join(slice(w, i + 1, width), ' '))")
    return stored(windows.select("window_id", "n", "width", run.alias("run")), "windows"), owners.select("window_id", "item_id")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(hits, owners): where windows occur, as (doc_id, text_key, start, n, window_id), start counted in words.

    A window is the ordered set of its shingles. Documents keep only shingles that some window has; those rows give every
    shingle's number of occurrences over all documents. A window is contained only where its rarest shingle occurs (the necessary
    prefix for full containment), so only that one is joined; the start that it implies must lie inside the document with the whole
    window before the document's end, and the window's shingles must all stand there in order. Shingles are found by their hashes and
    then compared as strings.
    """
    windows, owners = item_windows(items, size, shingle)
    known = windows.select("width", F.explode("run").alias("shingle")).distinct()
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # at most SHINGLE_WORDS values
    if not widths:
        empty = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window_id")).where("false")
        return empty, owners
    part = [F.when(F.col("width") > k, F.split("shingle", " ")[k]) for k in range(max(widths))]  # a hash passes over nulls
    known = stored(known.withColumn("h", F.xxhash64(*part)).groupBy("h").agg(F.collect_list("shingle").alias("shingles")), "known")
    text = F.concat_ws(" ", *(F.when(F.col("width") > k, F.col(f"w{k}")) for k in range(max(widths))))
    rows = positions(docs, widths).join(small_side(known), "h").where(F.array_contains("shingles", text))
    rows = rows.select("width", text.alias("shingle"), "doc_id", "text_key", "n_words", "pos")
    rows = stored(rows, "shingles")
    rarity = rows.groupBy("width", "shingle").agg(F.count("*").alias("df"))
    ranked = windows.select("window_id", "n", "width", "run", F.posexplode("run").alias("offset", "shingle")).join(rarity, ["width", "shingle"], "left")
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")
    prefix = ranked.groupBy("window_id", "n", "width", "run").agg(F.min(order).alias("least")).where("least.df > 0")
    prefix = stored(prefix.select("window_id", "n", "width", "run", F.col("least.shingle").alias("shingle"), F.col("least.offset").alias("offset")), "prefix")
    reach = size - 1
    near = Window.partitionBy("width", "doc_id", "text_key").orderBy("pos").rangeBetween(-reach, reach)
    around = rows.distinct().withColumn("around", F.collect_list(F.struct("pos", "shingle")).over(near))
    met = around.join(small_side(prefix), ["width", "shingle"]).withColumn("start", F.col("pos") - F.col("offset"))
    met = met.where("start >= 0 and start + n <= n_words and transform(filter(around, x -> x.pos >= start and x.pos <= start + size(run) - 1), x -> x.shingle) = run")
    return stored(met.select("doc_id", "text_key", "start", "n", "window_id").distinct(), "hits"), owners


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; rows that repeat a document repeat its result; items without words have no
    window; items with equal windows all count. A null item_id owns its windows but is not listed.
    """
    session(docs)
    hits, owners = occurrences(docs, items, size, shingle)
    key = ["doc_id", "text_key"]
    before = Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*key, "start", "n").distinct().withColumn("done", F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    covered = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "done"))).alias("n_hit"))
    owned = hits.select(*key, "window_id").distinct().join(small_side(stored(owners, "owned")), "window_id").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    listed = owned.groupBy(*key).agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    per = stored(covered.join(listed, (covered["doc_id"].eqNullSafe(listed["doc_id"])) & (covered["text_key"] == listed["text_key"])).select(covered["doc_id"].alias("_id"), covered["text_key"].alias("_key"), "n_hit", "n_items", "items"), "per-doc")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = base.join(small_side(per), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document, as ``contamination`` gives them: nulls, empty texts, ties, repeated rows and empty tables are as it says."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("text_key")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows; null and empty texts stay, repeated rows stay or go together, columns of any name stay."""
    bad = stored(contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    return docs.join(small_side(bad), docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM dw),
hit AS (SELECT DISTINCT dwin.doc_id, dwin.n, i, item_id FROM dwin JOIN wins ON dwin.n = wins.n AND dwin.win = wins.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit) x),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
