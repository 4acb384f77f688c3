"""SimHash near-duplicates: fingerprints, a grid join over segment popcounts, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import components, lookup_skewed, session, small_side, stored, utf8

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
#: The fingerprint has 32 segments of two bits; a half has 16 of them.
EVEN_BITS, SEGMENTS_OF_HALF = 0x55555555, 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 of all word shingles, repeats included; no words: 0; fewer words than a shingle: one of all."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begin, end = (ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
    for k in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    data, at = utf8(texts)
    return pa.array(np.array([fingerprint(bytes(data[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64))


def cells(prints: DataFrame, *others: str) -> DataFrame:
    """(cell, fp and others) for every grid point at Manhattan distance 0 or 1 from either half of a fingerprint's segment counts.

    Two fingerprints at Hamming distance 4 or less differ by 2 or less in one of the halves, and Manhattan distance on segment
    counts never exceeds Hamming distance. So the counts of that half are at most 2 apart, and a grid point lies within 1 of both.
    """
    count = "(({0} & {1}L) + (shiftright({0}, 1) & {1}L))".format
    halves = prints.select("fp", *others, F.posexplode(F.expr("array(fp & 4294967295L, shiftrightunsigned(fp, 32))")).alias("half", "x"))
    halves = halves.select("fp", *others, F.expr(f"{count('x', EVEN_BITS)} + half * 4294967296L").alias("h"))
    moves = ["h"]
    for j in range(SEGMENTS_OF_HALF):
        at = f"(shiftright(h, {2 * j}) & 3)"
        moves += [f"if({at} < 2, h + {1 << 2 * j}L, null)", f"if({at} > 0, h - {1 << 2 * j}L, null)"]
    return halves.select(F.explode(F.expr(f"array_compact(array({', '.join(moves)}))")).alias("cell"), "fp", *others)


def near_components(prints: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints that have a neighbour at Hamming distance 4 or less.

    First every fingerprint meets only the smallest one of each of its cells, so that a thousand variants of a text become one
    component through as many rows. The full join then only looks for links between different components: cells whose members are
    all of one, as in dense groups, are left out, so that those neither compare all their members there nor emit all their pairs.
    The join's exchanges are Spark's own, so that adaptive execution may split a hot cell.
    """
    grid = cells(prints).repartition("cell")
    shared = grid.groupBy("cell").agg(F.min("fp").alias("leader"), F.max("fp").alias("last")).where("leader < last").drop("last")
    near = (F.col("fp") != F.col("leader")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= DISTANCE)
    first = grid.withColumnRenamed("cell", "c").join(shared.hint("merge"), (F.col("c") == F.col("cell")) & near).select(F.col("fp").alias("u"), F.col("leader").alias("v"))
    part = stored(components(first.distinct()), "parts")
    named = prints.select("fp").join(part.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"))
    of_cell = Window.partitionBy("cell")
    mixed = cells(stored(named, "named-parts"), "part").withColumns({"least": F.min("part").over(of_cell), "last": F.max("part").over(of_cell)}).where("least < last")
    a = stored(mixed.select("cell", "fp", "part"), "mixed-cells")
    b = a.select(F.col("cell").alias("cell2"), F.col("fp").alias("fp2"), F.col("part").alias("part2"))
    across = (F.col("cell") == F.col("cell2")) & (F.col("part") < F.col("part2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE)
    more = a.join(b.hint("merge"), across).select(F.col("part").alias("u"), F.col("part2").alias("v")).distinct()
    return components(more.unionByName(part.select(F.col("node").alias("u"), F.col("component").alias("v")))).withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fp (long), text_key, component_id: the smallest id reachable over links, its own included.

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Rows with equal fingerprints are in
    one component, whatever their ids; a null id never names a component unless all its rows have none.
    """
    session(docs)
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), simhash(F.col(text_col)).alias("fp")), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    joined = distinct.join(near_components(distinct), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(joined.select("fp", "n", "component").join(names, "component").select("fp", "n", "component_id"), "named")
    return lookup_skewed(prints, named, "fp", "n", F.coalesce(F.col("doc_id"), F.col("text_key")))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint and component_id. Null, empty and wordless texts have fingerprint zero; texts of any
    length count whole; equal fingerprints are one component; repeated rows repeat theirs; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows that repeat the kept doc_id, and rows without one, stay."""
    gone = stored(simhash_groups(docs).where("doc_id > component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    return docs.join(small_side(gone), (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")
