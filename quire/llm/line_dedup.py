"""Line deduplication across documents: a segment-partition edit join, verified by a banded bit-parallel edit distance.

A line is cut into ``EDITS`` + 1 segments. Two lines at most EDITS edits apart share a segment of the shorter one, at a place that the
lengths and the segment's number narrow down to a few. Each line therefore sends its own segments and those few substrings, as hashes
that include the shorter line's length, to one join; the pairs that meet are checked by a parity signature and then exactly. Lines that
are too short for such segments to tell anything are duplicates only if they are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import components, lookup_skewed, mixed, release, session, slices, small_side, stored, trim, utf8

#: Lines of so many code points or more that are at most EDITS insertions, deletions and substitutions apart are links.
LEAST_CHARS, EDITS = 30, 2
#: Rows of one key that a task compares; the rows of a key with more go in parts of this size, two and two, to tasks of their own.
KEY_ROWS = 100_000
#: What a line that is more than white space holds.
SOLID = r"[^\x20\x09-\x0D]"
#: Bytes of text whose keys are made at once, in arrays of 8 bytes a character.
SEND_BYTES = 512 << 10
#: Lines whose keys a task remembers having sent, and rows that it matches at once.
REMEMBERED, ROWS_AT_ONCE, BLOCK = 300_000, 200_000, 2_048

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i (from 0) of lines of that length; later segments are longer by one where it does not divide."""
    size, more = length // (edits + 1), length % (edits + 1)
    short = edits + 1 - more
    return i * size + np.maximum(0, i - short), size + (i >= short)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(excess length, segment, shift): where a line may hold a segment of one that is shorter by the excess."""
    out = []
    for excess in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, excess - (edits - i)), min(i, excess + edits - i) + 1):
                if excess or shift:  # equal length and no shift: the line's own segments meet
                    out.append((excess, i, shift))
    return out


def line_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the line, key, whether it is one of its own segments, parity signature of each line)."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(length) - length
    up, down = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:-1], out=sums[1:])
    # One edit changes two character pairs into two others at most, and so four parities.
    pair = np.uint64(1) << (mixed(points[:-1] * np.uint64(0x100000001B3) + points[1:]) >> np.uint64(58))
    edges = np.ravel(np.column_stack([start, np.maximum(start + length - 1, start)]))
    signs = np.bitwise_xor.reduceat(np.append(pair, np.zeros(2, np.uint64)), edges)[::2]

    def hashed(who: np.ndarray, of: np.ndarray, i: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        a = start[who] + at
        h = (sums[a + size] - sums[a]) * down[a]
        return mixed(h ^ mixed((of.astype(np.uint64) << np.uint64(8)) + np.uint64(i)))

    everyone = np.arange(len(lines))
    who, keys, own = [], [], []
    for i in range(edits + 1):
        at, size = segment(length, i, edits)
        who.append(everyone)
        keys.append(hashed(everyone, length, i, at, size))
        own.append(np.ones(len(lines), bool))
    for excess, i, shift in probes(edits):
        of = length - excess
        at, size = segment(of, i, edits)
        at = at + shift
        ok = np.nonzero((of > edits) & (at >= 0) & (at + size <= length))[0]
        who.append(ok)
        keys.append(hashed(ok, of[ok], i, at[ok], size[ok]))
        own.append(np.zeros(len(ok), bool))
    return np.concatenate(who), np.concatenate(keys), np.concatenate(own), signs


def _send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in slices(np.diff(offsets), SEND_BYTES):
            fresh: dict[int, str] = {}
            for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True):
                for line in bytes(data[a:b]).split(b"\n"):
                    if len(line) >= LEAST_CHARS and (h := xxhash.xxh64_intdigest(line, 42)) not in seen and h not in fresh and len(text := line.decode()) >= LEAST_CHARS:
                        fresh[h] = text
            if not fresh:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(fresh)
            ids = np.fromiter(fresh, np.uint64, len(fresh)).view(np.int64)
            who, keys, own, signs = line_keys(list(fresh.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[who]), pa.array(signs.view(np.int64)[who]), pa.array(own)], ["key", "line", "sign", "own"])
    del seen
    trim(0)


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= 4 * EDITS


def _pairs(key: np.ndarray, line: np.ndarray, sign: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines of one key, one of which has it as its own segment, with close signatures. Rows are sorted by key."""
    head = np.nonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))[0]
    size = np.diff(np.append(head, len(key)))
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = head[(size > 1) & (size <= 64)]
    sizes = size[(size > 1) & (size <= 64)]
    for k in range(1, 64):  # every row with the one k places on
        keep = sizes > k
        small, sizes = small[keep], sizes[keep]
        if not len(small):
            break
        n = sizes - k
        x = np.repeat(small, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        y = x + k
        ok = (own[x] | own[y]) & (line[x] != line[y])
        ok[ok] = _close(sign[x[ok]], sign[y[ok]])
        a_out.append(line[x[ok]])
        b_out.append(line[y[ok]])
    for h, n in zip(head[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        rows = np.unique(np.column_stack([line[h : h + n], sign[h : h + n], own[h : h + n].astype(np.int64)]), axis=0)
        mine = rows[rows[:, 2] == 1]
        for i in range(0, len(mine), BLOCK):
            for j in range(0, len(rows), BLOCK):
                p, q = mine[i : i + BLOCK], rows[j : j + BLOCK]
                x, y = np.nonzero(_close(p[:, 1].view(np.uint64)[:, None], q[:, 1].view(np.uint64)[None, :]) & (p[:, 0][:, None] != q[:, 0][None, :]))
                a_out.append(p[x, 0])
                b_out.append(q[y, 0])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return np.minimum(a, b), np.maximum(a, b)


MET = "a long, b long, sign long, own boolean, key long, part int"


def _met(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.column_stack([a, b]), axis=0)
    none = [pa.nulls(len(both), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *none], ["a", "b", "sign", "own", "key", "part"])


def _meet(key_rows: int) -> Callable:
    """Rows come sorted by key; a key's rows are held together, in 25 bytes each, and compared in blocks.

    What comes out is pairs (a, b), or, of keys with more than ``key_rows`` rows, the rows themselves (a, sign, own, key), each with
    the number of its part.
    """

    def large(rows: list[np.ndarray], first: int) -> pa.RecordBatch:
        key, line, sign, own = rows
        part = (first + np.arange(len(key))) // key_rows
        return pa.RecordBatch.from_arrays([pa.array(line), pa.nulls(len(key), pa.int64()), pa.array(sign), pa.array(own), pa.array(key), pa.array(part.astype(np.int32))], ["a", "b", "sign", "own", "key", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, sent = 0, 0  # rows held; rows of the key at their start that went out as a large one's

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, sent
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            key = rows[0]
            heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            sizes = np.diff(np.append(heads, len(key)))
            small = np.ones(len(key), bool)
            for k in np.flatnonzero(sizes > key_rows).tolist() + ([0] if sent and sizes[0] <= key_rows else []):
                own = slice(heads[k], heads[k] + sizes[k])
                yield large([x[own] for x in rows], sent if k == 0 else 0)
                small[own] = False
                last = k == len(heads) - 1
                sent = (sent if k == 0 else 0) + int(sizes[k]) if last else sent if k else 0
            # The last key's rows may go on; those of a large one have gone out.
            cut = len(key) if final or not small[-1] else int(heads[-1])
            if small[-1] and len(heads) > 1:
                sent = 0
            now = small.copy()
            now[cut:] = False
            held, count = [[x[cut:] for x in rows]], len(key) - cut
            if now.any():
                a, b = _pairs(*(x[now] for x in rows))
                if len(a):
                    yield _met(a, b)

        more = ROWS_AT_ONCE
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            count += batch.num_rows
            if count >= more:
                yield from work(False)
                more = max(ROWS_AT_ONCE, min(2 * count, count + key_rows))
        if count:
            yield from work(True)
        held.clear()
        trim(0)

    return run


def _meet_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, line, sign, own) come sorted by key, i and j: part i (side 0) is compared with part j (side 1), or with itself."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, line, sign, own = (table.column(k).to_numpy() for k in ("side", "line", "sign", "own"))
        sign = sign.view(np.uint64)
        one = np.flatnonzero(side == 0)
        two = one if table.column("i")[0] == table.column("j")[0] else np.flatnonzero(side == 1)
        a, b = [], []
        for p in range(0, len(one), BLOCK):
            for q in range(0, len(two), BLOCK):
                x, y = one[p : p + BLOCK], two[q : q + BLOCK]
                m, n = np.nonzero(_close(sign[x][:, None], sign[y][None, :]) & (line[x][:, None] != line[y][None, :]) & (own[x][:, None] | own[y][None, :]))
                a.append(line[x[m]])
                b.append(line[y[n]])
            if sum(map(len, a)) > ROWS_AT_ONCE or p + BLOCK >= len(one):
                u, v = np.concatenate(a), np.concatenate(b)
                a, b = [], []
                if len(u):
                    both = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    now = None
    for batch in batches:
        names = np.column_stack([batch.column(k).to_numpy() for k in range(3)]) if batch.num_rows else np.zeros((0, 3), np.int64)
        cuts = np.append(np.flatnonzero((np.diff(names, axis=0) != 0).any(1)) + 1, len(names)) if len(names) else []
        at = 0
        for cut in cuts:
            if now is not None and tuple(names[at]) != now:
                yield from work(pa.Table.from_batches(held))
                held.clear()
            now = tuple(names[at])
            held.append(batch.slice(at, cut - at))
            at = int(cut)
    if held:
        yield from work(pa.Table.from_batches(held))


def within(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair of texts is at most so many edits apart: bit-parallel columns of a band of 2 * edits + 1 rows, all pairs at once."""
    out = np.zeros(len(a), bool)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    todo = np.nonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= edits)[0]
    todo = todo[np.argsort(sizes[todo].max(1), kind="stable")]
    width = 2 * edits + 1
    mask, top = np.uint64((1 << width) - 1), np.uint64(2 * edits)
    for i, j in slices(4 * sizes[todo].max(1) + 64):
        own = todo[i:j]
        m, n = sizes[own, 0], sizes[own, 1]
        most = int(max(m.max(), n.max()))
        # Rows outside the pattern hold numbers that no character has; row r stands at place r + edits.
        rows = np.full((len(own), most + width + 1), 0xFFFFFFFF, np.uint32)
        cols = np.full((len(own), most), 0xFFFFFFFE, np.uint32)
        for k, o in enumerate(own.tolist()):
            rows[k, edits + 1 : edits + 1 + m[k]] = np.frombuffer(a[o].encode("utf-32-le", "surrogatepass"), np.uint32)
            cols[k, : n[k]] = np.frombuffer(b[o].encode("utf-32-le", "surrogatepass"), np.uint32)
        plus = np.full(len(own), ((1 << (edits + 1)) - 1) << edits, np.uint64)  # rows 1 and on of column 0, as column 1 sees them
        minus, total, result = np.zeros(len(own), np.uint64), np.full(len(own), edits, np.int64), np.where(n == 0, m, edits + 1)
        for c in range(1, most + 1):
            equal = np.zeros(len(own), np.uint64)
            for t in range(width):  # bit t is row c - edits + t
                equal |= (rows[:, c + t] == cols[:, c - 1]).astype(np.uint64) << np.uint64(t)
            diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
            h_plus, h_minus = (minus | ~(diagonal | plus)) & mask, diagonal & plus
            total += ((diagonal >> top) & np.uint64(1)) == 0
            # This column's vertical differences, as its own rows see them.
            v_plus = ((h_minus << np.uint64(1)) | ~(diagonal | (h_plus << np.uint64(1)))) & mask
            v_minus = diagonal & (h_plus << np.uint64(1)) & mask
            last = np.nonzero(n == c)[0]
            if len(last):
                below = (c + edits - m[last]).clip(0, width).astype(np.uint64)  # rows under the pattern's last
                cut = ~((np.uint64(1) << (np.uint64(width) - below)) - np.uint64(1)) & mask
                result[last] = total[last] - np.bitwise_count(v_plus[last] & cut).astype(np.int64) + np.bitwise_count(v_minus[last] & cut).astype(np.int64)
            plus, minus = (h_minus | ~((diagonal >> np.uint64(1)) | h_plus)) & mask, (diagonal >> np.uint64(1)) & h_plus
        out[own] = result <= edits
    return out


@F.arrow_udf(BooleanType())
def within_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(within([x or "" for x in a.to_pylist()], [x or "" for x in b.to_pylist()]))


def lines_of(docs: DataFrame, *others: str) -> DataFrame:
    """others, line_no from 0, text_line and line, its two hashes (128 bits), of all lines that are more than white space."""
    cut = docs.select(*others, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text_line"))
    return cut.where(F.col("text_line").rlike(SOLID)).withColumn("line", F.struct(F.xxhash64("text_line").alias("h"), F.xxhash64(F.lit(1), "text_line").alias("g")))


def line_pairs(docs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): the pairs of lines, by their first hashes, that share a segment and have close signatures."""
    session(docs)
    keys = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_send, "key long, line long, sign long, own boolean")
    met = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(key_rows), MET).distinct(), "met")
    rows = met.where("b is null").select("key", "part", F.col("a").alias("line"), "sign", "own")
    parts = stored(rows.groupBy("key").agg(F.max("part").alias("last")), "large-keys")
    if parts.isEmpty():
        return met.where("b is not null").select("a", "b")
    each = rows.join(small_side(parts), "key")
    # Part p meets all parts: as i those from it on, as j those before it.
    each = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o"), "side": (F.col("part") > F.col("o")).cast("int")})
    each = each.select("key", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "side", "line", "sign", "own")
    more = each.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet_parts, "a long, b long")
    return stored(met.where("b is not null").select("a", "b").unionByName(more).distinct(), "line-pairs")


def line_links(docs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): the pairs of different lines that are at most EDITS edits apart. Lines whose first hashes agree are told apart by the second."""
    pairs = line_pairs(docs, key_rows)
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
    lines = lines_of(docs).where(F.length("text_line") >= LEAST_CHARS)
    texts = stored(lines.join(small_side(wanted), lines["line"]["h"] == wanted["h"], "left_semi").groupBy("line").agg(F.min("text_line").alias("text_line")), "line-texts")
    x, y = texts.select(F.col("line.h").alias("a"), F.col("line").alias("u"), F.col("text_line").alias("x")), texts.select(F.col("line.h").alias("b"), F.col("line").alias("v"), F.col("text_line").alias("y"))
    links = stored(pairs.join(x, "a").join(y, "b").where(within_edits("x", "y")).select(F.col("u").alias("a"), F.col("v").alias("b")), "line-links")
    release(pairs, wanted, texts)
    return links


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per line that is more than white space: doc_id, text_key, line_no, line, n_links (of the line to other texts), kept.

    Equal lines and lines that links connect are one class; only the class's first occurrence, by doc_id, text and line number, is
    kept. Null ids come last. Lines of under LEAST_CHARS code points have no links.
    """
    links = line_links(docs)
    degree = links.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count("*").alias("n_links"))
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).join(degree.withColumnRenamed("line", "node"), "node")
    each = stored(lines_of(docs, "doc_id", F.xxhash64("text").alias("text_key")).select("doc_id", "text_key", "line_no", "line"), "lines")
    each = each.join(small_side(stored(named, "line-classes")).withColumnRenamed("node", "line"), "line", "left").withColumn("class", F.coalesce("component", "line")).drop("component")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")
    groups = stored(each.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "line-groups")
    out = lookup_skewed(each, groups, "class", "copies", F.xxhash64("doc_id", "line_no"))
    return out.select("doc_id", "text_key", "line_no", "line", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("first").isNull() | (place == F.col("first"))).alias("kept"))


def dedup_lines(docs: DataFrame, names: tuple[str, str, str] = ("n_lines", "n_dropped", "n_links")) -> DataFrame:
    """docs with ``text`` without the lines that repeat an earlier one or nearly so, and with three counts under the given names: lines,
    lines dropped, and links of the lines to other texts.

    Null texts stay null; empty texts, lines of white space and texts without repeated lines stay as they are; an empty table gives one.
    Of repeated rows with equal id and text all keep or lose the same lines. Columns of docs named like the counts are replaced.
    """
    session(docs)
    per = line_classes(docs).where("not kept or n_links > 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("gone"), F.sum("n_links").alias("n_links"))
    per = stored(per.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("gone").alias("__gone"), F.col("n_links").alias("__links")), "lines-gone")
    own = docs["doc_id"].eqNullSafe(per["__id"]) & (F.xxhash64(docs["text"]) == per["__key"])
    out = docs.join(small_side(per), own, "left")
    # A map finds a line's number at once, however many lines a text loses.
    gone = "map_from_arrays(__gone, array_repeat(true, size(__gone)))"
    kept = F.expr(f"transform(array({gone}), g -> array_join(transform(filter(transform(split(text, '\\n'), (x, i) -> struct(x, i)), p -> not map_contains_key(g, p.i)), p -> p.x), '\\n'))[0]")
    text = F.when(F.size("__gone") > 0, kept).otherwise(F.col("text"))
    new = dict(zip(names, (
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))),
        F.coalesce(F.when(F.size("__gone") > 0, F.size("__gone")), F.lit(0)),
        F.coalesce("__links", F.lit(0)),
    ), strict=True))
    return out.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in new), *(x.alias(n) for n, x in new.items()))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_links and the SHA-256 of the text that is left (null: of the empty text).

    Empty texts and texts of any length, ties, repeated rows and an empty table are as ``dedup_lines`` says.
    """
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.col("n_links").cast("long").alias("n_links"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
