"""Secret scan in DataFrame expressions: fixed patterns, and character Markov models of random strings and of identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}+", r"[0-9a-f]{24,}+"
#: Strings that the models judge: unbroken runs of the whole alphabet that keys and tokens are written in, ``+`` and ``/`` of base64 among it.
CANDIDATE, LEAST_CHARS = r"[A-Za-z0-9+/_-]{20,}+", 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Matches whose places one fold finds.
PART = 64
#: The models are fitted on the documents whose hashed ids are the smallest, so many of them at most.
SAMPLE_DOCS = 4_000
#: Share of equal chances in the random model, weight of single characters' chances in the words' model, and the mean log-likelihood
#: ratio of a pair of characters that marks a string as random.
EQUAL, BACKOFF, MARGIN = 0.5, 5.0, 3.0


def _matches(text: str, pattern: str, kind: str, order: int, guard: str) -> str:
    """SQL of the spans of the pattern's matches, leftmost and not overlapping, in code points."""
    lit = "r'" + pattern.replace("'", "\\x27") + "'"
    cut, got = f"split({text}, {lit}, -1)", f"regexp_extract_all({text}, {lit}, 0)"
    none = "cast(array() as array<struct<s:int,o:int,e:int,k:string,m:string>>)"
    # A fold copies its array at each step, so pairs of a gap and a match are folded in parts, from where each part starts.
    parts = f"transform(array(zip_with(slice({cut}, 1, size({got})), {got}, (g, m) -> struct(g as g, m as m))), p -> if(size(p) = 0, cast(array() as array<array<struct<g:string,m:string>>>), transform(sequence(0, (size(p) - 1) div {PART}), c -> slice(p, c * {PART} + 1, {PART}))))[0]"
    starts = "aggregate(q, struct(0 as at, cast(array() as array<int>) as out), (a, x) -> struct(a.at + aggregate(x, 0, (n, y) -> n + length(y.g) + length(y.m)) as at, concat(a.out, array(a.at)) as out)).out"
    walk = (
        f"aggregate(x, struct(o as at, {none} as out),"
        f" (a, y) -> struct(a.at + length(y.g) + length(y.m) as at, concat(a.out, array(struct(a.at + length(y.g) as s, {order} as o, a.at + length(y.g) + length(y.m) as e, '{kind}' as k, y.m as m))) as out)).out"
    )
    return f"if({guard}, flatten(transform(array({parts}), q -> zip_with(q, {starts}, (x, o) -> {walk}))[0]), {none})"


def _spans(text: str, pattern: str, kind: str, order: int, guard: str, keep: str) -> Column:
    """The matches' spans; ``keep`` is a condition on match m."""
    return F.expr(f"filter({_matches(text, pattern, kind, order, guard)}, x -> {keep})")


def base_spans(text: str = "t") -> Column:
    """Spans as structs (s, o, e, k, m) by start, then kind."""
    value = "length(regexp_extract(x.m, r'" + ASSIGN.replace("'", "\\x27") + "', 2)) >= 6"
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, "assign", 0, f"{text} rlike r'(?i:password|passwd|secret|token|api_?key)'", value),
        _spans(text, ACCESS, "access", 1, f"contains({text}, 'AKIA')", "true"),
        _spans(text, HEX, "hex", 2, f"{text} rlike r'[0-9a-f]{{24}}'", "true"),
    ))


def _pairs(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters' places in the alphabet; at most the alphabet's size squared rows reach the driver."""
    at = "locate(substr(s, i, 1), '" + ALPHABET + "')"
    pairs = strings.where("length(s) > 1").select(F.explode(F.expr(f"transform(sequence(1, length(s) - 1), i -> {at} * 100 + {at.replace('(s, i', '(s, i + 1')})")).alias("p"))
    return {divmod(r.p, 100): r.n for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row; place 0 is any character outside the alphabet.

    Labelled samples: what follows the assignments, keys and hex strings that the fixed patterns find is random; the other words of
    the same documents, too short to be candidates, are ordinary. The random model is half what it saw and half equal chances, so that
    hex digits alone do not define it; the words' model falls back on how frequent a character is in words.
    """
    place = F.xxhash64("doc_id", "text")
    last = docs.select(place.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h  # hashes alone are sorted
    t = docs.select(F.coalesce("text", F.lit("")).alias("t"), place.alias("h")).where(F.lit(False) if last is None else F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t"))
    found = t.select("t", base_spans().alias("b"))
    value = F.when(F.col("x.k") == "assign", F.regexp_extract("x.m", ASSIGN, 2)).otherwise(F.col("x.m"))
    secret = found.select(F.explode("b").alias("x")).select(value.alias("s"))
    word = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,{LEAST_CHARS - 1}}}+(?![A-Za-z0-9+/_-])"
    plain = found.select(F.explode(F.regexp_extract_all("t", F.lit(word), F.lit(0))).alias("s"), "b").where("not exists(b, x -> contains(x.m, s))").select("s")
    n = len(ALPHABET) + 1

    def rows(pairs: dict[tuple[int, int], int]) -> tuple[dict[int, int], dict[int, int], int]:
        first: dict[int, int] = {}
        second: dict[int, int] = {}
        for (a, b), c in pairs.items():
            first[a], second[b] = first.get(a, 0) + c, second.get(b, 0) + c
        return first, second, sum(pairs.values())

    random, words = _pairs(secret), _pairs(plain)
    (r_first, _, _), (w_first, w_second, w_all) = rows(random), rows(words)

    def ratio(a: int, b: int) -> float:
        p_random = EQUAL / n + (1 - EQUAL) * (random.get((a, b), 0) / r_first[a] if a in r_first else 1 / n)
        p_single = (w_second.get(b, 0) + 0.5) / (w_all + 0.5 * n)
        return math.log(p_random) - math.log((words.get((a, b), 0) + BACKOFF * p_single) / (w_first.get(a, 0) + BACKOFF))

    return [round(ratio(a, b), 3) for a in range(n) for b in range(n)]


def model_spans(ratios: list[float], text: str = "t", base: str = "base") -> Column:
    """Spans outside base spans whose mean ratio a pair exceeds MARGIN, as structs like base_spans'.

    A candidate may be a path that holds a key, or a base64 key with slashes. Its pieces between ``+`` and ``/`` that the words' model
    explains better, and those of base spans, are split off at both ends, with what lies between them and the first or last key-like
    piece; pieces of under three characters are neither. What is left is judged as one string, and where that is not random, or meets
    a base span, each piece of LEAST_CHARS or more by itself.
    """
    table = "cast(split('" + ",".join(map(str, ratios)) + "', ',') as array<double>)"
    n = len(ALPHABET) + 1
    place = "locate(substr(x.m, i, 1), '" + ALPHABET + "')"
    pair = f"element_at({table}, {place} * {n} + {place.replace('(x.m, i', '(x.m, i + 1')} + 1)"
    score = lambda a, b: f"if({b} - {a} < 2, 0D, aggregate(slice(x.r, {a} + 1, {b} - {a} - 1), 0D, (z, v) -> z + v))"
    struct = "struct<s:int,o:int,e:int,k:string,m:string>"
    runs = _matches(text, CANDIDATE, "random", 3, f"{text} rlike r'[A-Za-z0-9+/_-]{{{LEAST_CHARS}}}'")
    # x: the run, its pairs' ratios r, its pieces p from a to b, each a word's (w), a key's (k) or neither.
    rated = f"transform({runs}, x -> struct(x.s as s, x.m as m, transform(sequence(1, length(x.m) - 1), i -> {pair}) as r, aggregate(split(x.m, '[+/]', -1), struct(0 as at, cast(array() as array<struct<a:int,b:int>>) as out), (z, v) -> struct(z.at + length(v) + 1 as at, concat(z.out, array(struct(z.at as a, z.at + length(v) as b))) as out)).out as p))"
    known = f"exists({base}, b -> b.s < x.s + q.b and x.s + q.a < b.e)"
    word = f"({known} or q.b - q.a > 2 and {score('greatest(q.a - 1, 0)', 'least(q.b + 1, length(x.m))')} <= 0)"
    judged = f"transform({rated}, x -> struct(x.s as s, x.m as m, x.r as r, transform(filter(x.p, q -> q.b > q.a), q -> struct(q.a as a, q.b as b, {word} as w)) as p))"
    judged = f"transform({judged}, x -> struct(x.s as s, x.m as m, x.r as r, transform(x.p, q -> struct(q.a as a, q.b as b, q.w as w, not q.w and q.b - q.a > 2 as k)) as p))"
    first, last = "array_min(transform(filter(x.p, q -> q.k), q -> q.a))", "array_max(transform(filter(x.p, q -> q.k), q -> q.b))"
    ends = f"transform(filter({judged}, x -> exists(x.p, q -> q.k)), x -> struct(x.s as s, x.m as m, x.r as r, x.p as p, if(exists(x.p, q -> q.w and q.b < {first}), {first}, 0) as a, if(exists(x.p, q -> q.w and q.a > {last}), {last}, length(x.m)) as b))"
    good = lambda q: f"({q}.b - {q}.a >= {LEAST_CHARS} and {score(q + '.a', q + '.b')} > {MARGIN} * ({q}.b - {q}.a - 1) and not exists({base}, b -> b.s < x.s + {q}.b and x.s + {q}.a < b.e))"
    chosen = f"if({good('x')}, array(struct(x.a as a, x.b as b)), transform(filter(x.p, q -> {good('q')}), q -> struct(q.a as a, q.b as b)))"
    return F.expr(f"cast(flatten(transform({ends}, x -> transform({chosen}, q -> struct(x.s + q.a as s, 3 as o, x.s + q.b as e, 'random' as k, substr(x.m, q.a + 1, q.b - q.a) as m)))) as array<{struct}>)")


def scan(docs: DataFrame, sample: int = SAMPLE_DOCS, names: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs' columns but text, with two more under the given names: arrays of structs (s start, o order, e end, k kind, m matched text).

    Null texts are empty; repeated rows repeat their result; a table without any secret gives models of which one is uniform. Columns
    of docs with those names are replaced, all others stay.
    """
    session(docs)
    ratios = train(docs, sample)
    read = docs.select(*(c for c in docs.columns if c not in ("text", *names)), F.coalesce("text", F.lit("")).alias("__text"))
    found = read.withColumn("__base", base_spans("__text")).withColumn("__added", model_spans(ratios, "__text", "__base"))
    return found.drop("__text").withColumnsRenamed({"__base": names[0], "__added": names[1]})


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts and hash of the base spans, and all spans. Null and empty texts have none; spans that start together
    come by kind; repeated rows repeat theirs; texts are read whole; an empty table gives no rows."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("array_sort(concat(base, added))").alias("spans"))
