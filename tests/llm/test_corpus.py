"""Operators that compare rows with each other, each against a brute-force version, and the pipeline."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, decontam, line_dedup, registry, simhash, token_store, toxicity, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(500, i) for i in range(501, 560)]
    named = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes(600, edges)
    assert named == {x: want[x] for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lookup_of_hot_keys(spark):
    left = spark.range(9000).select((F.when(F.col("id") < 6000, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("i"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = common.lookup_skewed(left, right, "k", "n", F.col("i"), least=10)
    assert got.count() == 9000 and got.where("k = 0 and m = 5999").count() == 6000 and got.where("m is null").count() == 0


def brute_fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [brute_fingerprint(d.text) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = classes(len(docs), links)
    least = {g: min(d.doc_id for d, h in zip(docs, group, strict=True) if h == g) for g in set(group)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf_dir).collect()}
    assert got == {d.doc_id: (f"{p:016x}", least[g]) for d, p, g in zip(docs, prints, group, strict=True)}
    rows = simhash.simhash_groups(odd_docs).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.component_id for r in rows if r.doc_id in (1, 2, 6)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = simhash.first_of_each_group(odd_docs)
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, None: 1, 3: 1, 4: 2, 7: 1} and kept.columns == odd_docs.columns


def test_popcount_grid_finds_all_neighbours(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds:
        for _ in range(14):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = classes(len(prints), links)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.fp: r.component for r in simhash.near_components(rows).collect()}
    by = defaultdict(set)
    for p, g in zip(signed, group, strict=True):
        by[g].add(found.get(p, p))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n, letters="abé"):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.33 or k == len(out):
            out.insert(k, rng.choice(letters))
        elif kind < 0.66:
            out.pop(k)
        else:
            out[k] = rng.choice(letters)
    return "".join(out)


def test_banded_edit_distance():
    rng = random.Random(3)
    a = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    b = [edited(rng, x, rng.randint(0, 4)) for x in a]
    for edits in (1, 2, 3):
        assert line_dedup.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b, strict=True)]
    long = "lorem ipsum " * 3000
    assert line_dedup.within([long, long], [long[1:] + "x", long[3:]]).tolist() == [True, False]


def test_segment_keys_miss_no_pair():
    rng = random.Random(8)
    for _ in range(60):
        lines = list({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(40)})
        who, key, own, sign = line_dedup.line_keys(lines)
        order = np.argsort(key.view(np.int64), kind="stable")
        a, b = line_dedup._pairs(key.view(np.int64)[order], who[order].astype(np.int64), sign[who][order], own[order])
        met = set(zip(a.tolist(), b.tolist(), strict=True))
        assert all((i, j) in met for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2)


def test_blocks_equal_small_groups(monkeypatch):
    rng = np.random.default_rng(1)
    line, sign, own = np.arange(300), rng.integers(0, 1 << 10, 300), rng.random(300) < 0.5
    key = np.repeat([5, 9], [100, 200])
    monkeypatch.setattr(line_dedup, "BLOCK", 32)
    blocks = set(zip(*(x.tolist() for x in line_dedup._pairs(key, line, sign, own)), strict=True))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j] and (own[i] or own[j]) and int(sign[i] ^ sign[j]).bit_count() <= 8}
    assert blocks == want


def brute_lines(docs):
    """kept text by row, for rows (doc_id, text) without repeats, and the number of links."""
    places, short = defaultdict(list), defaultdict(list)
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                (places if len(line) >= line_dedup.LEAST_CHARS else short)[line].append((i, k))
    lines = sorted(places, key=len)
    bags = [Counter(x) for x in lines]
    links = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if len(lines[j]) - len(a) > 2:
                break
            if sum((bags[i] - bags[j]).values()) <= 2 and sum((bags[j] - bags[i]).values()) <= 2 and distance(a, lines[j]) <= 2:
                links.append((i, j))
    group = classes(len(lines), links)
    first = {}
    for line, g in zip(lines, group, strict=True):
        first[g] = min([first[g], *places[line]] if g in first else places[line])
    keep = set(first.values()) | {min(x) for x in short.values()}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not x.strip(" \t\n\x0b\x0c\r") or (i, k) in keep) for i, t in docs}, len(links)


def test_line_dedup(spark, odd_docs, no_docs):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(28, 60))) for _ in range(25)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(6)) + "\nshort\nshort") for i in range(40)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, links = brute_lines(docs)
    assert {i: r.text for i, r in out.items()} == want
    assert sum(r.n_dropped for r in out.values()) == sum(len(t.split("\n")) - len(want[i].split("\n")) + (not want[i]) for i, t in docs) > 20 and links > 20
    rows = line_dedup.dedup_lines(odd_docs)
    assert rows.count() == 9 and rows.where("doc_id = 1 and text is null").count() == 1 and rows.where("class = 'own'").count() == 9 and dict(rows.dtypes)["n_links"] == "bigint"
    assert dict(line_dedup.dedup_lines(odd_docs, names=("x", "y", "z")).dtypes)["n_links"] == "string"
    assert line_dedup.dedup_lines(no_docs).count() == 0
    short = spark.createDataFrame([(1, "a\n\nb\n \na"), (2, "b\n\n c\nc"), (3, None), (None, "c\nd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(short).collect()} == {1: "a\n\nb\n ", 2: "\n c\nc", 3: None, None: "d"}


@pytest.mark.parametrize("key_rows", [2, 7, 50])
def test_large_keys_are_compared_in_parts(spark, key_rows):
    rng = random.Random(11)
    base = "".join(rng.choice("abcdé ") for _ in range(45))
    docs = spark.createDataFrame([(i, "\n".join(edited(rng, base, rng.randint(0, 5)) for _ in range(5))) for i in range(60)], "doc_id long, text string").repartition(3)
    whole, parted = ({tuple(r) for r in line_dedup.line_pairs(docs, n).collect()} for n in (line_dedup.KEY_ROWS, key_rows))
    assert whole == parted and len(whole) > 500


def test_lines_with_equal_first_hashes_are_told_apart(spark, monkeypatch):
    lines = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs", "a line of its own that resembles no other one"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    same = F.struct(F.lit(7).cast("long").alias("h"), F.xxhash64("text_line").alias("g"))
    real = line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "lines_of", lambda docs, *others: real(docs, *others).withColumn("line", same))
    monkeypatch.setattr(line_dedup, "line_pairs", lambda docs, key_rows: common.stored(spark.createDataFrame([(7, 7)], "a long, b long"), "p"))
    assert line_dedup.line_links(docs).where("a != b").count() == 2
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {0: lines[0], 1: "", 2: lines[2]}


def test_line_dedup_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = brute_lines(docs)
    assert {r.doc_id: r.text_sha256 for r in line_dedup.op6_line_dedup(spark, sf_dir).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_decontamination_widths(spark):
    """Items of one to eight words, and longer ones, in texts of few different words, against all windows of all texts."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") + rng.choice("cdef") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 8, 13, 15]))) for i in range(60)]
    docs = [(i, text(rng.randrange(40)) + (" " + rng.choice(items)[1] if i % 3 == 0 else "")) for i in range(80)]
    windows = [(i, w[k : k + 13]) for i, t in items for w in [t.split()] for k in range(max(len(w) - 12, 1))]
    want = {}
    for i, t in docs:
        w, hit, owners = t.split(), set(), set()
        for item, run in windows:
            for k in range(len(w) - len(run) + 1):
                if w[k : k + len(run)] == run:
                    hit |= set(range(k, k + len(run)))
                    owners.add(str(item))
        want[i] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest())
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    long = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, "Same TEXT"), (2, ""), (3, None), (None, "日本 \U0001f600"), (5, long), (6, long), (7, "!!! ???")], "item_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(20, "x " + " ".join(f"W{i}" for i in range(3, 20)) + " y"), (21, " ".join(f"w{i}" for i in range(12))), (22, "a " * 300 + long), (23, "q " * 900 + " ".join(f"w{i}" for i in range(13)))], "doc_id long, text string"))
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert (got[4].n_hit, got[4].n_words, got[4].contaminated, got[4].n_items) == (4, 4, True, 1)
    assert (got[20].n_hit, got[20].n_words, got[20].n_items, got[20].items_sha256) == (17, 19, 2, hashlib.sha256(b"5,6").hexdigest())
    assert got[21].n_hit == 0 and got[22].n_hit == 40 and got[22].contaminated and got[23].n_hit == 13 and not got[23].contaminated
    assert got[1].n_words == 0 and not got[1].contaminated and got[7].n_hit == 2 and got[7].n_items == 0
    assert decontam.contamination(docs, items).count() == 13 and decontam.contamination(no_docs, items).count() == 0 and decontam.contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    kept = decontam.clean_documents(odd_docs, items)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 3, 6}


def test_warc(spark, tmp_path):
    big, other = "é" * 600, "y" * 1200
    pages = spark.createDataFrame([(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (3, None, other)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path)
    rows = {r.page_id: r for r in got.collect()}
    assert got.count() == 10 and all(r.verified for r in rows.values())
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2), 7: ("response", None), 8: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    assert Counter(bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4] for r in warc.records(spark, path).collect()) == Counter([big.encode()] + [other.encode()] * 2 + [b"small"] * 2 + [b""] * 3 + [b"x" * 999] * 2)
    built = {r.page_id: bytes(r.record) for r in warc.records(spark, path).collect()}
    assert built[2].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and built[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"\r\nX: y" not in built[2]
    empty = f"file://{tmp_path}/e"
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    a, b = token_store.permuted(np.arange(n), n), token_store.permuted(np.arange(n), n, key=99)
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n)) and (n < 16 or (a != b).any() and (a != np.arange(n)).any())


def test_token_store(spark, sf_dir, odd_docs, no_docs, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"file://{tmp_path}/t"
    m = token_store.write_store(token_store.byte_ids(docs), path, seq_len=100, shard_bytes=1 << 16)
    rows = token_store.read_store(spark, path).collect()
    parts = defaultdict(dict)
    for r in rows:
        parts[r.doc_id][r.seq] = bytes(r.ids)
        assert r.byte_offset == (r.slot % m["per_shard"]) * m["stride"] and r.shard == r.slot // m["per_shard"] and r.n_tokens == len(r.ids)
    assert {k: b"".join(v[i] for i in sorted(v)) for k, v in parts.items()} == {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.slot for r in rows) == list(range(m["total"])) and m["shards"] > 3
    late = token_store.read_store(spark, path, first_slot=m["per_shard"] + 7).collect()
    assert sorted(r.slot for r in late) == list(range(m["per_shard"] + 7, m["total"]))
    assert json.loads((tmp_path / "t/manifest.json").read_text()) == m
    odd = token_store.write_store(token_store.byte_ids(odd_docs), f"file://{tmp_path}/o")
    assert odd["total"] == sum(max(1, -(-len((r.text or "").encode()) // 512)) for r in odd_docs.collect())
    assert {r.doc_id for r in token_store.read_store(spark, f"file://{tmp_path}/o").collect()} == {1, 2, 3, 4, 5, 6, 7, -1}
    assert token_store.write_store(token_store.byte_ids(no_docs), f"file://{tmp_path}/n")["total"] == 0 and token_store.read_store(spark, f"file://{tmp_path}/n").count() == 0


def test_token_store_query_holds_token_ids(spark, sf_dir, odd_docs, tmp_path):
    import base64
    import zlib

    import tiktoken

    with open(token_store.RANKS, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("test", pat_str=token_store.PATTERN, mergeable_ranks=table, special_tokens={})
    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode_ordinary(r.text or "")
        for k in range(max(1, -(-len(ids) // token_store.SEQ_LEN))):
            part = ids[k * token_store.SEQ_LEN : (k + 1) * token_store.SEQ_LEN]
            want[r.doc_id, k, len(part), zlib.crc32(np.array(part, "<u2").tobytes())] += 1
    assert Counter((r.doc_id, r.seq, r.n_tokens, r.crc32) for r in token_store.op4_token_store(spark, sf_dir).collect()) == want
    token_store.write_store(token_store.rank_ids(odd_docs), f"file://{tmp_path}/o", width=2)
    parts = defaultdict(dict)
    for r in token_store.read_store(spark, f"file://{tmp_path}/o").where("doc_id in (2, 3, 6, 7)").collect():
        parts[r.doc_id][r.seq] = np.frombuffer(r.ids, "<u2").tolist()
    assert {k: own.decode([x for i in sorted(v) for x in v[i]]) for k, v in parts.items()} == {r.doc_id: r.text for r in odd_docs.where("doc_id in (2, 3, 6, 7)").collect()}


def test_grammar():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"moro": 3.0})
    read = lambda t: toxicity.clause_emissions(t, lexicon)
    assert read("an idiot") == [("insult", 2.0)] and read("you are an idiot") == [("insult+target", 2.0)] and read("not an idiot") == [("insult+negated", 2.0)]
    assert read("she said that idiot") == [("insult+reported+target", 2.0)] and read("idiot, the man said") == [("insult+reported", 2.0)] and read("you moronic thing") == [("insult+target", 3.0)]
    assert read("i will kill you") == read("kill them all") == read("you i will kill") == [("threat+target", 2.0)] and read("kill the process") == [("threat", 2.0)]
    assert read("no, you idiot") == [("insult+target", 2.0)] and read("idiot and idiot") == [("insult", 2.0), ("insult", 2.0), ("again", 2.0)] and read("") == []
    assert toxicity.text_features("", lexicon) == [0.0] * len(toxicity.FEATURES)
    by = dict(zip(toxicity.FEATURES, toxicity.text_features("idiot. you idiot", lexicon), strict=True))
    assert by["insult"] == by["insult+target"] == by["heaviest"] == pytest.approx(np.log1p(2.0)) and by["clauses"] == pytest.approx(np.log1p(2))
    model = toxicity.Model(lexicon, toxicity.start_weights())
    assert model.score("Kill them all!") > 0.5 > model.score("kill the process") and model.score("you idiot") > 0.5 > model.score("you are not an idiot")
    long = "word " * 50_000 + "idiot " + "word " * 50_000
    assert toxicity.text_features(long, lexicon)[0] == pytest.approx(np.log1p(2.0))


def test_composed_machine_equals_all_paths_of_its_parts():
    def paths(machine, symbols):
        found = [(machine.start, (), ())]
        for x in symbols:
            found = [(after, out + (y,), names + (n,)) for s, out, names in found for z, y, n, after in machine.arcs[s] if z == x]
        return [(out, names) for s, out, names in found if s in machine.finals]

    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.patterns()]

    def brute(classes):
        found = [(tuple((c, frozenset()) for c in classes), ())]
        for machine in parts:
            found = [p for symbols, _ in found for p in paths(machine, symbols)]
        return [tuple((i, n) for i, names in enumerate(names) for n in names) for _, names in found]

    rng = random.Random(2)
    for _ in range(1500):
        classes = "".join(rng.choice(toxicity.CLASSES + "oi") for _ in range(rng.randint(0, 14)))
        assert brute(classes) == [toxicity.accepted(classes)], classes


def test_contexts_decide_where_words_do_not(monkeypatch):
    # Each pair has the same words; only where they stand differs.
    pairs = [("you are an idiot, not fine", "you are not an idiot, fine"), ("the man said fine. what an idiot", "the man said what an idiot. fine"), ("i will kill you. then stop the process", "i will kill the process. then you stop"), ("moron, never good", "never moron, good")]
    rng, lexicon = random.Random(7), toxicity.Lexicon({"idiot": 2.0, "moron": 2.0}, {})
    rows = [(" ".join(rng.choice(["alder", "birch", "cedar"]) for _ in range(5)) + ". " + rng.choice(pairs)[1 - i % 2], i % 2) for i in range(800)]

    def accuracy():
        x, y = np.array([toxicity.text_features(t, lexicon) for t, _ in rows]), np.array([y for _, y in rows], float)
        model = toxicity.Model(lexicon, toxicity.fit_logistic(x[:600], y[:600]))
        return sum((model.score(t) >= 0.5) == y for t, y in rows[600:]) / 200

    assert accuracy() >= 0.97
    words = lambda clause, lexicon: [("insult", w) for c, w in (lexicon.classify(m.group()) for m in toxicity._TOKENS.finditer(clause)) if c in (toxicity.INSULT, toxicity.THREAT)]
    monkeypatch.setattr(toxicity, "clause_emissions", words)
    assert accuracy() <= 0.7


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "an", "on", "es", "ti"]) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 < 1
        words = [word() for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["zorgle", "blarfish"])
            words[rng.randrange(60)] = rng.choice(["zorgle", "blarfish"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (999, None)], "doc_id long, toxic int")
    scored = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, known).collect()}
    assert sum(scored[i].predicted == y for i, y in labels) >= 396 and all(0 <= s.score <= 1 for s in scored.values())
    # Held-out labels change nothing.
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, flipped).collect()} == scored
    assert toxicity.score_documents(odd_docs, known).count() == 9 and toxicity.acceptable(no_docs, known).count() == 0
    kept = toxicity.acceptable(odd_docs, known.where("false"))
    assert kept.count() == 9 and kept.columns == odd_docs.columns and kept.where("toxicity = 'own'").count() == 9


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    rows = toxicity.op3_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.op3_toxicity(spark, sf_dir).collect()}
            assert set(after) == {i for i in given if not scores[i]}
        elif name == "line_dedup":
            want, _ = brute_lines([(r.doc_id, r.text) for r in before.values()])
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_duplicates":
            ids = sorted(before)
            prints = [brute_fingerprint(before[i].text) for i in ids]
            group = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
            assert set(after) == {ids[g] for g in group}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.contamination(spark.createDataFrame([(r.doc_id, r.text) for r in before.values()], "doc_id long, text string"), benchmark).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        else:
            assert set(after) == set(before) and all(r.decodes and len(r.piece_ids) > 0 or not r.text for r in after.values())
        if k < 4:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, sf_dir, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        tables = tmp_path / name
        docs.write.parquet(f"file://{tables}/documents.parquet")
        for t in ("labels", "benchmark"):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (rows if name == "odd" else rows.where("false")).write.parquet(f"file://{tables}/{t}.parquet")
        if name == "odd":
            rows = spark.read.parquet(f"file://{tables}/documents.parquet")
            for stage, f in corpus_pipeline.STAGES:
                rows = common.stored(f(spark, rows, f"file://{tables}"), "odd")
                assert stage == "encoding" or rows.columns == docs.columns
            out = rows.collect()
        else:
            out = corpus_pipeline.run(spark, f"file://{tables}").collect()
        if name == "odd":  # nulls, empty texts and blanks are one group of near-duplicates; so are the copies
            assert Counter(r.doc_id for r in out) == {1: 1, None: 1, 3: 1, 4: 2, 7: 1} and all(r.n_links == r.toxicity == r.gone == "own" and r.decodes for r in out)
            assert {r.text for r in out if r.doc_id == 4} == {"same text"}
        else:
            assert out == []
