import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import languages, paths, quality
from quire.functions import text as T
from quire.operators import images, regroup, structure


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<int>' if v == [] or isinstance(v[0], int) else 'array<string>'}" for k, v in values.items()))
    return rows.select(column.alias("x")).first().x


def column_of(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("text,n,parts,status", [
    ("rojo |||| verde |||| azul", 3, ["rojo", "verde", "azul"], "ok"), ("sur |||| norte", 3, ["sur", "norte", "norte"], "padded"), ("1 |||| 2 |||| 3 |||| 4", 2, ["1", "2"], "cut"), ("", 1, [""], "ok"),
    (" \tpan ||||  sal  ||||\n vino", 3, ["pan", "sal", "vino"], "ok"), ("x", 4, None, "error"), ("p||||q||||r||||s", 1, None, "error"),
])
def test_split_group(spark, text, n, parts, status):
    got = one(spark, regroup.split_group(F.col("t"), F.col("n")), t=text, n=n)
    assert (got.parts, got.status) == (parts, status)


@pytest.mark.parametrize("texts,limit,groups", [(["uno dos", "tres", "cuatro"], 4, [0, 0, 0]), (["un texto que pasa del tope", "breve", "y este que lo pasa otra vez"], 4, [0, 1, 2]), (["x y"], 1, [0]), (["a", "b c", "d"], 3, [0, 0, 1]), ([], 5, []), (["w"] * 1000, 7, [i // 7 for i in range(1000)])])
def test_pack(spark, texts, limit, groups):
    got = one(spark, regroup.pack(F.transform("t", T.effective_words), limit), t=texts)
    assert got == groups


def effective(t):
    w = len(t.split())
    return 0 if not w else max(1, len(t) // 2) if len(t) / w > 15 else w


def test_words_and_white_space_are_pythons(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["", "  ", "a b", "日本語の文章がここにあります。とても長い", "x" * 31, *(f"{s}a{s}b{s}" for s in spaces), "".join(spaces)]
    assert column_of(spark, T.effective_words(F.col("t")), texts) == [effective(t) for t in texts]
    assert column_of(spark, T.trim(F.col("t")), texts) == [t.strip() for t in texts]
    assert column_of(spark, T.lead(F.col("t")), texts) == [t[: len(t) - len(t.lstrip())] for t in texts]
    lines = ["", "a", "a\n", "a\r\nb\x0bc\x1dd\x85e f", "\n\n", "a\r\rb"]
    assert column_of(spark, T.lines(F.col("t")), lines) == [t.splitlines() for t in lines]


@pytest.mark.parametrize("source,translation,labels", [
    ("Rain today", "Hoy llueve", []), ("Wait", "Espera...", [quality.ELLIPSIS]), ("Wait...", "Espera...", []), ("Wait…", "Espera...", []), ("Bread and milk", "* Pan\n* Leche", [quality.LISTS]),
    ("- bread\n- milk", "- pan\n- leche", []), ("Rain", "Aquí no puedo traducir nada", [quality.META]), ("Lluvia", "Sorry, I cannot translate it", [quality.META]),
    ("x", "I CAN'T translate...", [quality.ELLIPSIS, quality.META]),
])
def test_anomalies(spark, source, translation, labels):
    assert one(spark, quality.anomalies(F.col("s"), F.col("t")), s=source, t=translation) == labels


@pytest.mark.parametrize("text,links,notes,intact", [
    ("⟦2⟧ va antes que ⟦1⟧", [1], [2], True), ("solo queda ⟦1⟧", [1], [2], False), ("⟦1⟧, ⟦2⟧ y de más ⟦3⟧", [1], [2], False), ("nada marcado", [], [], True), ("⟦1⟧⟦2⟧", [1, 2], [], True), ("⟦1⟧ dos veces ⟦1⟧", [1], [], False),
])
def test_tokens(spark, text, links, notes, intact):
    assert one(spark, quality.tokens_intact(F.col("t"), F.col("l"), F.col("n")), t=text, l=links, n=notes) is intact


def test_guards(spark):
    words = " ".join(f"w{i}" for i in range(50))
    assert column_of(spark, quality.guard_error(F.lit("a b c"), F.col("t")), [words, "si no " * 25, " ".join(f"w{i}" for i in range(101)), "si " * 40]) == [None, "repetition 2", "length", None]


@pytest.mark.parametrize("text,clean", [("SALIDA\nENTRADA\nCAJA", "SALIDA\nENTRADA\nCAJA"), ("menú\npostre\nmenú", "menú\npostre"), ("4\nkm\nlejos", "4\nkm\nlejos"), ("", ""), ("\n\na1b\n\n\nxyz\na1b\n \n", "a1b\n\nxyz"), ("ab\nab", "ab\nab"), ("\n".join(f"línea {i % 300}" for i in range(3000)), "\n".join(f"línea {i}" for i in range(300)))])
def test_image_lines(spark, text, clean):
    assert one(spark, images.clean_lines(F.col("t")), t=text) == clean


def test_image_loop_and_prompt(spark):
    assert column_of(spark, images.is_loop(F.col("t")), ["a\n" * 5, "a\n" * 6, "a\nb\nc\nd\ne\nf", "a\na\na\na\na\nb\nc"]) == [False, True, False, True]
    prompt = one(spark, T.image_prompt(F.col("a"), F.col("b")), a="English", b="Spanish")
    assert "English" in prompt and "Spanish" in prompt and "[NO_TEXT]" not in prompt


def png(w, h):
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"\xff" * 3 * w for _ in range(h)))) + chunk(b"IEND", b"")


def test_image_discard(spark):
    rows = spark.createDataFrame([(1, bytearray(png(50, 50))), (2, bytearray(png(200, 200))), (3, bytearray(b"solo letras")), (4, bytearray(png(200, 99)))], "i int, content binary")
    assert [r.x for r in rows.orderBy("i").select(images.discard(F.col("content")).alias("x")).collect()] == [True, False, True, True]
    done = images.translate_images(rows, lambda content: "uno\nuno\ndos" if len(content) else "")
    assert {r.i: (r.status, r.translation) for r in done.collect()} == {1: ("small", None), 2: ("text", "uno\ndos"), 3: ("small", None), 4: ("small", None)}


PATHS = ["", ".", "a/b/../c", "../a", "a/../../b", "/", "/..", "/a/../..", "//a//b", "///a", "a//b/./c/", "..", "../..", "a/..", "x/y/../../../z"]


def test_paths(spark):
    assert column_of(spark, paths.normalize(F.col("t")), PATHS) == [posixpath.normpath(p) for p in PATHS]
    for start in ("a", "a/b", "x/y/z"):
        relative = [p for p in ("a/b/c", "a", "q/r", "x/y", "x/y/z", "a/b") if p]
        assert column_of(spark, paths.relative(F.col("t"), F.lit(start)), relative) == [posixpath.relpath(p, start) for p in relative]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab. !", max_size=6), min_size=1, max_size=6))
def test_merge_is_a_left_fold(spark, parts):
    buffer, want = parts[0], []
    for t in parts[1:]:
        s = t.lstrip()
        if not (buffer.rstrip()[-1:] in (".", "!", "?", ":", "…") and buffer.rstrip()) and s and s[0].islower():
            buffer += " " + t
        else:
            want.append(buffer)
            buffer = t
    want.append(buffer)
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(parts)], "doc_id int, pos int, text string")
    assert [r.text for r in regroup.merge_units(rows, ["doc_id"]).orderBy("unit_no").collect()] == want


def test_segments(spark):
    got = one(spark, structure.segments(F.col("t"), F.col("l"), F.col("n")), t="a ⟦1⟧⟦2⟧ b ⟦9⟧c", l=[1], n=[2])
    assert [(x.kind, x.text, x.idx) for x in got] == [("text", "a ", None), ("link", "", 1), ("note", "", 2), ("text", " b ", None), ("text", "c", None)]


def test_page_break_places(spark):
    texts, shares = ["hola mundo feliz", "sinespacios", " a", "a b c d e", "", "uno  dos"], [0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0]

    def cut(t, share):
        p = int(len(t) * share)
        b, a = t.rfind(" ", 0, p), t.find(" ", p)
        return p if b == a == -1 else a if b == -1 else b if a == -1 else b if p - b <= a - p else a

    rows = spark.createDataFrame([(t, s) for t in texts for s in shares], "t string, s double")
    for r in rows.withColumn("x", structure.break_at(F.col("t"), F.col("s"))).collect():
        assert r.x == cut(r.t, r.s), (r.t, r.s)


def test_languages(spark):
    assert languages.label("en") == "English / Inglés" and len(languages.LANGUAGES) == 39
    with pytest.raises(KeyError):
        languages.label("xx")
