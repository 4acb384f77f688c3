"""Output guards and anomaly checks of translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import effective_words, n_words, words

# Labels of reports, and the patterns that they stand for.
ELLIPSIS = "puntos suspensivos no presentes en el original"
LISTS = "listas/explicaciones no presentes en el original"
META = "posible meta-comentario del modelo"
LIST_MARK = r"(?mdU)(?:^\s*[\*\-•]\s+\*{0,2}\S|\*\s+\*{2}\S)"
META_PHRASES = (r"se traduce como", r"por favor[,\s]+(proporciona|proporcione|provide)", r"no puedo traducir", r"texto (completo|que desea)", r"I cannot translate", r"I can'?t translate")
#: Words from which the guards look, and the share of one pair or triple of words that is too much.
GUARD_WORDS, PAIR_SHARE, TRIPLE_SHARE = 40, 0.10, 0.15
#: Output is too long from 4 times the input's words and 100 words on.
LENGTH_FACTOR, LENGTH_WORDS = 4, 100


def frequent_gram(found: Column, n: int, share: float) -> Column:
    """Whether some run of n words of an array makes up more than a share of all its runs.

    Runs are hashed to 64 bits and sorted; one occurs more than m times where a hash equals the one m places on. No row leaves its task,
    and the work is that of a sort of numbers.
    """
    count = F.size(found) - n + 1
    hashes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(n)))))
    most = F.floor(count * F.lit(share)).cast("int")

    def repeats(h: Column) -> Column:
        return F.when(most >= F.size(h), False).otherwise(F.exists(F.sequence(F.lit(0), F.size(h) - 1 - most), lambda i: F.get(h, i) == F.get(h, i + most)))

    return F.when(F.size(found) < n, False).otherwise(F.transform(F.array(hashes), repeats)[0])


def repetition(text: Column) -> Column:
    """'2' or '3' for the first length of runs of words that repeats too much, else null. The array of words is bound only once."""

    def judge(w: Column) -> Column:
        return F.when(frequent_gram(w, 2, PAIR_SHARE), "2").when(frequent_gram(w, 3, TRIPLE_SHARE), "3")

    return F.when(n_words(text) > GUARD_WORDS, F.transform(F.array(words(text)), judge)[0])


def too_long(n_out: Column, n_in: Column) -> Column:
    return (n_out > GUARD_WORDS) & (n_out > LENGTH_FACTOR * n_in) & (n_out > LENGTH_WORDS)


def guard_error(source: Column, translation: Column) -> Column:
    """The reason to reject a translation, or null; both guards need over 40 words."""
    return F.coalesce(F.concat(F.lit("repetition "), repetition(translation)), F.when(too_long(n_words(translation), effective_words(source)), "length"))


def anomalies(source: Column, translation: Column) -> Column:
    """The labels of what a translation has and its source has not, in a fixed order."""
    dots = translation.contains("...") & ~source.contains("...") & ~source.contains("…")
    lists = (F.regexp_count(translation, F.lit(LIST_MARK)) >= 2) & (F.regexp_count(source, F.lit(LIST_MARK)) == 0)
    meta = F.lit(False)
    for p in META_PHRASES:
        meta = meta | (translation.rlike(f"(?iu){p}") & ~source.rlike(f"(?iu){p}"))
    return F.array_compact(F.array(F.when(dots, ELLIPSIS), F.when(lists, LISTS), F.when(meta, META)))


def tokens(text: Column) -> Column:
    """The sorted numbers of a text's opaque tokens."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"⟦(\d+)⟧"), F.lit(1)), lambda x: x.cast("int")))


def tokens_intact(translation: Column, links: Column, notes: Column) -> Column:
    """Whether a translation has each expected token once and no other; links and notes are arrays of numbers."""
    return tokens(translation) == F.array_sort(F.array_union(links, notes))
