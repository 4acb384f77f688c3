"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans which the patterns do not know.

The field labels zones, runs of neighbouring words that hold a digit or an at sign. A zone is cut into tokens; a labelling cuts it
into segments, each with one type and at most ``MAX_TOKENS`` tokens, or single tokens of no type. Features look at a whole segment
(its digits, groups, separators, check digits) and at what stands before and after it. Weights are fitted by gradient ascent on the
conditional log-likelihood of generated zones, whose generator is below; boundaries and types come from one Viterbi pass.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import session, utf8

KINDS = ("email", "ip", "card", "phone")
#: Types of the field; 0 is no type. Spans of a type are named after it.
TYPES = ("-", "email", "ip", "card", "phone", "iban", "national_id")
MAX_TOKENS = 16
#: Segments scored at once; a zone may hold any number.
SEGMENTS = 2_048
#: Added spans need this marginal score over the best labelling without them, in nats.
MARGIN = 1.0

_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), sorted. Each kind's matches are leftmost and do not overlap; failing ones are dropped."""
    found, last = [], 0
    for at in _AT.finditer(text):
        start, least = at.start(), last
        while start > least and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at.start() and (m := _DOMAIN.match(text, at.end())):
            found.append((start, 0, m.end()))
            last = m.end()
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_SEED = re.compile(r"[0-9@]|[\[({]at[\])}]", re.IGNORECASE)
_BRACKET = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
_LABELS = re.compile(r" ?[\w-]+(?:\.[\w-]+| ?[\[({]dot[\])}] ?[\w-]+)*", re.IGNORECASE)
_WORD, _BANK = re.compile(r"\S+"), re.compile(r" [A-Z]{4} ")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
_CUES = {
    "phone": re.compile(r"(?:phone|tel|teléfono|télé?phone|telefon|call|mobile|móvil|handy|fax|contact)\W*$", re.IGNORECASE),
    "card": re.compile(r"(?:card|visa|mastercard|tarjeta|carte|karte|kreditkarte)\W*$", re.IGNORECASE),
    "id": re.compile(r"(?:ssn|social security|security no|dni|nif|passport|ausweis|id|nir)\W*$", re.IGNORECASE),
    "iban": re.compile(r"(?:iban|account|konto|cuenta|compte)\W*$", re.IGNORECASE),
    "ip": re.compile(r"(?:ip|host|address|server|addr)\W*$", re.IGNORECASE),
}


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or at sign, one blank apart or with four capitals (a bank's code) between, however long."""
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        start = m.start()
        if out and start < out[-1][1]:
            continue
        least = out[-1][1] if out else 0
        while start > least and not text[start - 1].isspace():
            start -= 1
        w = _WORD.match(text, start)
        end = w.end()
        if (b := _BRACKET.search(text, start, end)) and _BRACKET.sub("", text[start:end]).count("@") == 0:
            if b.start() == start:
                word = start - (start > least and text[start - 1] == " ")
                while word > least and not text[word - 1].isspace():
                    word -= 1
                    start = word
            if n := _LABELS.match(text, b.end()):
                end = max(end, n.end())
        if out and (start - out[-1][1] <= 1 or start - out[-1][1] == 6 and _BANK.fullmatch(text, out[-1][1], start)):
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _features(zone: str, tokens: list[tuple[int, int]], i: int, j: int, before: str, after: str) -> list[str]:
    a, b = tokens[i][0], tokens[j - 1][1]
    s = zone[a:b]
    groups = re.findall(r"\d+", s)
    nd = sum(map(len, groups))
    seps = "".join(sorted(set(re.findall(r"[^\w]", s))))
    f = [f"nd={nd if nd < 20 else 20}", f"sep={seps}", f"ng={min(len(groups), 6)}", "span"]
    if len(groups) <= 5:
        f.append("len=" + "-".join(str(min(len(g), 9)) for g in groups))
    if re.search(r"[^\W\d_]", s):
        f.append("letters")
    left = zone[a - 1] if a else before[-1:]
    right = zone[b] if b < len(zone) else after[:1]
    if left.isalnum() or left in "@_":
        f.append("glued-left" if left else "edge")
    elif left in "-./:+":
        f.append("sign-left")
    if right.isalnum() or right == "@":
        f.append("glued-right")
    elif right in "-/:" and right:
        f.append("sign-right")
    if s[0] == "+":
        f.append("plus")
    if s[0] == "(":
        f.append("paren")
    if not (s[0].isalnum() or s[0] in "+("):
        f.append("odd-start")
    if not s[-1].isalnum():
        f.append("odd-end")
    if "@" in s or re.search(r"[\[({]\s?at\s?[\])}]", s, re.IGNORECASE):
        f.append("at-once" if len(re.findall(r"@|[\[({]\s?at\s?[\])}]", s, re.IGNORECASE)) == 1 else "at-many")
        if re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[({]\s?at\s?[\])}])\s?[\w-]+(?:\.[\w-]+|\s?[\[({]\s?dot\s?[\])}]\s?[\w-]+)+", s, re.IGNORECASE):
            f.append("mail-shape")
    if 13 <= nd <= 19 and not re.search(r"[^\d .-]", s):
        f.append("luhn" if luhn("".join(groups)) else "no-luhn")
    if len(groups) == 4 and seps == ".":
        f.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "no-octets")
    if re.fullmatch(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", s):
        plain = s.replace(" ", "")
        f.append("mod97" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "no-mod97")
    context = (before + zone[max(0, a - 24) : a])[-24:]
    f += [f"cue={k}" for k, cue in _CUES.items() if cue.search(context)] or ["no-cue"]
    return f


def _segments(zone: str, tokens: list[tuple[int, int]], before: str, after: str) -> Iterator[tuple[int, int, list[str]]]:
    """Candidate segments by their first token."""
    for i, (start, _) in enumerate(tokens):
        first = zone[start]
        kind = "d" if first.isdigit() else "w" if first.isalpha() else first
        yield i, i + 1, [f"o={kind}"]
        if not (kind in "dw" or first in "+("):
            continue
        digits, at = 0, False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            a, b = tokens[j - 1]
            digits += b - a if zone[a].isdigit() else 0
            at = at or zone[a] in "@[({" and not first == "("
            if j > i + 1 and not re.fullmatch(r"\s?", zone[tokens[j - 2][1] : a]):
                break
            if zone[b - 1].isalnum() and (digits >= 6 or at and zone[b - 1].isalpha()):
                yield i, j, _features(zone, tokens, i, j, before, after)


def _candidates(zone: str, before: str, after: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    tokens = [m.span() for m in _TOKEN.finditer(zone)]
    return tokens, list(_segments(zone, tokens, before, after))


class Field:
    """A semi-Markov field over candidate segments; types may stand next to each other freely."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.weights = np.zeros((0, len(TYPES)))

    def _scores(self, segments: list, grow: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        ids = []
        for i, j, f in segments:
            if grow:
                for x in f:
                    self.places.setdefault(x, len(self.places))
            ids.append(np.array([self.places[x] for x in f if x in self.places], np.int64))
        if grow and len(self.places) > len(self.weights):
            self.weights = np.vstack([self.weights, np.zeros((len(self.places) - len(self.weights), len(TYPES)))])
        out = np.array([self.weights[k].sum(0) for k in ids]) if ids else np.zeros((0, len(TYPES)))
        for s, (_, _, f) in enumerate(segments):
            if f[0].startswith("o="):
                out[s, 1:] = -np.inf
            else:
                out[s, 0] = -np.inf
        return out, ids

    def decode(self, n: int, segments: Iterable) -> list[tuple[int, int, int, float]]:
        """The best labelling's typed segments as (first token, end, type, score over its tokens left untyped).

        segments come by their first token, so that what ends there is settled; they are scored a part at a time.
        """
        best, back, plain = [0.0] + [-np.inf] * n, [None] * (n + 1), [0.0] * n
        segments = iter(segments)
        while part := list(islice(segments, SEGMENTS)):
            for (i, j, _), scores in zip(part, self._scores(part)[0], strict=True):
                y = int(np.argmax(scores))
                if y == 0:
                    plain[i] = float(scores[0])
                if best[i] + scores[y] > best[j]:
                    best[j], back[j] = best[i] + float(scores[y]), (i, y, float(scores[y]))
        out, j = [], n
        while j > 0:
            i, y, score = back[j]
            if y:
                out.append((i, j, y, score - sum(plain[i:j])))
            j = i
        return out[::-1]

    def fit(self, samples: list[tuple[int, list, dict]], rounds: int = 120, rate: float = 0.4, decay: float = 3e-4) -> None:
        """samples: number of tokens, segments, and the type of each gold segment by (first, end). All segments are scored at once."""
        every = [x for _, segments, _ in samples for x in segments]
        _, ids = self._scores(every, True)
        flat, size = np.concatenate(ids), np.array([len(k) for k in ids])
        starts, kinds = np.cumsum(size) - size, len(TYPES)
        plain = np.array([f[0].startswith("o=") for _, _, f in every])
        allowed = np.where((np.arange(kinds) == 0) == plain[:, None], 0.0, -np.inf)
        truth = np.zeros((len(every), kinds))
        at = 0
        for _, segments, gold in samples:
            for s, (i, j, _) in enumerate(segments, at):
                y = gold.get((i, j), 0 if plain[s] and not any(a <= i < b for a, b in gold) else None)
                if y is not None and np.isfinite(allowed[s, y]):
                    truth[s, y] = 1
            at += len(segments)
        squares = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            scores = np.add.reduceat(self.weights[flat], starts) + allowed
            total = np.logaddexp.reduce(scores, axis=1).tolist()
            outside, at = [], 0
            for n, segments, _ in samples:
                outside += _outside(n, segments, total[at : at + len(segments)])
                at += len(segments)
            off = np.exp(scores + np.array(outside)[:, None]) - truth
            step = np.column_stack([np.bincount(flat, np.repeat(off[:, y], size), len(self.weights)) for y in range(kinds)])
            step = -step / len(samples) - decay * self.weights
            squares += step * step
            self.weights += rate * step / np.sqrt(squares)


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _outside(n: int, segments: list, total: list[float]) -> list[float]:
    """For each segment the log of all that stands around it over the sum of all labellings. Segments come by their first token."""
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for (i, j, _), x in zip(segments, total, strict=True):
        ahead[j] = _log_sum(ahead[j], ahead[i] + x)
    for (i, j, _), x in zip(reversed(segments), reversed(total), strict=True):
        behind[i] = _log_sum(behind[i], behind[j] + x)
    return [ahead[i] + behind[j] - ahead[n] for i, j, _ in segments]


def _generated(rng: random.Random) -> tuple[str, str, str, list[tuple[int, int, int]]]:
    """(before, zone, after, gold spans): one zone with its context, typed or ordinary."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card(valid: bool = True) -> str:
        x = d(15)
        c = next(k for k in "0123456789" if luhn(x + k))
        x += c if valid else str((int(c) + rng.randint(1, 9)) % 10)
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def iban(valid: bool = True) -> str:
        letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        land, body = rng.choice([("DE", d(18)), ("ES", d(20)), ("FR", d(10) + rng.choice("AKMX0123") + d(10) + d(2)), ("GB", letters(4) + d(14)), ("NL", letters(4) + d(10)), ("IT", letters(1) + d(22)), ("CH", d(17))])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        x = f"{land}{(check if valid else check % 96 + 2):02d}{body}"
        return x if rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    phone = [lambda: f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(3)}", lambda: f"+{rng.randint(1, 99)}{d(9)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(2)} {d(3)} {d(3)} {d(2)}"]
    mail = lambda at, dot: f"{word()}{rng.choice(['.', '_', '', '-'])}{rng.choice([word(), d(2)])}{at}{word()}{rng.choice(['', d(1)])}{dot}{rng.choice(['com', 'org', 'de', 'example' + dot + 'com'])}"
    kind = rng.choices(range(14), [3, 2, 2, 2, 4, 4, 2, 2, 2, 2, 2, 2, 2, 2])[0]
    cue, s, y = "", "", 0
    if kind == 0:
        s, y = mail("@", "."), 1
    elif kind == 1:
        s, y = mail(rng.choice(["[at]", "(at)", " [at] ", "{at}"]), rng.choice([".", "[dot]", " [dot] ", "(dot)"])), 1
    elif kind == 2:
        s, y, cue = ".".join(str(rng.randint(0, 255)) for _ in range(4)), 2, rng.choice(["", "ip ", "host "])
    elif kind == 3:
        s, y, cue = card(), 3, rng.choice(["", "card ", "visa: "])
    elif kind == 4:
        s, y, cue = rng.choice(phone)(), 4, rng.choice(["", "", "phone: ", "tel ", "call "])
    elif kind == 5:
        s, y, cue = iban(), 5, rng.choice(["", "", "IBAN ", "konto: ", "account "])
    elif kind == 6:
        s, y, cue = f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{d(4)}", 6, rng.choice(["", "SSN ", "id: "])
    elif kind == 7:
        s = rng.choice([lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}"])()
    elif kind == 8:
        s = rng.choice([lambda: f"{d(1)}.{d(1)}", lambda: f"{d(2)},{d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(1)}.{d(2)}.{d(3)}.{rng.randint(256, 999)}"])()
    elif kind == 9:
        s = d(rng.randint(6, 24))
    elif kind == 10:
        s = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 24, 32, 40])))
    elif kind == 11:
        s = card(False)
    elif kind == 13:
        s = iban(False)
    else:
        s = " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(2, 7)))
    lead, tail = rng.choice(["", "", "(", '"', word() + "."]) if kind != 1 else "", rng.choice(["", "", ".", ",", ")", '"'])
    before, after = f"{word()} {cue}", f" {word()}"
    if lead.endswith(".") and (y == 1 or kind in (10,)):
        lead = ""
    zone = lead + s + tail
    return before, zone, after, [(len(lead), len(lead) + len(s), y)] if y else []


@lru_cache(maxsize=2)
def trained(samples: int = 700, seed: int = 7) -> Field:
    """The field, fitted on so many generated zones."""
    rng, rows = random.Random(seed), []
    while len(rows) < samples:
        before, zone, after, gold = _generated(rng)
        tokens, segments = _candidates(zone, before, after)
        by = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j, f in segments if not f[0].startswith("o=")}
        if all((a, b) in by for a, b, _ in gold):
            rows.append((len(tokens), segments, {by[(a, b)]: y for a, b, y in gold}))
    field = Field()
    field.fit(rows)
    return field


def model_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(start, type, end) of the field's spans that overlap no base span."""
    out = []
    for a, b in zones(text):
        before = text[max(0, a - 24) : a]
        zone = text[a:b]
        tokens = [m.span() for m in _TOKEN.finditer(zone)]
        segments = _segments(zone, tokens, before, text[b : b + 2])
        ahead = list(islice(segments, SEGMENTS))
        if len(ahead) == len(tokens) < SEGMENTS:
            continue
        for i, j, y, gain in field.decode(len(tokens), chain(ahead, segments)):
            s, e = a + tokens[i][0], a + tokens[j - 1][1]
            if gain >= MARGIN and not any(s < z and x < e for x, _, z in base):
                out.append((s, y, e))
    return out


ROW = StructType([StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_added", LongType())])
_ROW = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in ROW])


def describe(text: str, field: Field) -> dict:
    base = base_spans(text)
    added = model_spans(text, base, field) if re.search(_SEED, text) else []
    named = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in base]
    every = sorted(named + [(s, len(KINDS) + y, f"{TYPES[y]}:{s}:{e}") for s, y, e in added])
    row = {f"n_{k}": sum(1 for x in base if x[1] == i) for i, k in enumerate(KINDS)}
    return row | {"base_sha256": hashlib.sha256(",".join(x[2] for x in named).encode()).hexdigest(), "spans": ",".join(x[2] for x in every), "n_added": len(added)}


def pii_spans(docs: DataFrame, field: Field | None = None, name: str = "pii") -> DataFrame:
    """docs with a struct column ``name``: counts, base_sha256 and spans (kind:start:end by start, in code points).

    Null texts are empty; repeated rows repeat their result; a column of docs with that name is replaced. Each text is read whole.
    """
    session(docs)
    field = field or trained()

    @F.arrow_udf(ROW)
    def find(texts: pa.Array) -> pa.Array:
        data, at = utf8(texts)
        return pa.array([describe(str(data[a:b], "utf-8"), field) for a, b in zip(at[:-1], at[1:], strict=True)], _ROW)

    return docs.withColumn(name, find("text"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts and hash of the base spans, all spans, and how many the field added. Null and empty texts have none;
    where an added span would overlap a base one the base one stays; repeated rows repeat theirs; texts are read whole."""
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii.*")
