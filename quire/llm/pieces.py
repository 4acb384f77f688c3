"""Sampled SentencePiece segmentations without replacement, by a perturbed A-star search over the piece lattice, and decoding.

All ways to spell a text with the vocabulary's pieces form a lattice; a piece's weight falls with its rank, and exact backward sums make
the weights probabilities of whole segmentations. The search keeps a queue of sets of segmentations that share a prefix, each with the
largest Gumbel-perturbed log-probability of its members. The set with the largest one is opened: its best segmentation is emitted, and
the rest of it is split, at each piece, into the segmentations that agree up to there and then differ, whose maxima are drawn below the
opened one's. Emissions are distinct by construction and follow the Gumbel top-k law. All texts of a batch are searched side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import mixed, session, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
#: Zipf-Mandelbrot shift of a piece's rank; exponent on weights (1: as they are, 0: all segmentations alike); log-probability a byte.
SHIFT, SHARPNESS, BYTE = 20.0, 1.0, -12.0
#: Positions of lattices that a Python worker keeps, of about 130 bytes each with their strings.
MAX_POINTS = 1_000_000
#: Bytes of text that are searched at once: few enough for the arrays to stay in the processor's cache.
SEARCH_BYTES = 512 << 10
BLANK, LITERAL, END = "▁", "\udfff", "\udffe"
_TYPES = re.compile("▁+[^▁\n]*|\n[^▁\n]*")
_B, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bits of a hash that choose a slot; marks of slots that a longer piece's beginning falls into, or a second piece.
_SLOTS, _LONGER, _SECOND = 19, 1 << 30, 1 << 29
#: Nats a character that are added to all weights, so that sums over segmentations neither grow nor vanish by much, and distances from
#: a string's end after which they are made 1 again. Segmentations of a string all have its characters, so no probability changes.
LEVEL, RENEW = 5.0, 32


class Vocabulary:
    """Pieces, their weights, and a table from hashes of strings to pieces. It is read on the driver and sent with the task."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if crossing := [p for p in (self.pieces[i] for i in plain) if re.search(f"[^{BLANK}]{BLANK}|.\n", p, re.DOTALL)]:
            raise ValueError(f"pieces that go on beyond a word's start are not supported: {crossing[:3]}")
        if max(len(self.pieces[i]) for i in plain) > 127:
            raise ValueError("pieces of over 127 characters are not supported")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        mass = np.array([1 / (SHIFT + r) for r in range(len(order))])
        self.weights = np.zeros(n)
        self.weights[order] = SHARPNESS * np.log(mass / mass.sum())
        self._index(plain)

    def _index(self, plain: list[int]) -> None:
        hashes, longer = np.zeros(len(self.pieces), np.uint64), set()
        for i in plain:
            h = 0
            for c in self.pieces[i]:
                longer.add(h)
                h = (h * int(_B) + ord(c) + 1) & (1 << 64) - 1
            hashes[i] = h
        longer.discard(0)
        slots = ((hashes * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.hashes, self.first, second = hashes, np.zeros(1 << _SLOTS, np.int32), {}
        for i in plain:
            if self.first[slots[i]]:
                second[int(hashes[i])] = i
            else:
                self.first[slots[i]] = i
        self.first[slots[list(second.values())]] |= _SECOND
        self.first[(np.array(sorted(longer), np.uint64) * _SPREAD) >> np.uint64(64 - _SLOTS)] |= _LONGER
        self.more = np.array(sorted(second), np.uint64)
        self.more_ids = np.array([second[int(h)] for h in self.more], np.int32)
        self.most = max(len(self.pieces[i]) for i in plain)
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], np.int32)
        spell = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            spell[i] = bytes([b])
        self.spellings = pa.array(spell, pa.large_binary())
        # The last place stands for piece -1, a character spelt in bytes.
        self.mass = np.append(np.exp(self.weights + LEVEL * np.array([len(p) for p in self.pieces])), np.exp(BYTE + LEVEL))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "bytes": self.bytes, "weights": self.weights, "plain": np.nonzero(self.hashes)[0].tolist()}

    def __setstate__(self, state: dict) -> None:
        self.pieces, self.bytes, self.weights = state["pieces"], state["bytes"], state["weights"]
        self._index(state["plain"])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each hash, 0 where there is none (id 0 is the unknown piece), and whether a longer piece may begin like it."""
        got = self.first[(h * _SPREAD) >> np.uint64(64 - _SLOTS)]
        piece = got & (_SECOND - 1)
        piece[self.hashes[piece] != h] = 0
        if len(self.more):
            rest = np.flatnonzero((piece == 0) & (got & _SECOND != 0))
            at = np.searchsorted(self.more, h[rest]).clip(0, len(self.more) - 1)
            hit = self.more[at] == h[rest]
            piece[rest[hit]] = self.more_ids[at[hit]]
        return piece, got & _LONGER != 0


def _split(text: str) -> list[str]:
    """The parts of a text that no piece crosses: a word with the blank before it, written without that blank, or with all of several;
    or a line feed with what follows it."""
    text = text.replace(BLANK, LITERAL)
    return [t if t[0] == "\n" or t[1:2] == BLANK else t[1:] for t in _TYPES.findall(BLANK + text.replace(" ", BLANK))]


def _plain(text: str) -> bool:
    """Whether _split needs no more than a cut at blanks."""
    return not ("  " in text or " \n" in text or "\n " in text or BLANK in text or text[:1] == " " or text[-1:] == " ")


class _Numbers(dict):
    """Numbers words as they are asked for; ``new`` are those that no lattice has been built for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of texts, one text after another, and how many each has. Arrow cuts all but odd texts."""
        plain = np.fromiter(map(_plain, texts), bool, len(texts)) & np.fromiter(map(bool, texts), bool, len(texts))
        column = pa.array([t for t, p in zip(texts, plain.tolist(), strict=True) if p], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self]
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.new += new
        known = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        per = np.zeros(len(texts), np.int64)
        per[plain] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        own = known[coded.indices.to_numpy()] if len(known) else known
        if plain.all():
            return own, per
        odd = [[self[w] for w in _split(t)] if t else [] for t, p in zip(texts, plain.tolist(), strict=True) if not p]
        per[~plain] = [len(x) for x in odd]
        out, is_plain = np.empty(int(per.sum()), np.int64), np.repeat(plain, per)
        out[is_plain], out[~is_plain] = own, np.array([n for x in odd for n in x], np.int64)
        return out, per


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, one run after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Lattice:
    """The lattices of distinct strings, one after another, each followed by an end position; strings are added as they come.

    The edges at position p are first[p] to first[p + 1], by size. An edge has its size in characters, its piece (-1: one character
    spelt in bytes), and the logarithms of its probability there and of that of all others together. A draw looks at the likeliest edge
    first, then at the others in turn.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.numbers, self.used, self.edges = vocabulary, _Numbers(), 0, 0
        self.positions = {"points": np.zeros(1 << 16, np.uint32), "first": np.zeros(1 << 16, np.int32), "best": np.zeros(1 << 16, np.int32), "likely": np.zeros(1 << 16, np.float32)}
        self.by_edge = {"size": np.zeros(1 << 17, np.int8), "piece": np.zeros(1 << 17, np.int32), "log_p": np.zeros(1 << 17, np.float32), "other": np.zeros(1 << 17, np.float32)}
        self.start, self.end, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def drop_rare(self) -> None:
        """Forgets the strings that were asked for once only since the last time, or all if the others fill half of MAX_POINTS."""
        own = np.flatnonzero(self.uses > 1)
        size = self.end[own] - self.start[own] + 1
        if 2 * int(size.sum()) > MAX_POINTS:
            own, size = own[:0], size[:0]
        words = list(self.numbers)
        self.numbers = _Numbers()
        self.numbers.update(zip([words[i] for i in own.tolist()], range(len(own)), strict=True))
        first_edge = self.positions["first"][self.start[own]].astype(np.int64)
        n_edges = self.positions["first"][self.end[own]] - first_edge
        places, moved = _runs(self.start[own], size), np.repeat(np.cumsum(n_edges) - n_edges - first_edge, size)
        edges = _runs(first_edge, n_edges)
        self.used, self.edges = len(places), len(edges)
        for name, x in self.positions.items():
            x[: self.used] = x[places] + moved if name in ("first", "best") else x[places]
        for x in self.by_edge.values():
            x[: self.edges] = x[edges]
        self.positions["first"][self.used] = self.edges
        begin = np.cumsum(size) - size
        self.start, self.end, self.uses = begin, begin + size - 1, np.zeros(len(own), np.int32)

    @staticmethod
    def _room(arrays: dict[str, np.ndarray], used: int, more: int) -> None:
        for name, old in arrays.items():
            if used + more > len(old):
                arrays[name] = np.zeros(max(used + more, 2 * len(old)), old.dtype)
                arrays[name][:used] = old[:used]

    def grow(self) -> None:
        """Builds the lattices of the strings that were numbered since the last call."""
        if not self.numbers.new:
            return
        # Each gets the blank before it unless it starts with a line feed or a blank of its own.
        strings = (END + BLANK) + (END + BLANK).join(self.numbers.new) + END
        strings = strings.replace(END + BLANK + "\n", END + "\n").replace(END + BLANK + BLANK, END + BLANK)
        self.numbers.new.clear()
        points = np.frombuffer(strings.encode("utf-32-le", "surrogatepass"), np.uint32)[1:]
        n = len(points)
        ends = np.flatnonzero(points == ord(END))
        begin = np.append(0, ends[:-1] + 1)
        left = np.repeat(ends, ends - begin + 1) - np.arange(n)
        pos, size, piece, count = self._edges(points, left)
        first = np.append(0, np.cumsum(count))
        p = self._shares(pos, size, self.vocabulary.mass[piece], count, first, left)
        with np.errstate(divide="ignore"):
            log_p = np.log(p).astype(np.float32)
        p = p.astype(np.float32)
        heads = first[:-1][count > 0]
        top = np.maximum.reduceat(p, heads)
        best_at = np.nonzero(p == np.repeat(top, count[count > 0]))[0]
        best, likely = np.zeros(n, np.int64), np.zeros(n)
        best[pos[best_at]] = best_at
        likely[count > 0] = np.where(count[count > 0] == 1, 2.0, top)
        first = first[:-1]
        self._room(self.positions, self.used, n + 1)
        self._room(self.by_edge, self.edges, len(pos))
        where, own = slice(self.used, self.used + n), slice(self.edges, self.edges + len(pos))
        for name, x in (("points", points), ("first", first + self.edges), ("best", best + self.edges), ("likely", likely)):
            self.positions[name][where] = x
        with np.errstate(divide="ignore"):
            other = np.log1p(-np.minimum(p, np.float32(0.999)))
            # The likeliest edge may leave less than its own rounding error, so the others there are summed.
            p[best[count > 0]] = 0
            other[best[count > 0]] = np.log(np.add.reduceat(p, heads))
        for name, x in (("size", size), ("piece", piece), ("log_p", log_p), ("other", other)):
            self.by_edge[name][own] = x
        self.start, self.end = np.append(self.start, begin + self.used), np.append(self.end, ends + self.used)
        self.uses = np.append(self.uses, np.zeros(len(ends), np.int32))
        self.used += n
        self.edges += len(pos)
        self.positions["first"][self.used] = self.edges

    def _edges(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, size, piece) of all edges by position, then size; and how many each position has."""
        n = len(points)
        shifted = np.append(points, np.zeros(self.vocabulary.most, np.uint32)).astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero(left > 0)
        h, found, count = np.zeros(len(at), np.uint64), [], np.zeros(n, np.int32)
        for size in range(1, self.vocabulary.most + 1):
            h = h * _B + shifted[at + (size - 1)]
            piece, longer = self.vocabulary.find(h)
            if size == 1:
                piece[piece == 0] = -1
                found.append((at, piece))
            else:
                own = np.flatnonzero(piece)
                found.append((at[own], piece[own]))
            count[found[-1][0]] += 1
            longer = np.flatnonzero(longer)
            at, h = at[longer], h[longer]
            if not len(at):
                break
        free = np.cumsum(count) - count
        total = int(count.sum())
        pos, sizes, pieces = np.zeros(total, np.int64), np.zeros(total, np.int8), np.zeros(total, np.int32)
        for size, (where, piece) in enumerate(found, 1):
            place = free[where]
            pos[place], sizes[place], pieces[place] = where, size, piece
            free[where] = place + 1
        return pos, sizes, pieces, count

    def _shares(self, pos: np.ndarray, size: np.ndarray, mass: np.ndarray, count: np.ndarray, first: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Each edge's probability at its position, by sums over all ways to a string's end, nearest positions first."""
        most = int(left.max())
        at = np.flatnonzero(count)
        away = left[at]
        order = at[np.argsort(away.astype(np.uint16) if most < 1 << 16 else away, kind="stable")]
        n_edges = count[order]
        heads = np.append(0, np.cumsum(n_edges))
        back = np.repeat(first[order] - heads[:-1], n_edges) + np.arange(len(pos))
        to, mass = (pos + size)[back], mass[back]
        bounds = np.append(0, np.cumsum(np.bincount(away, minlength=most + 1)[1:])).tolist()
        behind, sums = np.zeros(len(left)), np.zeros(len(pos))
        behind[left == 0] = 1.0
        cut, start = heads[bounds].tolist(), 0
        for a in range(1, most + 1):
            lo, hi, own = bounds[a - 1], bounds[a], slice(cut[a - 1], cut[a])
            sums[own] = mass[own] * behind[to[own]]
            behind[order[lo:hi]] = np.add.reduceat(sums[own], heads[lo:hi] - cut[a - 1])
            if a - start == max(RENEW, self.vocabulary.most) or a == most:
                own = slice(bounds[start], hi)
                sums[cut[start] : cut[a]] /= np.repeat(behind[order[own]], n_edges[own])
                start = a
                if a < most:
                    behind[order[lo:hi, None] + np.arange(self.vocabulary.most)] /= behind[order[lo:hi]][:, None]
        out = np.empty_like(sums)
        out[back] = sums
        return out

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge at each position, for uniform u."""
        out = self.positions["best"][at]
        rest = np.nonzero(u >= self.positions["likely"][at])[0]
        left = u[rest] - self.positions["likely"][at[rest]]
        edge, stop, best = self.positions["first"][at[rest]], self.positions["first"][at[rest] + 1], out[rest]
        while len(rest):
            left = left - np.where(edge == best, 0.0, np.exp(self.by_edge["log_p"][edge]))
            out[rest] = np.where(edge == best, out[rest], edge)  # the last one tried stands where rounding leaves a remainder
            keep = ((left >= 0) | (edge == best)) & (edge + 1 < stop)
            rest, left, edge, stop, best = rest[keep], left[keep], edge[keep] + 1, stop[keep], best[keep]
        return out

    def spread(self, at: np.ndarray) -> np.ndarray:
        """Probabilities at few positions, by size."""
        p, edge, stop = np.zeros((len(at), self.vocabulary.most)), self.positions["first"][at], self.positions["first"][at + 1]
        for k in range(self.vocabulary.most):
            own = np.nonzero(edge + k < stop)[0]
            e = edge[own] + k
            p[own, self.by_edge["size"][e] - 1] = np.exp(self.by_edge["log_p"][e].astype(float))
        return p

    def pick_other(self, at: np.ndarray, u: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Like pick, among edges whose place by size in the rows of ``taken`` is not set."""
        full = self.spread(at)
        p = np.where(taken, 0.0, full)
        sums = np.cumsum(p, axis=1)
        chosen = np.minimum((sums <= u[:, None] * sums[:, -1:]).sum(1), p.shape[1] - 1 - (p > 0)[:, ::-1].argmax(1))
        return self.positions["first"][at] + np.cumsum(full > 0, axis=1)[np.arange(len(at)), chosen] - 1


def _fraction(h: np.ndarray) -> np.ndarray:
    return ((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    return _fraction(seed + (count.astype(np.uint64) + np.uint64(1)) * _B)


def _below(limit: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of Gumbels of that total mass, given that it is below a limit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-limit, np.log(-np.log(u)) - log_mass))


def search(net: Lattice, texts: list[str], keys: np.ndarray, samples: int = SAMPLES) -> list[list[dict]]:
    """For each text up to ``samples`` distinct segmentations as dicts of ids, log_p, perturbed, log_inclusion, decoded (bytes)."""
    docs = len(texts)
    vocabulary = net.vocabulary
    kind, per = net.numbers.of(texts)
    if not len(kind):
        return [[{"ids": np.zeros(0, np.int32), "log_p": 0.0, "perturbed": 0.0, "log_inclusion": 0.0, "decoded": b""}] for _ in texts]
    net.grow()
    seen = np.zeros(len(net.uses), bool)
    seen[kind] = True
    net.uses += seen
    word_start, word_end = net.start[kind], net.end[kind]
    size = word_end - word_start
    word_at = np.cumsum(size) - size
    total = int(size.sum())
    word_doc = np.repeat(np.arange(docs), per)
    doc_words = np.cumsum(per) - per
    chars = np.bincount(word_doc, size, docs).astype(np.int64)
    doc_at = np.cumsum(chars) - chars
    seeds = mixed(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))

    live = chars > 0
    cut, base = doc_at.copy(), np.zeros(docs)
    now = np.where(live, -np.log(-np.log(_uniform(seeds, np.full(docs, 1 << 62)))), -np.inf)
    taken = np.zeros((docs, vocabulary.most), bool)
    heads: list[tuple[np.ndarray, bytes]] = [(np.zeros(0, np.int32), b"")] * docs
    paths: list[_Path] = []
    special: list[dict] = []  # sets that were opened before, by round: what is left of them
    out: list[list[dict]] = [[] for _ in texts]
    for r in range(samples + 1):
        if r:
            best, parent, which = np.full(docs, -np.inf), np.full(docs, -1), np.full(docs, -1)
            for q, path in enumerate(paths):
                m = path.largest()
                better = m > best
                best[better], parent[better], which[better] = m[better], q, -1
            for q, left in enumerate(special):
                better = left["best"] > best
                best[better], which[better] = left["best"][better], q
            live = np.isfinite(best)
            if r == samples or not live.any():
                break
            now = best
            taken[:] = False
            heads = list(heads)
            for q, path in enumerate(paths):
                own = np.nonzero(live & (which < 0) & (parent == q))[0]
                if len(own):
                    edge = path.open(own, best)
                    cut[own], base[own] = path.places[edge], path.before[edge]
                    taken[own, net.by_edge["size"][path.edges[edge]] - 1] = True
                    begin, n_ids = path.firsts[own], path.at[edge] - path.at[path.firsts[own]]
                    n_bytes = path.ends[path.at[edge]] - path.ends[path.at[begin]]
                    for d, i, j in zip(own.tolist(), n_ids.tolist(), n_bytes.tolist(), strict=True):
                        heads[d] = (path.ids[d][: i + path.id_base[d]], path.data[d][: j + path.byte_base[d]])
            for q, left in enumerate(special):
                own = np.nonzero(live & (which == q))[0]
                cut[own], base[own], taken[own] = left["cut"][own], left["base"][own], left["taken"][own]
                left["best"][own] = -np.inf
                for d in own.tolist():
                    heads[d] = left["heads"][d]
        # Draw the rest of each text from its cut on: first the piece at the cut, then word by word.
        edge_at = np.zeros(total, np.int32)  # one more than the edge that starts at a character
        word_cut = np.searchsorted(word_at, cut, side="right") - 1
        active = np.flatnonzero(np.arange(len(kind)) >= np.where(live, np.maximum(word_cut, 0), len(kind))[word_doc]) if r else np.arange(len(kind))
        place, at, stop = word_at[active], word_start[active], word_end[active]
        salt = (seeds + ((r << 40) + 1 - doc_at).astype(np.uint64) * _B)[word_doc[active]]  # _uniform's seed and count, but for the place
        if r:
            f = np.flatnonzero(active == word_cut[word_doc[active]])
            d = word_doc[active[f]]
            inside = cut[d] - place[f]
            place[f], at[f] = cut[d], at[f] + inside
            n = net.pick_other(at[f], _uniform(seeds[d], place[f] - doc_at[d] + (r << 40)), taken[d])
            edge_at[place[f]] = n + 1
            net_at_cut, cut_size = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            size_f = net.by_edge["size"][n].astype(np.int64)
            net_at_cut[d], cut_size[d] = at[f], size_f
            place[f] += size_f
            at[f] += size_f
            keep = np.flatnonzero(at < stop)
            place, at, stop, salt = place[keep], at[keep], stop[keep], salt[keep]
        while len(at):
            n = net.pick(at, _fraction(salt + place.astype(np.uint64) * _B))
            edge_at[place] = n + 1
            size_n = net.by_edge["size"][n]
            at = at + size_n
            keep = np.flatnonzero(at < stop)
            place, at, stop, salt = (place + size_n)[keep], at[keep], stop[keep], salt[keep]
        places = np.nonzero(edge_at)[0]
        edges = edge_at[places] - 1
        firsts = np.append(np.searchsorted(places, doc_at), len(places))
        doc_of = np.repeat(np.arange(docs), np.diff(firsts))
        sums = np.append(0.0, np.cumsum(net.by_edge["log_p"][edges], dtype=float))
        before = sums[:-1] + (base - sums[firsts[:-1]])[doc_of]
        mass = before + net.by_edge["other"][edges]
        maxima = _below(now[doc_of], mass, _fraction((seeds + ((r << 40) + (1 << 39) + 1 - doc_at).astype(np.uint64) * _B)[doc_of] + places.astype(np.uint64) * _B))
        if r:
            maxima[places == cut[doc_of]] = -np.inf
            own = np.nonzero(live)[0]
            left = taken.copy()
            left[own, cut_size[own] - 1] = True
            rest = np.where(left[own], 0.0, net.spread(net_at_cut[own])).sum(1)
            new_best = np.full(docs, -np.inf)
            with np.errstate(divide="ignore"):
                new_best[own] = _below(now[own], base[own] + np.log(rest), _uniform(seeds[own], np.full(len(own), (1 << 61) + r)))
            special.append({"best": new_best, "cut": cut.copy(), "base": base.copy(), "taken": left, "heads": heads})
        path = _Path(places, edges, before, maxima, firsts)
        path.spell(net, kind, word_at, heads, live if r else np.ones(docs, bool))
        paths.append(path)
        log_p = base + sums[firsts[1:]] - sums[firsts[:-1]]
        for d in np.nonzero(live if r else np.ones(docs, bool))[0].tolist():
            out[d].append({"ids": path.ids[d], "log_p": float(log_p[d]), "perturbed": float(now[d]) if chars[d] else 0.0, "log_inclusion": 0.0, "decoded": path.data[d][1:]})
    for d, found in enumerate(out):  # the largest maximum left is the threshold that the emitted ones exceed
        for x in found:
            gap = x["log_p"] - best[d] if np.isfinite(best[d]) else np.inf
            x["log_inclusion"] = 0.0 if gap > 30 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else float(gap)
    return out


class _Path:
    """The edges that one round drew for each text, from its cut on, with the log-probability before each edge and the maximum of the
    segmentations that agree up to it and then differ; and, spelt out by text, all ids and bytes, those before the cut included."""

    def __init__(self, places: np.ndarray, edges: np.ndarray, before: np.ndarray, maxima: np.ndarray, firsts: np.ndarray) -> None:
        self.places, self.edges, self.before, self.maxima, self.firsts = places, edges, before, maxima, firsts

    def largest(self) -> np.ndarray:
        a, b = self.firsts[:-1], self.firsts[1:]
        m = np.maximum.reduceat(np.append(self.maxima, -np.inf), np.minimum(a, len(self.maxima)))
        m[a == b] = -np.inf
        return m

    def open(self, docs: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The edges that hold the texts' largest maxima, which are taken away."""
        mine = np.full(len(self.firsts) - 1, np.inf)
        mine[docs] = best[docs]
        hits = np.nonzero(self.maxima == np.repeat(mine, np.diff(self.firsts)))[0]
        edge = np.zeros(len(self.firsts) - 1, np.int64)
        edge[np.searchsorted(self.firsts, hits[::-1], side="right") - 1] = hits[::-1]
        self.maxima[edge[docs]] = -np.inf
        return edge[docs]

    def spell(self, net: Lattice, kind: np.ndarray, word_at: np.ndarray, heads: list[tuple[np.ndarray, bytes]], live: np.ndarray) -> None:
        pieces = net.by_edge["piece"][self.edges]
        odd = np.nonzero(pieces < 0)[0]
        at, ids = np.arange(len(pieces) + 1), pieces
        if len(odd):
            w = np.searchsorted(word_at, self.places[odd], side="right") - 1
            points = net.positions["points"][net.start[kind[w]] + self.places[odd] - word_at[w]]
            spelt = [(BLANK if c == ord(LITERAL) else chr(c)).encode() for c in points.tolist()]
            extra = np.ones(len(pieces), np.int64)
            extra[odd] = sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
            at = np.append(0, np.cumsum(extra))
            ids = np.repeat(pieces, extra)
            ids[np.repeat(at[odd] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))] = net.vocabulary.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        data, ends = decode(net.vocabulary, ids)
        self.at, self.ends = at, ends
        self.id_base, self.byte_base = [len(h[0]) for h in heads], [len(h[1]) for h in heads]
        id_cut, byte_cut = at[self.firsts].tolist(), ends[at[self.firsts]].tolist()
        self.ids, self.data = [None] * len(heads), [b""] * len(heads)
        for d in np.nonzero(live)[0].tolist():
            own, head = ids[id_cut[d] : id_cut[d + 1]], heads[d]
            self.ids[d] = np.concatenate([head[0], own]) if len(head[0]) else own
            self.data[d] = head[1] + data[byte_cut[d] : byte_cut[d + 1]]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of ids, blanks restored, and where each id's begin, with the end last. A text's encoding starts with one blank more."""
    spelt = vocabulary.spellings.take(pa.array(ids))
    ends = np.frombuffer(spelt.buffers()[1], np.int64, len(spelt) + 1)
    return (spelt.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: int(ends[-1])], ends


SEGMENTATION = StructType([StructField("ids", ArrayType(IntegerType())), StructField("log_p", DoubleType()), StructField("perturbed", DoubleType()), StructField("log_inclusion", DoubleType()), StructField("decodes", BooleanType())])
DIGEST = StructType([StructField("n_pieces", IntegerType()), StructField("ids_sha256", StringType()), *SEGMENTATION.fields[1:]])


_KEPT: list[Lattice] = []


def _lattice(vocabulary: Vocabulary) -> Lattice:
    """This worker's lattice of the strings seen so far, without the rare ones when it has MAX_POINTS positions."""
    if not _KEPT or _KEPT[0].vocabulary.pieces is not vocabulary.pieces and _KEPT[0].vocabulary.pieces != vocabulary.pieces:
        _KEPT[:] = [Lattice(vocabulary)]
    if _KEPT[0].used > MAX_POINTS:
        _KEPT[0].drop_rare()
    return _KEPT[0]


def _batches(texts: pa.Array, keys: pa.Array, vocabulary: Vocabulary, samples: int) -> Iterator[tuple[bytes, list[dict]]]:
    data, at = utf8(texts)
    ids = keys.fill_null(-1).to_numpy(zero_copy_only=False)
    for i, j in slices(np.diff(at), SEARCH_BYTES):
        raw = [bytes(data[a:b]) for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
        yield from zip(raw, search(_lattice(vocabulary), [b.decode() for b in raw], ids[i:j], samples), strict=True)


def segmentations(text: Column, key: Column, vocabulary: Vocabulary, samples: int = SAMPLES) -> Column:
    """Up to ``samples`` segmentations of a text, best perturbed log-probability first, seeded by an integer key.

    Null and empty texts have one segmentation, the empty one; equal texts with equal keys have equal ones. ``decodes`` says whether
    the ids give back the text's bytes. A null key counts as -1.
    """

    @F.arrow_udf(ArrayType(SEGMENTATION))
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [[{"ids": x["ids"], "log_p": x["log_p"], "perturbed": x["perturbed"], "log_inclusion": x["log_inclusion"], "decodes": x["decoded"] == b} for x in found] for b, found in _batches(texts, keys, vocabulary, samples)]
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("log_p", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("decodes", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return run(text, key.cast("long"))


def segmentation_digests(text: Column, key: Column, vocabulary: Vocabulary, samples: int = SAMPLES) -> Column:
    """Like segmentations, with the number of ids and the SHA-256 of them as 32-bit little-endian numbers instead of them."""

    @F.arrow_udf(ArrayType(DIGEST))
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [[{"n_pieces": len(x["ids"]), "ids_sha256": hashlib.sha256(x["ids"].astype("<i4").tobytes()).hexdigest(), "log_p": x["log_p"], "perturbed": x["perturbed"], "log_inclusion": x["log_inclusion"], "decodes": x["decoded"] == b} for x in found] for b, found in _batches(texts, keys, vocabulary, samples)]
        kind = pa.struct([("n_pieces", pa.int32()), ("ids_sha256", pa.string()), ("log_p", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("decodes", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return run(text, key.cast("long"))


def op8_pieces(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """A row per sampled segmentation of each document: doc_id, sample from 0, n_pieces, ids_sha256, log_p, perturbed, log_inclusion,
    decodes. Null and empty texts have the empty one; texts with fewer ways to be cut than samples have fewer rows; repeated rows repeat
    theirs; texts are read whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    session(docs)
    found = docs.select("doc_id", F.posexplode(segmentation_digests(F.col("text"), F.col("doc_id"), Vocabulary(model))).alias("sample", "s"))
    return found.select("doc_id", "sample", "s.*")


def encoded_documents(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """docs with ``piece_ids``, the best sampled segmentation, and of all of them n_samples, log_p and log_inclusion, and whether each
    gives back the text. Null and empty texts have the empty one; equal rows have equal ones. Columns of docs named like these are replaced."""
    session(docs)
    vocabulary = Vocabulary(model)
    kind = StructType([StructField("piece_ids", ArrayType(IntegerType())), StructField("n_samples", IntegerType()), StructField("log_p", ArrayType(DoubleType())), StructField("log_inclusion", ArrayType(DoubleType())), StructField("decodes", BooleanType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ids, n, log_p, inclusion, decodes = [], [], [], [], []
        for raw, found in _batches(texts, keys, vocabulary, samples):
            ids.append(found[0]["ids"])
            n.append(len(found))
            log_p.append([x["log_p"] for x in found])
            inclusion.append([x["log_inclusion"] for x in found])
            decodes.append(all(x["decoded"] == raw for x in found))
        offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
        best = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.StructArray.from_arrays([best, pa.array(n, pa.int32()), pa.array(log_p, pa.list_(pa.float64())), pa.array(inclusion, pa.list_(pa.float64())), pa.array(decodes, pa.bool_())], [f.name for f in kind])

    found = docs.withColumn("__s", run(F.col("text"), F.col("doc_id").cast("long")))
    return found.select(*(F.col(c) for c in docs.columns if c not in kind.names), "__s.*")
