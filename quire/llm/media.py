"""Baseline JPEG media columns: bytes as blocks with one DC level each, a scan decoder in numpy, thumbnails and their hashes.

A thumbnail has one sample for each 8 by 8 block of the luminance component, from its DC coefficient alone. ``encode`` writes images
whose blocks are flat, with a DC quantiser of 8, so that every byte of a payload is one block's sample, exactly, in any decoder, and
the thumbnail that ``thumbnail`` reconstructs is the payload. Restart markers every ``INTERVAL`` blocks let all intervals of all
images be decoded side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import session, slices, utf8

INTERVAL, UNIT, MAX_BLOCKS = 512, 64, 8191
#: Segment that holds an image's number of payload bytes, before the padding of its last row.
OWN = b"QUIRE\0"
#: DC categories 0 to 8 and their code lengths, for differences of bytes of text; the AC table has only the end of a block.
DC_LENGTHS = {0: 4, 1: 5, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 5}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """DHT counts and symbols, and each symbol's code and length."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = bytearray(16), {}, 0, 0
    for s in ordered:
        code <<= lengths[s] - last if last else 0
        last = lengths[s]
        codes[s] = (code, last)
        counts[last - 1] += 1
        code += 1
    return bytes(counts), bytes(ordered), codes


_COUNTS, _SYMBOLS, _CODES = _canonical(DC_LENGTHS)


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits of a whole block for each DC difference from -255 to 255: its code, its value, the end of block (0)."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = _CODES[c]
        value = d if d >= 0 else d + (1 << c) - 1
        bits[d + 255], size[d + 255] = (code << c | value) << 1, n + c + 1
    return bits, size


_BITS, _SIZES = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, n: int) -> bytes:
    quant = bytearray([8] * 64)
    return b"".join((
        b"\xff\xd8", _segment(0xEB, OWN + struct.pack(">Q", n)), _segment(0xDB, b"\0" + bytes(quant)), _segment(0xC0, struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\0" + _COUNTS + _SYMBOLS), _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"), _segment(0xDD, struct.pack(">H", INTERVAL)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload of at least one byte; several in a row where a payload exceeds one image."""
    pieces: list[tuple[int, bytes]] = []
    for k, p in enumerate(payloads):
        most = MAX_BLOCKS // UNIT * UNIT * MAX_BLOCKS
        pieces += [(k, p[i : i + most]) for i in range(0, max(1, len(p)), most)]
    heads, blocks, lanes = [], [], []
    for _, p in pieces:
        rows = -(-len(p) // UNIT)
        width = UNIT * -(-rows // MAX_BLOCKS)
        height = max(1, -(-len(p) // width))
        heads.append(_head(width, height, len(p)))
        blocks.append(p + bytes(width * height - len(p)))
        lanes.append(-(-width * height // INTERVAL))
    data = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int16)
    sizes = np.array([len(b) for b in blocks])
    ends = np.cumsum(sizes)
    first = np.concatenate([np.arange(e - n, e, INTERVAL) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    diff = np.empty(len(data), np.int16)
    diff[0] = data[0] - 128
    np.subtract(data[1:], data[:-1], out=diff[1:])
    diff[first] = data[first] - 128
    place = diff + 255
    size = _SIZES[place]
    at = np.cumsum(size) - size
    # Every interval starts at a whole byte; what is left of its last byte is filled with ones.
    last = np.append(first[1:], len(data)) - 1
    used = at[last] + size[last] - at[first]
    room = (used + 7) // 8
    byte0 = np.cumsum(room) - room
    at += np.repeat(byte0 * 8 - at[first], last - first + 1)
    total = int(room.sum())
    out = np.zeros(total + 4, np.int64)
    word, shift = at >> 3, 24 - (at & 7) - size
    bits = _BITS[place] << shift
    for k in range(3):  # a block has 14 bits at most, so it lies in three bytes
        out += np.bincount(word + k, (bits >> (16 - 8 * k)) & 255, total + 4).astype(np.int64)
    fill = (-used) % 8
    out[byte0 + room - 1] |= (1 << fill) - 1
    scan = out[:total].astype(np.uint8).tobytes()
    result, lane = [b""] * len(payloads), 0
    cuts = np.append(byte0, total).tolist()
    for (k, _), head, n in zip(pieces, heads, lanes, strict=True):
        parts = [head]
        for i in range(n):
            parts.append(scan[cuts[lane + i] : cuts[lane + i + 1]].replace(b"\xff", b"\xff\0"))
            parts.append(bytes((0xFF, 0xD0 | i & 7)) if i < n - 1 else b"\xff\xd9")
        lane += n
        result[k] += b"".join(parts)
    return result


@dataclass
class Image:
    """What the markers of one image say. ``intervals`` are the entropy-coded bytes between restarts, unstuffed."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    quant: dict[int, int] = field(default_factory=dict)  # DC quantisers
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)  # (class, id): counts and symbols
    restart: int = 0
    payload: int | None = None
    intervals: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> list[Image]:
    """The images of a stream of baseline JPEGs. Raises ValueError on anything that baseline with one interleaved scan lacks."""
    images, i, now = [], 0, None
    while i < len(data):
        if data[i] != 0xFF or i + 1 >= len(data):
            raise ValueError(f"no marker at {i}")
        marker = data[i + 1]
        i += 2
        if marker == 0xFF:
            i -= 1
            continue
        if marker == 0xD8:
            now = Image()
            images.append(now)
            continue
        if marker == 0xD9:
            now = None
            continue
        if now is None:
            raise ValueError("a segment before the start of an image")
        n = struct.unpack(">H", data[i : i + 2])[0]
        body = data[i + 2 : i + n]
        i += n
        if marker == 0xC0:
            bits, now.height, now.width, k = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not now.height or not now.width:
                raise ValueError("8-bit samples and known dimensions are needed")
            now.components = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(k)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                now.quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                now.tables[(body[0] >> 4, body[0] & 15)] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            now.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEB and body.startswith(OWN):
            now.payload = struct.unpack(">Q", body[len(OWN) :])[0]
        elif marker == 0xDA:
            places = {c[0]: k for k, c in enumerate(now.components)}
            now.scan = [(places[body[1 + 2 * c]], body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(body[0])]
            if len(now.scan) != len(now.components):
                raise ValueError("one scan of all components is needed")
            start = i
            while True:
                i = data.find(b"\xff", i)
                if i < 0 or i + 1 >= len(data):
                    raise ValueError("the scan does not end")
                if data[i + 1] == 0:
                    i += 2
                    continue
                now.intervals.append(data[start:i].replace(b"\xff\0", b"\xff"))
                if not 0xD0 <= data[i + 1] <= 0xD7:
                    break
                start = i = i + 2
    return images


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """symbol << 8 | length for each 16-bit window; 0 where no code fits."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] << 8 | length
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """(difference + 2048) << 8 | length for windows that hold a whole block without AC coefficients; 0 for all others."""
    window = np.arange(1 << 16)
    size, cat = dc & 255, dc >> 8
    end = size + cat
    fits = (size > 0) & (end < 16)
    value = np.where(fits, (window >> np.maximum(0, 16 - end)) & ((1 << np.minimum(cat, 15)) - 1), 0)
    diff = np.where(value < (1 << np.maximum(0, cat - 1)), value - (1 << np.minimum(cat, 15)) + 1, value)
    diff = np.where(cat == 0, 0, diff)
    rest = ac[(window << np.minimum(end, 16)) & 0xFFFF]
    n = end + (rest & 255)
    fits &= ((rest & 255) > 0) & (rest >> 8 == 0) & (n <= 16)
    return np.where(fits, (diff + 2048) << 8 | n, 0).astype(np.int32)


_TABLES: dict[tuple, np.ndarray] = {}


def _table(kind: str, *parts: tuple[bytes, bytes]) -> np.ndarray:
    key = (kind, *parts)
    if key not in _TABLES:
        if len(_TABLES) > 256:
            _TABLES.clear()
        _TABLES[key] = _lookup(*parts[0]) if kind == "symbols" else _whole_blocks(_lookup(*parts[0]), _lookup(*parts[1]))
    return _TABLES[key]


def dc_levels(image_list: list[Image]) -> list[np.ndarray]:
    """DC levels of all blocks of each image, in the order of its scan, still quantised and in one row for all components.

    Images that share their layout and tables are decoded together, an interval a lane: each step reads one symbol, or a whole
    block that has no AC coefficients, in every lane that is not done.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(image_list)
    alike: dict[tuple, list[int]] = {}
    for k, im in enumerate(image_list):
        turn = []
        for place, dc, ac in im.scan:
            _, h, v, _ = im.components[place]
            turn += [(place, im.tables[(0, dc)], im.tables[(1, ac)])] * (h * v if len(im.scan) > 1 else 1)
        alike.setdefault(tuple(turn), []).append(k)
    for turn, members in alike.items():
        shape, lanes, need = [], [], []
        for k in members:
            im = image_list[k]
            mcus = _mcus(im)
            step = im.restart or mcus
            shape.append(mcus * len(turn))
            if len(im.intervals) != -(-mcus // step):
                raise ValueError("restart intervals are missing")
            lanes += im.intervals
            need += [min(step, mcus - j * step) * len(turn) for j in range(len(im.intervals))]
        diffs = _decode(lanes, np.array(need), turn)
        ends = np.cumsum(shape)
        for k, e, n in zip(members, ends.tolist(), shape, strict=True):
            out[k] = diffs[e - n : e]
    return out


def _mcus(im: Image) -> int:
    if len(im.scan) == 1:
        _, h, v, _ = im.components[im.scan[0][0]]
        hs, vs = max(c[1] for c in im.components), max(c[2] for c in im.components)
        return -(-(im.width * h) // (8 * hs)) * -(-(im.height * v) // (8 * vs))
    hs, vs = max(c[1] for c in im.components), max(c[2] for c in im.components)
    return -(-im.width // (8 * hs)) * -(-im.height // (8 * vs))


def _decode(lanes: list[bytes], need: np.ndarray, turn: tuple) -> np.ndarray:
    dc = np.concatenate([_table("symbols", t[1]) for t in turn])
    ac = np.concatenate([_table("symbols", t[2]) for t in turn])
    whole = np.concatenate([_table("blocks", t[1], t[2]) for t in turn])
    sizes = np.array([len(x) for x in lanes])
    padded = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in lanes) + b"\xff" * 8, np.uint8)
    word = padded[:-3].astype(np.uint32) << 24 | padded[1:-2].astype(np.uint32) << 16 | padded[2:-1].astype(np.uint32) << 8 | padded[3:]
    start = (np.cumsum(sizes + 4) - sizes - 4) * 8
    order = np.argsort(-need, kind="stable")
    base = (np.cumsum(need) - need)[order]
    need, limit, at = need[order], (start + sizes * 8)[order], start[order].copy()
    diffs = np.zeros(int(need.sum()), np.int32)
    if len(turn) == 1 and _flat(word, at, need, whole, diffs, base):
        if (at > limit).any():
            raise ValueError("a scan is too short")
        return _levels(diffs, base, need, turn)
    at, block, coef = start[order].copy(), np.zeros(len(need), np.int64), np.zeros(len(need), np.int64)
    active = np.nonzero(block < need)[0]
    n_turn = len(turn)
    while len(active):
        p, k = at[active], coef[active]
        window = (word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
        table = (block[active] % n_turn) << 16
        code = np.where(k == 0, dc[table + window], ac[table + window])
        length, symbol = code & 255, code >> 8
        if (length == 0).any() or (p > limit[active]).any():
            raise ValueError("a scan is damaged")
        cat = np.where(k == 0, symbol, symbol & 15)
        p = p + length
        value = (word[p >> 3].astype(np.int64) << (p & 7) & 0xFFFFFFFF) >> np.where(cat > 0, 32 - cat, 32)
        value = np.where((cat > 0) & (value < 1 << np.maximum(0, cat - 1)), value - (1 << cat) + 1, value)
        is_dc = k == 0
        diffs[base[active[is_dc]] + block[active[is_dc]]] = value[is_dc]
        k = np.where(is_dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        at[active] = p + cat
        done = k > 63
        block[active] += done
        coef[active] = np.where(done, 0, k)
        active = active[block[active] < need[active]]
    if (at > limit).any():
        raise ValueError("a scan is too short")
    return _levels(diffs, base, need, turn)


def _flat(word: np.ndarray, at: np.ndarray, need: np.ndarray, whole: np.ndarray, diffs: np.ndarray, base: np.ndarray) -> bool:
    """Decodes lanes whose blocks all fit the table of whole blocks, the longest lanes first; False at the first that does not."""
    n, rank = len(need), -need
    for step in range(int(need[0]) if n else 0):
        live = int(np.searchsorted(rank, -step, side="left"))
        p = at[:live]
        code = whole[(word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF]
        if not code.all():
            return False
        p += code & 255
        diffs[base[:live] + step] = (code >> 8) - 2048
    return True


def _levels(diffs: np.ndarray, base: np.ndarray, need: np.ndarray, turn: tuple) -> np.ndarray:
    """Running sums of the differences within each interval and component."""
    lane = np.repeat(np.arange(len(need)), need[np.argsort(base, kind="stable")])
    begin = np.sort(base)
    out = np.empty_like(diffs)
    place = np.array([t[0] for t in turn])[(np.arange(len(diffs)) - begin[lane]) % len(turn)] if len(turn) > 1 else np.zeros(1, int)
    for c in set(place.tolist()):
        own = np.nonzero(place == c)[0] if len(turn) > 1 else slice(None)
        d, l = diffs[own], lane[own]
        s = np.cumsum(d, dtype=np.int64)
        head = np.nonzero(np.diff(l, prepend=-1))[0]
        out[own] = s - np.repeat(s[head] - d[head], np.diff(np.append(head, len(d))))
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each stream its images, each with the luminance thumbnail (rows, columns) of uint8."""
    parsed = [parse(m) for m in media]
    flat = [im for images in parsed for im in images]
    made = []
    for im, levels in zip(flat, dc_levels(flat), strict=True):
        place = im.scan[0][0]
        _, h, v, q = im.components[place]
        hs, vs = max(c[1] for c in im.components), max(c[2] for c in im.components)
        wide, high = -(-(im.width * h) // (8 * hs)), -(-(im.height * v) // (8 * vs))
        if len(im.scan) > 1:
            per = sum(im.components[p][1] * im.components[p][2] for p, _, _ in im.scan)
            across, down = -(-im.width // (8 * hs)), -(-im.height // (8 * vs))
            levels = levels.reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        else:
            levels = levels.reshape(high, wide)
        # The mean of a block is its DC coefficient over 8; half is rounded up, as after an inverse transform of a flat block.
        made.append((im, np.clip((levels[:high, :wide] * im.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)))
    out, i = [], 0
    for images in parsed:
        out.append(made[i : i + len(images)])
        i += len(images)
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 by 8 grid over the thumbnail is brighter on average than the whole."""
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    lo = [np.minimum(np.arange(8) * n // 8, n - 1) for n in thumb.shape]
    hi = [np.maximum(a + 1, np.arange(1, 9) * n // 8) for a, n in zip(lo, thumb.shape, strict=True)]
    r0, r1, c0, c1 = lo[0][:, None], hi[0][:, None], lo[1], hi[1]
    sums = total[r1, c1] - total[r0, c1] - total[r1, c0] + total[r0, c0]
    bright = sums * thumb.size > total[-1, -1] * (r1 - r0) * (c1 - c0)
    return int.from_bytes(np.packbits(bright.ravel()).tobytes(), "big")


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


@F.arrow_udf(BinaryType())
def store_media(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a text, padded with zeros to a positive multiple of 64, as a JPEG stream; null texts are empty."""
    data, at = utf8(texts)
    out: list[bytes] = []
    for i, j in slices(np.diff(at)):
        out += encode_all([pad(bytes(data[a:b])) for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)])
    return pa.array(out, pa.binary())


FEATURES = StructType([StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("width", LongType()), StructField("height", LongType()), StructField("thumbnail_hash", StringType()), StructField("feature", StringType())])


def describe(media: list[bytes]) -> list[dict]:
    """Features of streams from their bytes alone: dimensions, thumbnail hash, and the payload that the thumbnails hold.

    A stream of several images, one below the other, has the hash of all their thumbnails' hashes.
    """
    rows = []
    for stream, images in zip(media, thumbnails(media), strict=True):
        payload = b"".join(t.tobytes()[: im.payload] if im.payload is not None else t.tobytes() for im, t in images)
        first = images[0][0]
        hashes = b"".join(average_hash(t).to_bytes(8, "big") for _, t in images)
        h = (hashes if len(images) == 1 else hashlib.sha256(hashes).digest()[:8]).hex()
        rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "width": first.width, "height": sum(im.height for im, _ in images), "thumbnail_hash": h, "feature": f"{first.width}x{sum(im.height for im, _ in images)}:{h}"})
    return rows


@F.arrow_udf(FEATURES)
def media_features(media: pa.Array) -> pa.Array:
    """Features of stored streams; null for a null stream or one that is no baseline JPEG."""
    data, at = utf8(media)
    valid, out = media.is_valid().to_pylist(), []
    for i, j in slices(np.diff(at)):
        own = [bytes(data[a:b]) if ok else None for a, b, ok in zip(at[i:j], at[i + 1 : j + 1], valid[i:j], strict=True)]
        try:
            got = iter(describe([m for m in own if m]))
            out += [next(got) if m else None for m in own]
        except (ValueError, KeyError, IndexError, struct.error):
            for m in own:
                try:
                    out.append(describe([m])[0] if m else None)
                except (ValueError, KeyError, IndexError, struct.error):
                    out.append(None)
    return pa.array(out, pa.struct([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in FEATURES]))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of documents' texts; null texts are empty, repeated rows repeat theirs."""
    session(docs)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store_media(F.col("text")).alias("media"))


def op1_media(spark, sf_dir: str) -> DataFrame:
    """One row per document: its text as a JPEG stream, read back. Null and empty texts are 64 zero bytes; texts of any length are whole,
    over several images where one is too small; repeated rows and equal texts have equal values; an empty table gives no rows."""
    stored = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return stored.select("doc_id", "n_bytes", media_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")
