"""Training-order token store: a keyed permutation gives every sequence a slot, range partitions write fixed-stride shards.

A document's token ids are cut into sequences of ``seq_len``. Sequences are numbered without gaps, from counts per input partition, and
a Feistel network over the next power of four, walked along its cycle until it lands inside, turns the number into a slot. Slot s lies
in shard s // per_shard at byte (s % per_shard) * stride, so that training reads shards from front to back and resumes at any slot.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import mixed, qualified, release, session, settings, shared_dir, stored, utf8

SEQ_LEN, SHARD_BYTES, KEY, ROUNDS = 512, 32 << 20, 0x5DEECE66D, 6
#: The query's vocabulary, 50,256 ranks of byte pairs of many languages, and the pattern that it was made with.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Record: document id, number of the sequence in the document, number of tokens, then the ids, filled up with zeros.
HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")])
FLUSH_BYTES, ROWS_AT_ONCE, MOST_PARTITIONS = 4 << 20, 1_024, 4_096
#: Ranges of shards that are written one after another: the shuffle's files of one are gone before the next one's are made, so that
#: they never take more than this share of the ids' space.
SHARD_ROUNDS = 2


def permuted(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of sequence numbers below total: a bijection of range(total) for each key."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [mixed(np.array([key + 0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1], np.uint64)) for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def byte_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): a text's UTF-8 bytes as ids of one byte, a vocabulary of 256."""
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("ids"))


_ENCODINGS: dict[tuple[str, str], object] = {}


def rank_ids(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): ids of two little-endian bytes by a byte-pair vocabulary of at most 65,536 ranks, stored so that they are made once."""
    from base64 import b64decode

    with open(ranks, "rb") as lines:
        table = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    @F.arrow_udf(BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        import tiktoken

        if not (own := _ENCODINGS.get((ranks, pattern))):  # once a worker
            own = _ENCODINGS[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        data, at = utf8(texts)
        return pa.array([np.array(own.encode_ordinary(str(data[a:b], "utf-8")), "<u2").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())

    return stored(docs.select("doc_id", encode("text").alias("ids")), "ids")


def _sender(width: int, seq_len: int, offsets: dict[int, tuple[int, int]], total: int, per_shard: int, key: int, slots: tuple[int, int]) -> Callable:
    """Sends the sequences whose slots lie in a range, as compressed blocks of one shard each."""
    payload = seq_len * width
    stride = HEAD.itemsize + payload

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, expected = offsets.get(part, (0, 0))
        end = at + expected
        squeeze = zstandard.ZstdCompressor(3)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            own, records = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = 0
            order = np.argsort(own)
            shard = own[order] // per_shard
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(order))
            blocks = [squeeze.compress(own[order[a:b]].astype("<i8").tobytes() + records[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], ["shard", "block"])

        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            data, starts = utf8(batch.column(1))
            flat, length = np.frombuffer(data, np.uint8), np.diff(starts)
            n = np.maximum(1, -(-length // payload))
            row = np.repeat(np.arange(len(n)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = permuted(np.arange(at, at + len(row)), total, key)
            at += len(row)
            chosen = np.flatnonzero((place >= slots[0]) & (place < slots[1]))
            for i in range(0, len(chosen), ROWS_AT_ONCE):
                own = chosen[i : i + ROWS_AT_ONCE]
                begin = starts[row[own]] + seq[own] * payload
                used = np.minimum(payload, starts[row[own] + 1] - begin)
                records = np.zeros((len(own), stride), np.uint8)
                heads = np.zeros(len(own), HEAD)
                heads["doc_id"], heads["seq"], heads["n"] = ids[row[own]], seq[own], used // width
                records[:, : HEAD.itemsize] = heads.view(np.uint8).reshape(len(own), -1)
                for record, a, b in zip(records, begin.tolist(), used.tolist(), strict=True):
                    record[HEAD.itemsize : HEAD.itemsize + b] = flat[a : a + b]
                held.append((place[own], records))
                size += records.size
                if size >= FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()
        if at != end:
            raise RuntimeError(f"partition {part} holds {at - end + expected} sequences now and held {expected} when they were counted")

    return send


def _writer(path: str, stride: int, total: int, per_shard: int) -> Callable:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        expand = zstandard.ZstdDecompressor()
        shard, records, filled = -1, np.zeros((0, stride), np.uint8), np.zeros(0, bool)

        def close() -> Iterator[pa.RecordBatch]:
            if shard < 0:
                return
            if not filled.all():
                raise RuntimeError(f"shard {shard} lacks {int((~filled).sum())} slots")
            body = records.tobytes()
            attempt = TaskContext.get().taskAttemptId()
            with store.open_output_stream(f"{folder}/.shard-{shard:08d}.{attempt}") as out:
                out.write(body)
            store.move(f"{folder}/.shard-{shard:08d}.{attempt}", f"{folder}/shard-{shard:08d}.bin")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(records)], pa.int64()), pa.array([zlib.crc32(body)], pa.int64())], ["shard", "slots", "crc32"])

        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != shard:
                    yield from close()
                    shard = number
                    own = min(per_shard, total - shard * per_shard)
                    records, filled = np.zeros((own, stride), np.uint8), np.zeros(own, bool)
                raw = expand.decompress(block.as_py())
                n = len(raw) // (8 + stride)
                slots = np.frombuffer(raw, "<i8", n) - shard * per_shard
                if filled[slots].any() or len(np.unique(slots)) < n:
                    raise RuntimeError(f"shard {shard} has a slot twice")
                records[slots], filled[slots] = np.frombuffer(raw, np.uint8, n * stride, 8 * n).reshape(n, stride), True
        yield from close()

    return write


def write_store(ids: DataFrame, path: str, width: int = 1, seq_len: int = SEQ_LEN, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> dict:
    """Writes ids (doc_id, ids of ``width`` bytes each) to ``path`` and returns the manifest, which is written last.

    ids must come in the same partitions each time it is read, as a table's scan does; a task that finds another number of sequences
    than was counted fails. Documents without tokens, nulls among them, have one sequence of none, and a null doc_id is stored as -1.
    Repeated rows are sequences of their own. A shard's file appears by a rename, so that a repeated task writes it again unharmed.
    """
    spark = session(ids)
    path = qualified(spark, path)
    stride, payload = HEAD.itemsize + seq_len * width, seq_len * width
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("ids") / payload)).cast("long")
    counted = {r.part: r.n for r in ids.select(F.spark_partition_id().alias("part"), n.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    offsets, total = {}, 0
    for part in sorted(counted):
        offsets[part] = (total, counted[part])
        total += counted[part]
    per_shard = max(1, shard_bytes // stride)
    shards = -(-total // per_shard)
    manifest = {"total": total, "seq_len": seq_len, "width": width, "stride": stride, "per_shard": per_shard, "shards": shards, "key": key}
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    count = 0
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        for r in range(min(SHARD_ROUNDS, shards)):
            low, high = shards * r // min(SHARD_ROUNDS, shards), shards * (r + 1) // min(SHARD_ROUNDS, shards)
            parts = min(high - low, MOST_PARTITIONS)
            blocks = ids.select("doc_id", "ids").mapInArrow(_sender(width, seq_len, offsets, total, per_shard, key, (low * per_shard, high * per_shard)), "shard int, block binary")
            placed = blocks.repartitionById(parts, ((F.col("shard") - low) * F.lit(parts).cast("long") / F.lit(high - low)).cast("int")).sortWithinPartitions("shard")
            written = placed.mapInArrow(_writer(path, stride, total, per_shard), "shard int, slots long, crc32 long").agg(F.count("*").alias("shards"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
            count += written.slots
            if written.shards != high - low:
                raise RuntimeError(f"{written.shards} of {high - low} shards were written")
    if count != total:
        raise RuntimeError(f"{count} of {total} slots were written")
    with store.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_store(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq, n_tokens, ids (binary) and crc32 of the ids, from ``first_slot`` on; shards are read in order."""
    path = qualified(spark, path)
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                skip = max(0, first_slot - shard * m["per_shard"])
                with store.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
                    f.seek(skip * m["stride"])
                    while raw := f.read(m["stride"] * 4096):
                        rows = np.frombuffer(raw, np.uint8).reshape(-1, m["stride"])
                        head = rows[:, : HEAD.itemsize].copy().view(HEAD).ravel()
                        body = [r[HEAD.itemsize : HEAD.itemsize + n].tobytes() for r, n in zip(rows, (head["n"] * m["width"]).tolist(), strict=True)]
                        at = np.arange(skip, skip + len(rows))
                        skip += len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(at + shard * m["per_shard"]), pa.array(np.full(len(rows), shard, np.int32)), pa.array(at * m["stride"]), pa.array(head["doc_id"].copy()), pa.array(head["seq"].copy()), pa.array(head["n"].copy()), pa.array(body, pa.binary()), pa.array([zlib.crc32(b) for b in body], pa.int64())], ["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "ids", "crc32"])

    first = first_slot // m["per_shard"]
    shards = spark.range(first, max(first, m["shards"]), 1, max(1, min(m["shards"] - first, 4 * spark.sparkContext.defaultParallelism)))
    return shards.mapInArrow(read, "slot long, shard int, byte_offset long, doc_id long, seq int, n_tokens int, ids binary, crc32 long")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    """One row per sequence of every document's token ids, read back from the shards: slot, shard, byte_offset, doc_id, seq, n_tokens, crc32.

    Null and empty texts have one sequence without tokens; a null doc_id is -1; repeated rows have sequences of their own; a table
    without rows gives none; long texts have as many sequences as they need.
    """
    path, ids = shared_dir(spark, "tokens"), rank_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    write_store(ids, path, width=2)
    release(ids)
    return read_store(spark, path).drop("ids")
