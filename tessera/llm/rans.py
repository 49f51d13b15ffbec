"""Op 5: token ids of a corpus in a static range asymmetric numeral system (rANS) container.

A container is a Parquet table of independent blocks (so any store that Spark writes to will do, and its committer
makes retried tasks safe). One shared frequency table, normalised to 2**SCALE slots, codes all blocks. A block
holds whole documents in ascending id order; its ids are dealt to up to LANES interleaved coders, one 64-bit state
each, that emit 32-bit words into one stream. Every CHECKPOINT steps the states and the place in the stream are
kept, and the parts of a block between them are decoded side by side. Block payload, little-endian::

    magic "TRB1" | u4 lanes | u4 steps | u8 tokens | u4 documents | u4 checkpoints | u4 words | u4 crc32 of ids | u4 crc32 of the rest
    i8 doc ids, u1 id present, u4 token counts | per checkpoint: u4 word place, u8 * lanes states | u4 words

Nulls: a null text is empty; a null doc_id sorts first and stays null. Repeated rows are kept, one document each,
ordered by (doc_id, crc32 of their ids, number of ids); rows that tie in these have equal ids or are told apart by
no one. A document of any length lies whole in one block, which then is longer. Names of special tokens in a text
become these tokens' ids, as the library does it. Empty tables give an empty container; extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, stored, with_only
from .tokens import encoder, tokenizer_path

SCALE, LOW = 20, 1 << 31
LANES, CHECKPOINT, BLOCK_TOKENS = 1024, 128, 262_144
#: Chunks of texts that a worker remembers: this job is nothing but tokenizing, so more than by default.
MEMORY = 700_000
HEAD = struct.Struct("<4sIIQIIIII")
U8 = np.uint64


class Frequencies:
    """Counts of symbols, scaled to 2**SCALE slots so that each symbol that occurs has one slot at least."""

    def __init__(self, counts: dict[int, int]):
        size = max(counts, default=0) + 1
        c = np.zeros(size, np.int64)
        c[list(counts)] = list(counts.values())
        self.freq = np.zeros(size, np.int64)
        if c.any():
            present = np.flatnonzero(c)
            f = np.maximum(1, (c[present].astype(np.float64) / c.sum() * (1 << SCALE)).astype(np.int64))
            order, left = np.argsort(-f, kind="stable"), (1 << SCALE) - int(f.sum())
            if left > 0:
                f[order[0]] += left
            while left < 0:  # take slots back from the most frequent
                take = np.minimum(f[order] - 1, np.maximum(1, f[order] * -left // (1 << SCALE)))
                take = np.where(np.cumsum(take) <= -left, take, np.maximum(0, -left - (np.cumsum(take) - take)))
                f[order] -= take
                left += int(take.sum())
            self.freq[present] = f
        self.start = np.cumsum(self.freq) - self.freq
        self._slots = None
        self.f8, self.s8 = self.freq.astype(U8), self.start.astype(U8)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._slots


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Frequencies) -> bytes:
    """ids: uint32 of all documents; docs: (doc_id, number of ids) in order."""
    n = len(ids)
    lanes = int(max(1, min(LANES, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, U8)
    parts: list[np.ndarray] = []
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        live = x[: len(s)]
        f = table.f8[s]
        over = live >= (f << U8(63 - SCALE))
        parts.append(live[over].astype("<u4"))
        live = np.where(over, live >> U8(32), live)
        q = live // f
        x[: len(s)] = (q << U8(SCALE)) + (live - q * f) + table.s8[s]
        if t % CHECKPOINT == 0:
            marks[t // CHECKPOINT] = x.copy()
    parts.reverse()
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    body = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + bytes(d is not None for d, _ in docs) + np.array([k for _, k in docs], "<u4").tobytes()
    body += b"".join(struct.pack("<I", at[k * CHECKPOINT]) + marks[k].astype("<u8").tobytes() for k in sorted(marks)) + words.tobytes()
    return HEAD.pack(b"TRB1", lanes, steps, n, len(docs), len(marks), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_parts(words: np.ndarray, states: np.ndarray, at: np.ndarray, steps: int, n: int, table: Frequencies) -> np.ndarray:
    """All ids of a block: the parts behind its checkpoints are decoded side by side, step by step, each from its own
    states (one row a part) and place in the stream."""
    parts, lanes = states.shape
    out = np.zeros((parts, CHECKPOINT, lanes), np.uint32)
    mask = U8((1 << SCALE) - 1)
    x, at = states.copy(), at.copy()
    last = steps - (parts - 1) * CHECKPOINT  # steps of the last part; its last step may have fewer lanes
    for t in range(min(CHECKPOINT, steps)):
        on = parts if t < last else parts - 1
        live = x[:on]
        slot = live & mask
        s = table.slots[slot]
        out[:on, t] = s
        live = table.f8[s] * (live >> U8(SCALE)) + slot - table.s8[s]
        low = live < U8(LOW)
        if on == parts and t == last - 1 and n % lanes:
            low[-1, n % lanes :] = False
        place = at[:on, None] + np.cumsum(low, axis=1) - 1
        live[low] = (live[low] << U8(32)) | words[place[low]].astype(U8)
        at[:on] += low.sum(axis=1)
        x[:on] = live
    return out.reshape(-1, lanes).ravel()[:n]


def decode_block(payload: bytes, table: Frequencies) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """(ids, docs) of a block. Raises ValueError on damage."""
    magic, lanes, steps, n, n_docs, n_marks, n_words, crc_ids, crc_body = HEAD.unpack_from(payload)
    body = memoryview(payload)[HEAD.size :]
    if magic != b"TRB1" or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    doc_ids = np.frombuffer(body, "<i8", n_docs)
    there = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
    place, marks = 13 * n_docs, []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<I", body, place)[0], np.frombuffer(body, "<u8", lanes, place + 4).astype(U8)))
        place += 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, place)
    ids = decode_parts(words, np.stack([x for _, x in marks]), np.array([a for a, _ in marks], np.int64), steps, n, table) if marks else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("damaged ids")
    return ids, [(int(d) if p else None, int(k)) for d, p, k in zip(doc_ids, there, sizes)]


def tokenize(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary: 2 or 4, bytes of an id, then the ids), crc, n of whole texts, each with the end id; and, in
    rows without ids, counts: how often each id is used in a task, as (id, count) pairs of 64 bits."""

    def make():
        tokens = encoder(path, kind, MEMORY)
        mark, total = bytes([tokens.dtype.itemsize]), np.zeros(1 << 16, np.int64)

        class Kernel:
            def __call__(self, c):
                nonlocal total
                ids = [tokens.numbers(x, end_id) for x in tokens.encode(c["text"])]
                used = np.bincount(np.concatenate(ids), minlength=len(total))
                if len(used) > len(total):
                    total = np.concatenate([total, np.zeros(len(used) - len(total), np.int64)])
                total += used
                yield {"doc_id": c["doc_id"], "ids": [mark + x.astype(tokens.dtype).tobytes() for x in ids], "crc": [zlib.crc32(x) for x in ids], "n": [len(x) for x in ids], "counts": [None] * len(ids)}

            def close(self):
                at = np.flatnonzero(total)
                yield {"doc_id": [None], "ids": [None], "crc": [None], "n": [None], "counts": [np.stack([at, total[at]], 1).astype("<i8").tobytes()]}

        return Kernel()

    return map_batches(with_only(docs, doc_id="long", text="string"), make, "doc_id long, ids binary, crc long, n long, counts binary")


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def count_symbols(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of each id over all documents; as many rows as the vocabulary has come to the driver."""

    def make():
        def kernel(c):
            for data in c["counts"]:
                x = np.frombuffer(data, "<i8").reshape(-1, 2)
                yield {"id": x[:, 0].tolist(), "count": x[:, 1].tolist()}

        return kernel

    parts = map_batches(tokens.filter("ids is null").select("counts"), make, "id long, count long", text="counts")
    return {r["id"]: r["count"] for r in parts.groupBy("id").agg(F.sum("count").alias("count")).collect()}


def write(docs: DataFrame, out: str, path: str, kind: str = "word", end_id: int = 1, partitions: int | None = None) -> None:
    """Writes the container: ``out``/blocks and ``out``/frequencies."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, path, kind, end_id), codec="snappy")
    counts = count_symbols(tokens)
    spark.createDataFrame(sorted(counts.items()), "id long, count long").coalesce(1).write.parquet(f"{out}/frequencies")
    shared = spark.sparkContext.broadcast(counts)

    def make():
        from pyspark import TaskContext

        table, shard = Frequencies(shared.value), TaskContext.get().partitionId()
        held: list = []
        state = {"block": 0, "start": 0, "size": 0}

        def flush():
            ids = np.concatenate([x for _, x in held])
            payload = encode_block(ids, [(d, len(x)) for d, x in held], table)
            row = {"shard": [shard], "block": [state["block"]], "start": [state["start"]], "n_tokens": [len(ids)], "payload": [payload]}
            held.clear()
            state.update(block=state["block"] + 1, start=state["start"] + len(ids), size=0)
            return row

        class Kernel:
            def __call__(self, c):
                for d, data in zip(c["doc_id"], c["ids"]):
                    held.append((d, widen(data)))
                    state["size"] += len(held[-1][1])
                    if state["size"] >= BLOCK_TOKENS:
                        yield flush()

            def close(self):
                return (flush(),) if held else ()

        return Kernel()

    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ("doc_id", "crc", "n")
    ordered = tokens.filter("ids is not null").drop("counts").repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    map_batches(ordered, make, "shard int, block int, start long, n_tokens long, payload binary", text="ids").write.option("compression", "none").parquet(f"{out}/blocks")


def read(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (array) of each document, decoded from the container.

    The shards' sizes, one row a shard, are summed on the side; blocks are decoded apart from one another."""
    blocks = spark.read.parquet(f"{out}/blocks")
    counts = {r["id"]: r["count"] for r in spark.read.parquet(f"{out}/frequencies").collect()}
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.join(F.broadcast(sizes.select("shard", "before")), "shard").select((F.col("before") + F.col("start")).alias("start"), "payload")
    shared = spark.sparkContext.broadcast(counts)

    def make():
        table = Frequencies(shared.value)

        def kernel(c):
            for start, payload in zip(c["start"], c["payload"]):
                ids, docs = decode_block(payload, table)
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum([k for _, k in docs])
                yield {
                    "doc_id": [d for d, _ in docs], "start": [start + int(e) - k for (_, k), e in zip(docs, ends)], "n_tokens": [k for _, k in docs],
                    "ids_crc32": [zlib.crc32(data[4 * (e - k) : 4 * e]) for (_, k), e in zip(docs, ends.tolist())], "ids": [bytes(data[4 * (e - k) : 4 * e]) for (_, k), e in zip(docs, ends.tolist())],
                }

        return kernel

    return map_batches(blocks, make, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", text="payload")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes, writes, reads back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = shared_dir(spark)
    write(docs, out, path or tokenizer_path("word_bpe_49k.json"))
    return read(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")
