"""Token ids as directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap
says which ids continue on level 1, and so on. A directory holds the number of set bits before
each 512 bits of a bitmap, so the place of an id on the next level is one look-up and at most
512 counted bits: any token is read without decoding its block.

A token file is a Parquet dataset whose rows are blocks of about ``block_tokens`` tokens in
ascending document order, written with Spark's commit protocol. Layout of ``codes``: the magic
``DAC1``, the number of levels, then for each level its length, its chunks, and for all but the
last its bitmap and directory (all integers little-endian).
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._shared import default_tokenizer, partitions, text_or_empty, word_ids

MAGIC, STRIDE = b"DAC1", 512
BLOCKS = "part int, block int, first_token long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, codes binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def encode_block(ids) -> bytes:
    """The codes of an array of unsigned 32-bit ids."""
    import numpy as np

    left, levels = np.asarray(ids, dtype="<u4"), []
    while True:
        more = left > 0xFF
        last = not more.any()
        part = struct.pack("<QB", len(left), last) + (left & 0xFF).astype(np.uint8).tobytes()
        if not last:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (STRIDE // 8), np.uint8)])
            counts = np.bitwise_count(bits.reshape(-1, STRIDE // 8)).sum(axis=1)
            before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")
            part += bits.tobytes() + before.tobytes()
        levels.append(part)
        if last:
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)
        left = left[more] >> 8


def levels_of(codes: bytes) -> list[tuple[int, int, int, int]]:
    """For each level: its length and the places of its chunks, bitmap and directory (0: none)."""
    if codes[:4] != MAGIC:
        raise ValueError("not a block of directly addressable codes")
    at, out = 5, []
    for _ in range(codes[4]):
        n, last = struct.unpack_from("<QB", codes, at)
        chunks = at + 9
        blocks = -(-n // STRIDE)
        bitmap, directory = (0, 0) if last else (chunks + n, chunks + n + blocks * STRIDE // 8)
        at = chunks + n if last else directory + 8 * blocks
        out.append((n, chunks, bitmap, directory))
    return out


def token_at(codes: bytes, i: int, levels: list | None = None) -> int:
    """The id at position ``i`` of a block; no other id is decoded."""
    value, shift = 0, 0
    for n, chunks, bitmap, directory in levels or levels_of(codes):
        if not 0 <= i < n:
            raise IndexError(i)
        value |= codes[chunks + i] << shift
        if not bitmap or not codes[bitmap + i // 8] >> (i % 8) & 1:
            break
        (rank,) = struct.unpack_from("<Q", codes, directory + 8 * (i // STRIDE))
        first = i // STRIDE * STRIDE // 8
        inside = int.from_bytes(codes[bitmap + first : bitmap + i // 8 + 1], "little") & ((1 << (i % STRIDE)) - 1)
        i, shift = rank + inside.bit_count(), shift + 8
    return value


def decode_block(codes: bytes):
    """All ids of a block."""
    import numpy as np

    raw, out, at = np.frombuffer(codes, np.uint8), None, None
    for k, (n, chunks, bitmap, _) in enumerate(levels_of(codes)):
        part = raw[chunks : chunks + n].astype("<u4") << (8 * k)
        if out is None:
            out, at = part, np.arange(n)
        else:
            out[at] |= part
        if bitmap:
            at = at[np.unpackbits(raw[bitmap : bitmap + -(-n // 8)], count=n, bitorder="little").view(bool)]
    return out


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 1, block_tokens: int = 1 << 20, num_partitions: int | None = None) -> None:
    """Encode whole texts, append ``end_id`` to each and write them in ascending doc_id order.

    Null text is empty text. Null doc_ids come first; rows with equal doc_ids are ordered by a
    hash of their text, then the text. Documents are dealt by ranges of that order, so a
    doc_id that many rows share is still spread. An empty table writes an empty dataset.
    """
    tokens = tokenizer or default_tokenizer()

    def kernel(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end, part = word_ids(tokens).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        block, first = 0, 0
        names: list = []
        ids: list[bytes] = []

        def flush():
            nonlocal block, first
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = [[part], [block], [first], [len(flat)], [list(names)], [[len(x) // 4 for x in ids]], [encode_block(flat)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])
            block, first = block + 1, first + len(flat)
            names.clear()
            ids.clear()
            return out

        held = 0
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                names.append(doc_id)
                ids.append(encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(num_partitions or partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(kernel, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: its ids, and the number of ids in all documents before it.

    Only the totals of the written partitions are summed up in order; there are as many as
    ``num_partitions``, so their broadcast does not grow with the documents.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).collect()
    before, bases = 0, {}
    for part, tokens in sorted(tuple(x) for x in totals):
        bases[part] = before
        before += tokens

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            for row in rows.to_pylist():
                ends = np.cumsum(row["doc_tokens"])
                starts, flat = ends - row["doc_tokens"], decode_block(row["codes"]).tobytes()
                ids = [flat[4 * s : 4 * e] for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(bases[row["part"]] + row["first_token"] + starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(kernel, DOCUMENTS)
