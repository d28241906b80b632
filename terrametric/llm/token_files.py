"""Token ids in binary files, coded by Simple-8b with escapes.

File format, all integers little-endian. A file is a run of chunks, each of
whole documents and readable on its own:

    magic     8 bytes  "TMS8B-01"
    counts    5 x u64  documents, ids, blocks, words, escapes
    doc_id    i64 a document        (0 where the id is null)
    has_id    u8 a document
    n_tokens  u64 a document
    words_at  u32 a block and one more: the block's first word
    escapes_at u32 a block and one more: the block's first escape
    words     u64
    escapes   u16

The ids of a chunk, one document after the other, are cut into blocks of 128.
A word has a selector in its top 4 bits and packs that selector's count of ids
from the lowest bits up; the last word of a block may hold fewer. An id that
is all ones in its slot, or larger, is escaped: the slot holds all ones, and
the block's next escape what the id is above that. The offsets let all blocks
be decoded at once, without a loop over words.

A manifest table lists each file's chunks. It names only files of tasks that
succeeded: a lost or repeated task leaves at most a file that nobody reads.

Defined results: null text is an empty document (its end id only); rows with a
null id come first; rows of one id are ordered by their text's hash, a
repeated row is a document of its own; an empty table gives no chunks; other
columns than id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, qualified, ready_workers

MAGIC = b"TMS8B-01"
BLOCK = 128
#: Ids after which a chunk is closed, at the end of a document.
CHUNK_IDS = 1 << 18
#: Chunks that one task reads, about.
CHUNKS_A_TASK = 32
END_ID = 0

#: Fixed values of the coding: selector -> (ids a word, bits an id). The widest holds any id below 2**60.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: What the encoder tries at a place, by bits an id, an escape being 16: (selector, escapes at most).
_CHOICES = sorted(((s, e) for s, (c, w) in enumerate(SELECTORS) for e in ((0, 1) if w in (10, 12, 15) else (0,))), key=lambda x: ((64 + 16 * x[1]) / SELECTORS[x[0]][0], x[1]))


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and the first word and escape of each block (one more entry for the end)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, "<u2"), np.zeros(1, "<u4"), np.zeros(1, "<u4")
    if int(ids.max()) >= (1 << 60) - 1:
        raise ValueError("an id must be below 2**60 - 1")
    # A column a block, so that the ids j places on are one run of memory; the zeros below fit any slot.
    grid = np.zeros((BLOCK + 60, blocks), ids.dtype)
    whole = n // BLOCK
    grid[:BLOCK, :whole] = ids[: whole * BLOCK].reshape(-1, BLOCK).T
    if whole < blocks:
        grid[: n - whole * BLOCK, -1] = ids[whole * BLOCK :]
    wide = np.iinfo(ids.dtype).max
    choice = np.full((BLOCK, blocks), 255, np.uint8)
    over: dict[int, np.ndarray] = {}
    for k, (s, allowed) in reversed(list(enumerate(_CHOICES))):  # the cheapest choice that fits is written last
        count, width = SELECTORS[s]
        most = (1 << width) - 1
        if width not in over:
            over[width] = (grid >= most).view(np.uint8) if most <= wide else np.zeros(grid.shape, np.uint8)
            if width in (10, 12, 15) and most + 65536 <= wide:  # an escape holds 16 bits
                over[width] += (grid >= most + 65536).view(np.uint8) * 16
        if allowed:
            held = over[width][:BLOCK].copy()
            for j in range(1, count):
                held += over[width][j : BLOCK + j]
        else:
            held, seen = over[width], 1
            while seen < count:  # windows of twice the length from two that meet or overlap
                step = min(seen, count - seen)
                held = held[:-step] | held[step:]
                seen += step
            held = held[:BLOCK]
        np.copyto(choice, np.uint8(k), where=held <= allowed)
    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    counts = np.array([SELECTORS[s][0] for s, _ in _CHOICES], np.int64)
    at, alive, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(alive):  # all blocks take their next word together
        place = at[alive]
        k = choice[place, alive]
        found.append((alive, place, k))
        place = place + counts[k]
        at[alive] = place
        alive = alive[place < lengths[alive]]
    per_block = np.bincount(np.concatenate([x[0] for x in found]), minlength=blocks)
    words_at = np.concatenate([[0], np.cumsum(per_block)])
    # The t-th words of all blocks go t places behind their blocks' first words.
    block, place, k = (np.empty(words_at[-1], x.dtype) for x in found[0])
    for t, (own, p, c) in enumerate(found):
        to = words_at[own] + t
        block[to], place[to], k[to] = own, p, c
    words = np.empty(len(block), np.uint64)
    for c in np.unique(k):
        s = _CHOICES[c][0]
        count, width = SELECTORS[s]
        own = np.flatnonzero(k == c)
        rows, cols = place[own], block[own]
        word = np.full(len(own), s << 60, np.uint64)
        for j in range(count):
            word |= np.minimum(grid[rows + j, cols], min((1 << width) - 1, wide)).astype(np.uint64) << np.uint64(j * width)
        words[own] = word
    # Escapes in order of their ids.
    most = np.array([(1 << SELECTORS[s][1]) - 1 if e else 0 for s, e in _CHOICES], ids.dtype)[k]  # 0: none in this word
    least = np.repeat(most, np.diff(np.append(block * BLOCK + place, n)))
    escaped = np.flatnonzero((ids >= least) & (least > 0))
    escapes = (ids[escaped] - least[escaped]).astype("<u2")
    words_at = words_at.astype("<u4")
    escapes_at = np.concatenate([[0], np.cumsum(np.bincount(escaped // BLOCK, minlength=blocks))]).astype("<u4")
    return words.astype("<u8", copy=False), escapes, words_at, escapes_at


def decode_blocks(words: np.ndarray, escapes: np.ndarray, words_at: np.ndarray, escapes_at: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive blocks, `n` in all; every block but the last of a chunk holds 128."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts, widths = (np.array(x, np.int64) for x in zip(*SELECTORS, strict=True))
    per_word = counts[selector]
    # Where a word's ids begin: blocks are 128 apart, within a block words follow each other.
    block = np.repeat(np.arange(len(words_at) - 1), np.diff(words_at.astype(np.int64)))
    total = np.cumsum(per_word) - per_word
    start = block * BLOCK + total - total[words_at[:-1].astype(np.int64)][block] if len(words) else total
    out = np.zeros(n + 60, np.uint64)
    least = np.full(n + 60, np.iinfo(np.uint64).max, np.uint64)
    for s in np.unique(selector)[::-1] if len(words) else ():
        count, width = SELECTORS[s]
        own = np.flatnonzero(selector == s)
        slots = (words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
        at = start[own][:, None] + np.arange(count)
        end = np.append(start[1:], n)[own][:, None]
        real = at < np.minimum(end, n)  # a block's last word may be padded
        out[at[real]] = slots[real]
        least[at[real]] = (1 << width) - 1
    escaped = np.flatnonzero(out[:n] >= least[:n])
    out[escaped] += escapes.astype(np.uint64)
    return out[:n]


def chunk_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, escapes, words_at, escapes_at = encode_blocks(ids)
    counts = np.array([len(doc_ids), len(ids), len(words_at) - 1, len(words), len(escapes)], "<u8")
    parts = [
        counts,
        np.array([x or 0 for x in doc_ids], "<i8"),
        np.array([x is not None for x in doc_ids], "u1"),
        np.array(lengths, "<u8"),
        words_at,
        escapes_at,
        words,
        escapes,
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of tokens, and all ids of the chunk."""
    if data[:8] != MAGIC:
        raise ValueError("not a chunk of token ids")
    docs, n, blocks, n_words, n_escapes = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
    at, out = 48, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u4", blocks + 1), ("<u8", n_words), ("<u2", n_escapes)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    doc_ids, has_id, lengths, words_at, escapes_at, words, escapes = out
    ids = decode_blocks(words, escapes, words_at, escapes_at, n)
    return [int(d) if h else None for d, h in zip(doc_ids, has_id, strict=True)], lengths.astype(np.int64), ids


def _store(uri: str):
    """(file system, path) of any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = "part int, path string, chunk int, at long, bytes long, docs long, ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending id order; returns the manifest, a row per chunk.

    The texts are exchanged once, by ranges of the id, and each range becomes one file.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, kind).encode
        end = END_ID.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex[:8]}.s8b"
        sink, rows, at = None, [], 0
        doc_ids: list[int | None] = []
        own: list[bytes] = []

        def close():
            nonlocal at, doc_ids, own
            data = chunk_bytes(doc_ids, [len(x) // 4 for x in own], np.frombuffer(b"".join(own), "<u4"))
            sink.write(data)
            rows.append((part, path, len(rows), at, len(data), len(own), sum(map(len, own)) // 4))
            at, doc_ids, own = at + len(data), [], []

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sink is None:
                    store, name = _store(path)
                    store.create_dir(_store(folder)[1], recursive=True)
                    sink = store.open_output_stream(name)
                ids = encode([text.as_py()])[0] + end
                doc_ids.append(doc)
                own.append(ids)
                held += len(ids) // 4
                if held >= CHUNK_IDS:
                    close()
                    held = 0
        if own:
            close()
        if sink is not None:
            sink.close()
        names = [x.split()[0] for x in _MANIFEST.split(", ")]
        types = {"part": pa.int32(), "path": pa.string(), "chunk": pa.int32()}
        cols = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, types.get(x, pa.int64())) for x, c in zip(names, cols, strict=True)], names)

    order = ["doc_id", "text_hash", "row"]
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


_DOCUMENTS = "part int, doc_id long, start long, n_tokens long, ids binary"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian)."""
    ready_workers(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # Sums before a chunk: of the files before its own, a row each, and of the chunks before it in its file.
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("file_before"))
    chunks = manifest.withColumn("chunk_before", earlier(Window.partitionBy("part").orderBy("chunk"))).join(files, "part").withColumn("before", F.col("file_before") + F.col("chunk_before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _store(row["path"])
                with store.open_input_file(name) as f:
                    doc_ids, lengths, ids = read_chunk(f.read_at(row["bytes"], row["at"]))
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(doc_ids), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + row["before"], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    tasks = max(1, -(-manifest.count() // CHUNKS_A_TASK))
    spread = chunks.select("part", "path", "at", "bytes", "before").repartition(tasks, "path", "at")
    return spread.mapInArrow(read, _DOCUMENTS).drop("part")


def roundtrip_digest(docs: DataFrame, tokenizer: str, kind: str = "byte", folder: str | None = None) -> DataFrame:
    """Writes all documents' ids, reads the files back, and returns a row per document from what was read."""
    spark = docs.sparkSession
    folder = folder or Scratch(spark, "token-files").path("ids")
    write_token_files(docs, folder, tokenizer, kind)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def digest(ids: bytes) -> int:
    return zlib.crc32(ids)
