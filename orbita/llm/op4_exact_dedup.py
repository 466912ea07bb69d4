"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name by sorting; then adjacent
names are named in pairs, again by sorting, until a document has one name. Names are given to keys, never to hashes,
so two documents have one identity exactly if their texts are equal. Documents stay in chunks; a chunk asks for the name
of each of its distinct keys once, so that a block which a third of all documents share is one row per chunk.

Null texts count as empty. Of equal texts the row with the largest doc_id stays (a null doc_id is the smallest; of
rows equal in both, one stays). Columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import grouped
from .common import BROADCAST_KEYS, forget, join_counted, map_rows, partitions, saved, table
from .rounds import place

BLOCK_BYTES = 4096
#: A chunk ends when its distinct blocks have so many bytes.
HELD_BYTES = 32 << 20

#: idx -1: a chunk's own row, its documents in ``state``; else the key that is asked for. ``done``: what has one name.
ASKED = "src long, at int, idx int, block binary, left long, right long, state binary"
DONE = "row long, doc_id long, digest binary, rounds int, name long"
ROW = "_orbita_row"


class Asked:
    """The distinct keys of a chunk, each with its place."""

    def __init__(self):
        self.places: dict = {}
        self.bytes = 0

    def __call__(self, key) -> int:
        at = self.places.setdefault(key, len(self.places))
        if at == len(self.places) - 1 and isinstance(key, bytes):
            self.bytes += 100 + len(key)
        return at

    def rows(self, src: int, at: int, state: bytes) -> dict:
        keys, n = list(self.places), len(self.places)
        blocks = n and isinstance(keys[0], bytes)
        side = lambda k: [None, *(None if blocks else key[k] for key in keys)]
        return {"src": [src] * (n + 1), "at": [at] * (n + 1), "idx": [-1, *range(n)], "block": [None, *(keys if blocks else [None] * n)], "left": side(0), "right": side(1), "state": [state, *[None] * n]}


def packed_state(rows: np.ndarray, about: bytes, sizes: np.ndarray, of: np.ndarray) -> bytes:
    """Documents by row number, with doc_id and digest (41 bytes each), number of names and places of their keys."""
    return np.int64(len(rows)).tobytes() + rows.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + of.astype("<i4").tobytes() + zlib.compress(about, 1)


def unpacked_state(state: bytes) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(state, "<i8", 1)[0])
    rows, sizes = np.frombuffer(state, "<i8", 2 * n, 8).reshape(2, n)
    places = int(sizes.sum())
    return rows, zlib.decompress(state[8 + 16 * n + 4 * places :]), sizes, np.frombuffer(state, "<i4", places, 8 + 16 * n)


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    parts = partitions(docs.sparkSession)
    numbered = ROW in docs.columns

    def work(batches):
        task, k, at_row = TaskContext.get().partitionId(), 0, 0
        ask, rows, about, sizes, of = Asked(), [], [], [], []

        def chunk():
            src, at = place(task, k, parts)
            return ask.rows(src, at, packed_state(np.array(rows, np.int64), b"".join(about), np.array(sizes, np.int64), np.array(of, np.int32)))

        for ids, texts, *row in batches:
            for j, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                data = (text or "").encode("utf-8")
                n = max(1, -(-len(data) // block_bytes))
                of += [ask(data[i * block_bytes : (i + 1) * block_bytes]) for i in range(n)]
                sizes.append(n)
                rows.append(row[0][j] if numbered else task << 40 | at_row)
                about.append(bytes([doc_id is not None]) + (doc_id or 0).to_bytes(8, "little", signed=True) + hashlib.sha256(data).digest())
                at_row += 1
                if ask.bytes > HELD_BYTES:
                    yield chunk()
                    ask, rows, about, sizes, of, k = Asked(), [], [], [], [], k + 1
        if rows:
            yield chunk()

    return map_rows(docs, ["doc_id", "text", *[ROW] * numbered], ASKED, work)


def named(asked: DataFrame, key: list[str]) -> DataFrame:
    """(src, at, idx, name): name = partition * 2^40 + rank of the key among the partition's sorted keys."""
    sent = asked.where("idx >= 0").repartition(partitions(asked.sparkSession), *key).sortWithinPartitions(*key)

    def work(batches):
        last, name = None, (TaskContext.get().partitionId() << 40) - 1
        for src, at, idx, *keys in batches:
            names = []
            for now in zip(*keys, strict=True):
                if now != last:
                    last, name = now, name + 1
                names.append(name)
            yield {"src": src, "at": at, "idx": idx, "name": names}

    return map_rows(sent, ["src", "at", "idx", *key], "src long, at int, idx int, name long", work)


def told(asked: DataFrame, names: DataFrame, rounds: int) -> DataFrame:
    """Each chunk's next keys, pairs of adjacent names (an odd last name is paired with -1), and its documents that have one name."""
    rows = asked.where("idx = -1").select("src", "at", "idx", "state", F.lit(None).cast("long").alias("name")).unionByName(names.withColumn("state", F.lit(None).cast("binary")))
    sent = rows.repartitionById(partitions(asked.sparkSession), "at").sortWithinPartitions("src", "idx")

    def work(batches):
        for (src, at), held in grouped(batches, 2):
            numbers, about, sizes, of = unpacked_state(held[0][1])
            name = np.array([n for *_, n in held[1:]], np.int64)[of]
            first = np.cumsum(sizes) - sizes
            one = np.flatnonzero(sizes == 1)
            entry = [about[41 * i : 41 * i + 41] for i in range(len(numbers))]
            more = np.flatnonzero(sizes > 1)
            n = len(one)
            done = {
                "row": numbers[one].tolist(), "doc_id": [int.from_bytes(entry[i][1:9], "little", signed=True) if entry[i][0] else None for i in one.tolist()],
                "digest": [entry[i][9:] for i in one.tolist()], "rounds": [rounds] * n, "name": name[first[one]].tolist(),
            }
            empty = {c.split()[0]: [None] * n for c in ASKED.split(", ")}
            ask, next_of = Asked(), []
            for i in more.tolist():
                own = name[first[i] : first[i] + sizes[i]].tolist()
                own += [-1] * (len(own) % 2)
                next_of += [ask(pair) for pair in zip(own[::2], own[1::2], strict=True)]
            if n:
                yield empty | done
            if len(more):
                next_ = ask.rows(src, at, packed_state(numbers[more], b"".join(entry[i] for i in more.tolist()), (sizes[more] + 1) // 2, np.array(next_of, np.int32)))
                yield next_ | {c.split()[0]: [None] * len(next_["src"]) for c in DONE.split(", ")}

    return map_rows(sent, ["src", "at", "idx", "state", "name"], f"{ASKED}, {DONE}", work)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, digest, rounds, name) of every row: equal (rounds, name) exactly for equal texts. row: of the column ROW if docs has one."""
    columns = [c.split()[0] for c in DONE.split(", ")]
    asked, key, rounds, done = saved(blocks(docs, block_bytes)), ["block"], 0, []
    while True:
        now = saved(told(asked, named(asked, key), rounds))
        forget(asked)
        done.append(now.where("row IS NOT NULL").select(*columns))
        asked, key, rounds = now.where("src IS NOT NULL").select(*[c.split()[0] for c in ASKED.split(", ")]), ["left", "right"], rounds + 1
        if asked.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (row, doc_id, keep_id, group_size, kept, text_sha256)."""
    each = identities(docs, block_bytes)
    groups = saved(each.groupBy("rounds", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")).withColumn("held", F.col("group_size")))
    return join_counted(each, groups, ["rounds", "name"]).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; null and empty texts are equal, an empty table stays empty."""
    numbered = saved(docs.withColumn(ROW, F.monotonically_increasing_id()))
    gone = saved(exact_groups(numbered, block_bytes).where("NOT kept").select(F.col("row").alias(ROW)))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return numbered.join(gone, ROW, "left_anti").drop(ROW)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
