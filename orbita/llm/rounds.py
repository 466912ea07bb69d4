"""Rounds of requests: chunks of texts ask buckets of the key space what all chunks hold of their keys.

A chunk is one row of blobs and sends each bucket its distinct keys with a number each; the bucket adds up and answers
every chunk in the order of its keys. A key that a third of all rows share is thus one number per chunk, and no task
holds the rows of a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import distinct, grouped, trim, unpacked
from .common import map_rows, partitions

MESSAGE = "src long, at int, kind int, dest int, a binary, b binary, c binary, n long"
NAMES = [f.split()[0] for f in MESSAGE.split(", ")]
#: The kind of a chunk's own row.
TEXTS = 0


def message(src, at, kind, dest, a, b=None, c=None, n=0) -> tuple:
    return src, at, kind, dest, a, b, c, n


def columns(rows: list[tuple]) -> dict:
    return dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {name: [] for name in NAMES}


def place(task: int, k: int, parts: int) -> tuple[int, int]:
    """A chunk's number and the task that gathers its answers: chunks of all tasks are dealt evenly."""
    return task << 24 | k, (task + 7919 * k) % parts


def to_buckets(requests: DataFrame) -> DataFrame:
    parts = partitions(requests.sparkSession)
    return requests.repartitionById(parts, F.expr(f"pmod(dest, {parts})")).sortWithinPartitions("dest", "kind", "src")


def to_chunks(*tables: DataFrame) -> DataFrame:
    """The rows of each chunk together: its own, then the answers in the order of its keys."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.repartitionById(partitions(rows.sparkSession), "at").sortWithinPartitions("src", "kind", "dest").select("src", "at", "kind", "a", "b", "c")


def each_chunk(rows: DataFrame, schema: str, of) -> DataFrame:
    """The rows that ``of`` yields for a chunk's number, task, blobs, and answers by kind."""

    def work(batches):
        for (src, at), own in grouped(batches, 2):
            answers: dict[int, list[bytes]] = {}
            for kind, a, _, _ in own[1:]:
                answers.setdefault(kind, []).append(a)
            yield from of(src, at, own[0][1:], answers)
            del own, answers
            trim()

    return map_rows(rows, ["src", "at", "kind", "a", "b", "c"], schema, work)


def common_keys(rows: list[tuple]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of requests (src, at, a, b, c), and where each request's keys stand among them."""
    keys = [unpacked(r[2]) for r in rows]
    unique = distinct(np.concatenate(keys))
    to = []
    while keys:  # each goes as soon as its places are known
        to.append(np.searchsorted(unique, keys.pop()).astype(np.uint32))
    return unique, to[::-1]
