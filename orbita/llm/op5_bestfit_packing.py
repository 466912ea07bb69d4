"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most ``CAPACITY`` tokens; full pieces are sequences of their own. The others are
dealt to blocks. Each block is evolved on several islands: a chromosome is a list of bins; crossover takes whole
well-filled bins of one parent into the other, drops the bins there that hold a document twice and fits the displaced
documents anew: an item of a bin is changed for a longer displaced one where that fills the bin better, new bins are
filled by pairs that leave the least room, the rest goes where it fits best, longest first. Populations live on from
epoch to epoch, and between epochs each island receives its neighbour's elite. An epoch ends when ``CHILDREN`` children
in a row bring no fewer bins, or when the bins are as few as the tokens allow. Of a block's best chromosome the fullest
bins stay, and the worst are dealt again with those of other blocks, until one block is left.

Null texts count as empty: one piece with the end token only. Repeated rows are pieces of their own; null doc_ids are
kept; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import struct
import zlib
from bisect import bisect_left, insort

import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import trim
from .bpe import word_encoder
from .common import map_rows, partitions, saved, table

VOCABULARY, CAPACITY, END = "word_bpe_49k.json", 4096, 1
#: Pieces in a block, islands of a block, epochs between which elites migrate, children without gain that end an epoch, chromosomes of an island.
BLOCK, ISLANDS, EPOCHS, CHILDREN, POPULATION = 8192, 2, 2, 32, 6
#: Pairs that are tried for each place in a new bin.
PAIRS = 12
#: The share of a block's bins, the worst filled, that is dealt again.
AGAIN = 0.05


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, doc_id, piece, start, length, ids_crc32) of every piece of every row."""

    def work(batches):
        trim()  # a worker may come from another stage
        coder, n = word_encoder(path), TaskContext.get().partitionId() << 40
        end, step = struct.pack("<I", END), 4 * capacity
        for keys, texts in batches:
            out: dict[str, list] = {c: [] for c in ("id", "doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(keys, coder.encode_many([t or "" for t in texts]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for c, v in zip(out.values(), (n, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
                    n += 1
            yield out
        trim()

    return map_rows(docs, ["doc_id", "text"], "id long, doc_id long, piece int, start long, length long, ids_crc32 long", work)


class Bins:
    """Bins under best fit: the least room that is enough is found by bisection."""

    def __init__(self, capacity: int, lengths: list[int]):
        self.capacity, self.lengths = capacity, lengths
        self.bins: list[list[int]] = []
        self.rooms: list[int] = []  # sorted rooms for which a bin is open
        self.open: dict[int, list[int]] = {}

    def give(self, bin_: int, room: int) -> None:
        if room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append(bin_)

    def add(self, items: list[int]) -> None:
        """A whole bin."""
        self.bins.append(items)
        self.give(len(self.bins) - 1, self.capacity - sum(self.lengths[i] for i in items))

    def fit(self, items: list[int]) -> None:
        """Best fit, the longest first."""
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            size = self.lengths[i]
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                self.bins.append([i])
                self.give(len(self.bins) - 1, self.capacity - size)
                continue
            room = self.rooms[at]
            bin_ = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                del self.rooms[at]
            self.bins[bin_].append(i)
            self.give(bin_, room - size)


    def fill(self, items: list[int]) -> None:
        """Exchanges that fill open bins better, then new bins by the best of some pairs, then best fit."""
        lengths, free = self.lengths, sorted((self.lengths[i], i) for i in items)
        for room in list(self.rooms):
            for bin_ in list(self.open.get(room, ())):
                best, own = (0, -1, -1), self.bins[bin_]
                for k, x in enumerate(own):
                    at = bisect_left(free, (lengths[x] + room + 1, -1)) - 1
                    if at >= 0 and free[at][0] - lengths[x] > best[0]:
                        best = (free[at][0] - lengths[x], k, at)
                if best[0]:
                    gain, k, at = best
                    own[k], out = free.pop(at)[1], own[k]
                    insort(free, (lengths[out], out))
                    self.open[room].remove(bin_)
                    if not self.open[room]:
                        del self.open[room]
                        self.rooms.remove(room)
                    self.give(bin_, room - gain)
        rest = []
        while free:
            size, i = free.pop()
            if bisect_left(self.rooms, size) < len(self.rooms):
                rest.append(i)  # fits into an open bin
                continue
            own, room = [i], self.capacity - size
            while (end := bisect_left(free, (room + 1, -1))) > 0:
                best = (free[end - 1][0], end - 1)
                for at in {end - 1 - (end - 1) * k // PAIRS for k in range(PAIRS)}:
                    left = room - free[at][0]
                    other = bisect_left(free, (left + 1, -1)) - 1
                    other -= other == at
                    best = max(best, (free[at][0] + (free[other][0] if other >= 0 else 0), at))
                size, i = free.pop(best[1])
                own.append(i)
                room -= size
            self.bins.append(own)
            self.give(len(self.bins) - 1, room)
        self.fit(rest)


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins as unequally filled as can be."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: list[list[int]], source: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    fill = sorted(source, key=lambda b: -sum(lengths[i] for i in b))
    best = fill[: max(1, len(fill) // 2)]
    injected = rng.sample(best, max(1, len(best) // 2))
    taken = {i for b in injected for i in b}
    child, displaced = Bins(capacity, lengths), []
    for b in injected:
        child.add(list(b))
    for b in into:
        if taken.isdisjoint(b):
            child.add(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    child.fill(displaced)
    return child.bins


def mutated(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The worst bins and some others are dissolved."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = set(order[: max(1, len(order) // 20)]) | set(rng.sample(order, len(order) // 10))
    out = Bins(capacity, lengths)
    for k, b in enumerate(bins):
        if k not in gone:
            out.add(list(b))
    out.fill([i for k in sorted(gone) for i in bins[k]])
    return out.bins


def evolve(lengths: list[int], capacity: int, seed: int, people: list[list[list[int]]], enough: int = 0, children: int = CHILDREN, population: int = POPULATION) -> list[list[list[int]]]:
    """The population after an epoch, the best first.

    The epoch goes on until so many ``children`` in a row have brought no fewer bins; it ends at once where the bins are
    ``enough`` or as few as the tokens allow.
    """
    rng, enough = random.Random(seed), max(enough, -(-sum(lengths) // capacity))
    key = lambda bins: fitness(bins, lengths, capacity)
    if not people:
        for start in ("fit", "fill"):
            first = Bins(capacity, lengths)
            getattr(first, start)(list(range(len(lengths))))
            people = [*people, first.bins]
            if len(first.bins) <= enough:
                return [first.bins]
    people = sorted(people, key=key)
    if len(people[0]) <= enough:
        return people[:1]
    while len(people) < population:
        people.append(mutated(rng.choice(people), lengths, capacity, rng))
    people.sort(key=key)
    least, stale = len(people[0]), 0
    while stale < children and least > enough:
        a, b = rng.sample(range(len(people)), 2)
        child = crossover(people[a], people[b], lengths, capacity, rng)
        people[-1] = mutated(child, lengths, capacity, rng) if rng.random() < 0.5 else child
        people.sort(key=key)
        least, stale = len(people[0]), 0 if len(people[0]) < least else stale + 1
    return people[:population]


def numbers(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def lists(of: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        out.setdefault(k, []).append(i)
    return list(out.values())


def solved(blocks: DataFrame, capacity: int, last: bool = True) -> DataFrame:
    """(block, ids, lengths, bins) of every block: the best island after all epochs. All blocks are evolved alike, ``last`` or not."""
    islands = blocks.select("block", "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array().cast("array<array<int>>").alias("people"))
    for epoch in range(EPOCHS):

        def work(batches, epoch=epoch):
            for block, ids, lengths, island, people in batches:
                found = []
                for b, own, k, before in zip(block, lengths, island, people, strict=True):
                    found.append([numbers(bins, len(own)) for bins in evolve(own, capacity, (b * ISLANDS + k) * EPOCHS + epoch, [lists(p) for p in before])])
                yield {"block": block, "ids": ids, "lengths": lengths, "island": island, "people": found}

        # a row is a bounded block; dealing rows evenly keeps all cores busy
        dealt = islands.repartition(partitions(blocks.sparkSession), "block", "island")
        out = saved(map_rows(dealt, ["block", "ids", "lengths", "island", "people"], "block long, ids array<long>, lengths array<int>, island int, people array<array<int>>", work))
        if epoch < EPOCHS - 1:
            migrants = out.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("people", 1, 1).alias("migrant"))
            islands = out.join(migrants, ["block", "island"]).select("block", "ids", "lengths", "island", F.concat("people", "migrant").alias("people"))
    best = out.groupBy("block").agg(F.min_by("island", F.struct(F.array_max(F.col("people")[0]), "island")).alias("island"))
    return out.join(best, ["block", "island"]).select("block", "ids", "lengths", F.col("people")[0].alias("bins"))


def placed(blocks: DataFrame, capacity: int, last: bool) -> DataFrame:
    """(id, length, sequence_id, offset) of a solution; sequence_id is null for pieces that are dealt again."""

    def work(batches):
        for ids, lengths, bins in batches:
            out: dict[str, list] = {c: [] for c in ("id", "length", "sequence_id", "offset")}
            for own, sizes, of in zip(ids, lengths, bins, strict=True):
                groups = sorted(lists(of), key=lambda b: sum(sizes[i] for i in b))
                loose = 0 if last else max(1, math.ceil(AGAIN * len(groups)))
                for k, b in enumerate(groups):
                    at = 0
                    for i in b:
                        for c, v in zip(out.values(), (own[i], sizes[i], None if k < loose else own[b[0]], at), strict=True):
                            c.append(v)
                        at += sizes[i]
            yield out

    return map_rows(blocks, ["ids", "lengths", "bins"], "id long, length int, sequence_id long, offset long", work)


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(id, sequence_id, offset) of items (id, length): a sequence is named by the id of its first item."""
    done = items.where(F.col("length") >= capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, turn = items.where(F.col("length") < capacity).select("id", F.col("length").cast("int").alias("length")), 0
    while n := rest.count():
        blocks, turn = -(-n // block), turn + 1
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(blocks)))
        grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "id")), asc=False).alias("all")).select("block", F.col("all.id").alias("ids"), F.col("all.length").alias("lengths"))
        result = saved(placed(solved(grouped, capacity), capacity, blocks == 1))
        done = done.unionByName(result.where("sequence_id IS NOT NULL").select("id", "sequence_id", "offset"))
        if blocks == 1:
            break
        rest = result.where("sequence_id IS NULL").select("id", "length")
    return done


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    cut = saved(pieces(docs, path, capacity))
    return cut.join(pack(cut, capacity), "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
