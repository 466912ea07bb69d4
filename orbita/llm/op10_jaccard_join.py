"""Near-duplicate join of word-shingle sets by parity sketches.

Sets are dealt to size bands of ratio 1.25 and compared in spaces of two neighbouring bands. In a space that allows at
most d differing shingles a set is sketched as p > d parts; a shingle's hash picks its part and is added to it, so a
shingle more or less changes one part and the number of differing parts is at most the symmetric difference. Two
linked sets thus agree in at least p - d parts, those that are empty in both included. A set with e empty parts may
therefore leave out its p - d - e - 1 commonest parts, and linked sets still meet in one: passages that many documents
share are left out without loss. A set with p - d or more empty parts also sends its single shingles, of which four
fifths less one may be left out alike.

How many sets hold a part is told by rounds of requests (see ``rounds``). Sets that still meet in a part of more than
``MANY`` sets take part in a second join, on their rarest shingles: what is common even there makes up four fifths of a
set. Sets that share a part are first compared with one set there (a star, not all pairs): parity sketches of about as
many bits as shingles rule out most chance meetings, texts decide. Then the parts whose sets still carry different
labels are gone through: sets that sketches leave a possible partner of another label meet in a task, which verifies the
nearest pairs first and skips pairs that links found so far connect. Parts of more than ``MANY`` sets are dealt to
blocks; only sets without the commonest label there go to all of them. An eighth of the parts goes first, so that large
groups of copies have one label before all parts are looked at; only the links found are sent on.

Texts are hashed once for sets and parts. Equal sets are one node from the start, and of those in several chunks one counts
as a holder of its parts. A node is a 128-bit digest of its set. Null or empty texts have no shingles and
link with nothing; null doc_ids are the smallest id and give a null component only among themselves. Every row gives
one row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import counts, grouped, packed, ranges, trim, uncounted, unpacked
from .common import forget, join_counted, map_rows, partitions, saved, table
from .components import components
from .hashing import mix, shingle_sets
from .rounds import MESSAGE, NAMES, TEXTS, columns, common_keys, each_chunk, message, place, to_buckets, to_chunks

SHINGLE, PERCENT = 5, 80
#: Keys in a chunk of sets, and keys of all sets for each bucket of the key space.
CHUNK, BUCKET = 2_000_000, 8_000_000
#: Sets of one part that a task compares with each other; larger groups are compared block by block.
MANY = 1000
#: So many ids (16 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
NO_ID = -(2**63)
#: Kinds of messages: requests and their answers, a row's set, and a chunk's sets that other chunks have before it.
KEYS, SET, FOREIGN = 1, 2, 3
SETS = "doc_id long, n_shingles long, node binary, sketch binary, number long"
SET_NAMES = [f.split()[0] for f in SETS.split(", ")]
#: Sets whose pairs are compared one by one; of more many pairs are compared at once.
FEW = 16
#: Shingles of sets that are gone through together: few enough for a core's cache.
BUNCH = 1 << 15
#: Rows of postings, and bytes of requests, that a task hands over at once.
ROWS, BYTES = 50_000, 1 << 20


def band_edges(most: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < most:
        edges.append(-(-edges[-1] * 5 // 4) if edges[-1] > 4 else edges[-1] + 1)
    return edges


EDGES = np.array(band_edges())


def node_of(hashes: np.ndarray) -> bytes | None:
    """A 128-bit digest of a set; none for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def bunches(sets: list[np.ndarray]):
    """(first set, hashes, sizes) of neighbouring sets with about ``BUNCH`` shingles, none for no sets."""
    a, size = 0, 0
    for b, s in enumerate(sets, 1):
        size += len(s)
        if size >= BUNCH or b == len(sets):
            yield a, np.concatenate(sets[a:b]), np.array([len(x) for x in sets[a:b]], np.int64)
            a, size = b, 0


def allowed(space):
    """Differing shingles of linked sets of bands ``space`` and ``space + 1``, the smaller set in the lower band: a quarter of it."""
    return (EDGES[space + 1] - 1) // 4


def needed(n: int) -> int:
    """Shingles that a set of n has in common with any linked one, at least."""
    return -(-n * PERCENT // 100)


class Lists:
    """Lists of keys of many sets: ``keys``, and of each list its length, its set's number, and how many of the commonest keys may be left out."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.about: list[np.ndarray] = []

    def add(self, keys, lengths, owner, out) -> None:
        self.keys.append(keys)
        self.about.append(np.array([lengths, owner, out], np.int64).reshape(3, -1))


def parts_of_all(sets: list[np.ndarray]) -> Lists:
    """The parts of sets in their two spaces."""
    lists = Lists()
    for at, hashes, sizes in bunches(sets):
        band = np.searchsorted(EDGES, sizes, "right") - 1
        for space in (band - 1, band):
            own = np.flatnonzero((space >= 0) & (EDGES[np.maximum(space, 0) + 1] > 4))  # else linked sets of such sizes are equal
            if not len(own):
                continue
            n, of = sizes[own], space[own].astype(np.uint64)
            here = hashes if len(own) == len(sizes) else hashes[np.repeat(np.isin(np.arange(len(sizes)), own), sizes)]
            d = allowed(space[own])
            p = d + d // 4 + 2
            seeded = mix(here ^ np.repeat(of * np.uint64(0x9E3779B97F4A7C15), n))
            part = (seeded >> np.uint64(32)) * np.repeat(p.astype(np.uint64), n) >> np.uint64(32)
            begin = np.cumsum(p) - p
            sums = np.zeros(int(p.sum()), np.uint64)
            np.add.at(sums, np.repeat(begin, n) + part.astype(np.int64), seeded)
            full = np.flatnonzero(sums)
            k = np.repeat(np.arange(len(own)), p)[full]
            held = np.bincount(k, minlength=len(own))
            empty = p - held
            lists.add(mix(sums[full] + mix((full - begin[k]).astype(np.uint64) + (of[k] << np.uint64(40)))), held, at + own, np.maximum(0, p - d - empty - 1))
            for i in np.flatnonzero(empty >= p - d).tolist():
                one = sets[at + own[i]]
                lists.add(mix(one ^ (of[i] << np.uint64(1) | np.uint64(1)) << np.uint64(48)), len(one), at + own[i], needed(len(one)) - 1)
    return lists


def parts_of(hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(keys, how many of the commonest may be left out) in a set's two spaces."""
    lists = parts_of_all([hashes])
    return [(keys, int(about[2, 0])) for keys, about in zip(lists.keys, lists.about, strict=True)]


def shingles_of(hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A set's shingles, of which any two linked sets have ``needed`` in common."""
    return [(hashes, needed(len(hashes)) - 1)]


def keyed_all(keyed, sets: list[np.ndarray]) -> Lists:
    """What ``keyed`` gives for each of many sets."""
    if keyed is parts_of:
        return parts_of_all(sets)
    lists = Lists()
    for i, s in enumerate(sets):
        for keys, out in keyed(s):
            lists.add(keys, len(keys), i, out)
    return lists


def sketches(sets: list[np.ndarray], times: int = 1) -> list[bytes]:
    """Of each set a parity bit for each of 2^k (64 at least) residues, ``times`` the shingles or more: a shingle more or less flips one bit."""
    out = []
    for _, hashes, sizes in bunches(sets):
        bits = np.array([max(64, times << max(0, n - 1).bit_length()) for n in sizes.tolist()], np.int64)
        ends = np.cumsum(bits)
        at = (mix(hashes + np.uint64(1)) >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, sizes)
        odd = np.bincount(at + np.repeat(ends - bits, sizes), minlength=int(ends[-1])) & 1
        whole = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
        out += [whole[a:b] for a, b in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist(), strict=True)]
    return out


def sketch_of(hashes: np.ndarray, times: int = 1) -> bytes:
    return sketches([hashes], times)[0]


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A sketch XORed into fewer residues; ``words`` of 64 bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, "<u8").reshape(-1, words), axis=0)


def bits_of(sketch: bytes, size: int) -> int:
    """A sketch as one number, XORed into the residues of ``size`` bytes."""
    x, n = int.from_bytes(sketch, "little"), len(sketch)
    while n > size:
        n //= 2
        x = x >> 8 * n ^ x & (1 << 8 * n) - 1
    return x


def near(n: int, sketch: bytes, m: int, other: bytes) -> bool:
    """False only if no sets of n and m shingles with these sketches are linked."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    size = min(len(sketch), len(other))
    return 9 * (bits_of(sketch, size) ^ bits_of(other, size)).bit_count() <= n + m


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared) > 0


def chunked(docs: DataFrame, keyed) -> DataFrame:
    """Every row's set, and chunks of sets; texts are hashed once for both.

    A set's row (kind ``SET``) has its chunk and its number there where it comes first. A chunk has equal sets once: nodes and what
    ``keyed`` lets them leave out (c), sorted keys (a) and whose they are (b).
    """
    parts = partitions(docs.sparkSession)

    def work(batches):
        task, k, size = TaskContext.get().partitionId(), 0, 0
        held: dict[bytes, int] = {}
        lists = Lists()

        def chunk():
            lengths, owner, out = np.concatenate([np.zeros((3, 0), np.int64), *lists.about], axis=1)
            about = np.int64(len(held)).tobytes() + b"".join(held) + owner.tobytes() + out.tobytes()
            keys = np.concatenate([np.zeros(0, np.uint64), *lists.keys])
            for x in (held, lists.keys, lists.about):
                x.clear()
            of = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
            order = np.argsort(keys)
            of = of[order]
            keys = keys[order]
            del order
            return message(*place(task, k, parts), TEXTS, 0, packed(keys), counts(of), zlib.compress(about, 1), len(keys))

        for ids, texts in batches:
            sets = shingle_sets(texts, SHINGLE)
            nodes, numbers, new = [node_of(s) for s in sets], [], []
            for s, node in zip(sets, nodes, strict=True):
                first = node is not None and node not in held
                numbers.append(len(held) if first else None)
                if first:
                    held[node] = len(held)
                    new.append(s)
            src, at = place(task, k, parts)
            rows = columns([message(src, at, SET, 0, None)] * len(sets))
            yield rows | {"doc_id": ids, "n_shingles": [len(s) for s in sets], "node": nodes, "sketch": sketches(sets), "number": numbers}
            own = keyed_all(keyed, new)
            for keys, about in zip(own.keys, own.about, strict=True):
                about[1] += len(held) - len(new)
                lists.keys.append(keys)
                lists.about.append(about)
                size += len(keys)
            del sets, nodes, new, own, rows
            trim()
            if size >= CHUNK:
                yield columns([chunk()]) | dict.fromkeys(SET_NAMES, [None])
                trim()
                size, k = 0, k + 1
        if held:
            yield columns([chunk()]) | dict.fromkeys(SET_NAMES, [None])
            trim()

    return map_rows(docs, ["doc_id", "text"], f"{MESSAGE}, {SETS}", work)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def listed(lists: np.ndarray, most: int):
    """Places of lists' numbers, whole lists in ascending order, about ``most`` places at once; a list's places ascend."""
    order, ends = np.argsort(lists, kind="stable"), np.cumsum(np.bincount(lists))
    a = 0
    while a < len(order):
        b = int(ends[min(np.searchsorted(ends, a + most), len(ends) - 1)])
        yield order[a:b]
        a = b


def foreign(read: DataFrame) -> DataFrame:
    """Messages to chunks: the numbers of their sets that a chunk before them has, too (a); saved."""
    own = read.where(F.col("number").isNotNull()).select("node", "src", "at", "number")
    least = own.groupBy("node").agg(F.min("src").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")
    rows = own.join(least, "node").where("src <> first").groupBy("src", "at").agg(F.sort_array(F.collect_list("number")).alias("numbers"))

    def work(batches):
        for src, at, numbers in batches:
            yield columns([message(x, y, FOREIGN, 0, packed(np.array(z, np.uint64))) for x, y, z in zip(src, at, numbers, strict=True)])

    return saved(map_rows(rows, ["src", "at", "numbers"], MESSAGE, work))


def of_chunk(a: bytes, b: bytes, c: bytes, gone: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A chunk's sorted keys and the list of each; of each list the set's number and what may be left out; nodes. Sets ``gone`` have no keys."""
    keys, lists, about = unpacked(a), uncounted(b).astype(np.uint32), zlib.decompress(c)
    nodes = int(np.frombuffer(about, "<i8", 1)[0])
    owner, out = np.frombuffer(about, "<i8", offset=8 + 16 * nodes).reshape(2, -1)
    if gone is not None:
        mine = np.ones(nodes, bool)
        mine[unpacked(gone).astype(np.int64)] = False
        mine = mine[owner][lists]
        keys, lists = keys[mine], lists[mine]
    return keys, lists, owner, out, [about[i : i + 16] for i in range(8, 8 + 16 * nodes, 16)]


def postings(texts: DataFrame, keyed) -> DataFrame:
    """(key, node, n) of all sets (doc_id, text), saved: the keys that n > 1 sets hold, without what each set may leave out."""
    return postings_of(saved(chunked(texts, keyed)))


def postings_of(read: DataFrame) -> DataFrame:
    """``postings`` of what ``chunked`` has read, which is deleted. Of equal sets in several chunks one counts."""
    chunks = read.where(F.col("kind") == TEXTS).select(*NAMES)
    elsewhere = foreign(read)
    told_once = elsewhere.select("src", F.col("a").alias("gone"))
    told_once = F.broadcast(told_once) if (elsewhere.agg(F.sum(F.length("a"))).first()[0] or 0) <= 16 * BROADCAST_IDS else told_once
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(read.sparkSession), -(-total // BUCKET))

    def ask(batches):
        for src, at, *blobs in batches:
            for x, y, *own in zip(src, at, *blobs, strict=True):
                keys, rows, size = of_chunk(*own)[0], [], 0
                for bucket, s in ranges(keys, buckets):  # equal keys are in one bucket
                    first = np.flatnonzero(firsts(keys[s]))
                    rows.append(message(x, y, KEYS, bucket, packed(keys[s][first]), counts(np.diff(first, append=s.stop - s.start))))
                    size += len(rows[-1][4]) + len(rows[-1][5])
                    if size >= BYTES:
                        yield columns(rows)
                        rows, size = [], 0
                del keys
                yield columns(rows)
                del rows
                trim()

    def answer(batches):
        for (dest,), rows in grouped(batches, 1):
            keys, to = common_keys(rows)
            held = np.zeros(len(keys), np.int64)
            del keys
            for r, here in zip(rows, to, strict=True):
                held[here] += uncounted(r[3])  # a request has distinct keys
            yield columns([message(src, at, KEYS, dest, counts(held[here])) for (src, at, *_), here in zip(rows, to, strict=True)])
            del rows, to, held
            trim()

    asked = to_buckets(map_rows(chunks.join(told_once, "src", "left"), ["src", "at", "a", "b", "c", "gone"], MESSAGE, ask))
    answers = saved(map_rows(asked, ["dest", "src", "at", "a", "b", "c"], MESSAGE, answer))

    def live(src, at, blobs, told):
        keys, lists, owner, out, nodes = of_chunk(*blobs, *told.get(FOREIGN, [None]))
        of_key = np.cumsum(firsts(keys), dtype=np.uint32)
        n, at_key = np.zeros(int(of_key[-1]) + 1 if len(keys) else 1, np.int64), 1  # the first key is number 1
        for x in told.get(KEYS, ()):
            part = uncounted(x)
            n[at_key : at_key + len(part)] = part
            at_key += len(part)
        shared = np.flatnonzero(n[of_key] > 1)  # those of one set are the rarest of a list and come after these
        keys, lists, n = keys[shared], lists[shared], n[of_key[shared]]
        del of_key, shared
        for places in listed(lists, ROWS):
            held, of_list = n[places], lists[places]
            order = np.lexsort((-held, of_list))  # of each list the commonest first, equal ones by key
            places, held = places[order], held[order]
            first = np.flatnonzero(firsts(of_list))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            kept = rank >= out[of_list]
            places, held = places[kept], held[kept]
            whose, own = owner[lists[places]], keys[places].astype(np.int64)
            for s in (slice(i, i + ROWS) for i in range(0, len(own), ROWS)):
                yield {"key": own[s].tolist(), "node": [nodes[i] for i in whose[s].tolist()], "n": held[s].tolist()}

    out = saved(each_chunk(to_chunks(chunks, answers, elsewhere), "key long, node binary, n long", live))
    forget(read, answers, elsewhere)
    return out


def salted(rows: DataFrame) -> DataFrame:
    """A part (key, n) in cells of about ``MANY`` rows: n is their number at least."""
    return rows.withColumn("cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MANY)).cast("int"))


def cells(parts: DataFrame) -> DataFrame:
    """A row for each cell of each part (key, n, ...)."""
    return parts.withColumn("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / MANY).cast("int") - 1)))


def stars(posts: DataFrame) -> DataFrame:
    """Distinct edges (a, b) from one set of each part, another for every part, to its others."""
    least = posts.groupBy("key", "n").agg(F.min(F.struct(F.xxhash64("key", "node"), "node")).alias("least")).select("key", "n", F.col("least.node").alias("a"))
    return salted(posts).join(cells(least), ["key", "n", "cell"]).where("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def with_shares(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, share, b), and (a, share): edges of a node with many are dealt to shares of about ``MANY``."""
    spread = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MANY).cast("int").alias("shares"))
    broad = spread.where("shares > 1")
    share = F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int").alias("share")
    return edges.join(broad, "a", "left").select("a", share, "b"), spread.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))


def likely(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (a, b) that sketches do not rule out."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    dealt, centers = with_shares(edges)
    both = dealt.join(side("b"), "b").join(centers.join(side("a"), "a"), ["a", "share"])

    def work(batches):
        for a, b, n, s, m, t in batches:
            keep = [near(*x) for x in zip(n, s, m, t, strict=True)]
            yield {"a": [x for x, k in zip(a, keep, strict=True) if k], "b": [x for x, k in zip(b, keep, strict=True) if k]}

    return map_rows(both, ["a", "b", "n_a", "s_a", "n_b", "s_b"], "a binary, b binary", work)


def verified_stars(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) whose sets are linked; a center with many edges is sent to several tasks."""
    dealt, centers = with_shares(edges)
    rows = dealt.select("a", "share", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(centers.select("a", "share", F.col("a").alias("node"), F.lit(0).alias("role")))
    sent = rows.join(texts, "node").select("a", "share", "role", "node", "text").repartition(partitions(edges.sparkSession), "a", "share").sortWithinPartitions("a", "share", "role")

    def work(batches):
        center, own = None, None
        for a, _, role, node, text in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for x, r, y, s in zip(a, role, node, shingle_sets(text, SHINGLE), strict=True):
                if r == 0:
                    center, own = x, s
                elif x == center and linked(own, s):
                    out["a"].append(x)
                    out["b"].append(y)
            yield out

    return map_rows(sent, ["a", "share", "role", "node", "text"], "a binary, b binary", work)


def unsettled(posts: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, block, node, label) of sets that sketches leave a possible partner of another label in a part's block.

    A part of up to ``MANY`` sets is one block. Of a larger one each set stands in its own block, and those that do not
    have the commonest label there in all blocks.
    """
    labelled = saved(posts.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    mixed = labelled.groupBy("key", "n").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("t")).where("x <> y")
    # parts of the same sets are gone through once
    once = saved(mixed.groupBy("held", "s", "t").agg(F.min(F.struct("key", "n")).alias("part")).select("part.key", "part.n", F.ceil(F.col("held") / MANY).cast("int").alias("blocks")))
    of_label = salted(labelled).join(cells(once.where("blocks > 1")), ["key", "n", "cell"]).groupBy("key", "n", "label").agg(F.count(F.lit(1)).alias("held"))
    commonest = of_label.groupBy("key", "n").agg(F.max(F.struct("held", "label")).alias("top")).select("key", "n", F.col("top.label").alias("common"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = F.when((F.col("blocks") == 1) | (F.col("label") == F.col("common")), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = salted(labelled).join(cells(once.join(commonest, ["key", "n"], "left")), ["key", "n", "cell"]).select("key", F.explode(blocks).alias("block"), "node", "label")
    rows = rows.join(nodes.select("node", "n_shingles", "sketch"), "node")

    def of(task, held):
        rows = [held[k] for k in sorted({x for pair in crossing([(r[1], r[2], r[3]) for r in held]) for x in pair[1:]})]
        return {"key": [task[0]] * len(rows), "block": [task[1]] * len(rows), "node": [r[0] for r in rows], "label": [r[1] for r in rows]}

    return by_task(rows, ["node", "label", "n_shingles", "sketch"], "key long, block int, node binary, label binary", of)


def by_task(rows: DataFrame, more: list[str], schema: str, of) -> DataFrame:
    """``of`` the task (key, block) and its rows."""
    sent = rows.repartition(partitions(rows.sparkSession), "key", "block").sortWithinPartitions("key", "block", "node")

    def work(batches):
        for task, held in grouped(batches, 2):
            yield of(task, held)

    return map_rows(sent, ["key", "block", *more], schema, work)


def crossing(rows: list[tuple[bytes, int, bytes]]) -> list[tuple[int, int, int]]:
    """(Hamming distance, place, place) of rows (label, size, sketch) with different labels that may be linked, the nearest first."""
    if len(rows) <= FEW:
        size = min(len(r[2]) for r in rows)
        bits = [bits_of(r[2], size) for r in rows]
        pairs = ((j, i) for i, x in enumerate(rows) for j, y in enumerate(rows[:i]) if x[0] != y[0] and near(*x[1:], *y[1:]))
        return sorted(((bits[j] ^ bits[i]).bit_count(), j, i) for j, i in pairs)
    numbers: dict[bytes, int] = {}
    label, n, size = np.array([(numbers.setdefault(x, len(numbers)), k, len(sketch)) for x, k, sketch in rows], np.int64).T
    least = int(size.min())
    small = np.stack([folded(r[2], least // 8) for r in rows])
    out = [np.zeros((3, 0), np.int64)]
    for own in np.unique(size).tolist():  # those of this size with those of this size before them, and with all of larger ones
        other = np.flatnonzero(size >= own)
        sketch, mine = np.stack([folded(rows[i][2], own // 8) for i in other.tolist()]), np.flatnonzero(size[other] == own)
        step = max(1, 8 * BUNCH // (own * len(other)))
        for here in (mine[i : i + step] for i in range(0, len(mine), step)):
            x = other[here][:, None]
            apart = np.bitwise_count(sketch[here, None] ^ sketch).sum(2, dtype=np.int64)
            close = (9 * apart <= n[x] + n[other]) & (label[x] != label[other]) & (100 * np.minimum(n[x], n[other]) >= PERCENT * np.maximum(n[x], n[other]))
            i, j = np.nonzero(close & ((other < x) | (size[other] > own)))
            y, z = x[i, 0], other[j]
            out.append(np.array([np.bitwise_count(small[y] ^ small[z]).sum(1, dtype=np.int64), np.minimum(y, z), np.maximum(y, z)]))
    found = np.concatenate(out, axis=1)
    return list(zip(*found[:, np.lexsort(found[::-1])].tolist(), strict=True))


def settled(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect different labels in the tasks of ``unsettled``; a forest over the labels of each task."""

    def of(task, held):
        sets = shingle_sets([r[2] for r in held], SHINGLE)
        top = {r[1]: r[1] for r in held}

        def root(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        a, b = [], []
        for _, i, j in crossing([(r[1], len(s), sketch) for r, s, sketch in zip(held, sets, sketches(sets, 8), strict=True)]):
            x, y = root(held[i][1]), root(held[j][1])
            if x != y and linked(sets[i], sets[j]):
                top[x] = y
                a.append(held[i][0])
                b.append(held[j][0])
        return {"a": a, "b": b}

    return by_task(rows.join(texts, "node"), ["node", "label", "text"], "a binary, b binary", of)


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of all wanted sets (node), once each. Few enough ids are broadcast, so that no other text is shuffled."""
    wanted = saved(nodes.join(wanted.select("node").distinct(), "node").select("node", "id"))
    ids = wanted.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # a doc_id may stand for several texts: their sets are told apart by their nodes
    found = with_nodes(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").join(ids, "id", "left_semi"))
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def with_nodes(texts: DataFrame) -> DataFrame:
    def work(batches):
        for (text,) in batches:
            yield {"node": [node_of(s) for s in shingle_sets(text, SHINGLE)], "text": text}

    return map_rows(texts, ["text"], "node binary, text string", work)


def star_links(posts: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of each part and one of them, saved."""
    met = saved(stars(posts))
    edges = saved(likely(met, nodes))
    forget(met)
    links = saved(verified_stars(edges, texts_of(docs, nodes, edges.select(F.explode(F.array("a", "b")).alias("node")))))
    forget(edges)
    return links


def node_labels(posts: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes that links connect to others; the label is equal for those of one component. posts: of ``parts_of``."""
    links = star_links(posts, docs, nodes)
    hot = posts.where(F.col("n") > MANY).select("node")
    if not hot.isEmpty():
        rarest = postings(texts_of(docs, nodes, hot).withColumn("doc_id", F.lit(None).cast("long")), shingles_of)
        links = links.unionByName(star_links(rarest, docs, nodes))
        posts = posts.where(F.col("n") <= MANY).unionByName(rarest)
    labels = components(links)
    for part in (posts.where(F.pmod(F.xxhash64("key"), F.lit(8)) == 0), posts):
        rows = saved(unsettled(part, labels, nodes))
        if not rows.isEmpty():
            links = links.unionByName(saved(settled(rows, texts_of(docs, nodes, rows))))
            labels = components(links)
        forget(rows)
    return labels


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    read = saved(chunked(docs, parts_of))
    rows = read.where(F.col("kind") == SET)
    each = saved(rows.select("doc_id", "n_shingles", "node"))
    of_node = rows.where("node IS NOT NULL").groupBy("node")
    nodes = saved(of_node.agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")))
    labels = node_labels(postings_of(read), docs, nodes)
    labelled = saved(nodes.select("node", "least", F.col("held").alias("rows")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held"))
    components_ = join_counted(labelled.drop("least"), saved(least), ["label"]).select("node", "component_id", F.col("rows").alias("held"))
    found = join_counted(each.where("node IS NOT NULL"), saved(components_), ["node"])
    without = each.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(without)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the document of the least doc_id stays, with all its columns; rows that repeat this doc_id stay with it."""
    stays = linked_documents(docs).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_orbita_key")).distinct()
    return docs.withColumn("_orbita_key", F.coalesce("doc_id", F.lit(NO_ID))).join(stays, "_orbita_key", "left_semi").drop("_orbita_key")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))
