"""Language-model scores by a probabilistic suffix tree over words, with spelled unknown words.

The symbols are a text's words and its end. Contexts are the last words, across the whole text, ``DEPTH`` at most (the
longest suffix that the method allows), with a mark for the text's beginning. A context that training texts hold
``LEAST`` times or more is retained if its next-symbol counts diverge from those of the context without its oldest word:
N * KL of at least ``DIVERGENCE`` nats for each distinct next symbol; nothing else bounds their number. The root's
distribution is smoothed by the spelling of words (a suffix tree over bytes, learnt from all distinct training words),
a state's by that of its longest retained suffix (Witten-Bell), and a symbol is scored in the longest retained suffix of
what stands before it. score is log10 of the probability of the text's words in their order, and its end.

Counts come from whole texts and stay on the cluster: chunks of texts ask for the counts of their distinct words and
word sequences, a bucket of the key space adds up what all chunks hold and answers each, so that a key which a third of
all texts share is one number per chunk. A second such round adds up the divergences of contexts. Words are compared as
they are; sequences by hashes of KEY_BITS bits, where of n different ones about n * n / 2^49 meet another by chance.

Null texts count as empty: the end only. A null doc_id counts as the empty id, which is learnt from. Without training
texts the model is the uniform spelling. Every row gives one row, also repeated ones; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import counts, floats, grouped, packed, ranges, trim, uncounted, unfloats, unpacked
from .common import crc_text, forget, map_rows, partitions, saved, table
from .hashing import LOWER, Words, mix
from .rounds import MESSAGE, TEXTS, columns, common_keys, each_chunk, message, place, to_buckets, to_chunks
from .spelling import Tree, retained, transitions

DEPTH, LEAST, DIVERGENCE = 2, 2, 2.0
#: Words of texts in a chunk (one text at least), and words of all texts for each bucket of the key space.
CHUNK, BUCKET = 400_000, 1_500_000
KEY_BITS = 48
SHORT = np.uint64((1 << 64) - (1 << 64 - KEY_BITS))
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows: a chunk itself, words, word sequences, transitions of spelled words, contexts.
WORDS, SEQUENCES, SPELLED, CONTEXTS = range(1, 5)


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text, apart): distinct words, the commonest first (a), the texts as numbers of words (b) and what is true of whole texts (c); n: training tokens."""
    parts = partitions(docs.sparkSession)

    def work(batches):
        task, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def chunk():
            hashes, inverse, lengths, apart, ids = ([h[i] for h in held] for i in (0, 2, 3, 4, 5))
            unique, first, to = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            begin = np.cumsum([0, *map(len, hashes)])
            numbers = np.concatenate([to[b + i] for b, i in zip(begin, inverse, strict=False)])
            order = np.argsort(-np.bincount(numbers, minlength=len(unique)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = [w for h in held for w in h[1]]
            lengths, apart, ids = np.concatenate(lengths), np.concatenate(apart), [i for x in ids for i in x]
            valid = np.array([i is not None for i in ids], np.uint8)
            about = lengths.astype("<u4").tobytes() + apart.astype(np.uint8).tobytes() + valid.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
            trained = int((lengths + 1)[~apart].sum())
            return message(*place(task, k, parts), TEXTS, int((~apart).sum()), zlib.compress(b" ".join([words[i] for i in first[order].tolist()]), 1), counts(rank[numbers]), zlib.compress(about, 1), trained)

        size = 0
        for ids, texts, apart in batches:
            words = Words([(t or "").encode("utf-8").translate(LOWER) for t in texts])
            unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            data = words.data.tobytes()
            held.append((unique, [data[a:b] for a, b in zip(words.first[first].tolist(), words.ends[first].tolist(), strict=True)], inverse, np.diff(words.offsets), np.array(apart, bool), ids))
            size += len(inverse) + len(ids)
            if size >= CHUNK:
                yield columns([chunk()])
                held, size, k = [], 0, k + 1
        if held:
            yield columns([chunk()])

    return map_rows(docs, ["doc_id", "text", "apart"], MESSAGE, work)


class Chunk:
    """A chunk's tokens one after another. ``grams[k]``: keys of a token and the k before it, at ``valid[k]``."""

    def __init__(self, a: bytes, b: bytes, c: bytes):
        joined = zlib.decompress(a)
        self.vocabulary = joined.split(b" ") if joined else []
        about = zlib.decompress(c)
        n = len(about) // 14
        size = np.frombuffer(about, "<u4", n).astype(np.int64) + 1
        self.apart, valid = (np.frombuffer(about, np.uint8, n, n * k).astype(bool) for k in (4, 5))
        self.ids = [i if v else None for i, v in zip(np.frombuffer(about, "<i8", n, 6 * n).tolist(), valid.tolist(), strict=True)]
        self.first = np.cumsum(size) - size
        self.size = size
        last = np.zeros(int(size.sum()), bool)
        last[self.first + size - 1] = True
        self.word = np.full(len(last), len(self.vocabulary))
        self.word[~last] = uncounted(b)
        self.owner = np.repeat(np.arange(n), size)
        self.place = np.arange(len(last)) - self.first[self.owner]
        self.trained = ~self.apart[self.owner]
        self.hashes = Words([joined]).hashes
        self.by_hash = np.argsort(self.hashes)
        own = np.concatenate((self.hashes, [END]))[self.word]
        self.grams, self.valid = [mix(own)], [np.arange(len(own))]
        for k in range(1, DEPTH + 1):
            before = np.where(self.place >= k, np.roll(own, k), START)
            self.grams.append(mix(self.grams[-1] * ODD + mix(before + np.uint64(k))))
            self.valid.append(np.flatnonzero(self.place >= k - 1))
        self.keys, self.inverse = np.unique(np.concatenate([g[v] & SHORT for g, v in zip(self.grams[1:], self.valid[1:], strict=True)]), return_inverse=True)

    def asked(self, buckets: int) -> list[tuple]:
        """(kind, bucket, a, b): words and sequences with how often training texts of this chunk hold them."""
        held = np.bincount(self.word[self.trained], minlength=len(self.vocabulary) + 1)[self.by_hash]
        words = [self.vocabulary[i] for i in self.by_hash.tolist()]
        out = [(WORDS, bucket, zlib.compress(b" ".join(words[s]), 1), counts(held[s])) for bucket, s in ranges(self.hashes[self.by_hash], buckets)]
        held = np.bincount(self.inverse, np.concatenate([self.trained[v] for v in self.valid[1:]]), len(self.keys))
        return out + [(SEQUENCES, bucket, packed(self.keys[s]), counts(held[s])) for bucket, s in ranges(self.keys, buckets)]

    def told(self, answers: dict[int, list[bytes]], tokens: int, texts: int) -> None:
        """Counts of all training texts: ``seen[k]`` of the sequences that end at a token, ``stood[k]`` of the k words before it."""
        whole = lambda kind: np.concatenate([uncounted(x) for x in answers[kind]]) if answers.get(kind) else np.zeros(0, np.int64)
        words = np.empty(len(self.vocabulary) + 1)
        words[self.by_hash], words[-1] = whole(WORDS), texts
        of_keys = whole(SEQUENCES)[self.inverse]
        self.seen, self.stood, at = [words[self.word]], [np.full(len(self.word), float(tokens))], 0
        for v in self.valid[1:]:
            self.stood.append(np.where(self.place > 0, np.roll(self.seen[-1], 1), texts))
            self.seen.append(np.zeros(len(self.word)))
            self.seen[-1][v] = of_keys[at : at + len(v)]
            at += len(v)

    def contexts(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Places of each length whose context training texts hold often enough, the distinct contexts' keys, and which of them stands there."""
        places, keys = [], []
        for k in range(1, DEPTH + 1):
            at = self.valid[k][self.stood[k][self.valid[k]] >= LEAST]
            places.append(at)
            keys.append(mix(np.where(self.place[at] > 0, self.grams[k - 1][at - 1], START) + np.uint64(k)) & SHORT)
        unique, to = np.unique(np.concatenate(keys), return_inverse=True)
        return places, unique, to

    def diverged(self, buckets: int) -> list[tuple]:
        """(kind, bucket, a, b, c): contexts with this chunk's part of their divergence and of their number of next symbols."""
        places, keys, to = self.contexts()
        gain, kinds = [], []
        for k, at in enumerate(places, 1):
            here = self.trained[at]
            seen, below = np.where(here, self.seen[k][at], 1.0), np.where(here, self.seen[k - 1][at], 1.0)
            gain.append(np.where(here, np.log(seen / self.stood[k][at] / (below / self.stood[k - 1][at])), 0.0))
            kinds.append(here / seen)
        gain, kinds = (np.bincount(to, np.concatenate(x), len(keys)) for x in (gain, kinds))
        return [(CONTEXTS, bucket, packed(keys[s]), floats(gain[s]), floats(kinds[s])) for bucket, s in ranges(keys, buckets)]

    def scores(self, answers: dict[int, list[bytes]], tree: Tree, tokens: int, distinct: int) -> dict:
        places, keys, to = self.contexts()
        kinds = (np.concatenate([uncounted(x) for x in answers[CONTEXTS]]) if answers.get(CONTEXTS) else np.zeros(0, np.int64))[to].astype(np.float64)
        spelled = np.append(tree.log10(self.vocabulary), tree.text_end())[self.word]
        seen = self.seen[0]
        new = seen == 0  # spelled in logarithms: the probability of a long one is less than the least number
        p = np.where(new, 1.0, (seen + distinct * 10.0 ** np.maximum(spelled, -300)) / max(1, tokens + distinct))
        at = 0
        for k, here in enumerate(places, 1):
            n = kinds[at : at + len(here)]
            at += len(here)
            here, n = here[n > 0], n[n > 0]
            p[here] = (self.seen[k][here] + n * p[here]) / (self.stood[k][here] + n)
        log_p = np.log10(p)
        log_p[new] += spelled[new] + (math.log10(distinct / (tokens + distinct)) if distinct else 0.0)
        base = np.log10(seen + 1) - math.log10(tokens + distinct + 1)
        of_text = lambda x: np.add.reduceat(x, self.first)
        return {"doc_id": self.ids, "held_out": self.apart.tolist(), "n_tokens": self.size.tolist(), "n_known": of_text((seen > 0).astype(np.int64)).tolist(), "train_tokens": [tokens] * len(self.ids), "base_score": of_text(base).tolist(), "score": of_text(log_p).tolist()}


def answered(requests: DataFrame, spellings: int) -> DataFrame:
    """Each request's keys with what all chunks hold of them; of a bucket of words also how words are spelled, for ``spellings`` tasks."""
    def of_words(dest, rows):
        words, held = [zlib.decompress(a).split(b" ") for *_, a, _, _ in rows], {}
        for own, (*_, b, _) in zip(words, rows, strict=True):
            for w, n in zip(own, uncounted(b).tolist(), strict=True):
                held[w] = held.get(w, 0) + n
        known = [w for w, n in held.items() if n]
        yield columns([message(src, at, WORDS, dest, counts(np.array([held[w] for w in own])), n=len(known) if k == 0 else 0) for k, (own, (src, at, *_)) in enumerate(zip(words, rows, strict=True))])
        for i in range(0, len(known), 200_000):
            codes, n = transitions(known[i : i + 200_000])
            share = codes % spellings
            yield columns([message(dest, s, SPELLED, s, packed(codes[share == s]), counts(n[share == s])) for s in np.unique(share).tolist()])

    def added(dest, kind, rows):
        keys, to = common_keys(rows)
        total = lambda values: np.bincount(np.concatenate(to), np.concatenate(values), len(keys))
        if kind == SEQUENCES:
            out = total([uncounted(b) for *_, b, _ in rows])
        else:
            gain, kinds = (total([unfloats(r[i]) for r in rows]) for i in (3, 4))
            out = np.where(gain >= DIVERGENCE * kinds, np.maximum(np.rint(kinds), 0), 0)
        yield columns([message(src, at, kind, dest, counts(out[here])) for (src, at, *_), here in zip(rows, to, strict=True)])

    def work(batches):
        for (dest, kind), rows in grouped(batches, 2):
            yield from of_words(dest, rows) if kind == WORDS else added(dest, kind, rows)
            del rows
            trim()

    return map_rows(to_buckets(requests), ["dest", "kind", "src", "at", "a", "b", "c"], MESSAGE, work)


def spelling(spelled: DataFrame) -> Tree:
    """The suffix tree of all distinct training words' spellings, and of one end of text."""
    sent = spelled.repartitionById(partitions(spelled.sparkSession), "dest").sortWithinPartitions("dest", "src")

    def work(batches):
        for _, rows in grouped(batches, 1):
            codes, to = np.unique(np.concatenate([unpacked(a) for a, _ in rows]).astype(np.int64), return_inverse=True)
            yield {"code": codes.tolist(), "c": np.bincount(to, np.concatenate([uncounted(b) for _, b in rows]), len(codes)).astype(np.int64).tolist()}

    entries = saved(map_rows(sent, ["dest", "a", "b"], "code long, c long", work))
    kept = saved(retained(entries))  # so that its joins leave no shuffle files beside the next round's
    got = kept.toArrow()  # bounded, see ``retained``
    forget(entries, kept)
    ends, n = transitions([], 1) if len(got) else (np.zeros(0, np.int64),) * 2
    return Tree.build(np.concatenate((got["code"].to_numpy(), ends)), np.concatenate((got["c"].to_numpy(), n)))


def lm_scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held_out: of a row, not learnt from."""
    apart = (crc_text("doc_id") % 7 == 2) if held_out is None else held_out
    chunks = saved(chunked(docs.select("doc_id", "text", F.coalesce(apart, F.lit(False)).alias("apart"))))
    tokens, texts = (int(x or 0) for x in chunks.agg(F.sum("n"), F.sum("dest")).first())
    spark, buckets = docs.sparkSession, max(partitions(docs.sparkSession), -(-tokens // BUCKET))
    parts = partitions(spark)

    def ask(batches):
        for src, at, a, b, c in batches:
            for x, y, *own in zip(src, at, a, b, c, strict=True):
                yield columns([message(x, y, *row) for row in Chunk(*own).asked(buckets)])

    first = saved(answered(map_rows(chunks, ["src", "at", "a", "b", "c"], MESSAGE, ask), parts))
    distinct = int(first.agg(F.sum("n")).first()[0] or 0) + (texts > 0)
    tree = spark.sparkContext.broadcast(spelling(first.where(F.col("kind") == SPELLED)))
    both, first = first, saved(first.where(F.col("kind") != SPELLED))
    forget(both)

    def diverge(src, at, blobs, answers):
        chunk = Chunk(*blobs)
        chunk.told(answers, tokens, texts)
        yield columns([message(src, at, *row) for row in chunk.diverged(buckets)])

    second = saved(answered(each_chunk(to_chunks(chunks, first), MESSAGE, diverge), parts))

    def score(src, at, blobs, answers):
        chunk = Chunk(*blobs)
        chunk.told(answers, tokens, texts)
        yield chunk.scores(answers, tree.value, tokens, distinct)

    return each_chunk(to_chunks(chunks, first, second), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", score)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
