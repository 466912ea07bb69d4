"""A suffix tree over the bytes of words: how likely a word is spelled.

A word is its bytes and a closing mark; a closing mark of another kind stands for the end of a text. Contexts are the
symbols of the word before, at most ``DEPTH``, with a mark for the word's beginning. A context is retained if its
next-symbol distribution diverges from that of the context without its oldest symbol by ``GAIN`` nats or more for each
symbol of the vocabulary: n * KL >= GAIN * total. For contexts of one length the left sides add up to a difference of
entropies, ln 259 * total at most, so no more than DEPTH * ln 259 / GAIN states are retained, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, GAIN = 5, 3e-4
WORD_END, TEXT_END, SYMBOLS, START = 256, 257, 258, 258
BITS = 9
#: Words of at most so many bytes go through a table of nodes and symbols, if the tree has no more nodes than that; other words are looked up symbol by symbol.
SHORT, NODES = 64, 4096
#: Stands where a node has no symbol.
NONE = 511


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words one after another, each with its word's number and how many stand before it, the start mark included."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    symbols = np.empty(int(end[-1]) if len(words) else 0, np.int64)
    last = np.zeros(len(symbols), bool)
    last[end - 1] = True
    symbols[last] = WORD_END
    symbols[~last] = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), size)
    return symbols, owner, np.arange(len(symbols)) - (end - size)[owner] + 1


def contexts(symbols: np.ndarray, before: np.ndarray):
    """For k = 0..DEPTH: the places with k symbols before them, and there the context's code (the latest symbol lowest)."""
    code = np.zeros(len(symbols), np.int64)
    yield np.arange(len(symbols)), code
    for k in range(1, DEPTH + 1):
        at = np.flatnonzero(before >= k)
        older = np.where(before[at] == k, START, symbols[np.maximum(at - k, 0)])
        code = code.copy()
        code[at] |= older << (BITS * (k - 1))
        yield at, code[at]


def entry_code(k: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (np.int64(k) << np.int64(BITS * (DEPTH + 1))) | (context << np.int64(BITS)) | symbol


def transitions(words: list[bytes], text_ends: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of (context, next symbol) with their counts: each word once, and ends of texts."""
    symbols, _, before = spelled(words)
    codes, counts = [], []
    for k, (at, context) in enumerate(contexts(symbols, before)):
        unique, count = np.unique(entry_code(k, context, symbols[at]), return_counts=True)
        codes.append(unique)
        counts.append(count)
    for k in (0, 1) if text_ends else ():
        codes.append(np.array([entry_code(k, np.int64(START if k else 0), np.int64(TEXT_END))]))
        counts.append(np.array([text_ends]))
    all_, to = np.unique(np.concatenate(codes), return_inverse=True)
    return all_, np.bincount(to, np.concatenate(counts), len(all_)).astype(np.int64)


def retained(entries: DataFrame) -> DataFrame:
    """Of all (code, c) those of the root and of the states that diverge."""
    width = BITS * (DEPTH + 1)
    entries = entries.select("code", "c", F.shiftright("code", width).cast("int").alias("k"), F.shiftright("code", BITS).alias("state"), F.expr(f"code & {(1 << BITS) - 1}").alias("symbol"))
    total = entries.where("k = 0").agg(F.sum("c")).first()[0] or 0
    totals = entries.groupBy("state").agg(F.sum("c").alias("n"))
    own = entries.join(totals, "state")
    # the suffix: one symbol fewer, the oldest gone
    shorter = F.expr(f"shiftleft(cast(k - 1 as bigint), {BITS * DEPTH}) | (state & (shiftleft(1L, {BITS} * (k - 1)) - 1))")
    below = own.select(F.col("state").alias("suffix"), "symbol", F.col("c").alias("below_c"), F.col("n").alias("below_n"))
    told = own.where("k > 0").withColumn("suffix", shorter).join(below, ["suffix", "symbol"])
    kept = told.groupBy("state").agg(F.sum(F.expr("c * ln((c / n) / (below_c / below_n))")).alias("gain")).where(F.col("gain") >= GAIN * total)
    return entries.join(kept.select("state"), "state").select("code", "c").unionByName(entries.where("k = 0").select("code", "c"))


@dataclass
class Tree:
    """Sorted codes of retained states and of their entries, with log10 of back-off weights and of smoothed probabilities (Witten-Bell)."""

    states: np.ndarray
    back_off: np.ndarray
    entries: np.ndarray
    log_p: np.ndarray
    #: For a node and a next symbol: the node after it, and the symbol's log10 (none for a tree of many nodes).
    step: np.ndarray | None = None
    cost: np.ndarray | None = None
    begin: int = 0

    @classmethod
    def build(cls, codes: np.ndarray, counts: np.ndarray) -> Tree:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        states, first = np.unique(codes >> BITS, return_index=True)
        if not len(states):
            states, first = np.zeros(1, np.int64), np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if len(codes) else np.zeros(1)
        kinds = np.diff(np.concatenate((first, [len(codes)]))).astype(np.float64) if len(codes) else np.zeros(1)
        p = np.zeros(len(codes))
        of = np.searchsorted(states, codes >> BITS)
        level = codes >> np.int64(BITS * (DEPTH + 1))
        for k in range(DEPTH + 1):
            mine = np.flatnonzero(level == k)
            lower = np.full(len(mine), 1.0 / SYMBOLS)
            open_ = np.arange(len(mine))
            for j in range(k - 1, -1, -1):  # the longest retained suffix has all symbols that the state has
                context = (codes[mine[open_]] >> BITS) & ((np.int64(1) << np.int64(BITS * j)) - 1)
                want = entry_code(j, context, codes[mine[open_]] & 511)
                at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
                hit = codes[at] == want
                lower[open_[hit]] = p[at[hit]]
                open_ = open_[~hit]
            p[mine] = (counts[mine] + kinds[of[mine]] * lower) / (total[of[mine]] + kinds[of[mine]])
        back = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        tree = cls(states, np.log10(np.maximum(back, 1e-300)), codes, np.log10(p))
        tree.tabulate()
        return tree

    def tabulate(self) -> None:
        """Nodes are the retained contexts and what they begin with, so that the longest node that ends a longer text follows from the one before."""
        width, held = BITS * DEPTH, {0}
        for s in self.states.tolist():
            while s not in held:
                held.add(s)
                s = (s >> width) - 1 << width | (s & (1 << width) - 1) >> BITS
            if len(held) > NODES:
                return
        nodes = np.array(sorted(held))
        length, context = nodes >> width, nodes & (1 << width) - 1
        self.begin = int(np.searchsorted(nodes, at)) if (at := 1 << width | START) in held else 0
        after = (context[:, None] << BITS | np.arange(WORD_END + 1)).ravel()
        size = np.repeat(np.minimum(length + 1, DEPTH), WORD_END + 1)
        self.step = np.zeros(len(after), np.int32)
        for k in range(1, DEPTH + 1):  # the longest that is a node comes last
            want = np.int64(k) << np.int64(width) | after & (1 << BITS * k) - 1
            where = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
            hit = (k <= size) & (nodes[where] == want)
            self.step[hit] = where[hit]
        cost = []
        for a in range(0, len(nodes), 256):
            own = context[a : a + 256]
            symbols = np.empty((len(own), WORD_END + 1, DEPTH + 1), np.int64)
            for k in range(DEPTH):
                symbols[:, :, DEPTH - 1 - k] = np.where(length[a : a + 256] > k, own >> BITS * k & NONE, NONE)[:, None]
            symbols[:, :, DEPTH] = np.arange(WORD_END + 1)
            before = np.zeros(symbols.shape, np.int64)
            before[:, :, DEPTH] = DEPTH + 1
            cost.append(self.of_symbols(symbols.ravel(), before.ravel())[DEPTH :: DEPTH + 1])
        self.cost = np.concatenate(cost)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word, its end mark included."""
        out, size = np.zeros(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        far = size > (SHORT if self.step is not None else -1)
        if far.any():
            symbols, owner, before = spelled([words[i] for i in np.flatnonzero(far).tolist()])
            out[far] = np.bincount(owner, self.of_symbols(symbols, before), int(far.sum()))
        order = np.argsort(-size, kind="stable")[int(far.sum()) :]  # the longest first
        if len(order):
            data, first, left = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(size) - size)[order], -size[order]
            node, sums = np.full(len(order), self.begin), np.zeros(len(order))
            for k in range(1 - int(left[0])):
                more, ended = np.searchsorted(left, -k), np.searchsorted(left, -k, "right")
                cell = node[:more] * (WORD_END + 1) + data[first[:more] + k]
                sums[:more] += self.cost[cell]
                sums[more:ended] += self.cost[node[more:ended] * (WORD_END + 1) + WORD_END]
                node[:more] = self.step[cell]
            out[order] = sums
        return out

    def text_end(self) -> float:
        return float(self.of_symbols(np.array([TEXT_END]), np.array([1]))[0])

    def of_symbols(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each symbol in the longest retained suffix of what stands before it."""
        out, done = np.zeros(len(symbols)), np.zeros(len(symbols), bool)
        for k, (at, context) in reversed(list(enumerate(contexts(symbols, before)))):
            keep = ~done[at]
            at, context = at[keep], context[keep]
            state = (np.int64(k) << np.int64(BITS * DEPTH)) | context
            where = np.minimum(np.searchsorted(self.states, state), len(self.states) - 1)
            here = self.states[where] == state
            at, state, where = at[here], state[here], where[here]
            code = state << np.int64(BITS) | symbols[at]
            entry = np.minimum(np.searchsorted(self.entries, code), max(0, len(self.entries) - 1))
            seen = self.entries[entry] == code if len(self.entries) else np.zeros(len(code), bool)
            out[at[seen]] += self.log_p[entry[seen]]
            done[at[seen]] = True
            out[at[~seen]] += self.back_off[where[~seen]]
        out[~done] -= math.log10(SYMBOLS)
        return out
