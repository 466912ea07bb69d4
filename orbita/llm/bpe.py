"""Byte-pair merging with a heap over a linked list of symbols, and the memo in front of it."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import xxhash

#: A heap entry is rank * 2^40 + position, a pair's key left * 2^20 + right.
POSITION_BITS, SYMBOL_BITS = 40, 20
POSITION_MASK = (1 << POSITION_BITS) - 1


class Memo(dict):
    """What was worked out for chunks of text, in two generations of at most ``most`` entries between texts.

    ``trim`` is called between texts: a full young generation becomes the old one and the old one goes, so chunks
    that keep coming stay and memory is bounded.
    """

    def __init__(self, work: Callable, most: int = 250_000):
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.work(chunk)
        self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int] | None) -> list[int]:
    """Apply merges lowest rank first, leftmost first among equals, and return the symbols that remain.

    ``ranks`` maps a pair's key to its rank; ``merged[rank]`` is the new symbol (the rank itself where None).
    Symbols form a doubly linked list over positions; stale heap entries are known by a changed pair.
    """
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << SYMBOL_BITS | symbols[i + 1])
        if rank is not None:
            heap.append(rank << POSITION_BITS | i)
    if not heap:
        return symbols
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    while heap:
        entry = heappop(heap)
        i = entry & POSITION_MASK
        left = symbols[i]
        if left < 0:
            continue
        j = after[i]
        if j >= n:
            continue
        rank = entry >> POSITION_BITS
        if get(left << SYMBOL_BITS | symbols[j]) != rank:
            continue
        new = rank if merged is None else merged[rank]
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = get(new << SYMBOL_BITS | symbols[k])
            if rank is not None:
                heappush(heap, rank << POSITION_BITS | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << SYMBOL_BITS | new)
            if rank is not None:
                heappush(heap, rank << POSITION_BITS | h)
    return [s for s in symbols if s >= 0]


def count_after_merges(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Initial symbols minus merges: ``merge`` with a counter in place of the result."""
    n = left_over = len(symbols)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << SYMBOL_BITS | symbols[i + 1])
        if rank is not None:
            heap.append(rank << POSITION_BITS | i)
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    while heap:
        entry = heappop(heap)
        i = entry & POSITION_MASK
        left = symbols[i]
        if left < 0:
            continue
        j = after[i]
        if j >= n:
            continue
        rank = entry >> POSITION_BITS
        if get(left << SYMBOL_BITS | symbols[j]) != rank:
            continue
        new = merged[rank]
        symbols[i], symbols[j] = new, -1
        left_over -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = get(new << SYMBOL_BITS | symbols[k])
            if rank is not None:
                heappush(heap, rank << POSITION_BITS | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << SYMBOL_BITS | new)
            if rank is not None:
                heappush(heap, rank << POSITION_BITS | h)
    return left_over


class PerfectHash:
    """A minimal perfect hash of the vocabulary's byte strings: hash, displace by bucket, compare one stored key.

    Buckets are placed from the largest down, each with the first seed that sends all its keys to free slots of a
    table with exactly as many slots as keys.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[(h >> 32) % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            seed = 0
            while groups[b]:
                slots = [self.slot(hashes[i], seed) for i in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(groups[b], slots if groups[b] else (), strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]

    def slot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        s = self.slot(h, self.seeds[(h >> 32) % self.buckets])
        return self.values[s] if self.keys[s] == key else None


#: White space as Unicode's White_Space property has it; str.split() and \s of ``re`` also take U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Marks that end a word and are no part of one.
MARKS = frozenset(",.;:!?)")


class RankEncoder:
    """Byte-level BPE by a file of ranks, as the tiktoken library encodes ordinary text, and back.

    A text is cut at spaces into chunks that keep the leading space; chunks are memoised whole. Inside a new chunk
    every match of the pattern is resolved by the perfect hash, else by merging.
    """

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.pairs = {ranks[t[:i]] << SYMBOL_BITS | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.of_byte = [ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.mixed = re.compile(f"[{WHITE}] (?:[{WHITE}]|$)|[{WHITE}] \\Z").search
        self.memo, self.tokens = Memo(self.chunk), Memo(self.pre_token)

    def pre_token(self, token: str) -> bytes:
        """The first tier is a whole match in the vocabulary, the second merges its bytes."""
        data = token.encode("utf-8")
        rank = self.whole.get(data)
        out = merge([self.of_byte[b] for b in data], self.pairs, None) if rank is None else (rank,)
        return struct.pack(f"<{len(out)}I", *out)

    def chunk(self, chunk: str) -> bytes:
        found = self.split(chunk)
        return self.tokens[found[0]] if len(found) == 1 else b"".join(map(self.tokens.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        self.memo.trim()
        self.tokens.trim()
        if ("  " in text or "\n " in text or not text.isascii() or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text or text.endswith(" ")) and self.mixed(text):
            return np.frombuffer(self.chunk(text), dtype="<u4")
        first, *rest = text.split(" ")
        found = [self.memo[first]] if first else []
        found += map(self.memo.__getitem__, [" " + x for x in rest])
        return np.frombuffer(b"".join(found), dtype="<u4")

    def decimal(self, ids: list[int]) -> bytes:
        """Decimal ids joined by one space."""
        table = self.text_of
        return " ".join([table[i] for i in ids]).encode()

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


class Lockstep:
    """The merges of many short words at once: row by row the lowest-ranked, leftmost pair, in numpy.

    Pair ranks sit in an open-addressing table, so that a step costs a few array operations for all words.
    """

    LONGEST, NONE, BITS = 128, 1 << 30, 18

    def __init__(self, ranks: dict[int, int], merged: list[int]):
        self.merged = np.array(merged, dtype=np.int32)
        self.bits = max(self.BITS, (4 * len(ranks)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int32)
        for key, at in zip(ranks, self.home(np.array(list(ranks), dtype=np.int64)).tolist(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ranks[at] = key, ranks[key]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge or the right side is empty (-1)."""
        keys = np.where(right < 0, -2, (left.astype(np.int64) << SYMBOL_BITS) | right)
        at = self.home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], self.NONE)
        ask = np.flatnonzero(((there != keys) & (there != -1) & (keys >= 0)).ravel())
        flat_at, flat_keys, flat_out = at.ravel(), keys.ravel(), out.ravel()
        while len(ask):
            flat_at[ask] = (flat_at[ask] + 1) & (len(self.keys) - 1)
            there = self.keys[flat_at[ask]]
            hit = there == flat_keys[ask]
            flat_out[ask[hit]] = self.ranks[flat_at[ask[hit]]]
            ask = ask[~hit & (there != -1)]
        return flat_out.reshape(out.shape)

    def merge(self, words: list[list[int]]) -> list[bytes]:
        size = np.array(list(map(len, words)), np.int64)
        return self.merge_flat(np.fromiter(chain.from_iterable(words), np.int32, int(size.sum())), size)

    def merge_flat(self, symbols: np.ndarray, size: np.ndarray) -> list[bytes]:
        """``merge`` of words that stand one after another in ``symbols``."""
        out: list[bytes] = [b""] * len(size)
        order, first = np.argsort(size, kind="stable"), np.cumsum(size) - size
        for begin in range(0, len(order), 4096):
            rows = order[begin : begin + 4096]
            there = np.arange(int(size[rows].max()))[None, :] < size[rows][:, None]
            words = np.full(there.shape, -1, np.int32)
            words[there] = symbols[(first[rows][:, None] + np.arange(there.shape[1]))[there]]
            self._merge(words, rows, out)
        return out

    def _merge(self, symbols: np.ndarray, live: np.ndarray, out: list[bytes]) -> None:
        wide = symbols.shape[1]
        ranks = np.full(symbols.shape, self.NONE, np.int32)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == self.NONE
            if done.any():
                for place, row in zip(live[done].tolist(), symbols[done].astype("<u4"), strict=True):
                    out[place] = row.tobytes().partition(b"\xff\xff\xff\xff")[0] if row[-1] == 0xFFFFFFFF else row.tobytes()
                symbols, ranks, at, best, live = symbols[~done], ranks[~done], at[~done], best[~done], live[~done]
                if not len(live):
                    break
            rows, new = np.arange(len(live)), self.merged[best]
            symbols[rows, at] = new
            shift = np.arange(wide - 1)[None, :] > at[:, None]
            symbols[:, :-1] = np.where(shift, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1])
            symbols[:, -1], ranks[:, -1] = -1, self.NONE
            right = np.where(at + 1 < wide, symbols[rows, np.minimum(at + 1, wide - 1)], -1)
            ranks[rows, at] = self.rank(new, right)
            has = at > 0
            ranks[rows[has], at[has] - 1] = self.rank(symbols[rows[has], at[has] - 1], new[has])


class WordEncoder:
    """BPE with word ends, read from a ``tokenizers`` file: NFC, lower case, white space dropped, byte-level symbols.

    Special tokens that stand in a text are single tokens, as the library's default has it.
    """

    #: Characters of texts that ``encode_many`` splits at once, and words and chunks whose identifiers a generation of the memo holds.
    AT_ONCE, WORDS = 500_000, 150_000

    def __init__(self, path: str):
        import re
        import unicodedata

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.ranks = {vocab[a] << SYMBOL_BITS | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.blank = re.compile(f"[{WHITE}]+").split
        self.nfc = unicodedata.normalize
        self.path = path
        self.strange_low, self.strange_high = (re.compile(x).search for x in strange_letters())
        self.split = self.words  # until a text with strange letters comes
        self.high = re.compile("[\U00010000-\U0010ffff]").search
        self.counts, self.word_counts = Memo(self._count), Memo(lambda w: count_after_merges(self.symbols(w), self.ranks, self.merged))
        self.ids = Memo(self._ids, self.WORDS)
        self.lockstep = Lockstep(self.ranks, self.merged)
        self.inner_of, self.last_of = np.array(self.inner, np.int32), np.array(self.last, np.int32)

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        out = [self.inner[b] for b in data]
        out[-1] = self.last[data[-1]]
        return out

    def merged_words(self, words: list[str]) -> list[bytes]:
        """Identifiers of short words, in lockstep."""
        data = [w.encode("utf-8") for w in words]
        size = np.array(list(map(len, data)), np.int64)
        letters = np.frombuffer(b"".join(data), np.uint8)
        symbols, last = self.inner_of[letters], np.cumsum(size) - 1
        symbols[last] = self.last_of[letters[last]]
        return self.lockstep.merge_flat(symbols, size)

    def words_of(self, chunk: str) -> list[str]:
        """``split``, without the pattern for letters alone or with one mark after them."""
        if chunk.isalpha():
            return [chunk]
        return [chunk[:-1], chunk[-1]] if chunk[-1] in MARKS and chunk[:-1].isalpha() else self.split(chunk)

    def _count(self, chunk: str) -> int:
        return sum(map(self.word_counts.__getitem__, self.words_of(chunk)))

    def split_strange(self, chunk: str) -> list[str]:
        """The words of a chunk; a chunk with a strange letter is one."""
        return [chunk] if not chunk.isascii() and self.strange(chunk) else self.words(chunk)

    def strange(self, text: str) -> bool:
        """Whether a letter is strange. Classes up to U+FFFF are compiled to bitmaps, others are tried range by range, so they are asked of few texts."""
        return self.strange_low(text) is not None or (self.high(text) is not None and self.strange_high(text) is not None)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _word_ids(self, word: str) -> bytes:
        out = merge(self.symbols(word), self.ranks, self.merged)
        return struct.pack(f"<{len(out)}I", *out)

    def _ids(self, chunk: str) -> bytes:
        """A word that is split again stays one, so one memo holds words and chunks."""
        found = self.words_of(chunk)
        return self._word_ids(chunk) if len(found) == 1 else b"".join(map(self.ids.__getitem__, found))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of every text, ``AT_ONCE`` characters of them (one text at least) at a time: their words take many times that."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.AT_ONCE:
                out += self._encode_some(some)
                some, size = [], 0
        return out + self._encode_some(some)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        """The short new words of all texts go through the merges in lockstep."""
        self.ids.trim()
        chunks = [None if "<|" in text else self.chunks(text) for text in texts]
        ids, old, new, parted = self.ids, self.ids.old, set(), {}
        for c in set().union(*(own or () for own in chunks)):
            if c in ids:
                continue
            if (value := old.get(c)) is not None:
                ids[c] = value
            elif c.isalpha() or len(found := self.words_of(c)) == 1:
                new.add(c)
            else:
                parted[c] = found
                new.update([w for w in found if w not in ids and w not in old])
        short = [w for w in new if len(w) <= Lockstep.LONGEST // 4]
        for begin in range(0, len(short), 8192):
            part = short[begin : begin + 8192]
            ids.update(zip(part, self.merged_words(part), strict=True))
        for c, found in parted.items():
            ids[c] = b"".join([ids[w] for w in found])
        return [self.encode(text) if own is None else b"".join([ids[c] for c in own]) for text, own in zip(texts, chunks, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Lower-cased stretches between white space, no word of the pattern crosses it; single words, as the library tells them, of a text with strange letters."""
        if not text.isascii():
            if self.strange(text):
                self.split = self.split_strange
                text = self.library.normalizer.normalize_str(text)
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            text = self.nfc("NFC", text).replace("Σ", "σ")  # each letter is lowered by itself, so no final sigma
        text = text.lower()
        return [x for x in self.blank(text) if x] if self.odd(text) else text.split()

    def count(self, text: str) -> int:
        self.counts.trim()
        self.word_counts.trim()
        if "<|" not in text:
            return sum(map(self.counts.__getitem__, self.chunks(text)))
        return sum(1 if part in self.special else sum(map(self.counts.__getitem__, self.chunks(part))) for part in self.parts(text))

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit numbers."""
        self.ids.trim()
        if "<|" not in text:
            return b"".join(map(self.ids.__getitem__, self.chunks(text)))
        return b"".join(struct.pack("<I", self.special[part]) if part in self.special else b"".join(map(self.ids.__getitem__, self.chunks(part))) for part in self.parts(text))


@lru_cache(maxsize=1)
def strange_letters() -> tuple[str, str]:
    """Classes of the letters of which Python's tables know less than the library's, up to U+FFFF and beyond: those not assigned, and three whose order among marks differs."""
    from unicodedata import category

    unknown = [c for c in range(0x80, 0x32400) if category(chr(c)) == "Cn"] + [0x1DF6, 0x1E4EC, 0x1E4ED]
    return letter_class([c for c in unknown if c < 0x10000]), letter_class([c for c in unknown if c >= 0x10000])


def letter_class(letters: list[int]) -> str:
    first = [c for c, before in zip(letters, [-1, *letters], strict=False) if c != before + 1]
    last = [c for c, after in zip(letters, [*letters[1:], -1], strict=True) if after != c + 1]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(0x100 + spare))
        spare += b not in plain
    return out


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One per worker and file."""
    return RankEncoder(path, pattern)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
