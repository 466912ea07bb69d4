"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of a row for its hash and a row for the hash of its first bytes. Filters of several
widths slide over the words, each keeps its maximum over the text, and a linear layer makes a logit; the logits of a few
networks are averaged. A threshold for each language, which is told from the text's own function words, moves the logit
so that 0.5 is the best cut there. The weights are learnt from a bounded sample of the labelled rows, each network's
without one of FOLDS folds; the thresholds from all rows that some network has not learnt from, by its logit (by the mean
where none has), counted by language, label and logit on the cluster.
Neither labels nor the columns lang, source and doc_id are inputs of a score.

Null texts count as empty; a text without words scores what the bias says. Labels that are null or of unknown
documents are not learnt from. Without both classes among the labels every score is the share of ones, 0 if there are
none. Every row of the documents gives one row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_text, map_rows, table
from .hashing import NO_LETTER, Words

#: The fixed bound of rows that are learnt from, for each class.
SAMPLE = 3000
BUCKETS, WIDTH, PREFIX = 1 << 15, 12, 4
FILTERS = {1: 16, 2: 8, 3: 8}
EPOCHS, STEPS, BATCH, RATE, SEED = 5, 400, 64, 0.01, 7
#: Networks that are averaged, folds of the labelled rows, and the bound of each one's logit.
MEMBERS, FOLDS, MOST = 3, 5, 12.0
#: What a share of clean rows above a threshold weighs against a share of toxic rows below it.
CLEAN_WEIGHT = 2
#: Function words that tell a language, and the order of languages; "other" where none stands out.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with it as be are this from at by not or have an",
    "fr": "le la les de des du et un une est que qui dans pour sur au avec ce pas par plus il",
    "de": "der die das und den von zu ist mit sich des auf für nicht ein eine dem im auch es an",
    "es": "el la los las de que y en un una es por con para se del al lo como su más no",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@dataclass
class Text:
    """A batch as bucket numbers: 0 is the padding, of which each text has as many as the widest filter needs."""

    words: np.ndarray
    prefixes: np.ndarray
    offsets: np.ndarray
    languages: np.ndarray


def hashed(word: str) -> int:
    return int(Words([word.encode("utf-8")], NO_LETTER).hashes[0])


_TOLD = sorted((hashed(w), i) for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split())
_TOLD_HASH, _TOLD_LANGUAGE = np.array([h for h, _ in _TOLD], np.uint64), np.array([i for _, i in _TOLD])


def languages_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    votes = np.zeros((len(offsets) - 1, len(FUNCTION_WORDS)))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low, high = np.searchsorted(_TOLD_HASH, hashes, "left"), np.searchsorted(_TOLD_HASH, hashes, "right")
    for shift in range(len(FUNCTION_WORDS)):  # a word may vote for several languages
        has = low + shift < high
        np.add.at(votes, (text[has], _TOLD_LANGUAGE[low[has] + shift]), 1)
    return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


def prepare(texts: list[str | None]) -> Text:
    words = Words([(t or "").lower().encode("utf-8") for t in texts], NO_LETTER, PREFIX)
    pad = max(FILTERS)
    size = np.diff(words.offsets)
    begin = np.concatenate(([0], np.cumsum(size + pad)))
    ids, prefixes = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.int64)
    if len(words.hashes):
        to = np.arange(len(words.hashes)) + np.repeat(np.arange(len(size)) * pad, size)
        ids[to] = (words.hashes >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1) + 1
        prefixes[to] = (words.prefixes >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1) + 1
    return Text(ids, prefixes, begin, languages_of(words.hashes, words.offsets))


@dataclass
class Network:
    words: np.ndarray
    prefixes: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float = 0.0

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
        model = cls(small(BUCKETS, WIDTH), small(BUCKETS, WIDTH), {w: small(w * WIDTH, n) * 3 for w, n in FILTERS.items()}, {w: np.zeros(n, np.float32) for w, n in FILTERS.items()}, small(sum(FILTERS.values())))
        model.words[0] = model.prefixes[0] = 0
        return model

    def pooled(self, text: Text) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima after ReLU by text and filter, and by width the places where each maximum stands."""
        x = self.words[text.words] + self.prefixes[text.prefixes]
        padded = np.concatenate([x, np.zeros((max(FILTERS), WIDTH), np.float32)])
        parts, places = [], {}
        for w, weights in self.filters.items():
            y = sum(padded[k : k + len(x)] @ weights[k * WIDTH : (k + 1) * WIDTH] for k in range(w)) + self.biases[w]
            top = np.maximum.reduceat(y, text.offsets[:-1], axis=0)
            places[w] = y
            parts.append(np.maximum(top, 0))
        return np.concatenate(parts, axis=1), places

    def logits(self, text: Text) -> np.ndarray:
        return self.pooled(text)[0] @ self.out + self.bias


@dataclass
class Model:
    members: list[Network]
    constant: float | None = None
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def logits(self, text: Text) -> np.ndarray:
        return np.mean([np.clip(m.logits(text), -MOST, MOST) for m in self.members], axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        text = prepare(texts)
        return sigmoid(self.logits(text) - self.thresholds[text.languages])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


class Adam:
    def __init__(self, rate: float = RATE):
        self.rate, self.state = rate, {}

    def __call__(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Update in place; with ``rows`` only those rows, each with moments of its own."""
        m, v, t = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        self.state[name][2] = t = t + 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient * gradient
        value[at] -= self.rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def train(texts: list[str | None], labels: list[int], folds: list[int] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The networks' weights, each without the rows of its own fold; thresholds are 0."""
    y, folds = np.array(labels, np.float32), np.array([-1] * len(labels) if folds is None else folds)
    if not len(y) or y.min() == y.max():
        return Model([], float(y.mean()) if len(y) else 0.0)
    members = []
    for k in range(MEMBERS):
        own = np.flatnonzero(folds != k)
        own = own if y[own].min(initial=1) < y[own].max(initial=0) else np.arange(len(y))
        members.append(network([texts[i] for i in own.tolist()], y[own], epochs, seed + k))
    return Model(members)


def network(texts: list[str | None], y: np.ndarray, epochs: int, seed: int) -> Network:
    model, rng, step = Network.new(seed), np.random.default_rng(seed), Adam()
    own, bias = np.arange(len(y)), np.zeros(1, np.float32)
    for _ in range(max(epochs, STEPS // -(-len(own) // BATCH))):  # few rows are gone through more often
        own = rng.permutation(own)
        for begin in range(0, len(own), BATCH):
            pick = own[begin : begin + BATCH]
            text = prepare([texts[i] for i in pick])
            pooled, places = model.pooled(text)
            model.bias = float(bias[0])
            error = (sigmoid(pooled @ model.out + model.bias) - y[pick]).astype(np.float32) / len(pick)
            back = error[:, None] * model.out[None, :] * (pooled > 0)
            step("out", model.out, pooled.T @ error + 1e-5 * model.out)
            step("bias", bias, np.array([error.sum()], np.float32))
            at, rows, grads = 0, [], []
            for w, n in FILTERS.items():
                values, g = places[w], back[:, at : at + n]
                at += n
                gw = np.zeros_like(model.filters[w])
                for i, (a, b) in enumerate(zip(text.offsets[:-1], text.offsets[1:], strict=True)):
                    live = np.flatnonzero(g[i])
                    if not len(live):
                        continue
                    top = a + values[a:b][:, live].argmax(0)
                    for k in range(w):
                        here = np.minimum(top + k, len(text.words) - 1)
                        x = model.words[text.words[here]] + model.prefixes[text.prefixes[here]]
                        gw[k * WIDTH : (k + 1) * WIDTH, live] += x.T * g[i, live]
                        rows.append(here)
                        grads.append(g[i, live][:, None] * model.filters[w][k * WIDTH : (k + 1) * WIDTH][:, live].T)
                step(f"f{w}", model.filters[w], gw)
                step(f"b{w}", model.biases[w], g.sum(0))
            if rows:
                here, grad = np.concatenate(rows), np.concatenate(grads)
                for name, weights, ids in (("words", model.words, text.words[here]), ("prefixes", model.prefixes, text.prefixes[here])):
                    unique, to = np.unique(ids, return_inverse=True)
                    total = np.zeros((len(unique), WIDTH), np.float32)
                    np.add.at(total, to, grad)
                    total[unique == 0] = 0
                    step(name, weights, total, unique)
    model.bias = float(bias[0])
    return model


#: Logits are counted in steps of one of so many parts, between -LIMIT and LIMIT.
STEP, LIMIT = 20, 40


def thresholds(counted: list[tuple[int, int, int, int]]) -> np.ndarray:
    """For each language the middle of the cuts with the least weighted share of errors, from counts (language, label, step, n); for few rows the common one."""

    def best(rows: list[tuple[int, int, int]]) -> float:
        held = np.zeros((2, 2 * STEP * LIMIT + 3))
        for label, step, n in rows:
            held[label, step + STEP * LIMIT + 1] += n
        share = held / np.maximum(held.sum(1, keepdims=True), 1)
        below = np.concatenate((np.zeros((2, 1)), np.cumsum(share, axis=1)[:, :-1]), axis=1)  # a cut stands at the lower end of its step
        wrong = below[1] + CLEAN_WEIGHT * (1 - below[0]) * (held[0].sum() > 0)
        tied = np.flatnonzero(np.isclose(wrong, wrong.min()))
        return ((tied[0] + tied[-1]) / 2 - STEP * LIMIT - 1) / STEP

    of = lambda label, rows: sum(n for y, _, n in rows if y == label)
    all_ = [row[1:] for row in counted]
    common = best(all_) if min(of(0, all_), of(1, all_)) >= 10 else 0.0
    out = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        mine = [row[1:] for row in counted if row[0] == k]
        if of(0, mine) + of(1, mine) >= 50 and min(of(0, mine), of(1, mine)) >= 10:
            out[k] = best(mine)
    return out


def logit_counts(rows: DataFrame, model: Model) -> DataFrame:
    """(language, toxic, step, n) of rows (text, toxic, member): by one network's logit, by the mean where member is -1."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        held: dict[tuple[int, int, int], int] = {}
        for texts, labels, members in batches:
            for i in range(0, len(texts), 64):
                text, of = prepare(texts[i : i + 64]), np.array(members[i : i + 64])
                each = np.stack([np.clip(m.logits(text), -MOST, MOST) for m in sent.value.members])
                logits = np.where(of < 0, each.mean(0), each[np.maximum(of, 0), np.arange(len(of))])
                step = np.floor(np.clip(logits, -LIMIT, LIMIT) * STEP).astype(int)
                for key in zip(text.languages.tolist(), labels[i : i + 64], step.tolist(), strict=True):
                    held[key] = held.get(key, 0) + 1
        language, label, step = (list(x) for x in zip(*held, strict=True)) if held else ([], [], [])
        yield {"language": language, "toxic": label, "step": step, "n": list(held.values())}

    counted = map_rows(rows, ["text", "toxic", "member"], "language int, toxic int, step int, n long", work)
    return counted.groupBy("language", "toxic", "step").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0; the weights from the ``sample`` rows of least hash for each class."""
    fold = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_text("doc_id") % 5 != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    one = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = one(0).unionByName(one(1)).collect()  # at most 2 * sample ids
    # as Arrow: from rows, each executor would start a second set of Python workers
    picked = docs.sparkSession.createDataFrame(pa.table({c: pa.array([r[c] for r in picked], kind) for c, kind in (("doc_id", pa.int64()), ("toxic", pa.int32()))}), "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "toxic", fold).collect()  # at most 2 * sample labels
    rows.sort(key=lambda r: (r["h"], r["text"] or "", r["toxic"]))
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows], [r["fold"] for r in rows])
    if model.constant is None:
        learnt = F.broadcast(picked.select("doc_id", F.lit(True).alias("learnt")).distinct())
        member = F.when(F.col("learnt"), F.when(F.col("fold") < MEMBERS, F.col("fold"))).otherwise(-1).alias("member")
        apart = known.join(learnt, "doc_id", "left").select("doc_id", "toxic", "learnt", fold).select("doc_id", "toxic", member).where("member IS NOT NULL")
        model.thresholds = thresholds([tuple(r) for r in logit_counts(docs.select("doc_id", "text").join(apart, "doc_id"), model).collect()])  # bounded by languages and steps
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for keys, texts in batches:
            scores = [float(s) for i in range(0, len(texts), 64) for s in sent.value.scores(texts[i : i + 64])]
            yield {"doc_id": keys, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double, predicted int", work)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = [float(s) for i in range(0, len(texts), 64) for s in sent.value.scores(texts[i : i + 64])]
            yield b.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    from .common import prepared

    return prepared(docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_text("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")
