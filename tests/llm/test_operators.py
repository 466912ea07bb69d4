"""The ten operators on small fixtures with every awkward row, against libraries, SQL or brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import chain
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbita.llm import blobs, common, components, hashing, queries, rounds, spelling
from orbita.llm import op1_bpe_codec as op1
from orbita.llm import op2_lm_scoring as op2
from orbita.llm import op3_html_extraction as op3
from orbita.llm import op4_exact_dedup as op4
from orbita.llm import op5_bestfit_packing as op5
from orbita.llm import op6_toxicity as op6
from orbita.llm import op7_license_scan as op7
from orbita.llm import op8_token_counts as op8
from orbita.llm import op9_merkle_fingerprints as op9
from orbita.llm import op10_jaccard_join as op10
from orbita.llm.bpe import PerfectHash, rank_encoder, word_encoder

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
random.seed(11)
BASE = [" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa").title() for _ in range(90)) for _ in range(4)]
LONG = " ".join(random.choice("lorem ipsum dolor sit amet") + str(i % 977) for i in range(30_000))


def near_copies(text: str, n: int) -> list[str]:
    words = text.split()
    return [" ".join(w if (i * 7 + k) % 89 else f"new{k}" for i, w in enumerate(words)) for k in range(n)]


ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "One  two\tthree\nfour"), (None, "one two three four five six"), (7, "one two three four five six"), (8, "one two three four five six"), (8, "one two three four five six"),
    (9, "All rights reserved. CC BY, general public license; cc-by All Rights Reserved"), (10, "héé Ünïcode ＡＢ ١٢ ²½ 'S don't 😀‍🏽 한국어 <|endoftext|> x"), (11, "a\n\nb. c!\n\n\nd e?"), (12, LONG), (13, LONG[:-1] + "?"), (14, LONG), (15, "\x00\x1c\x85\xa0 odd　white"), (16, "  leading   runs \n \n of space  "),
    *[(100 + i, t) for i, t in enumerate(BASE)], *[(200 + i, t) for i, t in enumerate(near_copies(BASE[0], 9))], *[(300 + i, t) for i, t in enumerate(near_copies(BASE[1], 3))],
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with those of results."""
    return spark.createDataFrame([(i, t, 7, "clash", 0.5, False) for i, t in ROWS], "doc_id long, text string, n_tokens long, key string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_perfect_hash_is_minimal_and_perfect():
    keys = [b"k%d" % i for i in range(5000)]
    h = PerfectHash(keys, list(range(5000)))
    assert len(h.keys) == 5000 and None not in h.keys
    assert [h.get(k) for k in keys] == list(range(5000)) and h.get(b"other") is None
    assert PerfectHash([], []).get(b"x") is None


def libraries():
    with open(public_tokenizers.path(op1.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(public_tokenizers.path(op8.VOCABULARY))


def test_encoders_equal_libraries_on_random_texts():
    tik, hf = libraries()
    mine, words = rank_encoder(public_tokenizers.path(op1.VOCABULARY), public_tokenizers.PATTERN), word_encoder(public_tokenizers.path(op8.VOCABULARY))
    letters = ["a", "the", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "Σ", "ς", "É", "é", "İ", "1", "²", "Ⅷ", "٣", "<|endoftext|>", "<|", "!", "😀", "​", "한", "\x00", "K", "_", "thninthre"]
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 14)))
        ids = hf.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == tik.encode_ordinary(text)
        assert mine.decode(mine.encode(text).tolist()) == text.encode()
        assert words.count(text) == len(ids) and words.encode(text) == struct.pack(f"<{len(ids)}I", *ids) == words.encode_many([text])[0]


def test_words_of_letters_and_a_mark_are_split_as_by_the_pattern():
    words = word_encoder(public_tokenizers.path(op8.VOCABULARY))
    for chunk in ("a", "ab", "é", "한국", "ab.", "é,", "ab..", "a1", "a1.", ".", "..", "'s", "a's", "ab!", "ab-", "²", "a²", "a̱", "a̱.", "ª", "(ab)", "ab\x00", "ⅷ", "ⅷ."):
        assert words.words_of(chunk) == words.words(chunk)
    many = ["a", "é", "thninthre", "x" * 32, "한국", "x" * 32, "zq"]
    assert words.merged_words(many) == [words._word_ids(w) for w in many] and words.merged_words([]) == []


def test_encoding_many_texts_holds_the_words_of_few():
    words, rng = word_encoder(public_tokenizers.path(op5.VOCABULARY)), random.Random(7)
    texts = [" ".join(f"w{rng.getrandbits(50):x}"[: rng.randint(4, 12)] + rng.choice(["", ",", "'s", "!?"]) for _ in range(6000)) for _ in range(80)]
    tracemalloc.start()
    try:
        got = words.encode_many(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6
    assert got[::20] == [words.encode(t) for t in texts[::20]] == [struct.pack(f"<{len(x)}I", *x) for x in (libraries()[1].encode(t, add_special_tokens=False).ids for t in texts[::20])]
    # one memo holds words and chunks
    for chunk in ("'s", "a's", "''s", "!?'ll", "a1b", "x,", "x!,", "'", "한국.", "²a", "\x00a", "ⅷ's"):
        assert all(words.words_of(w) == [w] for w in words.words_of(chunk))


def test_op1(spark, docs, none):
    tik, _ = libraries()
    path = public_tokenizers.path(op1.VOCABULARY)
    want = []
    for i, t in ROWS:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(map(tuple, op1.round_trip_digests(docs, path).collect())) == ordered(want)
    back = op1.decode(op1.encode(docs, path), path).collect()
    assert ordered((r.doc_id, bytes(r.data)) for r in back) == ordered((i, (t or "").encode()) for i, t in ROWS)
    assert op1.round_trip_digests(none, path).count() == 0


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def test_op2(spark, docs, none):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    count = Counter()
    for i, t in ROWS:
        if not held(i):
            count.update([*words_of(t), None])
    total, distinct, want = sum(count.values()), len(count), []
    for i, t in ROWS:
        own = [*words_of(t), None]
        want.append((i, held(i), len(own), sum(count[w] > 0 for w in own), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own), 6)))
    got = op2.lm_scores(docs).collect()
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == ordered(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert op2.lm_scores(none).count() == 0


def spelling_by_hand(words):
    """log10 p of a symbol after the symbols before it in a word, from distinct words and one end of text."""
    follow = defaultdict(Counter)
    for w in [*words, None] if words else []:
        s = [spelling.START, spelling.TEXT_END] if w is None else [spelling.START, *w, spelling.WORD_END]
        for i in range(1, len(s)):
            for k in range(min(i, spelling.DEPTH if w is not None else 1) + 1):
                follow[tuple(s[i - k : i])][s[i]] += 1
    total = sum(map(len, words)) + len(words)
    kept = {()}
    for context, own in follow.items():
        n, below = sum(own.values()), follow[context[1:]]
        m = sum(below.values())
        own = {x: c for x, c in own.items() if x != spelling.TEXT_END}
        if context and sum(c * math.log((c / n) / (below[x] / m)) for x, c in own.items()) >= spelling.GAIN * total:
            kept.add(context)

    def p(context, symbol):
        while context not in kept:
            context = context[1:]
        own = follow[context]
        lower = p(context[1:], symbol) if context else 1 / spelling.SYMBOLS
        n = sum(own.values())
        return (own[symbol] + len(own) * lower) / (n + len(own)) if n else lower

    def log10(w):
        s = [spelling.START, spelling.TEXT_END] if w is None else [spelling.START, *w, spelling.WORD_END]
        return sum(math.log10(p(tuple(s[max(0, i - spelling.DEPTH) : i]), s[i])) for i in range(1, len(s)))

    return log10


def scores_by_hand(rows, held):
    """(doc_id, score) by the definition: counts of all word sequences in dictionaries."""
    texts = {True: [], False: []}
    for i, t in rows:
        texts[held(i)].append((i, [w.encode() for w in words_of(t)]))
    padded = lambda own: [b" start"] * op2.DEPTH + own + [None]
    follow, count = defaultdict(Counter), Counter()
    for _, own in texts[False]:
        s = padded(own)
        for i in range(op2.DEPTH, len(s)):
            count[s[i]] += 1
            for k in range(1, min(op2.DEPTH, i - op2.DEPTH + 1) + 1):
                follow[tuple(s[i - k : i])][s[i]] += 1
    n, distinct = sum(count.values()), len(count)
    spell = spelling_by_hand([w for w in count if w is not None])
    kept = set()
    for context, own in follow.items():
        below = follow[context[1:]] if len(context) > 1 else count
        gain = sum(c * math.log((c / sum(own.values())) / (below[w] / sum(below.values()))) for w, c in own.items())
        if sum(own.values()) >= op2.LEAST and gain >= op2.DIVERGENCE * len(own):
            kept.add(context)
    out = []
    for i, own in chain(*texts.values()):
        s, score = padded(own), 0.0
        for j in range(op2.DEPTH, len(s)):
            log_p = spell(s[j]) + math.log10(distinct / (n + distinct)) if distinct else spell(s[j])
            if count[s[j]]:
                log_p = math.log10((count[s[j]] + distinct * 10 ** spell(s[j])) / (n + distinct))
            for k in range(1, min(op2.DEPTH, j - op2.DEPTH + 1) + 1):
                context = tuple(s[j - k : j])
                if context in kept:
                    m, kinds = sum(follow[context].values()), len(follow[context])
                    log_p += math.log10((follow[context][s[j]] / 10**log_p + kinds) / (m + kinds)) if log_p > -300 else math.log10(kinds / (m + kinds))
            score += log_p
        out.append((i, score))
    return out


def test_op2_scores_equal_those_by_hand(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for df, rows in ((docs, ROWS), (spark.read.parquet(f"{SF}/documents.parquet").repartition(3), sample)):
        got = sorted(((r.doc_id is not None, r.doc_id, r.score) for r in op2.lm_scores(df).collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
        want = sorted(((i is not None, i, x) for i, x in scores_by_hand(rows, held)), key=lambda x: (x[0], x[1] or 0, x[2]))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-6)


def test_op2_chunks_and_buckets_change_nothing(spark, docs, monkeypatch):
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.score)
    whole = sorted(op2.lm_scores(docs.coalesce(1)).collect(), key=key)
    monkeypatch.setattr(op2, "BUCKET", 900)
    parts = sorted(op2.lm_scores(docs.repartition(7)).collect(), key=key)
    assert [r[:5] for r in parts] == [r[:5] for r in whole] and [r.score for r in parts] == pytest.approx([r.score for r in whole], rel=1e-6)


def test_op2_reads_order_and_unknown_words(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(4)] + [(10, "the cat sat on the rug"), (11, "rug the on sat cat the"), (12, "the cats"), (13, "the qqzx"), (14, "the " + "qqzx" * 3000)]
    got = {r.doc_id: r for r in op2.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 10).collect()}
    assert got[10].score > got[11].score + 1 and got[10].base_score == pytest.approx(got[11].base_score)
    assert got[12].score > got[13].score > got[14].score + 1000 and got[12].n_known == got[14].n_known == 2


def test_op2_beats_its_base_where_all_words_are_known(spark):
    rows = [r for r in op2.op2_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.n_known == r.n_tokens]
    assert len(rows) > 20 and sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


def test_op2_spelling_leaves_no_shuffle_files(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    codes, n = spelling.transitions([b"word%d" % (i * 7919) for i in range(20_000)])
    rows = spark.createDataFrame([op2.message(0, k, op2.SPELLED, k, op2.packed(codes[k::3]), op2.counts(n[k::3])) for k in range(3)], op2.MESSAGE)
    before = shuffled()
    tree = op2.spelling(rows)
    left = sum(size for p, size in shuffled().items() if p not in before)
    assert len(tree.entries) > 100 and left < 20_000, left  # an aggregate's row for each task may stay


def test_op2_keeps_no_spelling_rows_beside_the_counts(spark, docs):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("orbita-*"))
    op2.lm_scores(docs)
    kinds = [{r.kind for r in t.select("kind").distinct().collect()} for t in (spark.read.parquet(str(p)) for p in set(shared.glob("orbita-*")) - before) if "kind" in t.columns]
    assert {op2.WORDS, op2.SEQUENCES} in kinds and not any(op2.SPELLED in k for k in kinds)


def test_op2_spelling_by_table_equals_lookups(monkeypatch):
    random.seed(5)
    words = list({bytes(random.choice(b"abcab\xc3\xa9") for _ in range(random.randrange(1, 12))) for _ in range(3000)})
    codes, n = spelling.transitions(words, 1)
    states = np.unique(codes >> spelling.BITS)
    kept = np.array([s == 0 or random.random() < 0.3 for s in states.tolist()])  # suffixes and beginnings are missing
    keep = kept[np.searchsorted(states, codes >> spelling.BITS)]
    asked = [*words, b"", b"z", b"abz" * 9, b"ab" * 32, b"ab" * 33, b"a" * 500]
    for entries in ((codes[keep], n[keep]), (codes[:0], n[:0])):
        monkeypatch.setattr(spelling, "NODES", 10**6)
        tree = spelling.Tree.build(*entries)
        monkeypatch.setattr(spelling, "NODES", 0)
        plain = spelling.Tree.build(*entries)
        assert tree.step is not None and plain.step is None
        assert tree.log10(asked).tolist() == plain.log10(asked).tolist() and tree.log10([]).tolist() == []


def test_op2_spelling_is_a_distribution_and_bounded():
    words = [b"the", b"then", b"other", b"zz"]
    tree = spelling.Tree.build(*spelling.transitions(words, 1))
    assert tree.log10([b"the"])[0] > tree.log10([b"teh"])[0]
    for before in (b"", b"t", b"th", b"othe", b"q"):
        places = np.arange(1, len(before) + 2)
        known = tree.of_symbols(np.array([*before], np.int64), places[:-1]).sum()
        total = sum(10 ** (tree.of_symbols(np.array([*before, s], np.int64), places).sum() - known) for s in range(spelling.SYMBOLS))
        assert total == pytest.approx(1.0)


PAGES = [
    ("<html><head><title>no</title></head><body><nav><a href=/a>menu</a></nav><article><h1>Head &amp; more</h1><p>First<b> para</b>graph<br>line two<p>Second  one.<p>Short.</article><footer>foot</footer>", "Head & more First paragraph line two Second one. Short."),
    ("<body><div class='site-header'>H</div><div id=x><h2>T</h2><p>A long enough text stands here, to win.<p>And another.</p><ul><li>one<li>two</ul><div class='comments'><p>nice one</div></div><div class=sidebar>s</div><form>f<input></form>", "T A long enough text stands here, to win. And another. one two"),
    ("<article>only <!-- c --> this<script>var a='</p>'</script><style>p{}</style></article><aside>no</aside>", "only this"),
    ("", ""), (None, ""), ("just text &lt;b&gt;", "just text <b>"), ("<body><nav>x</nav></body>", ""), ("<article>&#233;t&eacute;&nbsp; x</article", "été x"),
]


def test_op3(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in op3.extract_pages(pages).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert op3.extract_pages(pages.limit(0)).count() == 0


LEAD = "<p>A long enough text stands here, to win.<p>And another one of words."
LEAD_TEXT = "A long enough text stands here, to win. And another one of words."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div class='layout has-sidebar'><nav>x</nav><div>{LEAD}</div></div>", LEAD_TEXT),
        (f"<body><form id=aspnet><nav>x</nav><div>{LEAD}</div></form>", LEAD_TEXT),
        (f"<body><div id='content-with-header'>{LEAD}</div>", LEAD_TEXT),
        (f"<body><div class=sidebar>{LEAD}</div><div class=advert>buy</div>", LEAD_TEXT),
        (f"<article><div class='post-header'><h1>Title</h1></div>{LEAD}</article>", f"Title {LEAD_TEXT}"),
        (f"<body><div id=w><div id=t><h1>Title</h1></div><div id=b>{LEAD}</div></div><div class=share>s</div>", f"Title {LEAD_TEXT}"),
        (f"<main><article><h1>T</h1>{LEAD}</article><article class=c><p>nice one</article></main>", f"T {LEAD_TEXT}"),
        (f"<article>{LEAD}<article><p>nice one</article></article>", LEAD_TEXT),
        ("<body><div id=text><p>A text of some words stands here.</div><div id=comments><p>a long comment stands here which is longer than the text, really<p>and another one that is long as well</div>", "A text of some words stands here."),
        ("<div><ul>" + "<li><a href=x>a long enough label of a link</a>" * 30 + f"</ul><div>{LEAD}</div></div>", LEAD_TEXT),
        ("a < b and <3 c &#99999999999; &lt;x <a href='q>z</a> y", "a < b and <3 c \ufffd <x z y"),
    ],
)
def test_op3_density_decides(html, text):
    assert op3.extract(html) == text


def test_op3_reads_long_and_deep_pages_in_linear_time():
    began = time.perf_counter()
    for html in ("<a " * 350_000, "<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<a \"' >" * 50_000, "<p><b>" * 50_000, "<!-- -->" * 50_000, "&#" + "1" * 100_000):
        op3.extract(html)
    assert time.perf_counter() - began < 30
    assert op3.extract("<article><p>" + "word " * 400_000 + "</article>") == ("word " * 400_000).strip()


def test_op3_repeated_rows_and_null_columns(spark):
    rows = [(1, "u", PAGES[0][0])] * 3 + [(None, None, PAGES[0][0]), (None, None, None)]
    got = op3.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", PAGES[0][1], len(PAGES[0][1]))] * 3 + [(None, None, PAGES[0][1], len(PAGES[0][1])), (None, None, "", 0)])


def test_op3_on_the_pages(spark):
    from html import unescape

    for r in op3.op3_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_op4(spark, docs, none, block):
    rows = [r for r in ROWS if block > 1 or len(r[1] or "") < 200]
    df = docs if block > 1 else spark.createDataFrame(rows, "doc_id long, text string")
    got = op4.exact_groups(df, block if block > 7 else 512 * block).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = lambda t: max((i for i in groups[t or ""] if i is not None), default=None)
    want = [(i, best(t), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(want)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    kept = op4.drop_copies(df)
    assert kept.columns == df.columns and ordered((r.doc_id, r.text or "") for r in kept.collect()) == ordered((best(t), t) for t in groups)
    assert op4.exact_groups(none).count() == 0


def test_op5(spark, docs, none):
    _, hf = libraries()
    path = public_tokenizers.path(op5.VOCABULARY)
    want = []
    for i, t in ROWS:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, op5.END]
        want += [(i, k, a, len(p := ids[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, a in enumerate(range(0, len(ids), 4096))]
    got = op5.packed_documents(docs, path).collect()
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(want)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert op5.packed_documents(none, path).count() == 0


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_op5_blocks_and_rounds(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 700, 3000)] + [1000] * 20
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    got = op5.pack(items, 1000, 300).join(items, "id").collect()
    assert sorted(r.id for r in got) == list(range(len(lengths)))
    used = check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 1000)
    assert used <= math.ceil(sum(lengths) / 1000) * 1.03


def test_op5_evolution_improves_on_best_fit():
    rng = random.Random(4)
    lengths = [rng.choice([34, 33, 33, 26, 25, 24, 51, 49]) for _ in range(300)]
    first = op5.Bins(100, lengths)
    first.fit(list(range(300)))
    best = op5.evolve(lengths, 100, 1, [], 0, 30, 6)[0]
    assert sorted(i for b in best for i in b) == list(range(300)) and len(best) <= len(first.bins)


@pytest.mark.parametrize(("low", "high", "gain"), [(300, 1500, 15), (700, 1700, 60), (1000, 2000, 150)])
def test_op5_evolution_beats_best_fit_with_production_values(spark, low, high, gain):
    rng = random.Random(3)
    lengths = [rng.randint(low, high) for _ in range(op5.BLOCK)]
    first = op5.Bins(op5.CAPACITY, lengths)
    first.fit(list(range(len(lengths))))
    blocks = spark.createDataFrame([(0, list(range(len(lengths))), lengths)], "block long, ids array<long>, lengths array<int>")
    (r,) = op5.solved(blocks, op5.CAPACITY, True).collect()
    bins = op5.lists(r.bins)
    assert max(sum(lengths[i] for i in b) for b in bins) <= op5.CAPACITY and sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert len(bins) <= len(first.bins) - gain
    start = min((op5.evolve(lengths, op5.CAPACITY, k, [], 0, 0, 2)[0] for k in range(2)), key=len)
    assert len(bins) < len(start)  # better than both ways to begin


def test_op5_epoch_goes_on_while_children_improve():
    rng = random.Random(3)
    lengths = [rng.randint(1, 4095) for _ in range(op5.BLOCK)]
    start = op5.evolve(lengths, op5.CAPACITY, 0, [], 0, 0, 2)[0]
    best = op5.evolve(lengths, op5.CAPACITY, 0, [])[0]
    assert sorted(i for b in best for i in b) == list(range(op5.BLOCK)) and len(best) < len(start)


def test_op5_blocks_before_the_last_are_packed_as_well_as_tokens_allow(spark):
    rng = random.Random(3)
    lengths = [rng.randint(300, 1500) for _ in range(op5.BLOCK)]
    blocks = spark.createDataFrame([(0, list(range(len(lengths))), lengths)], "block long, ids array<long>, lengths array<int>")
    (r,) = op5.solved(blocks, op5.CAPACITY, False).collect()
    assert max(r.bins) + 1 == -(-sum(lengths) // op5.CAPACITY)

def test_op6(spark, docs, none):
    bad, ok = ["vile", "rotten", "scumword"], "the plain words of every day go here and there with more to say".split()
    rng = random.Random(2)
    train = []
    for i in range(900):
        words = [rng.choice(ok) for _ in range(rng.randint(3, 40))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        train.append((10_000 + i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t, None) for i, t, _ in train], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in train] + [(None, 1, None), (10_000, None, 3), (77, 1, 1)], "doc_id long, toxic int, text int")
    model = op6.fit(df, labels)
    truth = {i: y for i, _, y in train}
    got = op6.score(df, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert op6.score(docs, model).count() == len(ROWS) and op6.score(none, model).count() == 0
    clean = op6.keep_clean(df, model)
    assert clean.columns == df.columns and clean.count() == sum(not r.predicted for r in got)
    assert op6.fit(none, labels.limit(0)).scores(["x", None]).tolist() == [0.0, 0.0]
    assert op6.keep_clean(none, model).count() == 0


def test_op6_scores_equal_those_by_hand():
    model = op6.train(["one vile word", "a good word", "vile", "good words of a kind"] * 20, [1, 0, 1, 0] * 20)
    model.thresholds[:] = [0.3, -0.2, 0.1, 0.0, 0.7]
    for text in ["the vile word of the day", "Good words", "a", "", None, "le mot de la vile " * 30]:
        words = re.findall("[A-Za-z\x80-\U0010ffff]+", (text or "").lower())
        place = lambda h: int(h >> np.uint64(20)) % (op6.BUCKETS - 1) + 1
        hashes = [hashing.Words([x.encode()], hashing.NO_LETTER, op6.PREFIX) for x in words]
        logits = []
        for net in model.members:
            rows = [net.words[place(w.hashes[0])] + net.prefixes[place(w.prefixes[0])] for w in hashes]
            rows = np.array(rows + [np.zeros(op6.WIDTH)] * 2 * max(op6.FILTERS))
            own, at = net.bias, 0
            for width, n in op6.FILTERS.items():
                for f in range(n):
                    best = max(net.biases[width][f] + sum(rows[i + k] @ net.filters[width][k * op6.WIDTH : (k + 1) * op6.WIDTH, f] for k in range(width)) for i in range(len(words) + max(op6.FILTERS)))
                    own += max(best, 0) * net.out[at]
                    at += 1
            logits.append(min(max(own, -op6.MOST), op6.MOST))
        logit = sum(logits) / len(logits)
        votes = [sum(w in told.split() for w in words) for told in op6.FUNCTION_WORDS.values()]
        language = votes.index(max(votes)) if max(votes) else len(votes)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-(logit - model.thresholds[language]))), abs=1e-5)


def test_op6_thresholds_by_language_take_all_rows():
    counted = [(0, 0, s, 10) for s in range(-40, 0)] + [(0, 1, s, 10) for s in range(20, 40)] + [(1, 0, s, 10) for s in range(-40, -30)] + [(1, 1, s, 10) for s in range(-20, 40)] + [(2, 1, 0, 3)]
    cuts = op6.thresholds(counted)
    assert cuts[0] == pytest.approx(0.5) and cuts[1] == pytest.approx(-1.25, abs=0.3) and cuts[2] == cuts[3] == cuts[4]


def test_op6_held_out_rows(spark):
    got = op6.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_op7(spark, docs, none):
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    want = []
    for i, t in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want.append((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = op7.scan(docs).collect()
    assert ordered((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == ordered(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert op7.scan(none).count() == 0
    more = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy"), (3, "the apache licence"), (4, "Redistribution and use in source and binary forms, with or without modification, are allowed")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in op7.scan(more).collect()} == {1: "apache-2.0", 2: "mit", 3: "", 4: "bsd"}


def labels_by_hand(text, templates):
    """(labels, score) of a text: a key phrase in full, and the share of the template's words around it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for t in templates:
        k, n = t.key
        for s in range(len(words) - n + 1):
            if words[s : s + n] == t.words[k : k + n]:
                share = sum(0 <= s - k + i < len(words) and words[s - k + i] == w for i, w in enumerate(t.words)) / len(t.words)
                score = max(score, share)
                if share >= op7.COVERAGE:
                    labels.add(t.label)
    return ",".join(sorted(labels)), score


def test_op7_labels_equal_those_by_hand(spark, docs):
    rng, pieces = random.Random(8), [w for t in op7.TEMPLATES for w in (t.text, " ".join(t.words[t.key[0] : sum(t.key)]), t.words[0], "the")]
    rows = [(i, "; ".join(rng.choice([*pieces, "Other", "x1"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    for df, own in ((docs, ROWS), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        got = op7.scan(df).collect()
        assert ordered((r.doc_id, r.labels, round(r.score, 9)) for r in got) == ordered((i, x, round(y, 9)) for i, t in own for x, y in [labels_by_hand(t, op7.TEMPLATES)])


def test_op8(spark, docs, none):
    _, hf = libraries()
    path = public_tokenizers.path(op8.VOCABULARY)
    want = [(i, len((t or "").encode()), n := len(hf.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in ROWS]
    assert ordered(map(tuple, op8.count_tokens(docs, path).collect())) == ordered(want)
    assert op8.count_tokens(none, path).count() == 0


def test_op9(spark, docs, none):
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, texts = [], [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = op9.edited_prints(docs).collect()
    assert ordered((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == ordered(want)
    assert len({r.fingerprint for r in got}) == len(set(texts))
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert op9.edited_prints(none).count() == 0


def tree_by_hand(text):
    """(fingerprint, sections as lists of paragraphs as lists of pieces) of a text."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for section in filter(None, re.split(r"(?<=\n\n)(?!\n)", text)):
        sections.append([[m[0] for m in re.finditer(rf"[^.!?]{{1,{op9.PIECE}}}(?:[.!?]+[ \t\n\x0b\f\r]*)?|[.!?]+[ \t\n\x0b\f\r]*", p, re.S)] for p in filter(None, re.split(r"(?<=\n)(?!\n)", section))])
    nodes = [[("".join(map(sha, p)), p) for p in s] for s in sections]
    paragraph = lambda p: sha("".join(map(sha, p)))
    section = lambda s: sha("".join(map(paragraph, s)))
    body = ";".join(section(s)[:16] + "=" + ",".join(paragraph(p)[:16] + "-" + "".join(sha(x)[:8] for x in p) for p in s) for s in sections)
    assert all("".join(x for p in s for x in p) for s in sections) and nodes is not None
    return sha("".join(map(section, sections))) + "|" + body, sections


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    a, b = tree_by_hand(a)[1], tree_by_hand(b)[1]
    n, m = (sum(len(p) for s in x for p in s) for x in (a, b))
    key = lambda rows: [tuple(map(tuple, s)) for s in rows]
    once = lambda rows, other: [x for x in dict.fromkeys(rows) if x not in set(other)]
    sa, sb = key(a), key(b)
    pa, pb = [p for s in once(sa, sb) for p in s], [p for s in once(sb, sa) for p in s]
    xa, xb = [x for p in once(pa, pb) for x in p], [x for p in once(pb, pa) for x in p]
    alike = min(n - len(once(xa, xb)), m - len(once(xb, xa)))
    return max(0.0, min(alike / max(1.0, n + m - alike), 1 - 1 / (n + m + 1)))


def test_op9_prints_and_likeness_equal_those_by_hand(spark, docs):
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for df, own in ((docs, ROWS), (spark.read.parquet(f"{SF}/documents.parquet"), sample)):
        rows = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = []
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            want.append((i, tree_by_hand(t)[0], tree_by_hand(edited)[0], round(likeness_by_hand(t, edited), 9), round(likeness_by_hand(t, after), 9)))
        got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in op9.edited_prints(df).collect()]
        assert ordered(got) == ordered(want)


def test_op9_tree_locates_edits(spark):
    a = "p one. x\np two\n\nq three\nq four\n"
    rows = [(a, a.replace("two", "2")), (a, a), ("", "x"), (a, a.replace("\n\n", "\n\n\n")), (a, a + "more\n"), (a, "p one. x\n" + a), ("s\n\n" * 5, "s\n\n")]
    df = spark.createDataFrame(rows, "a string, b string").select(op9.fingerprint(F.col("a")).alias("a"), op9.fingerprint(F.col("b")).alias("b"))
    got = [(r.same, r.d and tuple(r.d), r.near) for r in op9.likeness(df, "a", "b", "near").select((op9.root(F.col("a")) == op9.root(F.col("b"))).alias("same"), op9.differing_paragraphs(F.col("a"), F.col("b")).alias("d"), "near").collect()]
    assert got[0][:2] == (False, (1, 1)) and got[1] == (True, None, 1.0) and got[2][:2] == (False, (0, -1)) and got[3][0] is False
    assert got[4][:2] == (False, (4, 3)) and got[5][0] is False and got[6][2] < 0.5


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a][1] & sets[b][1])
            if shared and 100 * shared >= 80 * (len(sets[a][1]) + len(sets[b][1]) - shared):
                top[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None and (least[root(k)] is None or i < least[root(k)]):
            least[root(k)] = i
    return [(i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)]


def test_op10(spark, docs, none):
    got = op10.linked_documents(docs).collect()
    assert ordered(map(tuple, got)) == ordered(brute_components(ROWS))
    assert op10.linked_documents(none).count() == 0
    kept = op10.keep_one(docs)
    assert kept.columns == docs.columns


def test_op10_on_random_sets(spark):
    rng, rows = random.Random(9), []
    for g in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 5, 6, 8, 12, 20, 40, 90, 200]))]
        for k in range(rng.choice([1, 2, 5])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            passage = [f"passage{j}" for j in range(60)] if rng.random() < 0.3 else []
            rows.append((1000 * g + k, " ".join(own + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(map(tuple, op10.linked_documents(df).collect())) == ordered(brute_components(rows))


def test_op10_keys_never_lose_a_link():
    rng = np.random.default_rng(0)

    def kept(s, keyed, turn):
        """The keys without as many of the commonest as may be left out; a hash stands for how many sets hold a key."""
        out = []
        for keys, leave in keyed(s):
            order = np.argsort(hashing.mix(keys + np.uint64(turn)))
            out.append(keys[order[leave:]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    for n in (4, 5, 7, 11, 20, 33, 70, 150, 400):
        for turn in range(40):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            b = a.copy()
            gone = rng.choice(len(b), int(rng.integers(0, n // 9 + 2)), replace=False)
            b[gone] = rng.integers(0, 1 << 62, len(gone), dtype=np.uint64)
            b = np.unique(b)
            if op10.linked(a, b) and not np.array_equal(a, b):
                for keyed in (op10.parts_of, op10.shingles_of):
                    assert len(np.intersect1d(kept(a, keyed, turn), kept(b, keyed, turn)))
                assert op10.near(len(a), op10.sketch_of(a), len(b), op10.sketch_of(b))


def test_op10_hot_parts(spark, monkeypatch):
    """Passages, near copies of one text and a third of all rows in one part, in blocks of a few sets."""
    monkeypatch.setattr(op10, "MANY", 6)
    rng, rows = random.Random(5), []
    passage, base = [f"p{j}" for j in range(60)], [f"b{j}" for j in range(50)]
    for i in range(60):
        rows.append((i, " ".join(passage + [f"o{i}_{j}" for j in range(rng.choice([5, 9, 20, 60]))])))
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(50), rng.choice([0, 1, 1, 2])):
            own[at] = f"n{i}_{at}"
        rows.append((1000 + i, " ".join(own)))
    for i in range(30):  # two families that only differ in their last quarter
        rows.append((2000 + i, " ".join(passage + [f"f{i % 2}_{j}" for j in range(12 + i % 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(map(tuple, op10.linked_documents(df).collect())) == ordered(brute_components(rows))


def test_op10_blobs_are_packed_without_copies():
    numbers = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 1_000_000, dtype=np.uint64))
    small = np.random.default_rng(1).integers(0, 1000, 1_000_000)
    for pack, unpack, x, most in ((blobs.packed, blobs.unpacked, numbers, 22e6), (blobs.counts, blobs.uncounted, small, 8e6)):
        tracemalloc.start()
        data = pack(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most and np.array_equal(unpack(data), x)


def traced(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_op10_texts_are_hashed_few_at_once():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.getrandbits(24)}" for _ in range(n)) for n in [6000] * 60 + [0, 3, 5]] + [None, LONG]
    sets, peak = traced(lambda: hashing.shingle_sets(texts, 5))
    assert peak < 40e6
    assert all(np.array_equal(s, hashing.shingle_sets([t], 5)[0]) for s, t in zip(sets, texts, strict=True))
    assert hashing.shingle_sets([], 5) == []


def test_op10_blobs_are_unpacked_without_copies():
    numbers = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 1_000_000, dtype=np.uint64))
    small = np.random.default_rng(1).integers(0, 1 << 40, 1_000_000)
    for pack, unpack, x, most in ((blobs.packed, blobs.unpacked, numbers, 19e6), (blobs.counts, blobs.uncounted, small, 16e6)):
        got, peak = traced(lambda data=pack(x), unpack=unpack: unpack(data))
        assert peak < most and np.array_equal(got, x)
        for n in (0, 1, blobs.PIECE - 1, blobs.PIECE, blobs.PIECE + 1):
            assert np.array_equal(unpack(pack(x[:n])), x[:n])


def test_keys_of_requests_are_sorted_not_put_into_a_hash_table():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 62, 1_000_000, dtype=np.uint64)
    asked = [np.unique(rng.choice(pool, n)) for n in (700_000, 700_000, 1, 0)]
    rows = [(0, 0, blobs.packed(x), None, None) for x in asked]
    began = time.process_time()
    keys, to = rounds.common_keys(rows)
    spent, whole = time.process_time() - began, np.concatenate(asked)
    began = time.process_time()
    whole.sort()
    assert spent < 12 * (time.process_time() - began)  # with a hash table of them: 29 times
    assert np.array_equal(keys, sorted(set(whole.tolist()))) and all(np.array_equal(keys[here], x) for here, x in zip(to, asked, strict=True))
    assert blobs.distinct(np.zeros(0, np.uint64)).tolist() == [] and blobs.distinct(np.array([3, 1, 3], np.uint64)).tolist() == [1, 3]


def test_op2_and_op10_blobs_of_planes_look_for_runs_only():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 200_000, dtype=np.uint64)) << np.uint64(16)
    held = np.minimum(np.random.default_rng(4).zipf(1.5, 200_000), 1 << 39)
    for pack, unpack, x, bits in ((blobs.packed, blobs.unpacked, keys, 8), (blobs.counts, blobs.uncounted, held, 5)):
        steps = np.diff(x, prepend=x[:1] * 0) if bits == 8 else x
        whole = zlib.compress(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :bits].T).tobytes(), 1)
        assert np.array_equal(unpack(pack(x)), x) and len(pack(x)) < 0.995 * len(whole)


def test_op10_ranges_of_keys():
    for buckets in (1, 3, 12, 1000):
        edge = [-(-(b << 32) // buckets) << 32 for b in range(1, buckets)]
        keys = np.array([0, *(e + d for e in edge for d in (-1, 0, 0)), (1 << 64) - 1], np.uint64)
        assert [int(k) for _, s in blobs.ranges(keys, buckets) for k in keys[s]] == keys.tolist()
        assert all((int(k) >> 32) * buckets >> 32 == b for b, s in blobs.ranges(keys, buckets) for k in keys[s])
        assert blobs.ranges(keys[:0], buckets) == []


def test_op10_only_texts_without_parts(spark):
    rows = [(1, "one two"), (2, "One\ttwo"), (3, "x"), (4, ""), (5, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert ordered(map(tuple, op10.linked_documents(df).collect())) == ordered(brute_components(rows))


def test_op10_postings_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(op10, "ROWS", 10)
    batches, once = [], op10.each_chunk

    def counted(rows, schema, of):
        def each(*chunk):
            for out in of(*chunk):
                yield {"key": [len(out["key"])], "node": [b""], "n": [0]}

        batches.append(once(rows, schema, each).select("key").collect())
        return once(rows, schema, of)

    monkeypatch.setattr(op10, "each_chunk", counted)
    df = spark.createDataFrame([(i, f"{i % 7} " + " ".join(BASE[0].split()[i % 7 :])) for i in range(40)], "doc_id long, text string")
    assert op10.postings(df, op10.shingles_of).count() > 10
    assert max(r.key for r in batches[0]) <= 10


def test_op10_equal_sets_of_several_chunks_count_once(spark, monkeypatch):
    monkeypatch.setattr(op10, "CHUNK", 100)
    words = lambda k: " ".join(f"v{k}_{j}" for j in range(60))
    rows = [(i, words(i % 4)) for i in range(64)] + [(100, words(9)), (101, words(9) + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    near = {op10.node_of(hashing.shingle_sets([t])[0]) for _, t in rows[64:]}
    for ids in (op10.BROADCAST_IDS, 0):
        monkeypatch.setattr(op10, "BROADCAST_IDS", ids)
        posts = op10.postings(df, op10.parts_of).collect()  # before, the copies' parts stood here, too: held twice, by one set
        assert {bytes(r.node) for r in posts} == near and {r.n for r in posts} == {2}
        assert len({(r.key, bytes(r.node)) for r in posts}) == len(posts)
    assert ordered(map(tuple, op10.linked_documents(df).collect())) == ordered(brute_components(rows))


def test_op10_sets_together_give_what_each_gives_alone():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in [0, 1, 3, 4, 5, 9, 70, 400, 40_000, *rng.integers(1, 300, 600)]]
    lists, alone = op10.parts_of_all(sets), {}
    of = np.repeat(np.concatenate([a[1] for a in lists.about]), np.concatenate([a[0] for a in lists.about]))
    keys = np.concatenate(lists.keys)
    for i, s in enumerate(sets):
        alone = [k for k, _ in op10.parts_of(s)] if len(s) else []
        assert sorted(keys[of == i].tolist()) == sorted(x for k in alone for x in k.tolist())
    for times in (1, 8):
        assert op10.sketches(sets, times) == [op10.sketch_of(s, times) for s in sets]
    assert op10.sketches([]) == [] and op10.parts_of_all([]).keys == []
    began = time.process_time()
    op10.parts_of_all(sets[9:])
    spent = time.process_time() - began
    began = time.process_time()
    for s in sets[9:]:
        op10.parts_of(s)
    assert 3 * spent < time.process_time() - began


def test_op10_few_sets_cross_as_many_do(monkeypatch):
    rng, groups = np.random.default_rng(7), []
    for m in (1, 2, 3, 5, 16) * 20:
        base, rows = rng.integers(0, 1 << 62, int(rng.choice([5, 40, 130, 400])), dtype=np.uint64), []
        for _ in range(m):
            own = base.copy()
            own[rng.choice(len(own), int(rng.integers(0, len(own) // 8 + 2)), replace=False)] += np.uint64(1)
            own = np.unique(own[int(rng.integers(0, len(own) // 5 + 1)) :])
            rows.append((bytes([rng.integers(4)]), len(own), op10.sketch_of(own, int(rng.choice([1, 8])))))
        groups.append(rows)
    few = list(map(op10.crossing, groups))
    monkeypatch.setattr(op10, "FEW", 0)
    assert few == list(map(op10.crossing, groups)) and any(few)
    assert all(op10.bits_of(r[2], 8) == int(op10.folded(r[2], 1)[0]) for rows in groups for r in rows)


def test_op10_words_of_any_length_are_told_apart():
    words = [c * n + d for n in (0, 1, 6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for c in "xy" for d in ("a", "b", "ab", "é", "日本")]
    sets = hashing.shingle_sets([*words, *(f" \t{w.upper()}\n" if w.isascii() else w for w in words)])
    assert len({int(s[0]) for s in sets}) == len({w for w in words}) and [s.tolist() for s in sets[: len(words)]] == [s.tolist() for s in sets[len(words) :]]
    order = hashing.shingle_sets(["a b c d e", "b a c d e", "e d c b a", "a a c d e", "a c a d e", "ab c d e f"])
    assert len({int(s[0]) for s in order}) == 6


def test_op10_many_null_ids(spark):
    rows = [(None if i % 2 else i, f"some words of a text that goes on with number {i // 4} and ends here x{i % 4 // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op10.linked_documents(df).collect()
    assert ordered((r.doc_id, r.component_id) for r in got) == ordered((i, k - k % 4) for k, (i, _) in enumerate(rows))


def test_op10_keep_one(spark, docs, none):
    want = {c for i, n, c in brute_components(ROWS)}
    assert {r.doc_id for r in op10.keep_one(docs).collect()} == want and op10.keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_tell_words_apart():
    words = [f"{c}{i}".encode() for i in range(3000) for c in ("a", "b", "ab", "ba", "x" * 70, "y" + "x" * 70)]
    assert len(set(hashing.Words(words).hashes.tolist())) == len(set(words))
    assert hashing.shingle_sets([None, "", "  ", "A b", "a B"])[3].tolist() == hashing.shingle_sets(["a b"])[0].tolist()


def test_queries_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))


def test_stages_of_the_pipeline_give_heap_back(spark):
    import corpus_pipeline as p

    jvm = spark._jvm
    beans = list(jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    whole = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    before = whole()
    common.compact(spark)
    assert whole() > before
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    for stage in (p.exact_dedup, p.jaccard_join, p.bestfit_packing):
        before = whole()
        stage(spark, docs, SF)
        assert whole() > before, stage


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = p.toxicity(spark, docs, SF).cache()
    assert clean.columns == docs.columns and clean.count() > 0.7 * docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()}
    assert gone and np.mean([labels[i] for i in gone if i in labels]) > 0.7
    once = p.exact_dedup(spark, clean, SF).cache()
    best = {}
    for r in clean.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(best.values())
    left = p.jaccard_join(spark, once, SF).cache()
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in once.collect()])}
    assert {r.doc_id for r in left.collect()} == want
    packed = p.bestfit_packing(spark, left, SF).collect()
    assert {r.doc_id for r in packed} == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in packed], 4096)
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "bestfit_packing"]
