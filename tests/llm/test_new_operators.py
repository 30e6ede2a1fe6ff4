"""Hard negatives, alignment and URL filters against brute force, on whole small tables with odd rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rxlake.llm import alignment, negatives, urls
from rxlake.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, URL_RULES

# --- 11 hard negatives ---------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, n_positives=5, n_negatives=5):
    sound = [
        (i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, lab in rows
        if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = collections.Counter()
    for i, lab, e in {(i, lab, tuple(e)) for i, lab, e in sound if is_anchor(i)}:
        scored = sorted((-clip(sum(a * b for a, b in zip(e, f))), j, m) for j, m, f in sound if j != i and len(f) == len(e))
        for p, j, m in [x for x in scored if x[2] == lab][:n_positives]:
            inside = [(s, k) for s, k, n in scored if n != lab and 80 * -p <= 100 * -s <= 100 * -p]
            out.update((i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(inside[:n_negatives]))
    return out


@pytest.mark.parametrize("sizes", [(16_384, 2_048, 1_024), (40, 3, 7)])
def test_negatives(spark, monkeypatch, sizes):
    """Ties, repeated rows and ids, null and non-finite parts, huge and short vectors; also with many small tiles."""
    for name, size in zip(("SHARD", "BLOCK", "FIELDS"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-1, 4, 3)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [rows[5], rows[5], rows[100], (100, [3.0, 3.0, 3.0], 1), (7, [1.0, 2.0, 3.0], 2), (None, [1.0, 1.0, 1.0], 1), (400, None, 1)]
    rows += [(401, [1.0, None, 2.0], 1), (402, [1.0, float("inf"), 2.0], 1), (500, [1.0, 1.0, 1.0], None), (600, [1.0, 2.0], 0), (601, [1.0, 2.0], 0)]
    rows += [(602, [1.0, 2.0], 1), (700, [1e9, -1e9, 5.0], 0), (800, [1e30, 1.0, 1.0], 1), (900, [], 1), (901, [], 1), (902, [], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("score", "rank", "dim", "block")})
    got = collections.Counter(map(tuple, negatives.mine_negatives(vectors, F.col("vec_id") % 20 == 0, F.col("label")).collect()))
    assert got == brute_negatives(rows, lambda i: i % 20 == 0) and len(got) > 100
    assert negatives.mine_negatives(vectors.limit(0), F.col("vec_id") % 20 == 0, F.col("label")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-1000, 1000), min_size=3, max_size=3), min_size=1, max_size=20), st.integers(0, 90))
def test_packed_products(rows, power):
    wide = np.array([[x << power for x in r] for r in rows], object if power > 50 else np.int64)
    anchor = [x << power for x in rows[0]]
    pack = negatives.Packed(wide, max(map(abs, anchor)))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert pack.products(anchor).tolist() == [clip(sum(int(a) * int(b) for a, b in zip(anchor, r))) for r in wide]


# --- 12 alignment --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTE_VOCABULARY)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY), alignment.words_of(BYTE_VOCABULARY, PIECE_VOCABULARY)


ODD = st.text(max_size=30) | st.text("ab tzé \n\t.,'1<|>▁\u00a0\u3000\u2028\x1c\x85日😀", max_size=40) | st.sampled_from(
    ["<|endoftext|> a", "<s> x </s>", "<0x41>", " " * 40 + "a", "a" * 500, "\x00a b", "it's  'll x", "ﬁ ½", "\r\n a\r\n"]
)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_words_are_tokenized_like_whole_texts(libraries, text):
    first, second, words = libraries
    parts = alignment.words_in(text)
    assert parts == (alignment.BREAK.split(text) if text else [])
    ids, counts = words.first_ids(parts, [(" " + p).encode() for p in parts])
    assert ids.tolist() == (first.encode(" " + text, add_special_tokens=False).ids if text else [])
    assert counts.tolist() == [len(first.encode(" " + p, add_special_tokens=False).ids) for p in parts]
    if "▁" not in text:  # not given back, so never aligned
        assert [i for ids in words.b.encode(parts) for i in ids] == second.encode(text)


def merged_groups(a, b):
    """Groups of two end lists by the set of common ends."""
    both, out, i, j = set(a) & set(b), [], 0, 0
    for end in sorted(both):
        m, n = a.index(end) + 1, b.index(end) + 1
        out.append((i, m - i, j, n - j))
        i, j = m, n
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 120), st.randoms(use_true_random=False), st.floats(0, 1), st.floats(0, 1))
def test_groups(last, random, x, y):
    a, b = (sorted({last, *(i for i in range(1, last) if random.random() < p)}) for p in (x, y))
    runs = alignment.aligned_groups(a, b)
    assert alignment.in_single_groups(runs).tolist() == [list(g) for g in merged_groups(a, b)]
    assert all(n > 0 or m == -n for _, m, _, n in runs)


def brute_alignment(rows, first, second):
    letter = {c: b for c, b in alignment.byte_letters().items()}
    found = []
    for i, t in rows:
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        spelled_a = [bytes(letter[c] for c in first.id_to_token(x)) for x in a]
        piece = lambda x: bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode()
        spelled_b = [piece(x) for x in b]
        if not t or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + t).encode():
            found.append((i, [], [], []))
            continue
        ends = [np.cumsum([len(s) for s in sp]).tolist() for sp in (spelled_a, spelled_b)]
        both, groups, m, n = set(ends[0]) & set(ends[1]), [], [], []
        at = 0
        for x, end in zip(a, ends[0]):
            m.append(x)
            if end in both:
                while True:
                    n.append(b[at])
                    at += 1
                    if ends[1][at - 1] == end:
                        break
                groups.append((m, n))
                m, n = [], []
        found.append((i, a, b, groups))
    count = collections.Counter(p for _, _, _, groups in found for p in {(x, y) for m, n in groups for x in m for y in n})
    most = collections.defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = collections.Counter()
    for i, a, b, groups in found:
        links = [(x, y) for m, n in groups for x in m for y in n]
        text = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, n)) for m, n in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out[(i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest)] += 1
    return out


def test_bounded_words(libraries, monkeypatch):
    """Generations come and go, long words are not kept, and odd words stay marked."""
    monkeypatch.setattr(alignment, "CACHE", 5)
    words = alignment.Words(BYTE_VOCABULARY, PIECE_VOCABULARY)
    for turn in range(30):
        texts = [f"w{turn + k} é{turn % 3} x▁y {'long' * 80}{k}" for k in range(4)]
        found = list(alignment.tokenized(words, texts))
        assert found == [alignment.NOTHING] * 4 and len(words.now.number) < 40 and not any(len(w) > 200 for w in [*words.now.number, *words.bad])
        again = list(alignment.tokenized(words, [t.replace("▁", "") for t in texts]))
        assert [r[0] for r in again] == [len(libraries[0].encode(" " + t.replace("▁", "")).ids) for t in texts]


@pytest.mark.parametrize(("frequent", "group"), [(1 << 18, 1 << 14), (30, 2)])
def test_alignment(spark, sample, empty, libraries, monkeypatch, frequent, group):
    """Odd texts too; also with few pairs held by tasks, and with every larger group counted by distinct tokens."""
    monkeypatch.setattr(alignment, "GROUP", group)
    odd = ["a▁b", "日本語 のテキスト 😀😀😀", "x" * 3_000, " " * 999 + "y", "tab\there  \n\n new", "<|endoftext|> <s>", "\x00 zero", "word " * 20_000]
    docs = sample.unionByName(spark.createDataFrame(list(enumerate(odd, -20)), "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = collections.Counter(map(tuple, alignment.align(docs, BYTE_VOCABULARY, PIECE_VOCABULARY, frequent).collect()))
    assert got == brute_alignment(rows, *libraries[:2])
    assert alignment.align(empty, BYTE_VOCABULARY, PIECE_VOCABULARY).count() == 0


# --- 13 URL filters ------------------------------------------------------------------------------


def as_regex(glob):
    out, i = b"", 0
    data = glob.encode()
    while i < len(data):
        c = data[i:i + 1]
        if c == b"\\" and i + 1 < len(data):
            i += 1
            out += re.escape(data[i:i + 1])
        elif c == b"*":
            out += b"(?s:.)*" if data[i + 1:i + 2] == b"*" else b"[^/]*"
            while data[i + 1:i + 2] == b"*":
                i += 1
        else:
            out += b"[^/]" if c == b"?" else re.escape(c)
        i += 1
    return re.compile(out)


def first_fit(globs, text):
    return next((n for n, g in enumerate(globs) if as_regex(g).fullmatch(text.encode())), -1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab/.*?\\é", max_size=12), min_size=1, max_size=40), st.lists(st.text("ab/.é*\n", max_size=14), min_size=1, max_size=12))
def test_globs(globs, texts):
    """Many rules share words and cross their edges."""
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert urls.Automaton(globs).first(data, offsets).tolist() == [first_fit(globs, t) for t in texts]


ODD_URLS = [
    None, "", "no scheme", "http://", "://", "a://b://c/d", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?x=/en/", "http://Éxample.net/es/é",
    "http://xexample.com/en/1", "http://com/", "http://a.com", "http://x.net/es", "http://x.net/es/", "http://evil.org/.example.com/en/", "http://my-spam.org", "http://my-spam.org/a",
    "http://a.org/b/c.exe", "http://a.org/wp-login.php", "http://a.org/x/wp-login.php", "http://u@a.com:80/en/", "http://www.example.com/EN/", "http://a.b.www.example.com/en/",
    "http://long.example.org/" + "x/" * 50_000 + "end.apk", "http://example.com\n/en/",
]


def test_urls(spark):
    rows = list(enumerate(ODD_URLS)) + [(None, "http://a.net/fr/1"), (3, "http://a.net/fr/1"), (3, "http://a.net/fr/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "glob")})
    got = collections.Counter(map(tuple, urls.judge_urls(pages, URL_RULES).collect()))
    expected = collections.Counter()
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for v, r in [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
                if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        n = first_fit([r.glob for r in URL_RULES], f".{host}{path}")
        name, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow" if n < 0 else URL_RULES[n].verdict)
        expected[(i, host, path, name, verdict, None if n < 0 else URL_RULES[n].glob)] += 1
        assert (URL_RULES[n].name if n >= 0 else None) == name
    assert got == expected
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, []).collect()} == {"allow"}


def test_texts_are_not_shuffled_for_their_bags(spark, monkeypatch):
    """A bounded table of bits leaves out texts that nobody asked for, and loses none; bags are made before the join."""
    from rxlake.llm import bag_minhash

    wanted = [-(1 << 63), -5, -1, 0, 3, (1 << 40) + 7, (1 << 63) - 1]
    ids = spark.createDataFrame([(i,) for i in wanted], "id long")
    table = bag_minhash.sieve(ids)
    others = np.arange(1_000, 2_000)
    assert bag_minhash.sifted(table, np.array(wanted)).all() and not bag_minhash.sifted(table, others).any()
    assert not bag_minhash.sieve(ids.limit(0)).any()
    plans, keep = [], bag_minhash.stored
    monkeypatch.setattr(bag_minhash, "stored", lambda df, name="table": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    texts = [(i, f"one two three four five six {i}") for i in [*wanted, -5, *others.tolist()]] + [(3 + bag_minhash.SIEVE, "same bit")]
    got = bag_minhash.bags_of(spark.createDataFrame(texts, "id long, text string"), ids).collect()
    assert sorted(r["id"] for r in got) == sorted(wanted) and all(len(r["bag"]) == 3 * 8 for r in got)
    assert -1 < plans[-1].index("Join LeftSemi") < plans[-1].index("MapInArrow")
