"""Winnowing, collocations and divergence on edge cases and against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortwell.llm import arrow, collocations, divergence, fm_index, sieve, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("x"), "size": F.lit(1), "n": F.lit(2), "item": F.lit("y"), "hash": F.lit(3), "rank": F.lit(0), "term": F.lit("t"), "p": F.lit(1)}).repartition(3)


# sieve and spans


def test_sieve_lets_members_through(spark):
    rng = np.random.default_rng(1)
    members, others = rng.integers(-(1 << 63), 1 << 63, 2000), rng.integers(-(1 << 63), 1 << 63, 20000)
    df = spark.createDataFrame([(int(h),) for h in members] + [(None,)], "h long")
    for most in (64, 1 << 12, 1 << 26):
        bits = sieve.sieve(df, 2000, most)
        assert len(bits) * 64 <= most
        assert sieve.passes(bits, members.view(np.uint64)).all()
    assert sieve.passes(bits, others.view(np.uint64)).mean() < 0.05
    assert not sieve.passes(sieve.sieve(df.where("h IS NULL"), 0), others.view(np.uint64)).any()


def test_spans_are_the_whole():
    data = b"ab cd  efg " * 50 + b"x" * 300 + b" end"
    for size in (1, 7, 100, 10000):
        assert b"".join(arrow.spans(data, re.compile(rb" "), size)) == data
    assert list(arrow.spans(b"", re.compile(rb" "))) == [b""]
    assert max(map(len, arrow.spans(b"ab " * 1000, re.compile(rb" "), 30))) <= 33


# 11


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[s : s + m])].add(item or "")
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w = plain_words(text)
        hit, met = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s : s + m])):
                    hit |= set(range(s, s + m))
                    met |= found
        yield doc_id, len(w), len(hit), sorted(met)


def test_every_window_keeps_its_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        h = rng.integers(0, 20, rng.integers(0, 40)).astype(np.uint64)
        want = {max(j for j in range(i, i + 6) if h[j] == h[i : i + 6].min()) for i in range(len(h) - 5)}
        assert set(winnowing.winnow(h, 6).tolist()) == want


def test_contamination_is_that_of_all_windows(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé", "E5", "f"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(str(k), text(rng.choice([10, 12, 25]))) for k in range(12)] + [("s", "zz yy"), ("one", "q"), ("five", "v w x y z"), (None, text(15)), ("empty", ""), ("null", None), ("0", text(11))]
    docs = [(k, text(rng.randrange(60)), "en", "a", 0) for k in range(40)]
    docs += [(100 + k, text(9) + " " + items[k % 12][1].upper() + " tail zz, YY q " + items[15][1], "en", "a", 0) for k in range(20)]
    docs += [(200, None, None, None, None), (200, None, None, None, None), (201, "", "en", "a", 0), (None, items[0][1], "en", "a", 0), (None, items[1][1] * 3, "en", "a", 0), (203, "v w x y z, q", "en", "a", 0), (204, items[0][1] * 400, "en", "a", 0)]
    docs += [(205, "".join(text(20) + rng.choice(items[:12])[1] + " " for _ in range(26000)), "en", "a", 0)]  # read in spans
    assert len(docs[-1][1]) > arrow.SLICE_BYTES
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r[0], r[1], r[2], tuple(r.items), r.contaminated): 0 for r in winnowing.contamination(odd(spark, docs), bench).collect()}
    want = {(d, n, hit, tuple(met), hit > 0) for d, n, hit, met in plain_contamination([d[:2] for d in docs], items)}
    assert set(got) == want
    assert winnowing.contamination(odd(spark, docs), bench).count() == len(docs)


def test_contamination_without_broadcast_or_sieve(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "LOOKUP_ROWS", -1)
    monkeypatch.setattr(winnowing, "sieve", lambda h, n: np.full(1, (1 << 64) - 1, np.uint64))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = odd(spark, [(1, "zero one two three four five six seven eight nine ten twelve", "en", "a", 0), (2, "one two three four five six seven eight nine, none", "en", "a", 0)])
    assert sorted(tuple(r)[:4] for r in winnowing.contamination(docs, bench).collect()) == [(1, 12, 10, 1), (2, 10, 0, 0)]


def test_contamination_of_nothing(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contamination(none, bench).count() == 0
    docs = odd(spark, [(1, "a b", "en", "a", 0)])
    assert [tuple(r) for r in winnowing.contamination(docs, bench).collect()] == [(1, 2, 0, 0, [], False)]


# 12


def test_intervals_are_all_patterns():
    rng = np.random.default_rng(4)
    for n, v in ((1, 2), (40, 3), (300, 6), (500, 60)):
        ids = np.concatenate([[0], rng.integers(0, v, n), [0]])
        s = ids.tolist()
        for size, found in enumerate(fm_index.patterns(ids, v, 4), 1):
            want = Counter(tuple(s[i : i + size]) for i in range(len(s) - size + 1) if 0 not in s[i : i + size])
            assert dict(zip(map(tuple, found.words.tolist()), found.size.tolist(), strict=True)) == want


def plain_collocations(docs, least=30, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[s : s + m]) for s in range(len(w) - m + 1))
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], a)
        rows = []
        for p, a in cands.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, lf, rf = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lf, rf))
        for rank, (score, a, p, lf, rf) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, p.decode(), -a, lf, rf, n[lang], -score


def made_texts(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "of", "new", "york", "é", "z\x00", "x y", " ", *[f"w{k}" for k in range(30)]]
    for k in range(n):
        words = [rng.choice(vocab[:6] if rng.random() < 0.7 else vocab) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n"]) for _ in range(rng.randrange(80))]
        yield k, "".join(words), rng.choice(["en", "de", None, ""]), "a", 0


@pytest.mark.parametrize("shard_words", [5, 1 << 20])
def test_collocations_are_those_of_plain_counts(spark, shard_words):
    docs = [*made_texts(5, 150), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " .\n,", "fr", "a", 0), (4, "New York " * 3000, "en", "a", 0), (4, "a b c d e. " * 40, "fr", "a", 0), (4, "a b c d e. " * 40, "fr", "a", 0)]
    got = collocations.collocations(odd(spark, docs), top=40, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_collocations([d[1:3] for d in docs], top=40))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(odd(spark, [(1, None, "en", "a", 0), (2, "rare words", "en", "a", 0)])).count() == 0


def test_scores_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    big = 9 * 10**14
    grams = [("en", "a", 1, 3 * big + 1), ("en", "b", 1, 3 * big), ("en", "a b", 2, 2 * big + 1)]
    made = spark.createDataFrame(grams, "lang string, phrase string, size int, n long"), spark.createDataFrame([("en", 7 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: made)
    row = collocations.collocations(None).collect()[0]
    assert row.score == 2000000 * (2 * big + 1) // (6 * big + 1) and row.a == 2 * big + 1


# 13


def plain_divergence(docs):
    kept, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(w)
        kept[lang].update(set(w))
    share = lambda n, total: 1 + 10**9 * (n + 1) // total
    gap = lambda p, q: (p - q) ** 2 // q
    for lang, source in groups:
        terms = [t for t, n in kept[lang].items() if n >= 3]
        of = {s: counts[lang, s] for g, s in groups if g == lang}
        total = {s: sum(c[t] for t in terms) + len(terms) for s, c in of.items()}
        pairs = [(-sum(gap(share(of[source][t], total[source]), share(c[t], total[s])) for t in terms), s.encode()) for s, c in of.items() if s != source]
        for rank, (v, s) in enumerate(sorted(pairs), 1):
            yield lang, source, "pair", s.decode(), -v, rank
        found = []
        for t in terms:
            p, q = share(of[source][t], total[source]), share(sum(c[t] for c in of.values()), sum(total.values()) - (len(of) - 1) * len(terms))
            if of[source][t] and p > q:
                found.append((-gap(p, q), t.encode()))
        for rank, (v, t) in enumerate(sorted(found)[:200], 1):
            yield lang, source, "term", t.decode(), -v, rank


def test_divergence_is_that_of_the_grid(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("", "é", "Ü", "xy", "qrs", "日")]
    docs = []
    for k in range(300):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", "é", None, ""])
        words = [rng.choice(vocab[: 20 + 10 * (k % 5)]) + rng.choice([" ", "1", "-", "\n"]) for _ in range(rng.randrange(60))]
        docs.append((k, "".join(words), rng.choice(["en", "en", "de", None]), source, 0))
    docs += [(1, None, "xx", "a", 0), (1, None, "xx", "b", 0), (2, "the the the", "yy", "a", 0), (3, "", "en", "none", 0), (3, "Lone words", "zz", "a", 0), (4, "a " * 20000, "en", "s1", 0), (4, "a " * 20000, "en", "s1", 0)]
    want = sorted(plain_divergence([d[1:4] for d in docs]))
    got = divergence.divergence(odd(spark, docs))
    assert sorted(map(tuple, got.collect())) == want and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    monkeypatch.setattr(divergence, "LOOKUP_ROWS", -1)
    assert sorted(map(tuple, divergence.divergence(odd(spark, docs)).collect())) == want


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_tree_shares_paths():
    rows = sorted(tuple(sorted({random.Random(s).randrange(4): 1 + random.Random(s + k).randrange(2) for k in range(3)}.items())) for s in range(60))
    rows = [tuple((g, n) for g, n in r) for r in rows]
    want = Counter(r[: d + 1] for r in rows for d in range(len(r)))
    flat = [c for r in rows for c in r]
    lengths = np.array([len(r) for r in rows])
    cell, depth, times = divergence.tree_nodes(np.array([c[0] for c in flat]), np.array([c[1] for c in flat]), lengths, np.ones(len(rows), np.int64))
    start, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(rows)), lengths)
    got = {rows[row[c]][: d + 1]: t for c, d, t in zip(cell.tolist(), depth.tolist(), times.tolist(), strict=True)}
    assert len(cell) == len(want) and got == want and (start[row[cell]] + depth == cell).all()
