"""Operators 11 to 13 against plain models, on odd rows, and on empty and clashing tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sightings.llm import divergence, phrases, sketch, substrings, wording

from .conftest import DOCUMENTS, clashing, odd_rows, prose, rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- hashes and sketches -----------------------------------------------------------------------

def test_window_hashes_tell_windows_apart():
    h = wording.Lexicon().hashes([f"w{k % 7}".encode() for k in range(500)])
    got = wording.window_hashes(h, 5)
    words = [tuple((k + i) % 7 for i in range(5)) for k in range(496)]
    assert len(set(got.tolist())) == len(set(words)) == len(set(zip(got.tolist(), words)))
    swapped = h[:5].copy()
    swapped[[1, 3]] = swapped[[3, 1]]
    assert wording.window_hashes(swapped, 5)[0] != got[0]
    assert len(wording.window_hashes(h[:4], 5)) == 0


def test_hashed_words_are_those_of_split(monkeypatch):
    """Words get one hash wherever they stand: over stretches, and where they are long."""
    texts = [(r[1] or "").encode() for r in odd_rows()] + [b"", b" a ", b"a\x0bb\x0ca\rb\na", b"y" * 70 + b" " + b"y" * 71]
    for stretch in (1 << 20, 1000):
        monkeypatch.setattr(wording, "_STRETCH", stretch)
        wording._byte_tables.cache_clear()
        h, sizes = wording.hashed_words(texts)
        words = [w for t in texts for w in t.split()]
        assert sizes.tolist() == [len(t.split()) for t in texts]
        assert len(h) == len(words) and len(set(zip(h.tolist(), words))) == len(set(words)) == len(set(h.tolist()))
    wording._byte_tables.cache_clear()


@pytest.mark.parametrize("threshold,bits", [(2, 16), (30, 16), (2, 20)])
def test_sketch_misses_nothing(spark, threshold, bits):
    """Counts spread over many tasks; a sketch of 2**16 cells is far too small and still loses none."""
    rng = np.random.default_rng(4)
    items = rng.integers(0, 60_000, 200_000)
    many = {k for k, n in Counter(items.tolist()).items() if n >= threshold}
    df = spark.createDataFrame([(int(x),) for x in items], "x long").repartition(7)
    plan = sketch.Plan(bits, 2, threshold)

    def hashed(batches):
        for b in batches:
            yield wording.mixed(b.column(0).to_numpy().astype(np.uint64))

    lookup = sketch.Lookup(sketch.build(df, hashed, plan), plan)
    known = np.unique(items)
    reach = lookup.may_reach(wording.mixed(known.astype(np.uint64)))
    assert many <= set(known[reach].tolist())
    if bits == 20:
        assert reach.sum() < len(many) + 0.2 * len(known)
        assert lookup.may_reach(wording.mixed(np.arange(10**6, 10**6 + 1000, dtype=np.uint64))).sum() < 150


# -- 11: divergence ------------------------------------------------------------------------------

def plain_divergence(rows, least, top):
    groups, df, n, whole = set(), Counter(), Counter(), Counter()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(UPPER))
        for t in found:
            n[lang, source, t] += 1
            whole[lang, t] += 1
        for t in set(found):
            df[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= least]
        over = lambda counts: sum(counts) + 5 * len(kept)
        share = lambda c, total: 1 + 10**9 * (c + 5) // total
        all_q = {t: share(whole[lang, t], over([whole[lang, x] for x in kept])) for t in kept}
        p = {}
        for s in (s for x, s in groups if x == lang):
            total = over([n[lang, s, t] for t in kept])
            p[s] = {t: share(n[lang, s, t], total) for t in kept}
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            marks = [(all_q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > all_q[t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(marks)[:top])]
    return sorted(out, key=repr)


def divergence_rows():
    rng = random.Random(5)
    vocabulary = [f"Wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["é", "日本語", "don't", "x1y"]
    rows = []
    for k in range(400):
        s = rng.choice(["a", "a", "a", "b", "ä", "\U0001f600", None])
        lang = rng.choice(["en", "en", None])
        words = [vocabulary[min(63, int(rng.expovariate(0.1 if s == "a" else 0.05)))] for _ in range(rng.randint(0, 30))]
        rows.append((k, rng.choice([" ", ".", "7", "\x1f"]).join(words), lang, s, 0))
    return [*rows, (900, "zzz", "de", "only", 0), (901, None, "fr", "p", 0), (902, "", "fr", "q", 0), *rows[:40]]


@pytest.mark.parametrize("tile", [512, 2])
def test_divergence(spark, odd, none, tile, monkeypatch):
    monkeypatch.setattr(divergence, "_TILE", tile)
    monkeypatch.setattr(divergence, "_HELD_SHARES", 512 if tile == 512 else 32)
    rows = divergence_rows()
    df = clashing(spark.createDataFrame(rows, DOCUMENTS).repartition(6))
    got = divergence.divergence(df, most_terms=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == plain_divergence(rows, 30, 7)
    assert rows_of(divergence.divergence(odd, min_documents=2)) == plain_divergence(odd_rows(), 2, 50)
    assert rows_of(divergence.divergence(none)) == []


def test_shares_beyond_64_bits():
    n = np.array([0, 7, 10**13], np.int64)
    over = 10**13 + 400
    want = [1 + 10**9 * (x + 5) // over for x in n.tolist()]
    assert divergence._shares(n, over, 5).tolist() == want


# -- 12: repeated substrings ---------------------------------------------------------------------

def plain_removals(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = {}
    for r, w in zip(rows, words):
        if r[0] is not None:
            for i in range(len(w) - width + 1):
                gram = tuple(w[i : i + width])
                least[gram] = min(least.get(gram, r[0]), r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            first = least.get(tuple(w[i : i + width]))
            if first is not None and (r[0] is None or first < r[0]):
                gone.update(range(i, i + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), kept))
    return sorted(out, key=repr)


def repeating_rows():
    passage, other = prose(70, 55), prose(71, 14)
    rows = [(k, f"{prose(100 + k, 40)} {passage} {prose(300 + k, 20 + k % 7)}", "en", "a", 0) for k in range(60)]
    rows += [(100 + k, f"{other} {prose(500 + k, 9)}\n{other}\t{other}", "en", "a", 0) for k in range(30)]
    rows += [(200 + k, " ".join(passage.split()[: 10 + k]), "en", "b", 0) for k in range(8)]  # 10 to 17 words
    rows += [(300 + k, " ".join(passage.split()[k : k + 13]), "en", "b", 0) for k in range(40)]  # runs that overlap
    rows += [(400, prose(400, 50) + " " + prose(400, 50), "en", "c", 0)]  # repeats within itself alone
    return [*rows, (5, passage, "en", "a", 0), (None, passage, "en", "a", 0), (None, prose(9999, 30), None, None, 0)]


@pytest.mark.parametrize("bits,words", [(28, 1 << 20), (16, 1 << 20), (28, 100)])
def test_repeated_substrings(spark, odd, none, bits, words, monkeypatch):
    """The same with a sketch that is too small, and with chunks of a document or two."""
    monkeypatch.setattr(wording.chunks, "__defaults__", (words,))
    rows = repeating_rows()
    df = clashing(spark.createDataFrame(rows, DOCUMENTS).repartition(5))
    got = substrings.without_repeats(df, most_bits=bits)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert rows_of(got) == plain_removals(rows)
    assert rows_of(substrings.without_repeats(odd, most_bits=bits)) == plain_removals(odd_rows())
    assert rows_of(substrings.without_repeats(none)) == []


# -- 13: collocations ----------------------------------------------------------------------------

def plain_phrases(rows, least=30, most=2000):
    out, by_lang = [], {}
    for r in rows:
        found = re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(UPPER))
        by_lang.setdefault("und" if r[2] is None else r[2], []).extend(re.findall(r"[^\x20\x09]+", p) for p in found)
    for lang, found in by_lang.items():
        f = Counter(tuple(w[i : i + k]) for w in found for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        n = sum(map(len, found))
        several = [p for p in f if len(p) > 1 and f[p] >= least]
        held = {}
        for p in several:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held.get(p[i : i + k], 0), f[p])
        best = []
        for p in several:
            if 100 * held.get(p, 0) >= 80 * f[p]:
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -f[p], " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        best.sort()
        out += [(lang, i + 1, t, -a, x, y, n, -s) for i, (s, a, _, t, x, y) in enumerate(best[:most])]
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(6)
    words = [f"{c}{d}" for c in "aBéx日" for d in "123456"]
    fixed = ["new york city hall", "per se", "Per SE", "a1 a1 a1 a1 a1", "old\tyork city", "x\x1cy z"]
    rows = []
    for k in range(900):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words[:12] if k % 3 else words) for _ in range(rng.randint(0, 25))]
        rows.append((k, "".join(p + rng.choice([" ", " ", "  ", " ", ".", ", ", "\n", "\r\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "de", None]), "a", 0))
    return [*rows, (None, None, None, None, None), (1, "", "fr", None, 0), *rows[:30]]


@pytest.mark.parametrize("words", [1 << 20, 300])
def test_collocations(spark, odd, none, words, monkeypatch):
    monkeypatch.setattr(wording.chunks, "__defaults__", (words,))
    rows = phrase_rows()
    df = clashing(spark.createDataFrame(rows, DOCUMENTS).repartition(5))
    want = plain_phrases(rows)
    got = phrases.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 20 and rows_of(got) == want
    assert rows_of(phrases.collocations(df, most=5)) == plain_phrases(rows, most=5)
    assert rows_of(phrases.collocations(odd, min_count=2)) == plain_phrases(odd_rows(), least=2)
    assert rows_of(phrases.collocations(none)) == []


def test_a_sketch_too_small_changes_no_phrase(spark, monkeypatch):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    monkeypatch.setattr(sketch.Lookup, "may_reach", lambda self, h: np.ones(len(h), bool))
    assert rows_of(phrases.collocations(df)) == plain_phrases(rows)


def test_digests_of_the_query(spark):
    """The query's digest is that of the kept text."""
    from sightings.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in plain_removals(rows)]
    assert rows_of(QUERIES["op12_repeated_substrings"](spark, sf)) == sorted(want, key=repr)
