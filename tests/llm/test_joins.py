"""The Jaccard join, the prefix trie and collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import collocations, jaccard_join, prefix_trie
from tallyloom.llm.jaccard_join import JaccardJoin
from tallyloom.llm.near_dedup import shingles


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# ------------------------------------------------------------------ Jaccard join

def sets_of(docs, width=3):
    out = defaultdict(list)
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        out[i].append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def classes(docs, percent=90):
    sets = sets_of(docs)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                top[hi] = lo
    return {i: root(i) for i in ids}


def chains(seed, families, size, lengths=(4, 12, 40, 90, 200)):
    """Families of texts that drift apart word by word; all open with one common passage."""
    rnd, docs = random.Random(seed), []
    common = [f"c{k}" for k in range(12)]
    for _ in range(families):
        words = common + [f"w{rnd.randint(0, 500)}" for _ in range(rnd.choice(lengths))]
        for _ in range(size):
            docs.append(" ".join(words))
            for _ in range(max(1, len(words) // 90)):
                words[rnd.randrange(len(words))] = f"x{rnd.random()}"
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_linked_sets_share_a_region(seed):
    rng, config = np.random.default_rng(seed), JaccardJoin()
    for _ in range(300):
        n = int(rng.integers(9, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        drop = int(rng.integers(0, config.slack(len(x)) + 1))
        add = int(rng.integers(0, config.slack(len(x)) + 1 - drop))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            a, b = jaccard_join.regions(x, config), jaccard_join.regions(y, config)
            assert np.array_equal(x, y) or len(np.intersect1d(a, b))
            sketches = jaccard_join.level([jaccard_join.sketch(s, config).tobytes() for s in (x, y)])
            assert np.abs(sketches[0] - sketches[1]).sum() <= len(x) + len(y) - 2 * both


def test_sets_in_few_classes_still_meet():
    """All shingles in one hash class: regions of more classes take over, alike for both sets."""
    config = JaccardJoin()
    x = np.sort(np.arange(1, 41, dtype=np.uint64) << np.uint64(20))
    for drop in range(1, config.slack(40) + 1):
        a, b = jaccard_join.regions(x, config), jaccard_join.regions(x[drop:], config)
        assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("config,block,limit", [(JaccardJoin(), 1000, 1_000_000), (JaccardJoin(pivots=(2, 3), leaf=3), 5, 0), (JaccardJoin(pivots=(), leaf=3), 4, 1_000_000)])
def test_join_matches_brute_force(spark, monkeypatch, config, block, limit):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    docs = chains(4, 6, 14)
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "É one two three"), (n + 6, "é one two three"), (n + 7, docs[3][1].upper())]
    docs += [(n + 8, " ".join(f"l{k}" for k in range(30_000))), (n + 9, " ".join(f"l{k}" for k in range(300, 30_000)))]
    docs += [docs[7], docs[7], (9, "another text of a known id")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component_id string, region int")
    want = classes(docs)
    got = jaccard_join.joined(table, config, limit).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {i: sorted(map(len, s)) for i, s in sets_of(docs).items()}
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r.n_shingles)
    assert {i: sorted(s) for i, s in found.items()} == sizes


def test_windows_split_a_large_region(spark):
    """One crowded region of far-apart families: pivots and windows must keep every link."""
    rnd, docs = random.Random(8), []
    for f in range(5):
        words = [f"f{f}w{k}" for k in range(200)]
        for _ in range(30):
            docs.append(" ".join(words))
            words[rnd.randrange(200)] = f"x{rnd.random()}"
            words[rnd.randrange(200)] = f"x{rnd.random()}"
    docs = list(enumerate(docs))
    config = JaccardJoin(pivots=(4, 4, 4), leaf=4)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = jaccard_join.regions
    try:
        jaccard_join.regions = lambda values, config: np.array([1], np.uint64)  # tasks see the copy sent with the closure
        got = jaccard_join.joined(table, config).collect()
    finally:
        jaccard_join.regions = whole
    assert {r.doc_id: r.component_id for r in got} == classes(docs)


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.joined(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    got = jaccard_join.joined(spark.createDataFrame([(None, text), (None, text), (3, text), (2, text)], schema))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (0, 0), (2, 2), (3, 2)]
    with pytest.raises(ValueError):
        JaccardJoin(percent=50)
    assert shingles("A b C", 3).tolist() == shingles("a B c", 3).tolist()


# ------------------------------------------------------------------ prefix trie

def brute_trie(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(np.fmod(c, 20)), [])
        rebuilt[c] = base[:h] + mine[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                below[tuple(path[:d - 1])].add(tuple(path[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below[node]) if below[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below[node])
    out = []
    for node, who in members.items():
        at_end = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(below[node]), leaves[node], saved[node], hashlib.sha256(at_end.encode()).hexdigest()))
    return sorted(out)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talk(seed, n, odd=True):
    rnd, turns = random.Random(seed), []
    say = lambda: rnd.choice(["yes", "no way", "tell me  more\n", "Ünï code", ""])
    for c in range(n):
        for k in range(rnd.choice([1, 2, 3, 5, 8])):
            turns.append((c, k, rnd.choice(["user", "assistant"]), say()))
    if odd:
        turns += [(None, 1, "user", "nobody")] * 2 + [(-7, 0, None, None), (-7, 1, "user", None), (5, None, "user", "first"), (5, None, "user", "first"), (5, None, None, "x")]
        turns += [(c, 0, "user", "same") for c in (1000, 1001, 1021)] + [(1040, 3, "user", "a")] * 3
    return turns


@pytest.mark.parametrize("leaf", [2000, 3])
def test_trie_matches_brute_force(spark, leaf):
    turns = talk(1, 60)
    table = spark.createDataFrame([(*t, "z", 1) for t in turns], "conv_id long, turn long, role string, text string, depth string, owner int").repartition(5)
    got = prefix_trie.prefix_trie(table, prefix_trie.PrefixTrie(leaf=leaf))
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(turns)


@pytest.mark.parametrize("leaf", [2000, 20])
def test_deep_trie(spark, monkeypatch, leaf):
    """One conversation holds most turns, so the trie is deep, and spans and strings of ends are cut."""
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    monkeypatch.setattr(prefix_trie, "ENDS", 2)
    turns = [(40, k, "user", f"turn {k % 7} of {k}") for k in range(150)] + [(c, k, "user", "hello you") for c in range(41, 60) for k in range(3)]
    turns += [(c, k, "user", f"turn {k % 7} of {k}") for c in (61, 62) for k in range(120)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(table, prefix_trie.PrefixTrie(leaf=leaf))
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(turns)


def test_empty_trie(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_decomposition_of_random_trees(seed):
    rng = np.random.default_rng(seed)
    n = 200
    up = np.array([-1] + [int(rng.integers(max(0, k - (3 if seed % 2 else k)), k)) for k in range(1, n)])
    depth, size, want = np.zeros(n, np.int64), np.ones(n, np.int64), rng.integers(0, 9, (n, 2))
    own = want.copy()
    for k in range(1, n):
        depth[k] = depth[up[k]] + 1
    for k in range(n - 1, 0, -1):
        size[up[k]] += size[k]
        want[up[k]] += want[k]
    totals = np.concatenate([np.zeros((n, 2), np.int64), own], axis=1)
    mixed = rng.permutation(n)
    got = prefix_trie.decomposed(*[a[mixed] for a in (np.arange(n), depth, up, np.zeros(n, np.int64), np.zeros(n, np.int64), size, totals)])
    assert np.array_equal(got, want[mixed])


# ------------------------------------------------------------------ collocations

def brute_collocations(docs, least=10, within=50, top=2000):
    count = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        good = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in good.items():
            if any(len(h) > len(g) and 100 * b >= within * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in good.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def chatter(seed, n):
    rnd, docs = random.Random(seed), []
    vocabulary = ["a", "B", "of", "é", "new", "york", "strong", "tea", "x\x1cy", "big", "b"]
    for _ in range(n):
        parts = [rnd.choice(vocabulary + ["new york city", "strong tea", f"rare{rnd.random()}"]) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rnd.choice([0, 1, 3, 40]))]
        docs.append((rnd.choice(["en", "fr", None]), "".join(parts)))
    return docs + [("en", None), (None, ""), ("de", "..!"), ("de", "one word")]


CONFIGS = [collocations.Collocations(), collocations.Collocations(block_words=50, range_words=30), collocations.Collocations(least=2, within=80, top=5, block_words=200, range_words=10 ** 6)]


@pytest.mark.parametrize("config", CONFIGS)
def test_collocations_match_brute_force(spark, config):
    docs = chatter(3, 150)
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "lang string, text string, phrase string, n int")
    got = collocations.collocations(table, config)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(docs, config.least, config.within, config.top)


def test_collocations_of_odd_tables(spark):
    schema = "lang string, text string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], schema)).count() == 0
    long = [("en", "to be or not " * 20_000)]
    got = collocations.collocations(spark.createDataFrame(long, schema))
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(long)


@pytest.mark.parametrize("seed", range(3))
def test_transducers_unite_and_compose(seed):
    rnd = random.Random(seed)
    parts, want = [], Counter()
    for _ in range(5):
        symbols = sorted(rnd.sample([f"w{k}".encode() for k in range(30)], 12))
        grams = Counter(tuple(rnd.randrange(12) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(80))
        rows = np.array([g + (-1,) * (3 - len(g)) for g in grams])
        parts.append(collocations.Transducer.build(symbols, *collocations.summed(rows, np.array(list(grams.values())))))
        want.update({tuple(symbols[k] for k in g): n for g, n in grams.items()})
    whole = collocations.united(parts)
    rows, counts = whole.grams()
    assert {tuple(whole.symbols[k] for k in r if k >= 0): int(c) for r, c in zip(rows, counts)} == dict(want)
    asked = [list(g) for g in want] + [[b"w0", b"nowhere"], [b"zz"], [b"w0", b"w0", b"w0"]]
    assert whole.compose(asked).tolist() == [want.get(tuple(a), 0) for a in asked]
    assert sum(len(level[1]) for level in whole.levels) <= len({g[:k] for g in want for k in range(1, len(g) + 1)})


def test_score_needs_more_than_64_bits(spark):
    """2,000,000 occurrences: 10^6 a^2 is beyond 64 bits."""
    rows = spark.range(2000).select(F.lit("en").alias("lang"), F.expr("repeat('alpha beta. ', 1000)").alias("text"))
    got = [tuple(r) for r in collocations.collocations(rows).collect()]
    assert got == [("en", 1, "alpha beta", 2_000_000, 2_000_000, 2_000_000, 4_000_000, 1_000_000)]
