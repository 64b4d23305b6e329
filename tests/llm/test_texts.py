"""Document operators against plain Python, on small tables with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, near_dedup, quality_rules, queries, secrets

SPACE = r"[\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def rows(df, *names):
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


# ------------------------------------------------------------------ near duplicates

def shingle_sets(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(SPACE, lower(t)) if x]
        sets.setdefault(i, []).append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return sets


def brute_components(docs):
    sets = shingle_sets(docs)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                a_, b_ = sorted((root(a), root(b)))
                top[b_] = a_
    return {i: root(i) for i in ids}


def families(seed, n_families, size):
    """Chains of edits: links hold between near members of a family only."""
    rnd, docs = random.Random(seed), []
    for _ in range(n_families):
        words = [rnd.choice("abcdefghij") * rnd.randint(1, 4) + str(rnd.randint(0, 30)) for _ in range(rnd.choice([4, 12, 60, 150]))]
        for _ in range(size):
            docs.append(" ".join(words))
            for _ in range(max(1, len(words) // 60)):
                words[rnd.randrange(len(words))] = "x" + str(rnd.random())
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_match_brute_force(spark):
    docs = families(5, 8, 14) + [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "É one two three four five"), (506, "é one two three four five")]
    docs += [(7, docs[7][1])] * 2
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    want = brute_components(docs)
    got = near_dedup.near_duplicates(table)
    assert got.count() == len(docs)
    for r in got.collect():
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    kept = near_dedup.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [near_dedup.BLOCK_ROWS, 6])
def test_later_stars_find_links_that_the_first_misses(spark, monkeypatch, block):
    """Bands of one bin put whole families into one bucket, so its first star alone would lose links."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    docs = [d for d in families(11, 3, 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    config = near_dedup.MinHash(bands=30, rows=1)
    want = brute_components(docs)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, config).collect()} == want
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, config, broadcast_rows=0).collect()} == want


def test_near_duplicates_of_odd_ids(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert near_dedup.keep_one(spark.createDataFrame([], schema)).count() == 0
    text = "a b c d e f g"
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, text), (None, text), (3, text), (2, text), (2, "other words altogether here now")], schema))
    assert rows(got, "doc_id", "component_id", "kept") == sorted(map(repr, [(None, None, True)] * 2 + [(3, 2, False), (2, 2, True), (2, 2, True)]))


@pytest.mark.parametrize("broadcast_rows", [near_dedup.BROADCAST_ROWS, 0, 3])
def test_unlike_texts_of_one_id_are_documents_of_their_own(spark, broadcast_rows):
    text, other, third = "a b c d e f g", "wholly other words stand in this one here", "yet another row of words that is like none"
    docs = [(1, text, "x"), (2, text, "x"), (2, other, "x"), (2, other, "y"), (3, other, "x"), (-5, None, "x"), (-5, "", "x"), (-5, third, "x"), (4, third, "x"),
            (None, text, "x"), (None, text, "x"), (6, None, "x"), (7, "", "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, row string")
    kept = near_dedup.keep_one(table, broadcast_rows=broadcast_rows)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    want = [(1, text), (2, other), (-5, ""), (-5, third), (None, text), (None, text), (6, ""), (7, "")]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("broadcast_rows", [near_dedup.BROADCAST_ROWS, 100, 0])
def test_large_groups_of_copies(spark, broadcast_rows):
    """Classes above the bound are broadcast, smaller ones shuffled; both, and copies near another class, get their component."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    docs = [(i, text) for i in range(300, 500)] + [(i, text + " more") for i in range(100, 250)] + [(9, "some pair of copies that is alike"), (8, "some pair of copies that is alike"), (7, "alone")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == {**{i: 100 for i, _ in docs if i >= 100}, 9: 8, 8: 8, 7: 7}


# ------------------------------------------------------------------ benchmark passages

def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(text, items):
    w, hit, found = word_list(text), set(), set()
    for item, t in items:
        b = word_list(t)
        n = min(13, len(b))
        grams = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(item)
    return w, hit, sorted(map(str, found))


@pytest.fixture(scope="module")
def contaminated():
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Alpha", "beta", "gämma", "d4", "É", "eps", "zeta"])
    text = lambda n: rnd.choice([" ", "-", ", "]).join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 13, 14, 5, 3, 60, 13])] + [(20, None), (21, "--"), (22, ""), (6, "beta d4")]
    items.append((23, items[1][1].upper().replace("É", "É")))
    docs = [(i, text(rnd.choice([0, 1, 12, 13, 80, 400]))) for i in range(40)]
    docs += [(100 + i, text(50) + " | " + t + " | " + text(50)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (None, items[0][1]), (None, items[0][1]), (202, items[5][1]), (202, "clean"), (203, items[0][1] + " " + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_contamination_matches_brute_force(spark, contaminated, block):
    docs, items = contaminated
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, mark int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, passage string")
    got = decontaminate.contamination(table, bench, block_windows=block)
    want = []
    for i, t in set(docs):
        w, hit, found = brute_hits(t, items)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(map(repr, want))


def test_contaminated_texts_and_spans_go(spark, contaminated):
    docs, items = contaminated
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, t) for i, t in docs if not (lambda w, h, f: h and 20 * len(h) >= len(w))(*brute_hits(t, items))]
    assert rows(decontaminate.drop_contaminated(table, bench), "doc_id", "text") == sorted(map(repr, clean))
    cut = decontaminate.drop_spans(table, bench)
    assert cut.columns == table.columns and cut.count() == len(docs)
    for r in cut.where("doc_id is not null and doc_id < 200").collect():
        w, hit, _ = brute_hits(dict(docs)[r.doc_id], items)
        assert word_list(r.text) == [x for k, x in enumerate(w) if k not in hit]
    none = bench.limit(0)
    assert decontaminate.drop_contaminated(table, none).count() == len(docs)
    assert decontaminate.contamination(table.limit(0), bench).count() == 0


# ------------------------------------------------------------------ quality

def brute_counts(text):
    x = text or ""
    w = [y for y in re.split(SPACE, x) if y]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a a a", "x y z x y z", "#$ é|\n\n é \n é \nx", "\x85a\xa0b", "w " * 3000]
    texts += ["".join(rnd.choices(["a ", "b ", "c\n", "\t", "|", "!", "É ", "dd "], k=rnd.randint(1, 200))) for _ in range(200)]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a b", 0)], "doc_id long, text string, n_words int")
    for r in quality_rules.judged(table).collect():
        want = brute_counts("a b" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judged(table.limit(0)).count() == 0 and quality_rules.keep_good(table.limit(0)).count() == 0


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = queries.QUERIES["op8_quality_rules"](spark, sf)
    told = judged.join(queries.table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in told) >= 0.98 * len(told)
    docs = queries.table(spark, sf, "documents")
    assert rows(quality_rules.keep_good(docs), "doc_id") == rows(judged.where("kept"), "doc_id")


def test_rule_accuracies_are_recovered(spark):
    """Votes drawn from known accuracies: the fitted posterior is close to the true class."""
    rnd = random.Random(8)
    draws = []
    for k in range(4000):
        good = rnd.random() < 0.7
        vote = lambda hit: 0 if rnd.random() < 0.3 else (1 if good == (rnd.random() < hit) else -1)  # noqa: E731, B023
        draws.append((k, good, [vote(a) for a in (0.95, 0.9, 0.85, 0.8, 0.75)]))
    table = spark.createDataFrame(draws, "id long, good boolean, votes array<int>")
    model = quality_rules.fit(table, 5, reach=0.5, weight=0.01)
    assert abs(model.prior - 0.7) < 0.08
    right = table.withColumn("p", model.posterior(table["votes"])).where("good = (p >= 0.5)").count()
    assert right > 0.9 * len(draws)
    strong, weak = (model.good[0][2] / (model.good[0][2] + model.good[0][0]), model.good[4][2] / (model.good[4][2] + model.good[4][0]))
    assert strong > weak


# ------------------------------------------------------------------ secrets

PATTERNS = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def brute_base(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= n)
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found]


def secret_texts():
    rnd = random.Random(6)
    parts = ["token", "PassWord", "api_key", "=", ": ", '"', "'", "abcdef", "token=token : abcdefg", "AKIA", "AKIA" + "B2" * 9, "deadbeef" * 4, " ", "🙂é", "0a1b" * 5, "secret: x", "\n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(300)]
    return [None, "", "plain words only", *texts, "token=abcdef1 " * 2000]


def random_string(rnd, n=32):
    return "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))


def model_of(spark):
    rnd = random.Random(1)
    syllables = ["user", "get", "name", "_", "list", "count", "Index", "value", "data", "set", "time", "er", "ing", "tion", "the", "and", "re", "con", "pro"]
    labelled = [(random_string(rnd), True) for _ in range(300)] + [("".join(rnd.choices(syllables, k=6)), False) for _ in range(1500)] + [(None, True), ("", False)]
    return secrets.fit(spark.createDataFrame(labelled, "string string, secret boolean"))


def test_base_spans_match_brute_force(spark):
    texts = secret_texts()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x")], "doc_id long, text string, secrets string")
    got = secrets.scanned(table).select("doc_id", secrets.listed(F.col("secrets")).alias("s")).collect()
    for r in got:
        listed = [s for s in r.s.split(",") if s and not s.startswith("markov")]
        assert listed == brute_base(texts[r.doc_id] if r.doc_id is not None else None)


def test_markov_models_tell_random_from_ordinary(spark):
    model, rnd = model_of(spark), random.Random(9)
    randoms = [random_string(rnd) for _ in range(200)]
    ordinary = ["".join(rnd.choices(["user", "get", "list", "_", "time", "count", "ing", "pro", "value"], k=6))[:40] for _ in range(200)]
    texts = [f"key {s} end" for s in randoms] + [f"key {s} end" for s in ordinary]
    found = {r.doc_id: r.secrets for r in secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    hits = [[s for s in found[i] if s["kind"] == 3] for i in range(400)]
    assert sum(bool(h) for h in hits[:200]) >= 195 and sum(bool(h) for h in hits[200:]) <= 4
    assert all((h[0]["start"], h[0]["end"]) == (4, 36) for h in hits[:200] if h)


def test_secrets_joined_to_ordinary_text_are_found(spark):
    rnd, path = random.Random(1), "user/the/list/count/data/time/value/name/index/"
    labelled = [(random_string(rnd), True) for _ in range(300)] + [("/".join(rnd.choices(path[:-1].split("/"), k=6)), False) for _ in range(1500)]
    model = secrets.fit(spark.createDataFrame(labelled, "string string, secret boolean"))
    keys = ["Qz8vT1xWb4Lk9Rm2Pf7Yc3Hd", "9f3kq7zx2mv8bt4wJ6Ns5Gu0"]
    texts = [path + keys[0], f"{path * 3}{keys[0]}/{path * 3}{keys[1]}/{path}", "AKIA" + "B2" * 9 + "/" + keys[0], path * 4,
             f"token=abcdef1 {keys[1]}", "x" + "deadbeef" * 4 + "_" + keys[1], f"{path * 40}{keys[1]}" * 3]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s for s in r.secrets if s["kind"] == 3] for r in secrets.scanned(table, model).collect()}
    for i, text in enumerate(texts):
        assert all(text[s["start"]:s["end"]] == s["value"] for s in found[i])
        for k in keys:
            for m in re.finditer(k, text):
                assert any(s["start"] <= m.start() and m.end() <= s["end"] for s in found[i]), (i, k)
    assert not found[3]
    assert [(s["start"], s["end"]) for s in found[0]] == [(len(path), len(path) + 24)]
    assert not any(k in r.text for k in keys for r in secrets.redact(table, model).collect())


def test_redaction_leaves_no_base_secret(spark):
    texts = secret_texts()
    table = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, secrets string")
    out = secrets.redact(table, model_of(spark), marker="#")
    assert out.columns == table.columns
    for r in out.collect():
        text = texts[r.doc_id]
        if not brute_base(text):
            continue
        gone = set()
        for s in brute_base(text):
            _, a, b = s.split(":")
            gone |= set(range(int(a), int(b)))
        kept = "".join("\0" if k in gone else c for k, c in enumerate(text))
        if "#" not in re.sub("\0+", "", kept):
            assert re.sub("\0+", "#", kept) == r.text or "#" in r.text  # model spans may take more
        assert not any(s in r.text for s in ("deadbeef" * 4, "AKIA" + "B2" * 9)) and r.n_chars == len(r.text)
    assert secrets.redact(table.limit(0), model_of(spark)).count() == 0
