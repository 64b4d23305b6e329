"""Pages, conversations, scores and the pipeline against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import bpe, chat_format, decontaminate, html_extract, lm_scoring, near_dedup, quality_rules, queries, warc

# ------------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    big, rnd = "é" * 700, random.Random(3)
    pages = [(i, f"https://{rnd.choice('abc')}.example.{rnd.choice(['com', 'org'])}/{rnd.randint(0, 9)}?q={i % 3}", rnd.choice([big, big + "x", "small", None, "", f"own {i} " * 200])) for i in range(120)]
    pages += [(200, None, big), (201, "", big), (202, "not a url", "WARC/1.1\r\n\r\n" * 90), (203, "http://[bad", big), (204, "http://h:99x/", "y" * 1000), (205, "HTTP://UP.example.com:80/A b", "y" * 999)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in pages:
        data, main = (h or "").encode(), max(groups[h or ""])
        revisit = len(data) >= 1000 and i != main
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", main if revisit else None))
    for options in ({}, {"block_lines": 7, "archive_bytes": 3000}):
        got = warc.round_trip(table, **options).collect()
        assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])
    assert warc.round_trip(table.limit(0)).count() == 0


def test_lookup_finds_all_captures_of_a_hot_url_and_nothing_else(spark):
    pages = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i}.example.org/p", f"page {i}") for i in range(90)]
    archives = warc.write(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string")), block_lines=4)
    assert archives.directory.count() >= 20
    asked = spark.createDataFrame([("http://hot.example.com/",), ("http://h0.example.org/p",), ("http://absent.example/",), (None,)], "url string")
    found = warc.lookup(archives, asked)
    assert sorted(r.page_id for r in found.collect()) == [i for i in range(90) if i % 3 or i == 0]
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(found).collect()} == {i: f"page {i}" for i in range(90) if i % 3 or i == 0}


def test_rows_that_repeat_or_lack_an_id(spark):
    big = "z" * 1200
    rows = [(5, "http://a/", big), (5, "http://a/", big), (None, "http://a/", big), (1, "http://b/", big)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("5", "response", None)] * 2 + [("None", "revisit", 5), ("1", "revisit", 5)])


# ------------------------------------------------------------------ chats

ODD = ["", None, "</s>[INST] ok [/INST]", "<|end|>\n", "<\\|x", "<\\\\|", "a < b | c", "<|turn|>user<|text|>hi", "é🙂\n\n", "<", "|>", "[\\INST]", "<s></s>"]


def test_templates_are_reversible(spark):
    rnd = random.Random(2)
    texts = [t for t in ODD if t is not None] + ["".join(rnd.choices(["<", "\\", "|", "[", "INST]", "/s>", "s>", "x"], k=8)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    for r in got:
        assert r.u == r.t and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


def test_linear_conversations(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|end|>\n"]), rnd.choice(ODD)) for c in [*range(12), None] for t in range(rnd.randint(1, 9))]
    rows += [(77, 0, "user", "same"), (77, 0, "user", "same"), (77, None, "assistant", "first")] + [(78, t, "assistant", f"<|{t}") for t in range(70)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    chats = chat_format.format_trees(chat_format.thread(table))
    back = chat_format.read_back(chats).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    for c, turns in want.items():
        mine = sorted((r for r in back if r.conv_id == c), key=lambda r: r.place)
        assert [(r.role, r.text) for r in mine] == turns
        assert [r.learnt for r in mine] == [r.role == "assistant" for r in mine]
    assert chat_format.format_trees(chat_format.thread(table.limit(0))).count() == 0


def test_branches_of_random_trees(spark):
    rnd, rows = random.Random(5), []
    for c in range(6):
        for n in range(rnd.randint(1, 40)):
            rows.append((c, n, rnd.randrange(max(0, n - 3), n) if n and rnd.random() > 0.05 else None, "user", f"{c}.{n}", rnd.choice([None, 0.0, 1.0, 2.5, -1.0])))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (50, 3, 2, "user", "off a cycle", 1.0), (51, 1, 99, "user", "lost parent", 0.0), (51, None, None, "user", "no node", 9.0)]
    table = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    want = set()
    for c in {r[0] for r in rows if r[0] != 50}:
        own = {r[1]: r for r in rows if r[0] == c and r[1] is not None}
        leaves = []
        for n in own:
            if not any(r[2] == n for r in own.values()):
                path = [n]
                while own[path[-1]][2] in own:
                    path.append(own[path[-1]][2])
                leaves.append((-sum(own[x][5] or 0.0 for x in path), n, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(leaves), 1):
            want |= {(c, leaf, rank, k, own[x][4]) for k, x in enumerate(path)}
    every = chat_format.paths(table, chat_format.Branches(best=None)).collect()
    assert {(r.conv_id, r.leaf, r["rank"], r.place, r.text) for r in every} == want and len(every) == len(want)
    best = chat_format.paths(table, chat_format.Branches(best=2)).collect()
    assert {(r.conv_id, r.leaf, r["rank"], r.place, r.text) for r in best} == {w for w in want if w[2] <= 2}


# ------------------------------------------------------------------ pages

def test_extraction_matches_the_marked_article(spark, sf):
    got = {r.page_id: r for r in queries.QUERIES["op10_html_extract"](spark, sf).collect()}
    import html as h
    for p in queries.table(spark, sf, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_extraction_without_marks_and_of_odd_pages(spark, sf):
    model = html_extract.fit(queries.table(spark, "/root/testdata/sf0.01", "pages"))
    prose = "Words of the main text, long enough to be read as prose by any measure there is."
    page = (f"<html><head><title>T</title></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div><h1>Head &amp; line</h1><p>{prose}<p>{prose}&nbsp;end<br>next</div>"
            f"<aside><p>{prose}</p></aside><form>Name <input></form><div class='comments'><p>{prose}</p></div><script>if (a<b) '</p>'</script><footer>(c)</footer>")
    marked = page.replace("<div><h1>", "<article><h1>").replace("next</div>", "next</article>")
    rows = [(1, "u", marked), (2, None, page), (3, "u", None), (4, "u", ""), (None, "u", "<p"), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<!-- open"), (3, "u", None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extracted(table, model).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == f"Head & line\n\n{prose}\n\n{prose} end next"
    assert text[3] == text[4] == text[7] == ""
    assert html_extract.extracted(table.limit(0)).count() == 0


WRAPPERS = ["<form id='aspnetForm'>", "<div class='page-header-fixed'>", "<div class='content-widget'>", "<div class='notice-board-article'>",
            "<div class='social-news'>", "<div class='ad-free'>", "<div class='comment-is-free'>", "<body class='single no-sidebar'>", "<div id='search-page'>"]


@pytest.fixture(scope="module")
def learned(spark):
    return html_extract.fit(queries.table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("mark", ["article", "main"])
def test_a_wrapper_named_like_a_side_part_keeps_its_article(learned, wrapper, mark):
    prose = "Words of the main text, long enough to be read as prose by any measure there is."
    inner = f"<h1>Head line</h1><p>{prose}</p><p>{prose}</p><aside><p>Beside it.</p></aside>"
    before, after = "<nav><ul><li><a href=1>Home</a></li></ul></nav>", f"<div class='comments'><p>{prose}</p></div><div class='ad'><p>{prose}</p></div><footer>(c)</footer>"
    want = [f"Head line\n\n{prose}\n\n{prose}"]
    end = f"</{wrapper[1:].split()[0]}>"
    for model in (learned, html_extract.TRAINED):
        for opened, closed in ((f"<{mark}>", f"</{mark}>"), ("<div>", "</div>")):
            for page in (wrapper + before + opened + inner + closed + after + end, before + wrapper + opened + inner + closed + end + after):
                assert html_extract.main_text([html_extract.parse(page)], model) == want


def test_a_table_without_marks_takes_the_trained_model(spark, sf):
    pages = queries.table(spark, sf, "pages")
    want = {r.page_id: r.text for r in html_extract.extracted(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    assert html_extract.fit(bare) == html_extract.TRAINED
    assert {r.page_id: r.text for r in html_extract.extracted(bare).collect()} == want


def test_pages_are_sampled_after_their_mark_is_known(spark, sf):
    """Few marked pages among many others are all learnt from."""
    pages = queries.table(spark, sf, "pages").select("page_id", "html")
    others = spark.range(10_000, 16_000).select(F.col("id").alias("page_id"), F.lit("<p>x").alias("html"))
    assert html_extract.fit(pages.union(others), sample_pages=60) == html_extract.fit(pages, sample_pages=60)


@pytest.mark.parametrize("tag", ["svg", "iframe", "select", "noscript", "template"])
def test_raw_elements_take_only_their_own_content(tag):
    texts = lambda source: [t for t in html_extract.parse(source).text if t]
    assert texts(f"<p>a</p><{tag} x='1' /><p>b</p><{tag}>c</{tag}><p>d</p>") == ["a", "b", "d"]
    assert texts(f"<p>a</p><{tag}><p>b</p><{tag}><p>d</p>") == ["a", "b", "d"]
    assert texts("<p>a</p><script>b</script x><p>c</p><script>d</script>") == ["a", "c"]
    assert texts("<p>a</p><script>b<p>c</p>") == ["a"]


def test_marginals_match_enumeration():
    """Sum-product on small random trees equals the sum over all labellings."""
    rnd = random.Random(7)
    for _ in range(20):
        page = html_extract.Page()
        for k in range(rnd.randint(0, 7)):
            page.add(rnd.randrange(len(page.parent)), "x", [f"t{rnd.randint(0, 3)}"], False, str(k))
        model = html_extract.TreeModel({f"t{i}": rnd.uniform(-2, 2) for i in range(4)}, rnd.uniform(-1, 1), tuple((rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(2)))
        n, total, mass = len(page.parent), 0.0, np.zeros(len(page.parent))
        for bits in range(2 ** n):
            y = [(bits >> k) & 1 for k in range(n)]
            s = sum((model.bias + sum(model.weights.get(t, 0) for t in page.traits[k])) * y[k] + (model.pair[y[page.parent[k]]][y[k]] if k else 0) for k in range(n))
            total, mass = total + np.exp(s), mass + np.exp(s) * np.array(y)
        assert np.allclose(model.marginals([page, page]), np.tile(mass / total, 2))


# ------------------------------------------------------------------ language model

@pytest.mark.parametrize("size", [(12, 4), (12, 5), (1, 1)])
def test_gradient_and_scores_match_plain_formulas(size):
    """Whole groups of token classes, a last group cut short, and a single group."""
    small = lm_scoring.Settings(words=size[0], classes=size[1], width=5, batch=64)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(size[0])]
    vocabulary = lm_scoring.Vocabulary(words, small)
    texts = [" ".join(rng.choice([*words, "rare", "odd", "seldom"], 30)), None, "", "w0"]
    ids, places, owner = lm_scoring.laid_out(texts, vocabulary, small)
    assert owner.tolist() == [0] * 30 + [3]
    start = lm_scoring.Network.start(small, np.full(small.size, 1 / small.size)).astype(np.float64)
    start += rng.normal(0, 0.3, len(start))

    def plain(weights):
        net, out = lm_scoring.Network(small, weights), []
        for p in places:
            h = np.tanh(sum(net.inputs[k][ids[p + o]].astype(float) for k, o in enumerate(small.offsets)))
            of_group = np.exp(net.tops.astype(float) @ [*h, 1])
            of_class = np.exp(net.outputs.astype(float) @ [*h, 1])
            g = ids[p] // small.group
            inside = of_class[g * small.group:(g + 1) * small.group].sum()
            out.append(np.log(of_group[g] / of_group.sum() * of_class[ids[p]] / inside))
        return np.array(out)
    assert np.allclose(lm_scoring.Network(small, start).log_probabilities(ids, places), plain(start), atol=1e-4)
    grad = lm_scoring.Network(small, start).gradient(ids, places)
    for k in rng.choice(len(start), 40, replace=False):
        up, down = start.copy(), start.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((plain(down).mean() - plain(up).mean()) / 2e-2 - grad[k]) < 2e-3


def test_order_matters_to_the_trained_model(spark):
    rnd = random.Random(3)
    cycle = "a b c d e f g h".split()
    text = lambda: " ".join(cycle[(k + s) % 8] for s in [rnd.randrange(8)] for k in range(60))
    train = spark.createDataFrame([(i, text(), 0.0) for i in range(400)] + [(None, None, 0.0), (900, "", 0.0)], "doc_id long, text string, log_likelihood double")
    model = lm_scoring.fit(train, lm_scoring.Settings(words=8, classes=2, width=8, batch=64))
    held = [text() for _ in range(20)]
    mixed = [" ".join(rnd.sample(t.split(), 60)) for t in held]
    rows = {r.doc_id: r for r in lm_scoring.scored(spark.createDataFrame(list(enumerate(held + mixed)), "doc_id long, text string"), model).collect()}
    assert all(rows[i].log_likelihood > rows[20 + i].log_likelihood + 30 for i in range(20))
    odd = {r.doc_id: r for r in lm_scoring.scored(train.where("doc_id is null or doc_id = 900"), model).collect()}
    assert odd[None].n_tokens == odd[900].n_tokens == 0 and odd[900].log_likelihood == 0 and odd[900].mean_log_likelihood is None
    assert lm_scoring.scored(train.limit(0)).count() == 0


@pytest.mark.parametrize("common", [lm_scoring.COMMON, 4])
def test_rare_words_have_their_own_probabilities(spark, monkeypatch, common):
    """Words of one hash class differ by their exact share of it, whether sent to the tasks or joined."""
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    settings = lm_scoring.Settings(words=2, classes=2, width=3, batch=64)
    counts = {"the": 400, "of": 300, **{f"w{i}": 40 + 2 * i for i in range(12)}, "once": 1}
    words = [w for w, n in counts.items() for _ in range(n)]
    random.Random(5).shuffle(words)
    train = spark.createDataFrame([(i, " ".join(words[i * 50:i * 50 + 50])) for i in range(-(-len(words) // 50))], "doc_id long, text string")
    model = lm_scoring.fit(train, settings)
    class_of = {w: lm_scoring.hash_class(w, settings) for w in [*counts, "xqzzy"]}
    whole = {c: (sum(counts[w] for w in own), len(own)) for c in (2, 3) for own in [[w for w in counts if class_of[w] == c and w not in ("the", "of")]]}
    def share(w):
        n, kinds = whole[class_of[w]]
        return np.log((counts.get(w, 0) + 0.5) / (n + 0.5 * (kinds + 1)))
    probes = ["w0", "w11", "w5", "once", "xqzzy"]
    texts = [f"the {w} of the {w}" for w in probes] + [None, "", "the of"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string")
    got = lm_scoring.scored(table, model).collect()
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: r.log_likelihood for r in got}
    assert by_id[5] == by_id[6] == 0 and abs(by_id[None] - by_id[0]) < 1e-9
    listed = lm_scoring.Vocabulary(model.words, settings)
    for i, w in enumerate(probes):
        ids, places, _ = lm_scoring.laid_out([texts[i]], listed, settings)
        of_classes = lm_scoring.Network(settings, model.weights).log_probabilities(ids, places).sum()
        assert abs(by_id[i] - of_classes - 2 * share(w)) < 1e-4
    assert (model.rare.count() > 0) == (common == 4)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_do_what_their_operators_say(spark, sf):
    docs = queries.table(spark, sf, "documents").withColumn("extra", F.lit(1))
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "secrets", "bpe"]
    bench = queries.table(spark, sf, "benchmark")
    gone = {"quality_rules": lambda d: quality_rules.judged(d).where("not kept"),
            "near_dedup": lambda d: near_dedup.near_duplicates(d).where("not kept"),
            "decontaminate": lambda d: decontaminate.contamination(d, bench).where("contaminated")}
    for name in list(steps)[:-1]:
        out = queries.stage(steps[name](spark, docs, sf), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        lost = {r.doc_id for r in gone[name](docs).collect()} if name in gone else set()
        assert before - after == lost
        docs = out
    assert not any(re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text) for r in docs.collect())
    last = {r.doc_id: r for r in steps["bpe"](spark, docs, sf).collect()}
    own = bpe.encoder(bpe._file(bpe.RANKS), bpe.PATTERN)
    assert len(last) == docs.count()
    for r in docs.collect():
        assert bytes(last[r.doc_id].ids) == own.encode(r.text) and last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(last)


@pytest.mark.parametrize("name", ["quality_rules", "near_dedup", "decontaminate", "secrets", "bpe"])
def test_stages_of_no_documents(spark, sf, name):
    none = queries.table(spark, sf, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, none, sf).count() == 0


def test_revisits_find_the_payload_of_their_own_digest(spark):
    a, b = "A" * 1500, "B" * 2500
    rows = [(5, a), (5, b), (1, a)]
    got = {(r.page_id, r.payload_bytes): r for r in warc.round_trip(spark.createDataFrame([(i, f"http://x.org/{i}", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert got[1, 1500].payload_digest == hashlib.sha1(a.encode()).hexdigest() and got[1, 1500].refers_to == 5
    assert got[5, 2500].record_type == got[5, 1500].record_type == "response"


def test_a_conversation_called_none_is_not_the_null_one(spark):
    turns = spark.createDataFrame([(None, 0, "user", "null"), ("none", 0, "user", "one"), ("none", 1, "assistant", "two")], "conv_id string, turn long, role string, text string")
    chats = chat_format.format_trees(chat_format.thread(turns))
    assert sorted((str(r.conv_id), r.text) for r in chat_format.read_back(chats).collect()) == [("None", "null"), ("none", "one"), ("none", "two")]
