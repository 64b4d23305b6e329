"""BPE against the tiktoken library, whole texts at once; token counts against a plain count."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tallyloom.llm import bpe, queries, token_counts


@pytest.fixture(scope="module")
def library():
    with open(bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def odd_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["'", "r", "e", "l", "s", " ", " ", "\n", "\t", "a", "é", "1", "!", "　", "🙂", "'ll", "<|endoftext|>"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 120))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_whole_text(spark, library):
    texts = odd_texts(1, 300) + [None, "", "x" + " " * 3000 + "y", "'s" * 2000, "\n" * 500 + "a" * 3000, " a" * 2000, "ab" * 3000]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash")] * 2 + [(999, " a" * 2000, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for chunk, overlap in ((32, 8), (100, 50), (bpe.CHUNK, bpe.OVERLAP)):
        got = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), packed(library, t)) for i, t, _ in rows)
        assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t, _ in rows)


def test_long_runs_take_the_merges_of_the_library(library):
    own = bpe.encoder(bpe._file(bpe.RANKS), bpe.PATTERN)
    for text in ("ab" * 5000, "a" * 4097, "é" * 999, "thetheandion" * 300):
        assert own.encode(text) == packed(library, text)


def test_query(spark, sf, library):
    docs = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op2_bpe"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = packed(library, d.text)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert token_counts.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_histogram_query(spark, sf, library):
    lengths = sorted(len(library.encode_ordinary(r.text or "")) for r in queries.table(spark, sf, "documents").collect())
    rows = queries.QUERIES["op4_token_counts"](spark, sf).orderBy("n_tokens").collect()
    check_histogram(rows, lengths)


def check_histogram(rows, lengths):
    assert [r.n_tokens for r in rows] == sorted(set(lengths))
    for r in rows:
        longer = [x for x in lengths if x > r.n_tokens]
        assert (r.n_docs, r.tokens) == (lengths.count(r.n_tokens), lengths.count(r.n_tokens) * r.n_tokens)
        assert (r.docs_longer, r.tokens_longer, r.docs_within) == (len(longer), sum(longer), len(lengths) - len(longer))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.total_docs, r.total_tokens, r.share_within) == (len(lengths), sum(lengths), r.docs_within / len(lengths))


def test_limits_and_quantiles(spark):
    rnd = random.Random(3)
    lengths = [rnd.choice([0, 3, 5, 5, 9, 40, 41, 300, 5000, 9000]) for _ in range(400)]
    table = spark.createDataFrame([(x, "extra") for x in lengths] + [(None, "x")], "n_tokens long, block string")
    histogram = token_counts.length_histogram(table, block=16)
    check_histogram(histogram.orderBy("n_tokens").collect(), lengths)
    limits = [0, 1, 4, 5, 100, 4999, 10_000]
    asked = spark.createDataFrame([(x,) for x in [*limits, 5, None]], "context_limit long")
    got = {r.context_limit: r for r in token_counts.at_limits(histogram, asked).collect()}
    for x in limits:
        inside = [y for y in lengths if y <= x]
        assert (got[x].docs_within, got[x].tokens_within, got[x].truncated_tokens) == (len(inside), sum(inside), sum(min(x, y) for y in lengths))
    assert got[None].docs_within is None and got[None].truncated_tokens is None
    for r in token_counts.quantiles(histogram, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    below = token_counts.length_histogram(spark.createDataFrame([(7,), (9,)], "n_tokens long"))
    one = token_counts.at_limits(below, spark.createDataFrame([(5,)], "context_limit long")).first()
    assert (one.docs_within, one.tokens_within, one.truncated_tokens) == (0, 0, 10)


def test_memo_generations_lose_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_TOKENS", 4)
    own = bpe.Encoder(bpe._file(bpe.RANKS), bpe.PATTERN)
    for text in odd_texts(5, 200) + ["a b c d e f g h a b c", "x" * 100]:
        assert own.encode(text) == packed(library, text)
        assert len(own) <= 4 and len(own.before) <= 4


def test_given_tables_hold_chunked_texts(spark):
    """Texts of the dealt method's own path: longer than one chunk."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    assert docs.where(f"length(text) > {bpe.CHUNK + bpe.OVERLAP}").count() > 0


def test_histogram_encodes_each_text_once(spark, sf):
    """The histogram's plan reads staged counts only."""
    plan = queries.QUERIES["op4_token_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
