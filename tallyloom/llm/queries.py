"""Registered queries of the training-data operators, one thin query each, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import bpe, chat_format, collocations, decontaminate, html_extract, jaccard_join, lm_scoring, near_dedup, prefix_trie, quality_rules, secrets, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP1_SQL = r"""with
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct item_id, least(13, len(w)) as n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
        lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) as p from b where len(w) > 0),
k as (select distinct n from g),
x as (select d.doc_id, k.n, unnest(range(1, len(d.w) - k.n + 2)) as i, d.w from d, k where len(d.w) >= k.n),
h as (select x.doc_id, x.i, x.n, g.item_id from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as p from x) x
        join g on x.p = g.p and x.n = g.n),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(t, ',' order by t) as ids
      from (select distinct doc_id, cast(item_id as varchar) as t from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items,
  sha256(coalesce(m.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join c on d.doc_id = c.doc_id left join m on d.doc_id = m.doc_id"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the bytes they decode to."""
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


OP3_SQL = """with p as (select page_id, encode(coalesce(html, '')) as b from pages),
g as (select b, max(page_id) as main from p where octet_length(b) >= 1000 group by b)
select p.page_id, cast(octet_length(p.b) as bigint) as payload_bytes, sha1(p.b) as payload_digest,
  case when g.main <> p.page_id then 'revisit' else 'response' end as record_type, case when g.main <> p.page_id then g.main end as refers_to
from p left join g on p.b = g.b"""


@query("op3_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, looked up in the capture index and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of the documents' encoded lengths, with suffix sums."""
    lengths = bpe.encode(table(spark, sf_dir, "documents")).select((F.octet_length("ids") / 4).alias("n_tokens"))
    return token_counts.length_histogram(lengths)


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of all documents under a network trained on all of them."""
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


OP6_SQL = r"""with
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + 24 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id"""


@query("op6_chat_format", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                              F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    chats = stage(chat_format.format_trees(chat_format.thread(turns)), "chats")
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"))))
    learnt = F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct("place", F.col("text").alias("t")))))
    joined = lambda a: F.array_join(F.transform(a, lambda r: r["t"]), "")  # noqa: E731
    back = chat_format.read_back(chats).groupBy("conv_id").agg(F.count("*").alias("n_turns"), joined(rows).alias("turns"), joined(learnt).alias("loss"))
    sizes = chats.select(F.col("conv_id").alias("c"), F.length("text").cast("long").alias("formatted_chars"))
    return back.join(sizes, F.expr("conv_id <=> c")).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    base = lambda s: F.filter(s, lambda x: x["kind"] < len(secrets.BASE))  # noqa: E731
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")  # noqa: E731
    return secrets.scanned(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base("secrets")), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and learned verdict of all documents."""
    return quality_rules.judged(table(spark, sf_dir, "documents"))


OP9_SQL = r"""with recursive
t as (select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from t),
n as (select t.doc_id, count(s.g) as n from t left join s on t.doc_id = s.doc_id group by t.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * p.c >= 75 * (x.n + y.n - p.c)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as a, doc_id as r from t union select b.b, r.r from reach r join both_ways b on r.a = b.a)
select n.doc_id, n.n as n_shingles, min(r.r) as component_id, n.doc_id = min(r.r) as kept
from n join reach r on n.doc_id = r.a group by n.doc_id, n.n"""


@query("op9_near_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_html_extract")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


OP11_SQL = OP9_SQL.replace("len(w) < 5", "len(w) < 3").replace("len(w) - 3)", "len(w) - 1)").replace("w[i:i + 4]", "w[i:i + 2]").replace("* p.c >= 75 *", "* p.c >= 90 *").replace(
    "select n.doc_id, n.n as n_shingles, min(r.r) as component_id, n.doc_id = min(r.r) as kept", "select n.doc_id, n.n as n_shingles, min(r.r) as component_id")


@query("op11_jaccard_join", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that links of nine tenths of their 3-word shingles connect."""
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


OP12_SQL = r"""with
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as r, role, text from t),
c as (select conv_id, count(*) as n, conv_id - conv_id % 20 as base, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), lambda acc, b:
        list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda u, z: case when u & 1 = 1 then xor(u >> 1, 3988292384) else u >> 1 end)),
        4294967295::bigint) % 4 as h from o group by conv_id),
d as (select c.*, least(c.h, coalesce(b.n, 0)) as taken from c left join c b on c.base = b.conv_id),
p as (select d.conv_id, o.r + 1 as depth, o.role, o.text from d join o on o.conv_id = d.base and o.r < d.taken
  union all select d.conv_id, o.r - d.h + d.taken + 1, o.role, o.text from d join o on o.conv_id = d.conv_id and o.r >= d.h),
q as (select conv_id, depth, len(regexp_extract_all(text, '[^ 	-]+')) as words,
        string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by depth) over (partition by conv_id order by depth) as k from p
  union all select conv_id, 0, 0, '' from d),
l as (select conv_id, max(depth) as length from q group by conv_id),
n as (select depth, k, min(conv_id) as conv, count(*) as n_convs, max(words) as words from q group by all),
m as (select n.*, a.conv as parent from n left join q on q.conv_id = n.conv and q.depth = n.depth - 1 left join n a on a.depth = q.depth and a.k = q.k),
h as (select parent, depth - 1 as depth, count(*) as n_children from m where depth > 0 group by all),
f as (select m.*, coalesce(h.n_children, 0) as n_children from m left join h on h.parent = m.conv and h.depth = m.depth),
s as (select q.depth, q.k, count(*) filter (where f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.words)::bigint as saved_tokens
  from f join q on q.conv_id = f.conv and q.depth <= f.depth group by all),
e as (select q.depth, q.k, string_agg(q.conv_id::varchar, ',' order by q.conv_id) as ids from q join l on l.conv_id = q.conv_id and l.length = q.depth group by all)
select f.conv as conv_id, f.depth::bigint as depth, f.parent as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from f join s on s.depth = f.depth and s.k = f.k left join e on e.depth = f.depth and e.k = f.k"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations' first turns with totals over subtrees."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""with
t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from t),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as s from f where k > 1 and a >= 10),
x as (select lang, k, phrase, a, s, unnest(range(1, k)) as i from c),
y as (select x.lang, x.k, x.phrase, x.a, x.i, l.a as l, r.a as r, (1000000::hugeint * x.a * x.a) // (l.a::hugeint * r.a) as score from x
  join f l on l.lang = x.lang and l.phrase = array_to_string(x.s[1:x.i], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.s[x.i + 1:x.k], ' ')),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, i) = 1),
b as (select lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) as phrase from c where k = 3),
m as (select lang, phrase, max(a) as more from b group by all),
o as (select z.* from z left join m on z.lang = m.lang and z.phrase = m.phrase where coalesce(100 * m.more < 50 * z.a, true)),
q as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score::bigint as score from q join n on q.lang = n.lang where q.rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
