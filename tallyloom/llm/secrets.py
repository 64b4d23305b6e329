"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import least_hashed, let, prefix_sums

#: Base kinds in their order: name, pattern, the group whose length counts, its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(name for name, *_ in BASE), "markov")
#: What the models may judge: a run of these, at least so long, with a letter in it.
ALPHABET = "A-Za-z0-9+/_=-"
N_ALPHABET = 66
LEAST = 16
#: Strings of each class, at most, that the models learn from: those of least hash among all distinct ones.
SAMPLE = 20_000
CODES = 128


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, value); code points, end exclusive."""
    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(m))
        ends = prefix_sums(F.zip_with(gaps, m, lambda g, x: (F.length(g) + F.length(x)).cast("long")))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, nothing).otherwise(placed(m)))


def _kind(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of the fixed patterns, sorted. A match too short in its counted group is dropped."""
    def of(number: int) -> Column:
        _, pattern, group, least = BASE[number]
        return _kind(F.filter(found(text, pattern), lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least), number)
    return F.array_sort(F.concat(*[of(i) for i in range(len(BASE))]))


@dataclass(frozen=True)
class RandomStrings:
    """``ratios[128 * a + b]``: log P(b follows a | random string) - log P(b follows a | ordinary identifier)."""

    ratios: tuple[float, ...]

    def pairs(self, string: Column) -> Column:
        """The log-likelihood ratio of each character of a string of the alphabet; character 0 stands before its first."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")  # one literal, folded once
        codes = F.transform(F.split(string, ""), lambda c: F.ascii(c))
        return let(codes, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, F.lit(1), F.size(c) - 1)), c,
                                               lambda a, b: F.coalesce(F.get(table, a * CODES + b), F.lit(0.0))))

    def score(self, string: Column) -> Column:
        """The log-likelihood ratio of a string of the alphabet."""
        return F.aggregate(self.pairs(string), F.lit(0.0), lambda t, x: t + x)

    def parts(self, string: Column, threshold: float) -> Column:
        """Structs (start, end) of what is random in a string: all of it if its score exceeds ``threshold``, else every part of
        ``LEAST`` characters or more whose score does, and that no fall by ``threshold`` splits."""
        nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
        def of(p: Column) -> Column:
            whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.size(p).cast("long").alias("end")))
            return (F.when(F.aggregate(p, F.lit(0.0), lambda t, x: t + x) > threshold, whole)
                    .when(F.size(p) <= LEAST, nothing).otherwise(_random_parts(p, threshold)))
        return let(self.pairs(string), of)


#: Ratios are summed as whole numbers of this part of a nat.
GRAIN = 1 << 20


def _random_parts(ratios: Column, threshold: float) -> Column:
    """Structs (start, end) of the parts of ``LEAST`` ratios or more with a sum over ``threshold``, in one pass over running sums.

    A part ends where its sum is highest; it is closed by a fall below that by ``threshold``, and the next may start from its
    end on. The lowest running sum ``LEAST`` places back is the best start: ``low`` of this part, ``next`` of the one after it.
    """
    least = int(threshold * GRAIN)
    state = "struct<low:bigint,start:bigint,best:bigint,end:bigint,peak:bigint,next:bigint,next_start:bigint,parts:array<struct<start:bigint,end:bigint>>>"
    none = F.lit((1 << 62)).cast("long")
    zero = F.struct(none.alias("low"), F.lit(0).cast("long").alias("start"), F.lit(least).cast("long").alias("best"), F.lit(-1).cast("long").alias("end"),
                    F.lit(0).cast("long").alias("peak"), none.alias("next"), F.lit(0).cast("long").alias("next_start"),
                    F.array().cast("array<struct<start:bigint,end:bigint>>").alias("parts")).cast(state)

    def made(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(("low", "start", "best", "end", "peak", "next", "next_start", "parts"), values)]).cast(state)

    def step(a: Column, x: Column) -> Column:
        back, now, at = x["back"], x["now"], x["at"]  # the running sums before a part of LEAST ratios and after it
        i = at - LEAST
        lower = (a["end"] < 0) & (back < a["low"])
        later = (a["end"] >= 0) & (i >= a["end"]) & (back < a["next"])
        low, start = F.when(lower, back).otherwise(a["low"]), F.when(lower, i).otherwise(a["start"])
        nxt, next_start = F.when(later, back).otherwise(a["next"]), F.when(later, i).otherwise(a["next_start"])
        return (F.when(now - low > a["best"], made(low, start, now - low, at, now, none, F.lit(0).cast("long"), a["parts"]))
                .when((a["end"] >= 0) & (now < a["peak"] - least),
                      made(nxt, next_start, F.lit(least).cast("long"), F.lit(-1).cast("long"), F.lit(0).cast("long"), none, F.lit(0).cast("long"),
                           F.concat(a["parts"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))))
                .otherwise(made(low, start, a["best"], a["end"], a["peak"], nxt, next_start, a["parts"])))

    def closed(a: Column) -> Column:
        return F.when(a["end"] < 0, a["parts"]).otherwise(F.concat(a["parts"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))

    def passed(sums: Column) -> Column:
        places = F.sequence(F.lit(LEAST).cast("long"), F.size(sums).cast("long"))
        backs = F.concat(F.array(F.lit(0).cast("long")), sums)
        steps = F.zip_with(F.zip_with(places, F.slice(sums, F.lit(LEAST), F.size(sums)), lambda p, s: F.struct(p.alias("at"), s.alias("now"))),
                           F.slice(backs, F.lit(1), F.size(sums) - LEAST + 1), lambda q, b: F.struct(q["at"].alias("at"), q["now"].alias("now"), b.alias("back")))
        return F.aggregate(steps, zero, step, closed)

    return let(prefix_sums(F.transform(ratios, lambda r: F.round(r * GRAIN).cast("long"))), passed)


def samples(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(string, secret): labelled strings of ``docs`` (text). Values that the fixed patterns find are secrets; the other runs
    of the alphabet of 6 characters or more are ordinary. Of each class the ``size`` distinct strings of least hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    values = F.transform(base_spans(text), lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], BASE[0][1], 2)).otherwise(s["value"]))
    ordinary = F.filter(F.split(text, f"[^{ALPHABET}]+"), lambda x: F.length(x) >= 6)
    each = docs.select(let(values, lambda v: F.array(v, F.array_except(ordinary, v))).alias("lists")).select(F.posexplode("lists").alias("ordinary", "list"))
    distinct = stage(each.select((F.col("ordinary") == 0).alias("secret"), F.explode("list").alias("string")).distinct(), "strings", by="secret")
    least = lambda secret: least_hashed(distinct.where(F.col("secret") == secret), "string", size)
    return least(True).unionByName(least(False)).select("string", "secret")


def fit(labelled: DataFrame, uniform: float = 0.5, smoothing: float = 0.5) -> RandomStrings:
    """Both models from (string, secret): character pairs are counted by Spark, at most 2 x 128 x 128 counts reach the driver.

    Unseen pairs have ``smoothing`` counts. The random model is mixed with even odds for every character, with weight
    ``uniform``, so that kinds of random strings that no sample shows count as random too. Null strings add nothing.
    """
    codes = F.concat(F.array(F.lit(0)), F.filter(F.transform(F.split("string", ""), lambda c: F.ascii(c)), lambda c: (c > 0) & (c < CODES)))
    pairs = let(codes, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: c[i - 1] * CODES + c[i]))
    counts = (labelled.where("length(string) > 0").select("secret", F.explode(F.when(F.size(codes) > 1, pairs)).alias("pair"))
              .groupBy("secret", "pair").count().collect())
    seen = {True: [0.0] * CODES**2, False: [0.0] * CODES**2}
    for r in counts:
        seen[r["secret"]][r["pair"]] = float(r["count"])
    ratios = []
    for a in range(CODES):
        row = {k: v[a * CODES:(a + 1) * CODES] for k, v in seen.items()}
        total = {k: sum(v) + smoothing * N_ALPHABET for k, v in row.items()}
        for b in range(CODES):
            random = (1 - uniform) * (row[True][b] + smoothing) / total[True] + uniform / N_ALPHABET
            ratios.append(math.log(random * total[False] / (row[False][b] + smoothing)))
    return RandomStrings(tuple(ratios))


def _masked(text: Column, base: Column) -> Column:
    """``text`` with blanks for what ``base``, sorted spans, covers."""
    before = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    def step(a: Column, s: Column) -> Column:
        upto = F.greatest(a["at"], s["start"])
        cut = F.substring(text, (a["at"] + 1).cast("int"), (upto - a["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - upto, F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], F.array(F.concat(cut, blank))).alias("parts"))
    rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(base, before, step, rest))


def _to_edges(run: Column, part: Column) -> Column:
    """``part`` of ``run`` up to the next '=', '/', '_' or '-' on each side, so that no end of a secret stays."""
    value = F.translate(run["value"], "=_-", "///")
    edge = lambda at: F.substring(value, at.cast("int"), F.lit(1)) == "/"
    before = F.when(edge(part["start"] + 1), "").otherwise(F.substring_index(F.substring(value, F.lit(1), part["start"].cast("int")), "/", -1))
    after = F.when(edge(part["end"]), "").otherwise(F.substring_index(F.substring(value, (part["end"] + 1).cast("int"), F.length(value)), "/", 1))
    start, end = part["start"] - F.length(before), part["end"] + F.length(after)
    return F.struct((run["start"] + start).alias("start"), (run["start"] + end).alias("end"),
                    F.substring(run["value"], (start + 1).cast("int"), (end - start).cast("int")).alias("value"))


def spans(text: Column, model: RandomStrings, threshold: float = 15.0) -> Column:
    """All spans (start, kind, end, value) sorted: the base, and what the models take for random by ``threshold`` nats in the
    runs outside base spans: the whole run, or parts of it. A null text has none; the whole text is read."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    def judged(rest: Column) -> Column:
        runs = F.filter(found(rest, f"[{ALPHABET}]{{{LEAST},}}"), lambda s: s["value"].rlike("[A-Za-z]"))
        each = F.transform(runs, lambda s: F.transform(model.parts(s["value"], threshold), lambda p: _to_edges(s, p)))
        return F.filter(F.array_distinct(F.flatten(each)), lambda s: s["value"].rlike("[A-Za-z]"))
    return let(base_spans(text), lambda base: F.array_sort(F.concat(base, _kind(judged(_masked(text, base)), len(BASE)))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scanned(docs: DataFrame, model: RandomStrings | None = None, **options) -> DataFrame:
    """(doc_id, secrets) for each row of ``docs`` (doc_id, text); secrets as ``spans`` gives them.

    Without ``model`` one is fitted on labelled samples of ``docs`` itself. Rows are judged where they are read: null and
    empty texts have no spans, repeated rows repeat, a null doc_id is carried through, no rows give no rows.
    """
    model = model or fit(stage(samples(docs), "samples"))
    return docs.select("doc_id", spans(F.col("text"), model, **options).alias("secrets"))


def redact(docs: DataFrame, model: RandomStrings | None = None, marker: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by ``marker``, overlapping ones by one; ``n_chars``, if there, follows.

    All rows and columns stay; a text without secrets stays as it is, null included.
    """
    model = model or fit(stage(samples(docs), "samples"))
    step = lambda a, s: F.when(F.element_at(a, -1)["end"] >= s["start"], F.concat(
        F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))
    )).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    before = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
    text = F.col("text").cast("string")
    def rebuilt(merged: Column) -> Column:
        parts = F.zip_with(merged, F.slice(merged, F.lit(2), F.size(merged)), lambda a, b: F.concat(
            F.when(a["start"] < 0, F.lit("")).otherwise(F.lit(marker)),
            F.substring(text, (F.greatest(a["end"], F.lit(0)) + 1).cast("int"),
                        (F.coalesce(b["start"], F.length(text).cast("long")) - F.greatest(a["end"], F.lit(0))).cast("int"))))
        return F.array_join(parts, "")
    new = let(spans(F.col("text"), model, **options), lambda s: F.when(F.size(s) == 0, text).otherwise(let(F.aggregate(s, before, step), rebuilt)))
    out = docs.withColumn("text", new)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out
