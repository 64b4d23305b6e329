"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import let

SPACE = r"[\x20\x09-\x0D]+"
#: Function words of English, French, German and Spanish.
FUNCTION_WORDS = ("the of and to in is that for it as was with be by on "
                  "le la les de des et en un une du que qui dans pour par "
                  "der die das und den von zu mit sich auf ist im ein eine "
                  "el los las y a se con su es lo del al una").split()

BAD, ABSTAIN, GOOD = -1, 0, 1


@dataclass(frozen=True)
class Rule:
    """Votes BAD where ``bad`` holds, else GOOD where ``good`` holds, else abstains; both take the feature struct."""

    name: str
    bad: Callable[[Column], Column]
    good: Callable[[Column], Column]


#: Each looks at one trait; the thresholds are parameters, their weights are learned.
RULES = (
    Rule("word_length", lambda f: (f["word_chars"] < 3 * f["n_words"]) | (f["word_chars"] > 10 * f["n_words"]),
         lambda f: (2 * f["word_chars"] >= 7 * f["n_words"]) & (f["word_chars"] <= 9 * f["n_words"])),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"], lambda f: 50 * f["n_symbols"] < f["n_words"]),
    Rule("capitals", lambda f: 10 * f["n_upper"] > 3 * f["word_chars"], lambda f: 10 * f["n_upper"] < f["word_chars"]),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"],
         lambda f: 100 * f["n_repeat_words"] < 15 * f["n_words"]),
    Rule("repeated_lines", lambda f: (f["n_lines"] >= 4) & (2 * f["n_dup_lines"] > f["n_lines"]),
         lambda f: (f["n_lines"] >= 2) & (20 * f["n_dup_lines"] < f["n_lines"])),
    Rule("function_words", lambda f: 100 * f["n_function"] < 5 * f["n_words"], lambda f: 100 * f["n_function"] >= 12 * f["n_words"]),
    Rule("exclamation", lambda f: 20 * f["n_shouts"] > f["n_words"], lambda f: 100 * f["n_shouts"] < f["n_words"]),
    Rule("sentences", lambda f: (200 * f["n_stops"] < f["n_words"]) | (2 * f["n_stops"] > f["n_words"]),
         lambda f: (100 * f["n_stops"] >= 2 * f["n_words"]) & (4 * f["n_stops"] <= f["n_words"])),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, in n log n steps.

    Windows are compared by 64-bit hashes. Equal ones meet by sorting (hash, place); each place of a repeated window
    then adds the words up to the next such place, three at most.
    """
    def windows(w):
        h = F.transform(w, lambda x: F.xxhash64(x))
        return let(h, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 2),
                                            lambda i: F.xxhash64(h[i - 1], h[i], h[i + 1])))

    def places(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(
            F.transform(s, lambda x, i: F.struct(
                x["i"].alias("i"),
                ((i > 0) & (F.get(s, i - 1)["g"] == x["g"]) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))

    def covered(p):
        following = F.concat(F.slice(p, 2, F.size(p)), F.array(F.element_at(p, -1) + 3))
        return F.aggregate(F.zip_with(p, following, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0).cast("long"), lambda t, x: t + x)

    repeated = let(windows(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
                   .otherwise(let(places(g), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(repeated)


def features(text: Column) -> Column:
    """A struct of counts over the whole text; a null text is empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    read = F.struct(
        F.array_remove(F.split(t, SPACE), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.regexp_replace(t, r"[^A-Z#*$%&|<>.?!]+", "").alias("m"))
    marks = lambda m, other: F.length(F.regexp_replace(m, other, "")).cast("long")
    return let(read, lambda x: F.struct(
        F.size(x["w"]).cast("long").alias("n_words"),
        F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
        marks(x["m"], r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
        _repeat_words(x["w"]).alias("n_repeat_words"),
        F.size(x["l"]).cast("long").alias("n_lines"),
        F.size(F.filter(x["w"], lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        marks(x["m"], "[^A-Z]+").alias("n_upper"), marks(x["m"], "[^.?]+").alias("n_stops"), marks(x["m"], "[^!]+").alias("n_shouts")))


def votes(f: Column, rules=RULES) -> Column:
    """The rules' votes on one feature struct, as an array."""
    return F.array(*[F.when(r.bad(f), BAD).when(r.good(f), GOOD).otherwise(ABSTAIN) for r in rules])


def base_failed(f: Column) -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, per rule, P(vote | bad) and P(vote | good) for the votes BAD, ABSTAIN, GOOD."""

    prior: float
    bad: tuple[tuple[float, float, float], ...]
    good: tuple[tuple[float, float, float], ...]

    def log_odds(self, votes: Column) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for i, (b, g) in enumerate(zip(self.bad, self.good)):
            weights = F.array(*[F.lit(math.log(y / x)) for x, y in zip(b, g)])
            total = total + F.element_at(weights, F.element_at(votes, i + 1) + 2)
        return total

    def posterior(self, votes: Column) -> Column:
        """P(good | votes)."""
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit(voted: DataFrame, n_rules: int, rounds: int = 50, reach: float = 0.3, slip: float = 0.02, weight: float = 0.1) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns of all rows of ``voted`` (column ``votes``).

    Only the patterns, at most 3^rules whatever the input, reach the driver. The prior belief is that a rule votes BAD on
    ``reach`` of the bad rows and on ``slip`` of the good ones, GOOD on 0.4 and 0.7; it is worth a share ``weight`` of all
    rows, starts the search, names the classes and stands alone over an empty table.
    """
    patterns = sorted((tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    belief_bad, belief_good = (reach, 0.6 - reach, 0.4), (slip, 0.3 - slip, 0.7)
    weight = weight * sum(n for _, n in patterns) or 1.0
    model = LabelModel(0.5, (belief_bad,) * n_rules, (belief_good,) * n_rules)
    for _ in range(rounds):
        n_bad = [[weight * x for x in belief_bad] for _ in range(n_rules)]
        n_good = [[weight * x for x in belief_good] for _ in range(n_rules)]
        bad_rows = good_rows = weight / 2
        for pattern, count in patterns:
            odds = math.log(model.prior / (1 - model.prior))
            for v, b, g in zip(pattern, model.bad, model.good):
                odds += math.log(g[v + 1] / b[v + 1])
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_rows += p * count
            bad_rows += (1 - p) * count
            for i, v in enumerate(pattern):
                n_good[i][v + 1] += p * count
                n_bad[i][v + 1] += (1 - p) * count
        share = lambda rows: tuple(tuple(x / sum(row) for x in row) for row in rows)
        model = LabelModel(good_rows / (good_rows + bad_rows), share(n_bad), share(n_good))
    return model


def judged(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the features, base_failed, posterior, kept) for each row of ``docs`` (doc_id, text).

    The label model is fitted on the votes of all rows. A row is kept if it passes the base and its posterior quality
    reaches ``threshold``. Null and empty texts have no words and so fail the base; rows without doc_id are judged like
    others; repeated rows count, and come out, as often as they stand; no rows give no rows. Other columns are ignored.
    """
    f = F.col("f")
    counted = stage(docs.select("doc_id", features(F.col("text")).alias("f")).withColumn("votes", votes(f, rules)), "quality")
    model = fit(counted, len(rules))
    return (counted.select("doc_id", "f.*", base_failed(f).alias("base_failed"), model.posterior(F.col("votes")).alias("posterior"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever their names.

    Rows are staged with their votes beside them: the label model reads the votes alone, and the filter counts nothing again.
    """
    judged = let(features(F.col("text")), lambda f: F.struct(votes(f, rules).alias("votes"), base_failed(f).alias("failed")))
    noted = stage(docs.select(F.struct("*").alias("row"), judged.alias("f")), "votes")
    model = fit(noted.select("f.votes"), len(rules))
    return noted.where(~F.col("f.failed") & (model.posterior(F.col("f.votes")) >= threshold)).select("row.*")
