"""Document scores by masked pseudo-likelihood: a bidirectional window network predicts each token's class from both sides,
and word counts of the whole corpus predict the word in its class."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import stage

#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 500_000
DOCS_AT_ONCE = 500
#: A word with at least 1 in so many of all tokens is sent to every task, so at most so many are; the rarer ones, none of
#: which weighs much in a shuffle, are joined.
COMMON = 400_000


@dataclass(frozen=True)
class Settings:
    """``words`` most frequent words and ``classes`` hash classes for all others are the token classes,
    predicted by way of about the square root of so many groups; a token sees ``reach`` neighbours on each side through vectors of ``width``; one pass trains in steps of ``batch`` tokens. A word of a
    hash class has its count and ``smoothing`` more, as has one unseen word, of the class's sum."""

    words: int = 896
    classes: int = 128
    reach: int = 2
    width: int = 16
    batch: int = 8192
    rate: float = 0.2
    seed: int = 7
    smoothing: float = 0.5

    @property
    def size(self) -> int:
        return self.words + self.classes

    @property
    def group(self) -> int:
        """Token classes in a group; consecutive ones, so words of similar frequency."""
        return isqrt(self.size - 1) + 1

    @property
    def groups(self) -> int:
        return -(-self.size // self.group)

    @property
    def offsets(self) -> list[int]:
        return [o for o in range(-self.reach, self.reach + 1) if o]


def hash_class(word: str, settings: Settings) -> int:
    return settings.words + xxh3_64_intdigest(word) % settings.classes


class Vocabulary(dict):
    """Word -> entry: a listed word's is its token class, a word of ``common`` has one of its own after all classes, and any
    other word has its hash class and is not remembered. ``class_of`` gives the token classes of entries."""

    def __init__(self, words: list[str], settings: Settings, common: list[str] = ()):
        super().__init__((w, i) for i, w in enumerate(words))
        self.update((w, settings.size + i) for i, w in enumerate(common))
        self.first, self.classes = settings.words, settings.classes
        self.class_of = np.array([*range(settings.size), *(hash_class(w, settings) for w in common)], np.int32)

    def __missing__(self, word: str) -> int:
        return self.first + xxh3_64_intdigest(word) % self.classes


def entries(texts: list[str | None], vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all texts, their entries, and the number of words of each text."""
    split = [(t or "").split() for t in texts]
    words = [x for w in split for x in w]
    return words, np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), np.array([len(w) for w in split], np.int64)


def padded(classes: np.ndarray, sizes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token classes of texts of ``sizes`` with padding around each, the places of the tokens, and the text each belongs to."""
    ids = np.full(len(classes) + settings.reach * (len(sizes) + 1), settings.size, np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(owner)) + settings.reach * (owner + 1)
    ids[places] = classes
    return ids, places, owner


def laid_out(texts: list[str | None], vocabulary: Vocabulary, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``padded`` token classes of all texts."""
    _, found, sizes = entries(texts, vocabulary)
    return padded(vocabulary.class_of[found], sizes, settings)


class Network:
    """log P(token | neighbours): neighbours' vectors, one table for each offset, are summed and squashed; the token class follows
    by two softmaxes, first of its group of classes, then of the class in its group, so a token costs two small ones.

    The target itself is never an input, which is what masking it means for a window network. ``tops`` and ``outputs`` have
    their bias as the last column.
    """

    def __init__(self, settings: Settings, weights: np.ndarray):
        s = self.settings = settings
        self.weights = weights.astype(np.float32)
        rows, wide = s.size + 1, s.width + 1
        cut, end = len(s.offsets) * rows * s.width, len(s.offsets) * rows * s.width + s.groups * wide
        self.inputs = self.weights[:cut].reshape(len(s.offsets), rows, s.width)
        self.tops = self.weights[cut:end].reshape(s.groups, wide)
        self.outputs = self.weights[end:].reshape(s.size, wide)

    @staticmethod
    def start(settings: Settings, shares: np.ndarray) -> np.ndarray:
        """Initial weights: small vectors, and as bias the log shares of the groups and of the token classes."""
        s, rng = settings, np.random.default_rng(settings.seed)
        parts = [rng.normal(0, 0.1, (len(s.offsets) * (s.size + 1), s.width))]
        for share in (np.add.reduceat(shares, np.arange(0, s.size, s.group)), shares):
            parts.append(np.column_stack([rng.normal(0, 0.1, (len(share), s.width)), np.log(share)]))
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    def _by_group(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of ``places`` by the group of their token, the tokens in this order, and (group, start, end) of each group."""
        own = ids[places]
        group = (own // self.settings.group).astype(np.int16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.settings.groups)).tolist()
        return order, own[order], [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]

    def _hidden(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        width = self.settings.width
        hidden = np.ones((len(places), width + 1), np.float32)
        summed = self.inputs[0][ids[places + self.settings.offsets[0]]]
        for table, offset in zip(self.inputs[1:], self.settings.offsets[1:]):
            summed += table[ids[places + offset]]
        np.tanh(summed, out=hidden[:, :width])
        return hidden

    def log_probabilities(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.float64)
        for at in range(0, len(places), self.settings.batch):
            p = places[at:at + self.settings.batch]
            order, own, groups = self._by_group(ids, p)
            hidden, found = self._hidden(ids, p[order]), np.empty(len(p), np.float64)
            for g, a, b in groups:
                found[a:b] = _log_softmax(self.outputs[g * self.settings.group:(g + 1) * self.settings.group], hidden[a:b], own[a:b] - g * self.settings.group)
            found += _log_softmax(self.tops, hidden, own // self.settings.group)
            out[at + order] = found
        return out

    def gradient(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability of the tokens at ``places``."""
        s = self.settings
        order, own, groups = self._by_group(ids, places)
        places = places[order]
        hidden = self._hidden(ids, places)
        out = np.zeros(len(self.weights), np.float32)
        cut, end = self.inputs.size, self.inputs.size + self.tops.size
        tops, outputs = out[cut:end].reshape(self.tops.shape), out[end:].reshape(self.outputs.shape)
        wrong = _excess(self.tops, hidden, own // s.group, len(places))
        np.matmul(wrong, hidden, out=tops)
        back = wrong.T @ self.tops[:, :s.width]
        for g, a, b in groups:
            first = g * s.group
            wrong = _excess(self.outputs[first:first + s.group], hidden[a:b], own[a:b] - first, len(places))
            np.matmul(wrong, hidden[a:b], out=outputs[first:first + s.group])
            back[a:b] += wrong.T @ self.outputs[first:first + s.group, :s.width]
        squashed = hidden[:, :s.width]
        back *= 1 - squashed * squashed
        tables = out[:cut].reshape(self.inputs.shape)
        for table, offset in zip(tables, s.offsets):
            seen = ids[places + offset].astype(np.int16 if s.size < 1 << 15 else np.int32)
            by_class = np.argsort(seen, kind="stable")
            seen = seen[by_class]
            starts = np.flatnonzero(np.diff(seen, prepend=-1))
            table[seen[starts]] = np.add.reduceat(back[by_class], starts, axis=0)
        return out

    def train(self, ids: np.ndarray, places: np.ndarray, squares: np.ndarray) -> None:
        """One pass of Adagrad over all places; ``squares`` holds the sums of squared gradients."""
        for at in range(0, len(places), self.settings.batch):
            g = self.gradient(ids, places[at:at + self.settings.batch])
            squares += g * g
            g *= self.settings.rate
            g /= np.sqrt(squares)
            self.weights -= g


def _log_softmax(table: np.ndarray, hidden: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log of the softmax of ``table`` by ``hidden`` at the row ``own`` of each."""
    scores = table @ hidden.T
    scores -= scores.max(axis=0)
    found = scores[own, np.arange(len(own))]
    return found - np.log(np.exp(scores, out=scores).sum(axis=0))


def _excess(table: np.ndarray, hidden: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The softmax less 1 at the row ``own``, by ``n``: the gradient of the scores."""
    p = table @ hidden.T
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p *= 1 / (n * p.sum(axis=0))
    p[own, np.arange(len(own))] -= np.float32(1 / n)
    return p


@dataclass(frozen=True)
class Model:
    """``common`` and ``common_counts``: frequent words beside the listed ``words``. ``class_sums``: log of tokens and smoothing of
    each hash class. ``rare``: (word, count) of all other words, staged, so kept until scores are written."""

    settings: Settings
    words: list[str]
    weights: np.ndarray
    common: list[str]
    common_counts: np.ndarray
    class_sums: np.ndarray
    rare: DataFrame

    def small(self) -> tuple:
        """What every scoring task holds."""
        return self.settings, self.words, self.weights, self.common, self.common_counts, self.class_sums


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            yield batch.slice(at, DOCS_AT_ONCE)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over all texts; tasks count first, Spark adds up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "count"])
        for batch in _batches(batches):
            for text in batch.column(0):
                counts.update((text.as_py() or "").split())
            if len(counts) > COUNTED_WORDS:
                yield handed()
                counts.clear()
        yield handed()
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _class_counts(counts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each hash class, as if no word were listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, settings.size), np.int64)
        for batch in batches:
            classes = np.fromiter((hash_class(w, settings) for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(sums[0], classes, batch.column(1).to_numpy(zero_copy_only=False))
            np.add.at(sums[1], classes, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(settings.size), pa.int32()), *map(pa.array, sums)], ["class", "tokens", "types"])
    rows = counts.mapInArrow(run, "class int, tokens long, types long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens, types = np.zeros(settings.size), np.zeros(settings.size)
    for r in rows:
        tokens[r["class"]], types[r["class"]] = r["tokens"], r["types"]
    return tokens, types


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A network trained on every token of ``docs`` (text), and the counts of all its words.

    Word counts over all texts give the word list, the starting bias and the shares of words in their hash classes. Then each
    task trains a copy of the network on the texts it reads, and the copies are averaged by Spark, weight by weight, weighed
    by their tokens. What is gathered, words and copies, grows with the input; the listed and common words and one averaged
    copy reach the driver, the counts of all other words stay a table.
    """
    counts = stage(word_counts(docs), "words")
    top = counts.orderBy(F.desc("count"), "word").limit(settings.words).collect()
    words, total = [r["word"] for r in top], counts.agg(F.sum("count")).first()[0] or 0
    listed = np.array([r["count"] for r in top] + [0] * (settings.words - len(top)), float)
    often = F.col("count") * COMMON >= total
    known = set(words)
    common = sorted((r["word"], r["count"]) for r in counts.where(often).collect() if r["word"] not in known)
    tokens, types = _class_counts(counts, settings)
    for r in top:
        tokens[hash_class(r["word"], settings)] -= r["count"]
        types[hash_class(r["word"], settings)] -= 1
    class_sums = np.log(tokens + settings.smoothing * (types + 1))
    shares = np.concatenate([listed, np.full(settings.classes, (total - listed.sum()) / settings.classes)]) + 1
    start = Network.start(settings, shares / shares.sum())
    sent = docs.sparkSession.sparkContext.broadcast((words, [w for w, _ in common], start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common, start = sent.value
        vocabulary, network, seen = Vocabulary(words, settings, common), Network(settings, start.copy()), 0
        squares = np.full(len(start), 1e-3, np.float32)
        for batch in _batches(batches):
            ids, places, _ = laid_out(batch.column(0).to_pylist(), vocabulary, settings)
            network.train(ids, places, squares)
            seen += len(places)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start)), pa.int32()), pa.array(network.weights, pa.float32()), pa.array([seen] * len(start), pa.int64())],
                                             ["place", "weight", "seen"])

    copies = docs.select(F.col("text").cast("string")).mapInArrow(run, "place int, weight float, seen long")
    mean = copies.groupBy("place").agg((F.sum(F.col("weight").cast("double") * F.col("seen")) / F.sum("seen")).alias("weight")).orderBy("place").collect()
    rare = counts.where(~often & ~F.col("word").isin(words)) if words else counts
    return Model(settings, words, np.array([r["weight"] for r in mean], np.float32) if mean else start,
                 [w for w, _ in common], np.array([c for _, c in common], float), class_sums, rare)


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row of ``docs`` (doc_id, text).

    The log-likelihood sums log P(token | both sides) over every token of the whole text; tokens are runs of non-space. A word
    that is not listed has the probability of its hash class times its share of the class. Counts of common words are at hand
    where texts are read; rarer and unseen words are handed on, once a text, and joined with the table of counts. Null
    and empty texts have no tokens, a sum of 0 and a null mean; a null doc_id is carried through; repeated rows repeat; no
    rows give no rows; other columns are ignored. Without ``model`` one is fitted on ``docs``.
    """
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model.small())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, listed, weights, common, common_counts, class_sums = sent.value
        vocabulary, network = Vocabulary(listed, s, common), Network(s, weights)
        share = np.concatenate([np.zeros(s.words), -class_sums[s.words:], np.log(common_counts + s.smoothing) - class_sums[vocabulary.class_of[s.size:]]])
        row = TaskContext.get().partitionId() << 40
        for batch in _batches(batches):
            words, found, sizes = entries(batch.column(1).to_pylist(), vocabulary)
            ids, places, owner = padded(vocabulary.class_of[found], sizes, s)
            sums = np.bincount(owner, network.log_probabilities(ids, places) + share[found], batch.num_rows)
            rare = np.flatnonzero((found >= s.words) & (found < s.size))
            times = Counter(zip(owner[rare].tolist(), map(words.__getitem__, rare.tolist())))
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.fromiter((o for o, _ in times), np.int64, len(times)), minlength=batch.num_rows))])
            handed = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([w for _, w in times], pa.string()), pa.array(times.values(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(sizes), pa.array(sums, pa.float64()), handed],
                                             ["row", "doc_id", "n_tokens", "log_likelihood", "rare"])
            row += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = stage(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, log_likelihood double, rare map<string,int>"), "read")
    added = (read.select("row", F.explode("rare").alias("word", "n")).join(model.rare, "word", "left").groupBy("row")
             .agg(F.sum(F.col("n") * F.log(F.coalesce("count", F.lit(0)) + F.lit(model.settings.smoothing))).alias("added")))
    whole = F.col("log_likelihood") + F.coalesce("added", F.lit(0.0))
    return (read.select("row", "doc_id", "n_tokens", "log_likelihood").join(added, "row", "left")
            .select("doc_id", "n_tokens", whole.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_likelihood")))
