"""Phrase collocations by count transducers: weighted acyclic automata over words.

Each block of text gives a transducer for each prefix range: an acyclic automaton that reads one to three words and returns
their count. Transducers of one range are united, counts summed, from block to block; counts of parts of phrases are
then read by composing a range's transducer with the automaton of the phrases asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import stage
from .near_dedup import mix

#: Ends of pieces, and what stands for them among words: a byte that UTF-8 never holds.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
TO_END = bytes.maketrans(ENDS, END * len(ENDS))
MOST = 3


@dataclass(frozen=True)
class Collocations:
    """Phrases of ``least`` occurrences or more; a phrase is dropped if a longer one has ``within`` percent of its count;
    ``top`` phrases a language. A task holds about ``block_words`` words at a time, a block those of one language; a range about ``range_words``."""

    least: int = 10
    within: int = 50
    top: int = 2000
    block_words: int = 1 << 20
    range_words: int = 1 << 21


def words(text: bytes) -> list[bytes]:
    """Words in order, with an ``END`` for each end of a piece. Only A-Z are lower-cased; words end at blanks and tabs."""
    return text.lower().translate(TO_END).replace(END, b" " + END + b" ").split()


#: Step sizes of packed arrays; an array's first byte is its place here.
STEPS = (np.int8, np.int16, np.int32, np.int64)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Integer arrays as steps in the fewest bytes each (step size, length, steps), compressed; the first eight bytes tell their size."""
    out = []
    for a in arrays:
        step = a.astype(np.int64)
        step[1:] -= a[:-1]
        low, high = (int(step.min()), int(step.max())) if len(step) else (0, 0)
        kind = next(k for k, t in enumerate(STEPS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        out += [bytes([kind]), len(step).to_bytes(8, "little"), step.astype(STEPS[kind]).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, size = STEPS[raw[at]], int.from_bytes(raw[at + 1:at + 9], "little")
        out.append(np.cumsum(np.frombuffer(raw, kind, size, at + 9), dtype=np.int64))
        at += 9 + size * np.dtype(kind).itemsize
    return out


def _blocks(config: Collocations):
    """Batches (lang, text) -> (block, lang, words, counts, tokens): ``tokens`` are places in the sorted ``words``, -1 for an end."""
    def flush(block: int, lang: str, held: list[bytes]) -> pa.RecordBatch:
        symbols = sorted({*held} - {END})
        place = {w: i for i, w in enumerate(symbols)}
        place[END] = -1
        tokens = np.fromiter(map(place.__getitem__, held), np.int32, len(held))
        counts = np.bincount(tokens[tokens >= 0], minlength=len(symbols))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([lang]), pa.array([symbols], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
             pa.array([packed([tokens])], pa.binary())], ["block", "lang", "words", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, total = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = held.setdefault(lang.as_py(), [])
                before = len(own)
                own += words(text.as_py().encode("utf-8", "replace"))
                own.append(END)
                total += len(own) - before
                if total >= config.block_words:  # of all languages together, so that many of them take no more memory
                    most = max(held, key=lambda x: len(held[x]))
                    total -= len(held[most])
                    yield flush(block, most, held.pop(most))
                    block += 1
        for lang, own in held.items():
            yield flush(block, lang, own)
            block += 1
    return run


class Ranges:
    """Prefix ranges: n-grams in the order of the prefixes of their first two words, cut into ``count`` parts of like many occurrences.

    A prefix is two bytes, so the histogram behind it has 65,792 rows at most. A pair of prefixes that is due more than one range
    is spread over them by hash of the two words, so common beginnings crowd none.
    """

    def __init__(self, histogram: list[tuple[bytes, int]], range_words: int):
        keys, totals = zip(*sorted(histogram)) if histogram else ((b"",), (1,))
        self.keys, total = list(keys), max(sum(totals), 1)
        self.share = np.array(totals) / total
        self.before = np.concatenate([[0.0], np.cumsum(self.share)[:-1]])
        self.count = -(-total // range_words)
        self.place = {k: i for i, k in enumerate(self.keys)}

    def codes(self, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the prefix, hash) of each word; one more of each, for no word, at the end."""
        return np.array([*(self.place[w[:2]] for w in symbols), -1], np.int64), np.array([*map(zlib.crc32, symbols), 0], np.uint64)

    def of(self, codes: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The ranges of n-grams whose first two words are at ``first`` and ``second`` (-1 for none) in ``codes``."""
        p, q = codes[0][first], codes[0][second]
        inner = np.where(q < 0, 0.0, self.before[np.maximum(q, 0)])
        wide = np.where(q < 0, 0.0, self.share[np.maximum(q, 0)])
        mixed = ((codes[1][first] * np.uint64(2654435761) + codes[1][second] * np.uint64(40503)) >> np.uint64(8)) % np.uint64(1 << 24)
        at = self.before[p] + self.share[p] * (inner + wide * np.where(self.count * self.share[p] * wide > 1, mixed / float(1 << 24), 0.0))
        return np.minimum((self.count * at).astype(np.int64), self.count - 1)


class Transducer:
    """Acyclic automaton over sorted ``symbols`` that returns a count for one to ``MOST`` words.

    Level k holds its arcs sorted by (state, symbol): ``symbol``, ``weight`` (0 where no counted n-gram ends) and ``to``, the state of
    the next level. ``edge`` holds where each state's arcs begin. Equal states are one, level by level from the last.
    """

    def __init__(self, symbols: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.symbols, self.levels = symbols, levels

    @staticmethod
    def build(symbols: list[bytes], grams: np.ndarray, counts: np.ndarray) -> "Transducer":
        """From distinct n-grams (rows of symbol places, -1 after the last) in sorted order: prefixes become states of a trie,
        which is then minimised."""
        edges = []
        for k in range(MOST):
            has = grams[:, k] >= 0
            rows = np.flatnonzero(has)
            new = np.ones(len(rows), bool)
            if len(rows) > 1:
                new[1:] = (grams[rows[1:], :k + 1] != grams[rows[:-1], :k + 1]).any(axis=1)
            first = rows[new]
            ends = (grams[first, k + 1] < 0) if k + 1 < MOST else np.ones(len(first), bool)
            edges.append((first, grams[first, k], np.where(ends, counts[first], 0)))
        levels: list = [None] * MOST
        target = np.full(len(edges[-1][0]), -1, np.int64)
        for k in reversed(range(MOST)):
            first, symbol, weight = edges[k]
            if k == 0:
                levels[0] = (np.array([0, len(first)]), symbol, weight, target)
                break
            above = edges[k - 1][0]
            begin = np.searchsorted(first, above)
            size = np.diff(np.append(begin, len(first)))
            state = np.full(len(above), -1, np.int64)  # -1: no arcs
            if len(first):
                arc = np.stack([symbol, weight, target], axis=1).astype(np.int64)
                full = np.flatnonzero(size)
                one, two = (np.add.reduceat(_mixed(arc, seed), begin[full]) for seed in (1, 2))
                _, where, back = np.unique(one, return_index=True, return_inverse=True)
                if (two[where][back] != two).any():  # unlike states of one hash: all stay apart
                    where = back = np.arange(len(full))
                order = np.argsort(where)  # numbered as they first occur, so that steps between arcs are small
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                where, back = where[order], place[back]
                state[full] = back
                kept = full[where]
                take = _runs(begin[kept], size[kept])
                levels[k] = (np.concatenate([[0], np.cumsum(size[kept])]), symbol[take], weight[take], target[take])
            else:
                levels[k] = (np.zeros(1, np.int64), symbol, weight, target)
            target = state
        return Transducer(symbols, levels)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All counted n-grams with their counts, by length and in sorted order."""
        rows, counts = [], []
        state, prefix = np.zeros(1, np.int64), np.empty((1, 0), np.int64)
        for k, (edge, symbol, weight, to) in enumerate(self.levels):
            size = edge[state + 1] - edge[state]
            arcs = _runs(edge[state], size)
            prefix = np.concatenate([np.repeat(prefix, size, axis=0), symbol[arcs, None]], axis=1)
            ends = weight[arcs] > 0
            rows.append(np.pad(prefix[ends], ((0, 0), (0, MOST - 1 - k)), constant_values=-1))
            counts.append(weight[arcs][ends])
            on = to[arcs] >= 0
            prefix, state = prefix[on], to[arcs][on]
        return np.concatenate(rows), np.concatenate(counts)

    def compose(self, asked: list[list[bytes]]) -> np.ndarray:
        """Counts of the phrases ``asked``, 0 for others: all are read at once, level by level."""
        place = {w: i for i, w in enumerate(self.symbols)}
        path = np.array([[place.get(w, -2) for w in p] + [-1] * (MOST - len(p)) for p in asked], np.int64).reshape(-1, MOST)
        out, state = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)
        for k, (edge, symbol, weight, to) in enumerate(self.levels):
            if not len(symbol):
                break
            width = len(self.symbols) + 1
            owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            keys = owner * width + symbol
            at = np.minimum(np.searchsorted(keys, state * width + path[:, k]), len(keys) - 1)
            met = (state >= 0) & (path[:, k] >= 0) & (keys[at] == state * width + path[:, k])
            last = met & ((path[:, k + 1] == -1) if k + 1 < MOST else True)
            out[last] = weight[at[last]]
            state = np.where(met & ~last, to[at], -1)
        return out


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of ``size[0]`` places, then those of the next run."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _mixed(arcs: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of rows of arcs; a state is known by the sums of its arcs under two of them."""
    x = np.zeros(len(arcs), np.uint64)
    for i in range(arcs.shape[1]):
        x = (x + arcs[:, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def united(parts: list[Transducer]) -> Transducer:
    """One transducer with the summed counts of all."""
    symbols = sorted(set().union(*(p.symbols for p in parts)))
    place = {w: i for i, w in enumerate(symbols)}
    grams, counts = [], []
    for p in parts:
        g, c = p.grams()
        move = np.array([place[w] for w in p.symbols] + [-1], np.int64)
        grams.append(move[g])
        counts.append(c)
    return Transducer.build(symbols, *summed(np.concatenate(grams), np.concatenate(counts)))


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in sorted order with summed counts."""
    if not len(grams):
        return grams, counts
    width = int(grams.max()) + 2
    if width < 1 << 20:  # one number for an n-gram
        code = np.zeros(len(grams), np.int64)
        for i in range(MOST):
            code = code * width + grams[:, i] + 1
        order = np.argsort(code, kind="stable")
        new = np.diff(code[order], prepend=-1) != 0
    else:
        order = np.lexsort(grams.T[::-1])
        new = np.concatenate([[True], (grams[order[1:]] != grams[order[:-1]]).any(axis=1)])
    grams, counts, first = grams[order], counts[order], np.flatnonzero(new)
    return grams[first], np.add.reduceat(counts, first)


PARTS = "lang string, prefix_range long, symbols array<binary>, arcs binary"


def _row(lang: str, prefix_range: int, part: Transducer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang], pa.string()), pa.array([prefix_range], pa.int64()), pa.array([part.symbols], pa.list_(pa.binary())),
         pa.array([packed([a for level in part.levels for a in level])], pa.binary())], ["lang", "prefix_range", "symbols", "arcs"])


def _read(batch: pa.RecordBatch, i: int) -> tuple[tuple[str, int], Transducer]:
    """((lang, prefix_range), transducer) of row ``i``."""
    flat = unpacked(batch.column("arcs")[i].as_py())
    key = (batch.column("lang")[i].as_py(), batch.column("prefix_range")[i].as_py())
    return key, Transducer(batch.column("symbols")[i].as_py(), [tuple(flat[k:k + 4]) for k in range(0, len(flat), 4)])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (block, lang, words, tokens, frequent) -> (block, lang, symbols, tokens): what is left of a block without its rare words.

    Words that are rare everywhere cannot be part of a candidate: like ends, they part what stands around them.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            every = batch.column("words")[i].values
            frequent = np.sort(batch.column("frequent")[i].values.to_numpy())
            place = np.full(len(every) + 1, -1, np.int64)
            place[frequent] = np.arange(len(frequent))
            tokens = place[unpacked(batch.column("tokens")[i].as_py())[0]]
            tokens = tokens[(tokens >= 0) | (np.append(-2, tokens[:-1]) >= 0)]  # one end says as much as many
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").slice(i, 1), batch.column("lang").slice(i, 1), pa.array([every.take(pa.array(frequent)).to_pylist()], pa.list_(pa.binary())),
                 pa.array([packed([tokens])], pa.binary())], ["block", "lang", "symbols", "tokens"])


@dataclass(frozen=True)
class Pairs:
    """How neighbouring words are counted before any transducer is built: by hashes of ``bits`` bits, dealt into ``deals`` spans.

    Pairs of one hash are counted together, so a frequent pair is never missed; the width grows with the corpus to keep that rare.
    """

    deals: int
    bits: int

    def of(self, lang: str, symbols: list[bytes], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the distinct pairs in ascending order, their counts, for each token the place of the pair that it begins or -1,
        where each span begins)."""
        width = len(symbols)
        met = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
        codes, back, counts = np.unique(tokens[:-1][met] * width + tokens[1:][met], return_inverse=True, return_counts=True)
        word = np.fromiter(map(xxh3_64_intdigest, symbols), np.uint64, width)
        first, second = (word[codes // width], word[codes % width]) if width else (word, word)
        own = np.uint64(xxh3_64_intdigest(lang))
        hashes = mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second + own)) >> np.uint64(64 - self.bits)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.full(len(tokens), -1, np.int64)
        starts[:-1][met] = place[back]
        hashes = hashes[order].astype(np.int64)
        span = -(-(1 << self.bits) // self.deals)
        return hashes, counts[order], starts, np.searchsorted(hashes, np.arange(self.deals + 1) * span)

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches (block, lang, symbols, tokens) -> (deal, block, pairs): the block's hashes and counts of each span."""
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, counts, _, edges = self.of(batch.column("lang")[i].as_py(), batch.column("symbols")[i].as_py(), unpacked(batch.column("tokens")[i].as_py())[0])
                deals = np.flatnonzero(np.diff(edges))
                if len(deals):
                    blobs = [packed([hashes[edges[d]:edges[d + 1]], counts[edges[d]:edges[d + 1]]]) for d in deals]
                    yield pa.RecordBatch.from_arrays([pa.array(deals, pa.int64()), pa.array([batch.column("block")[i].as_py()] * len(deals), pa.int64()), pa.array(blobs, pa.binary())],
                                                     ["deal", "block", "pairs"])


def _common(least: int):
    """Batches (deal, block, pairs) sorted by deal -> (block, deal, bits): which pairs of each block occur ``least`` times in all blocks."""
    def finish(deal: int, held: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        hashes = np.concatenate([pairs[0] for _, pairs in held])
        _, back = np.unique(hashes, return_inverse=True)
        totals = np.zeros(int(back.max()) + 1, np.int64)
        np.add.at(totals, back, np.concatenate([pairs[1] for _, pairs in held]))
        often = np.split(totals[back] >= least, np.cumsum([len(pairs[0]) for _, pairs in held])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([deal] * len(held), pa.int64()),
                                           pa.array([np.packbits(x).tobytes() for x in often], pa.binary())], ["block", "deal", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for deal, block, pairs in zip(batch.column("deal").to_pylist(), batch.column("block").to_pylist(), batch.column("pairs")):
                if held and deal != key:
                    yield finish(key, held)
                    held = []
                key = deal
                held.append((block, unpacked(pairs.as_py())))
        if held:
            yield finish(key, held)
    return run


def _counted(ranges: Ranges, pairs: Pairs):
    """Batches (lang, symbols, tokens, common) -> one transducer a row for each range that the block meets.

    A phrase of ``least`` occurrences holds only pairs of as many, so n-grams with a rarer pair are not built. Words count alone too.
    """
    def grams(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alone = np.bincount(tokens[tokens >= 0])
        used, starts = np.flatnonzero(alone), tokens >= 0
        rows, counts = [np.stack([used] + [np.full(len(used), -1)] * (MOST - 1), axis=1)], [alone[used]]
        for n in range(2, MOST + 1):
            starts = starts[:-1] & common[n - 2:len(tokens) - 1]  # the n-gram's last pair begins n - 2 further on
            at = np.flatnonzero(starts)
            rows.append(np.stack([tokens[at + k] for k in range(n)] + [np.full(len(at), -1)] * (MOST - n), axis=1))
            counts.append(np.ones(len(at), np.int64))
        return summed(np.concatenate(rows), np.concatenate(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, symbols = batch.column("lang")[i].as_py(), batch.column("symbols")[i].as_py()
                tokens = unpacked(batch.column("tokens")[i].as_py())[0]
                hashes, _, starts, edges = pairs.of(lang, symbols, tokens)
                often = np.zeros(len(hashes) + 1, bool)  # the last, for no pair, stays false
                for told in batch.column("common")[i].as_py() or []:
                    lo, hi = edges[told["deal"]], edges[told["deal"] + 1]
                    often[lo:hi] = np.unpackbits(np.frombuffer(told["bits"], np.uint8), count=hi - lo)
                rows, counts = grams(tokens, often[starts])
                if not len(rows):
                    continue
                codes = ranges.codes(symbols)
                where = ranges.of(codes, rows[:, 0], rows[:, 1])
                order = np.argsort(where, kind="stable")  # n-grams stay sorted inside a range
                rows, counts, where = rows[order], counts[order], where[order]
                cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
                for lo, hi in zip(cuts, cuts[1:]):
                    some = rows[lo:hi]
                    used, back = np.unique(np.append(some.reshape(-1), -1), return_inverse=True)
                    yield _row(lang, int(where[lo]), Transducer.build([symbols[k] for k in used[1:]], back[:-1].reshape(-1, MOST) - 1, counts[lo:hi]))
    return run


def _united(least: int, at_once: int = 4):
    """Batches of transducers sorted by (lang, prefix_range) -> one for each range: the union, of counts of ``least`` or more.

    A few are held at a time; unions of as many parts each are united again, so each count is handled log n times.
    """
    def finish(key: tuple, held: list[Transducer]) -> pa.RecordBatch:
        whole = united(held)
        grams, counts = whole.grams()
        often = counts >= least
        used, back = np.unique(np.append(grams[often].reshape(-1), -1), return_inverse=True)
        part = Transducer.build([whole.symbols[k] for k in used[1:]], *summed(back[:-1].reshape(-1, MOST) - 1, counts[often]))
        return _row(key[0], key[1], part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[list[Transducer]] = []
        key = None
        for batch in batches:
            for i in range(batch.num_rows):
                now, part = _read(batch, i)
                if levels and now != key:
                    yield finish(key, [p for held in levels for p in held])
                    levels = []
                key = now
                for k in range(len(levels) + 1):
                    if k == len(levels):
                        levels.append([])
                    levels[k].append(part)
                    if len(levels[k]) < at_once:
                        break
                    part, levels[k] = united(levels[k]), []
        if levels:
            yield finish(key, [p for held in levels for p in held])
    return run


def _candidates(ranges: Ranges):
    """Batches of united transducers -> (lang, phrase, size, a, slot, part, prefix_range): each candidate once for each part."""
    out_schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("a", pa.int64()), ("slot", pa.int32()), ("part", pa.list_(pa.binary())),
                            ("prefix_range", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (language, _), own = _read(batch, i)
                grams, counts = own.grams()
                codes = ranges.codes(own.symbols)
                for size in range(2, MOST + 1):
                    mine = (grams >= 0).sum(axis=1) == size
                    rows, a = grams[mine], counts[mine]
                    for at in range(0, len(rows), 20_000):
                        some, n = rows[at:at + 20_000], a[at:at + 20_000]
                        spelled = [[own.symbols[k] for k in r[:size]] for r in some]
                        phrases = [b" ".join(p).decode() for p in spelled]
                        for cut in range(1, size):
                            for slot, (lo, hi) in ((2 * cut, (0, cut)), (2 * cut + 1, (cut, size))):
                                second = some[:, lo + 1] if hi - lo > 1 else np.full(len(some), -1)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([language] * len(some)), pa.array(phrases), pa.array([size] * len(some), pa.int32()), pa.array(n, pa.int64()),
                                     pa.array([slot] * len(some), pa.int32()), pa.array([p[lo:hi] for p in spelled], pa.list_(pa.binary())),
                                     pa.array(ranges.of(codes, some[:, lo], second), pa.int64())], schema=out_schema)
    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (lang, prefix_range, kind): a range's transducer, then what is asked of it -> (lang, phrase, size, a, slot, f)."""
    own = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            some = batch.slice(lo, hi - lo)
            if hi > lo and kinds[lo] == 0:
                key, own = _read(some, some.num_rows - 1)  # ranges before the last have no requests
            elif hi > lo:
                keys = list(zip(some.column("lang").to_pylist(), some.column("prefix_range").to_pylist()))
                assert keys[0] == keys[-1] == key, "requests follow their own range"
                found = own.compose(some.column("part").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("lang", "phrase", "size", "a", "slot")] + [pa.array(found, pa.int64())],
                                                 ["lang", "phrase", "size", "a", "slot", "f"])


def collocations(docs: DataFrame, config: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words of ``docs`` (lang, text).

    Texts are lower-cased (A-Z), parted at ``.,;:!?`` and line ends, and split at blanks and tabs. ``a`` counts a phrase's occurrences
    inside pieces, ``l`` and ``r`` those of its two parts, ``n`` all words of the language. Of the ways to cut a phrase in two that of the
    lowest floor(10^6 a a / (l r)) counts, of equals the one with the shorter first part. Phrases below ``least`` are no candidates;
    one inside a longer candidate of ``within`` percent of its count or more is dropped. Ranked by score, count and phrase.

    A null lang is ``und``; a null or empty text has no words; repeated rows count again; an empty table gives no rows; other
    columns are ignored. Words of fewer than ``least`` occurrences, found by counting the hashes of all, are part of no candidate and
    are left out of the transducers, and so are n-grams with a rarer pair of words; each block is told which of its own words and
    pairs are frequent, so no list of all is held anywhere. A rare word or pair that shares its hash with others may stay in;
    counts are of words and phrases, so results do not change.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = stage(rows.mapInArrow(_blocks(config), "block long, lang string, words array<binary>, counts array<long>, tokens binary"), "blocks")
    listed = (blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
              .select("block", "lang", "place", F.col("w.counts").alias("n"), F.xxhash64("lang", "w.words").alias("h"), F.substring("w.words", 1, 2).alias("k")))
    totals = stage(listed.groupBy("lang", "k").agg(F.sum("n").alias("n")), "totals")
    histogram = totals.groupBy("k").agg(F.sum("n").alias("n")).collect()  # two bytes: 65,792 rows at most
    ranges = Ranges([(bytes(r.k), r.n) for r in histogram], config.range_words)

    often = stage(listed.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= config.least).select("h"), "often")
    told = listed.select("block", "place", "h").join(often, "h").groupBy("block").agg(F.collect_list("place").alias("frequent"))
    kept = stage(blocks.select("block", "lang", "words", "tokens").join(told, "block").mapInArrow(_kept, "block long, lang string, symbols array<binary>, tokens binary"), "kept")
    pairs = Pairs(ranges.count, min(62, max(40, sum(r.n for r in histogram).bit_length() + 14)))
    common = (kept.mapInArrow(pairs.dealt, "deal long, block long, pairs binary").repartition("deal").sortWithinPartitions("deal")
              .mapInArrow(_common(config.least), "block long, deal long, bits binary").groupBy("block").agg(F.collect_list(F.struct("deal", "bits")).alias("common")))
    made = kept.join(common, "block", "left").select("lang", "symbols", "tokens", "common").mapInArrow(_counted(ranges, pairs), PARTS)
    held = stage(made.repartition("lang", "prefix_range").sortWithinPartitions("lang", "prefix_range").mapInArrow(_united(config.least), PARTS), "ranges")

    asked = held.mapInArrow(_candidates(ranges), "lang string, phrase string, size int, a long, slot int, part array<binary>, prefix_range long")
    both = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    found = stage(both.repartition("lang", "prefix_range").sortWithinPartitions("lang", "prefix_range", "kind")
                  .mapInArrow(_looked_up, "lang string, phrase string, size int, a long, slot int, f long"), "parts")

    at = lambda k: F.max(F.when(F.col("slot") == k, F.col("f"))).alias(f"f{k}")
    wide = found.groupBy("lang", "phrase", "size", "a").agg(*[at(k) for k in range(2, 2 * MOST)])
    ratio = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast({0} as decimal(19,0)) * cast({1} as decimal(19,0)))"
    cut = lambda k: F.struct(F.expr(ratio.format(f"f{2 * k}", f"f{2 * k + 1}")).alias("score"), F.lit(k).alias("k"),
                             F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))
    cuts = F.filter(F.array(*[F.when(F.col("size") > k, cut(k)) for k in range(1, MOST)]), lambda c: c.isNotNull())
    scored = stage(wide.withColumn("c", F.array_min(cuts)).select("lang", "phrase", "size", "a", "c.score", "c.l", "c.r"), "scored")

    longer = scored.where("size > 2").select("lang", F.col("a").alias("more"), F.split("phrase", " ").alias("w"), "size")
    inner = longer.select("lang", "more", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    beaten = inner.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    left = scored.join(beaten, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("more") < config.within * F.col("a"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= config.top)
    total = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
