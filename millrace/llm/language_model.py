"""Scoring by a hierarchical Pitman-Yor language model.

Words are dishes. Every pair of words before a word has its own restaurant, all pairs with the same last word share
that word's restaurant as their parent, and those share one root, whose base is uniform over the known words and an
unknown one. A dish's tables in a restaurant are its customers in the parent. A Gibbs step takes a dish's tables out of
its restaurant and of the parents, and draws how many it has from the conditional, in which seatings with as many tables
are summed up by generalised Stirling numbers. A sweep draws all dishes from the totals of the sweep before; then all
totals are exchanged. After BURN_IN sweeps, SAMPLES more are drawn from the same totals, and predictive probabilities
are averaged over them. Draws are seeded by the words and the sweep, and totals are sums over all of training, so the
scores depend neither on partitions nor on order.

Tasks ask, once for each distinct (word before that, word before, word) of a chunk of texts, the bucket of the word
before; a bucket holds whole restaurants and their parents. A frequent word before, found in a bounded sample, is dealt
by (word before, word), and its restaurants' totals are exchanged like those of the root: this is routing only. Each
word, and each restaurant so split, has an owner that adds up its totals. Messages are compressed arrays; texts are not
shuffled, and buckets answer with each document's sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, fold, mixed, pack, partitions, trim, unpack, words_of

LEAF, MIDDLE, ROOT = (0.8, 0.5), (0.75, 0.5), (0.6, 1.0)  # discount and strength of the restaurants of pairs, of words, of the root
BURN_IN, SAMPLES, SEED = 3, 3, 11
EXACT = 512  # customers up to which Stirling numbers come from their table; beyond, from their saddle points
CHUNK = 12 << 20  # bytes of texts that ask together
HEAVY = 32  # documents of a chunk from which a bucket answers an entry's probability rather than the documents' sums
SAMPLE_DOCUMENTS, COMMON = 8_000, 1 << 18  # words are coded, and frequent ones dealt, by what a sample shows
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SALT, _ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
# what a row holds
ASK, DOCS, IDS, LISTS, STATE, SUMS, OWN, LOCAL, FRESH, PART, ALL, KNOWN, FINAL, HEAVIES, CORE = range(15)
MESSAGE = "dest long, src long, kind int, blob binary"


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, an end behind each, and each token's text."""
    words, owner, k = [], [], 0
    raws = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
    while k < len(raws):
        size, first = 0, k
        while k < len(raws) and (k == first or size + len(raws[k]) < PIECE):
            size += len(raws[k]) + 1
            k += 1
        h, at = words_of(b"\n".join(raws[first:k]))
        starts = np.cumsum([0] + [len(r) + 1 for r in raws[first : k - 1]])
        words.append(h)
        owner.append(np.searchsorted(starts, at, side="right") - 1 + first)
    h, doc = (np.concatenate(x) for x in (words, owner)) if words else (np.empty(0, np.uint64), np.empty(0, np.int64))
    n = len(raws)
    all_words, all_docs = np.full(len(h) + n, END), np.empty(len(h) + n, np.int64)
    at = np.arange(len(h)) + doc
    ends = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    all_words[at], all_docs[at], all_docs[ends] = h, doc, np.arange(n)
    return all_words, all_docs


def _before(x: np.ndarray, doc: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that, `start` beyond a text's beginning."""
    one, two = (np.concatenate([np.full(k, start, x.dtype), x[:-k]])[: len(x)] for k in (1, 2))
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(x)])
    one[first] = two[first] = start
    second = first + 1
    two[second[second < len(x)]] = start
    return one, two


# draws


@cache
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: seatings of c customers at t tables."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[1, 1] = 0
    t = np.arange(EXACT + 2)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(s[n] > -np.inf, np.log(np.maximum(n - discount * t, 1e-300)) + s[n], -np.inf)
        s[n + 1, 1:] = np.logaddexp(stay[1:], s[n, :-1])
    return s


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series eight further on."""
    x = np.asarray(x, float)
    y, product = x + 8, x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _ratio(s: np.ndarray, d: float) -> np.ndarray:
    """log (n / t) of the saddle point at s = -log(1 - x)."""
    return np.log(-np.expm1(-s)) + math.log(d) - s * (d - 1) - np.log(-np.expm1(-d * s))


@cache
def _saddle_points(d: float) -> tuple[np.ndarray, np.ndarray]:
    s = np.geomspace(1e-9, 700, 4096)
    return _ratio(s, d), np.log(s)


def _saddle(n: float, t: np.ndarray, d: float) -> np.ndarray:
    """log of n! / (t! d^t) [x^n] (1 - (1 - x)^d)^t at the saddle point, for t below n."""
    ratio, at = _saddle_points(d)
    s = np.exp(np.interp(np.log(n / t), ratio, at))
    for _ in range(2):
        y = np.exp(-s)
        slope = y / -np.expm1(-s) - (d - 1) - d * np.exp(-d * s) / -np.expm1(-d * s)
        s = np.maximum(s - (_ratio(s, d) - np.log(n / t)) / np.maximum(slope, 1e-12), s / 2)
    x, f = -np.expm1(-s), -np.expm1(-d * s)
    one = d * np.exp(-s * (d - 1)) / f  # f'/f
    two = d * (1 - d) * np.exp(-s * (d - 2)) / f
    spread = t * (x * one + x * x * (two - one * one))
    return _lgamma(np.array([n + 1.0])) - _lgamma(t + 1) - t * math.log(d) + t * np.log(f) - n * np.log(x) - 0.5 * np.log(2 * math.pi * spread)


@cache
def _saddle_error(d: float) -> tuple[np.ndarray, np.ndarray]:
    """What the saddle point misses at EXACT customers, by log t."""
    t = np.arange(1, EXACT).astype(float)
    return np.log(t), _saddle(EXACT, t, d) - _stirling(d)[EXACT, 1:EXACT]


def stirling_beyond(n: int, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of more than EXACT customers.

    The saddle point's error depends on t / n^d where it matters, so that it is known from EXACT customers.
    """
    t = np.minimum(np.asarray(t, float), n - 1)
    at, error = _saddle_error(d)
    x = np.log(t) + d * math.log(EXACT / n)
    return _saddle(n, t, d) - np.where(x < 0, error[0] + x * (error[1] - error[0]) / at[1], np.interp(x, at, error))


def _steps(x: np.ndarray) -> np.ndarray:
    x = np.round(x).astype(np.int64)
    return x[np.append(True, x[1:] > x[:-1])]


def _draw_large(c: int, u: float, a: float, d: float, g: float, h: float, step: int) -> int:
    """As draw_tables, for one dish of many customers: intervals of counts, then evenly within one."""

    def log_p(t: np.ndarray) -> np.ndarray:
        more = (t - 1) * math.log(d) + _lgamma(a / d + t) - _lgamma(np.array([a / d + 1]))
        if step:
            return stirling_beyond(c, t, d) + more + _lgamma(g + t) - _lgamma(np.array([g + 1.0])) - _lgamma(h + t) + _lgamma(np.array([h + 1.0]))
        return stirling_beyond(c, t, d) + more + (t - 1) * (math.log(g / h) if g > 0 else -1e9)

    t = _steps(np.geomspace(1, c, 256))
    p = log_p(t.astype(float))
    some = np.flatnonzero(p > p.max() - 40)
    low, high = int(t[max(some[0] - 1, 0)]), int(t[min(some[-1] + 1, len(t) - 1)])
    t = _steps(np.linspace(low, high, min(513, high - low + 1)))
    p = log_p(t.astype(float))
    width = np.diff(np.append(t, high + 1))
    p = np.cumsum(np.exp(p - p.max()) * width)
    u *= p[-1]
    k = min(int(np.searchsorted(p, u, side="right")), len(t) - 1)
    before = p[k - 1] if k else 0.0
    return int(t[k] + min(width[k] - 1, int(width[k] * (u - before) / (p[k] - before))))


def draw_tables(c: np.ndarray, u: np.ndarray, a: np.ndarray, d: float, g: np.ndarray, h: np.ndarray, step: int = 1) -> np.ndarray:
    """Tables of dishes with c customers, by the even numbers u: p(t) ~ S(c, t) prod (a + d i) (step i + g) / (step i + h)
    over i from 1 to t - 1: a is the restaurant's strength and tables without this dish's, and the fraction the parent's
    probability of the dish after i more tables of it."""
    t = np.minimum(c, 1)
    s = _stirling(d)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    end = np.searchsorted(c[order], EXACT, side="right")
    sizes, start = np.unique(c[order[:end]], return_index=True)
    edges = np.append(start, end)
    for n, i, j in zip(sizes.tolist(), edges[:-1], edges[1:], strict=True):
        rows = max(1, (1 << 19) // n)
        for lo in range(i, j, rows):
            x, k = order[lo : min(j, lo + rows)], np.arange(1, n)
            with np.errstate(divide="ignore"):
                p = np.log(a[x, None] + d * k) + np.log(step * k + g[x, None]) - np.log(step * k + h[x, None])
            p = s[n, 1 : n + 1] + np.concatenate([np.zeros((len(x), 1)), np.cumsum(p, axis=1)], axis=1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[x] = 1 + (p[:, :-1] < (u[x] * p[:, -1])[:, None]).sum(axis=1)
    for x in order[end:].tolist():
        t[x] = _draw_large(int(c[x]), float(u[x]), float(a[x]), d, float(g[x]), float(h[x]), step)
    return t


def even(keys: np.ndarray, sweep: int, level: int) -> np.ndarray:
    """A number in [0, 1) for each key, sweep and level."""
    step = np.uint64((4 * sweep + level + 1) * int(_ONE) & (1 << 64) - 1)
    return (mixed(mixed(keys + np.uint64(SEED)) + step) >> np.uint64(11)).astype(float) * 2.0**-53


def pair_key(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(first + _ONE) ^ word)


def leaf_key(second: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(second + _TWO) ^ pair_key(first, word))


# asking


def _edges(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """owner, first and last place of each run of a sorted array of owners."""
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    return list(zip(owner[at].tolist(), at.tolist(), np.append(at[1:], len(owner)).tolist(), strict=True))


class Coder:
    """Words as numbers: frequent ones, `common`, by their rank in a sample, others by their place in a list of their own."""

    def __init__(self, common: np.ndarray):
        self.common, self.size = common, len(common)
        self.rank = np.argsort(common, kind="stable")
        self.ordered = common[self.rank]

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """-1 for words that are not frequent."""
        if not self.size:
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.ordered, words), self.size - 1)
        return np.where(self.ordered[at] == words, self.rank[at], -1)


def _keys(first: np.ndarray, second: np.ndarray, third: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of triples of numbers below `bound`, and where another triple begins."""
    if bound < 1 << 21:
        key = first.astype(np.uint64) << np.uint64(42)
        key |= second.astype(np.uint64) << np.uint64(21)
        key |= third.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])[: len(key)]
    order = np.lexsort((third, second, first))
    return order, np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0) | (np.diff(third[order]) != 0))[: len(order)]


def asks(texts: list[str | None], train: np.ndarray, coder: Coder, hot: np.ndarray, n: int, chunk: int, heavy_from: int) -> list[tuple]:
    """What a chunk of texts asks each bucket, and what it keeps for itself: tokens of each text, entries in many texts."""
    w, doc = tokens(texts)
    words, x = np.unique(np.append(w, START), return_inverse=True)
    del w
    x, doc = x.astype(np.int32), doc.astype(np.int32)
    sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    start, x = x[-1], x[:-1]
    one, two = _before(x, doc, start)
    order, entry = _keys(one, x, two, len(words))
    at = np.flatnonzero(entry)
    first = order[at]
    one, x, two = one[first], x[first], two[first]
    of, doc_of = (np.cumsum(entry) - 1).astype(np.int32), doc[order]
    del order, doc, first
    many = np.diff(np.append(at, len(of)))
    again = np.flatnonzero(many[of] > 1)  # tokens of entries that occur again, by document
    doc_of[again] = doc_of[again][np.lexsort((doc_of[again], of[again]))]
    place = np.flatnonzero(entry | np.append(True, doc_of[1:] != doc_of[:-1])[: len(of)])
    pair_entry, pair_doc, pair_n = of[place], doc_of[place], np.diff(np.append(place, len(of))).astype(np.int32)
    del of, doc_of, again, place, entry
    c = np.bincount(pair_entry, weights=pair_n * train[pair_doc], minlength=len(at)).astype(np.int32)
    many = np.bincount(pair_entry, minlength=len(at)).astype(np.int32)
    heavy = many >= heavy_from
    spread = words[one] ^ np.where(np.isin(words, hot)[one], mixed(words[x] + np.uint64(1)), np.uint64(0))
    bucket = (mixed(spread + _SALT) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int32)  # short ones sort faster
    order = np.argsort(bucket, kind="stable")
    own, dense = bucket[pair_entry], heavy[pair_entry]
    light, dense = np.flatnonzero(~dense), np.flatnonzero(dense)
    light, dense = light[np.argsort(own[light], kind="stable")], dense[np.argsort(own[dense], kind="stable")]
    lights = {b: (i, j) for b, i, j in _edges(own[light])}
    ranks, number = coder.ranks(words), np.empty(len(words), np.int32)
    out, flags = [], np.zeros(len(words), bool)
    for b, i, j in _edges(bucket[order]):
        own = order[i:j]
        ids = np.concatenate([one[own], x[own], two[own]])
        if len(ids) * 8 > len(words):
            flags[:] = False
            flags[ids] = True
            used = np.flatnonzero(flags)
        else:
            used = np.unique(ids)
        local = used[ranks[used] < 0]
        number[used] = ranks[used]
        number[local] = coder.size + np.arange(len(local))
        a, e, f = number[one[own]], number[x[own]], number[two[own]]
        head = np.append(True, a[1:] != a[:-1])
        lo, hi = lights.get(b, (0, 0))
        pairs = light[lo:hi]
        runs = np.diff(np.append(np.flatnonzero(head), len(own))).astype(np.int32)
        out.append((b, chunk, ASK, pack(words[local], a[head], runs, e, f, c[own], np.where(heavy[own], 0, many[own]).astype(np.int32), pair_doc[pairs], pair_n[pairs])))
    home = int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(n))
    out.append((home, chunk, DOCS, pack(sizes, many[order[heavy[order]]], pair_doc[dense], pair_n[dense])))
    return out


def _asker(shared, n: int, schema: pa.Schema, chunk: int, heavy: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size, k = TaskContext.get().partitionId() << 32, [], 0, 0
        coder, hot = shared.value

        def flush():
            nonlocal held, size, k
            table = pa.Table.from_batches(held)
            rows = asks(table["text"].to_pylist(), table["train"].to_numpy().astype(float), coder, hot, n, base + k, heavy)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([table.schema.field("doc_id")]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.select(["doc_id"]))
            rows.append((rows[-1][0], base + k, IDS, sink.getvalue().to_pybytes()))
            held, size, k = [], 0, k + 1
            del table
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema, strict=True)], schema=schema)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            lo = 0
            while lo < len(lengths):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]) + size, chunk, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(lengths[lo:hi].sum())
                lo = hi
                if size >= chunk or lo < len(lengths):
                    yield from flush()
        if held:
            yield from flush()
        trim()

    return ask


# buckets


class Bucket:
    """All entries of a bucket: leaves (first, word, second), their pairs (first, word), their words."""

    def __init__(self, rows: pd.DataFrame, coder: Coder, hot: np.ndarray, n: int):
        rows = rows[rows["kind"] == ASK].sort_values("src")
        parts = [unpack(b) for b in rows["blob"]]
        cat = lambda k, t: np.concatenate([np.empty(0, t), *(p[k] for p in parts)])
        self.chunks = list(zip(rows["src"].tolist(), [len(p[3]) for p in parts], [len(p[7]) for p in parts], strict=True))
        self.words = np.unique(np.concatenate([coder.common, *(p[0] for p in parts)]))
        common = np.searchsorted(self.words, coder.common)
        at = [np.concatenate([common, np.searchsorted(self.words, p[0])]).astype(np.int32) for p in parts]
        one = np.concatenate([np.empty(0, np.int32), *(np.repeat(x[p[1]], p[2]) for x, p in zip(at, parts, strict=True))])
        word, two = (np.concatenate([np.empty(0, np.int32), *(x[p[k]] for x, p in zip(at, parts, strict=True))]) for k in (3, 4))
        given = [cat(k, np.int32) for k in (5, 6, 7, 8)]
        del parts, at
        order, new = _keys(one, word, two, len(self.words))
        self.leaf_of = np.empty(len(order), np.int32)
        self.leaf_of[order] = np.cumsum(new) - 1
        of = order[new]
        first, word, self.second = (v[of] for v in (one, word, two))
        del one, two, order
        c, self.many, self.pair_doc, self.pair_n = given
        self.c = np.bincount(self.leaf_of, weights=c, minlength=len(of)).astype(np.int64)
        new = np.append(True, (first[1:] != first[:-1]) | (word[1:] != word[:-1]))[: len(of)]
        self.pair_of = (np.cumsum(new) - 1).astype(np.int32)
        self.first, self.word = first[new], word[new]
        left, left_of = np.unique(first.astype(np.int64) << 32 | self.second, return_inverse=True)
        self.left_of = left_of.astype(np.int32)
        self.c2 = np.bincount(self.left_of, weights=self.c, minlength=len(left)).astype(np.int64)
        self.total = np.bincount(self.pair_of, weights=self.c, minlength=len(self.first)).astype(np.int64)
        used = np.zeros((2, len(self.words)), bool)
        used[0, self.word] = used[1, self.first] = True
        split = np.isin(self.words, hot)
        self.lists = []  # what is shared with owners: places and keys, by owner and key
        for places, keys in (
            (x := np.flatnonzero(used[0]), self.words[x]),
            (x := np.flatnonzero(used[1] & split), self.words[x]),
            (x := np.flatnonzero(split[left >> 32]), mixed(mixed(self.words[left[x] & 0xFFFFFFFF] + _TWO) ^ self.words[left[x] >> 32])),
        ):
            owner = (mixed(keys ^ _SALT) % np.uint64(n)).astype(np.int64)
            order = np.lexsort((keys, owner))
            self.lists.append((places[order], keys[order], owner[order]))
        self.owners = np.unique(np.concatenate([o for *_, o in self.lists]))
        self.cuts = [np.searchsorted(o, np.append(self.owners, n)) for *_, o in self.lists]

    def dealt(self, arrays: list[tuple[int, np.ndarray]], me: int) -> list[tuple]:
        """Rows for the owners: arrays with the number of their list, cut."""
        return [(o, me, LISTS, pack(*(v[self.cuts[k][i] : self.cuts[k][i + 1]] for k, v in arrays))) for i, o in enumerate(self.owners.tolist())]

    def tables(self, t2: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all leaves and pairs, from those that are drawn."""
        full2 = np.minimum(self.c, 1)
        full2[self.c > 1] = t2
        full1 = np.minimum(self.total, 1)
        full1[self.total > 1] = t1
        return full2, full1

    def totals(self, t2: np.ndarray, t1: np.ndarray, replies: list[np.ndarray]) -> dict:
        """k of pairs, K and T1 of words before, T2 of their pairs; m and r of words: of all buckets, where shared."""
        total = lambda of, v, size: np.bincount(of, weights=v, minlength=size).astype(np.int64)
        k, words = total(self.pair_of, t2, len(self.first)), len(self.words)
        out = {"m": np.zeros(words, np.int64), "r": np.zeros(words, np.int64), "k": k, "K": total(self.first, k, words), "T1": total(self.first, t1, words), "T2": total(self.left_of, t2, len(self.c2))}
        for name, of, values in zip(NAMES, SETS, replies, strict=True):
            out[name][self.lists[of][0]] = values
        return out

    def core(self) -> bytes:
        """What sweeps need: leaves and pairs with more than one customer, and how much the others add to each total."""
        pairs, leaves = np.flatnonzero(self.total > 1), np.flatnonzero(self.c > 1)
        single = self.c == 1
        alone = self.total == 1
        place = np.empty(len(self.first), np.int64)
        place[pairs] = np.arange(len(pairs))
        m = np.bincount(self.word[alone], minlength=len(self.words))
        K = np.bincount(self.first[alone], minlength=len(self.words))
        T2 = np.bincount(self.left_of[single], minlength=len(self.c2))
        where = []
        for (places, *_), size in zip(self.lists, (len(self.words), len(self.words), len(self.c2)), strict=True):
            at = np.full(size, -1, np.int32)
            at[places] = np.arange(len(places))
            where.append(at)
        first, first_of = np.unique(self.first[pairs], return_inverse=True)
        word, word_of = np.unique(self.word[pairs], return_inverse=True)
        left, left_of = np.unique(self.left_of[leaves], return_inverse=True)
        second, second_of = np.unique(self.second[leaves], return_inverse=True)
        (words, *_), (ones, *_), (twos, *_) = self.lists
        i = lambda v: v.astype(np.int32)
        return pack(
            self.words[first], i(np.diff(first_of, prepend=0)), i(K[first]), where[1][first], self.words[word], i(word_of), where[0][word], i(np.bincount(self.pair_of[single], minlength=len(self.first))[pairs]),
            i(np.diff(place[self.pair_of[leaves]], prepend=0)), i(self.c[leaves]), i(left_of), i(T2[left]), where[2][left], self.words[second], i(second_of), i(m[words]), i(K[ones]), i(T2[twos]), i(self.owners), *(i(c) for c in self.cuts),
        )


NAMES, SETS = ("m", "r", "K", "T1", "T2"), (0, 0, 1, 1, 2)  # totals, and the list that each is shared by


class Core:
    """Leaves and pairs of a bucket whose tables are drawn."""

    def __init__(self, blob: bytes):
        x = unpack(blob)
        self.firsts, self.first, self.single_K, self.one_at, self.words, self.word, self.word_at, self.singles = x[0], np.cumsum(x[1]), *x[2:8]
        self.pair, self.c, self.left, self.single_T2, self.two_at, self.seconds, self.second = np.cumsum(x[8]), x[9].astype(np.int64), *x[10:15]
        self.m, self.K, self.T2, self.owners, self.cuts = *x[15:19], x[19:]
        self.pair_keys = pair_key(self.firsts[self.first], self.words[self.word])
        self.leaf_keys = mixed(mixed(self.seconds[self.second] + _TWO) ^ self.pair_keys[self.pair])

    def customers(self, t2: np.ndarray) -> np.ndarray:
        return self.singles + np.bincount(self.pair, weights=t2, minlength=len(self.first)).astype(np.int64)

    def own(self, t2: np.ndarray, t1: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        """This bucket's totals, and those that are shared, as the lists go."""
        total = lambda of, v, size: np.bincount(of, weights=v, minlength=size).astype(np.int64)
        k = self.customers(t2)
        K, T1, T2 = total(self.first, k, len(self.firsts)), total(self.first, t1, len(self.firsts)), total(self.left, t2, len(self.single_T2))
        shared = [self.m.astype(np.int64), self.K.astype(np.int64), self.K.astype(np.int64), self.T2.astype(np.int64)]
        shared[0][self.word_at] += total(self.word, t1, len(self.words))
        here = self.one_at >= 0
        shared[1][self.one_at[here]] += K[here]
        shared[2][self.one_at[here]] += T1[here]
        here = self.two_at >= 0
        shared[3][self.two_at[here]] += T2[here]
        return {"k": k, "K": self.single_K + K, "T1": self.single_K + T1, "T2": self.single_T2 + T2}, shared

    def all(self, sums: dict, replies: list[np.ndarray]) -> dict:
        """Totals of all buckets, where they are shared."""
        m, r, K, T1, T2 = replies
        one, two = self.one_at, self.two_at
        put = lambda own, at, given: np.where(at >= 0, given[np.maximum(at, 0)], own) if len(given) else own
        return {"m": m[self.word_at], "r": r[self.word_at], "k": sums["k"], "K": put(sums["K"], one, K), "T1": put(sums["T1"], one, T1), "T2": put(sums["T2"], two, T2)}

    def dealt(self, arrays: list[tuple[int, np.ndarray]], me: int) -> list[tuple]:
        return [(o, me, LOCAL, pack(*(v[self.cuts[k][i] : self.cuts[k][i + 1]].astype(np.int32) for k, v in arrays))) for i, o in enumerate(self.owners.tolist())]


def _replied(rows: pd.DataFrame, sets: int) -> list[np.ndarray]:
    """The owners' answers put together again."""
    rows = rows[rows["kind"] == OWN].sort_values("src")
    parts = [unpack(b) for b in rows["blob"]]
    return [np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in range(sets)]


def sweep(b: Core, t2: np.ndarray, t1: np.ndarray, x: dict, M: int, R: int, V: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws all tables anew from totals x that hold t2 and t1. Without a vocabulary V, the base counts for nothing."""
    (d2, s2), (d1, s1), (d0, s0) = LEAF, MIDDLE, ROOT
    base = 1 / (V + 1) if V else 0.0
    pair, first, word = b.pair, b.first[b.pair], b.word[b.pair]
    k = x["k"][pair] - t2
    kept = np.maximum(np.minimum(t1[pair], k), 1)
    moved = kept - t1[pair]
    m = x["m"][word] + moved
    r = np.minimum(x["r"][word], m)
    p = (m - d0 * r + (s0 + d0 * (R - x["r"][word] + r)) * base) / (s0 + M + moved)
    new2 = draw_tables(b.c, even(b.leaf_keys, number, 2), s2 + d2 * (x["T2"][b.left] - t2), d2, k - d1 * kept + (s1 + d1 * (x["T1"][first] + moved)) * p, s1 + x["K"][first] - t2)
    first, word = b.first, b.word
    m = x["m"][word] - t1
    r = np.maximum(np.minimum(x["r"][word], m), 1)
    new1 = draw_tables(b.customers(new2), even(b.pair_keys, number, 1), s1 + d1 * (x["T1"][first] - t1), d1, m - d0 * r + (s0 + d0 * (R - x["r"][word] + r)) * base, s0 + M - t1)
    return new2, new1


def _one(rows: pd.DataFrame, kind: int) -> list[np.ndarray]:
    found = rows.loc[rows["kind"] == kind, "blob"]
    return unpack(found.iloc[0]) if len(found) else []


def _lister(shared, n: int):
    """A bucket's first word to the owners: keys, training counts and the tables it begins with. To itself, its core."""

    def start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        coder, hot = shared.value
        b = Bucket(rows, coder, hot, n)
        known = np.bincount(b.word, weights=b.total, minlength=len(b.words)).astype(np.int32)
        (words, wk, _), (_, ok, _), (twos, tk, _) = b.lists
        core = b.core()
        c = Core(core)
        t2, t1 = np.ones(len(c.c), np.int64), np.ones(len(c.first), np.int64)
        m, K, T1, T2 = (v.astype(np.int32) for v in c.own(t2, t1)[1])
        out = b.dealt([(0, wk), (0, known[words]), (0, m), (1, ok), (1, K), (1, T1), (2, tk), (2, b.c2[twos].astype(np.int32)), (2, T2)], key[0])
        out.append((0, key[0], SUMS, pack(np.array([b.c.sum(), (b.total > 0).sum()], np.int64))))
        out.append((key[0], key[0], CORE, core))
        trim()
        return pd.DataFrame(out, columns=["dest", "src", "kind", "blob"])

    return start


def _sweeper(number: int, samples: int):
    """One sweep of a bucket, or several from the same totals."""

    def step(key: tuple, kept: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        me, out = key[0], []
        (all_,) = _one(rows, ALL)
        M, N, V, R = all_.tolist()
        core = kept.loc[kept["kind"] == CORE, "blob"]
        if len(core):
            b = Core(core.iloc[0])
            t2, t1 = _one(rows, STATE) or (np.ones(len(b.c), np.int64), np.ones(len(b.first), np.int64))
            t2, t1 = t2.astype(np.int64), t1.astype(np.int64)
            alone = int(b.m.sum())
            x = b.all(b.own(t2, t1)[0], _replied(rows, len(SETS)))
            drawn = [sweep(b, t2, t1, x, M, R, V, number + s) for s in range(samples)]
            out += b.dealt([(k, v) for d in drawn for k, v in zip((0, 1, 1, 2), b.own(*d)[1], strict=True)], me)
            out.append((me, me, STATE, pack(*(v.astype(np.int32) for d in drawn for v in d))))
            out.append((0, me, SUMS, pack(np.array([0, *(alone + d1.sum() for _, d1 in drawn)], np.int64))))
        out.append((me, me, KNOWN, pack(np.array([V, R, N], np.int64))))
        out += [(me, me, FINAL, v) for v in rows.loc[rows["kind"] == FINAL, "blob"]]  # the owner's own state
        parts = rows.loc[rows["kind"] == PART, "blob"]
        if len(parts):
            out.append((0, me, FRESH, pack(np.sum([unpack(p)[0] for p in parts], axis=0))))
        return pd.DataFrame(out, columns=["dest", "src", "kind", "blob"])

    return step


# owners


def _short(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32) if len(v) and v.max() < 1 << 31 else v


def _owner(n: int, number: int, samples: int, last: bool):
    """Adds up the totals of an owner's words and split restaurants, draws the root's tables, and answers the buckets."""

    def own(key: tuple, lists: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        me = key[0]
        listed = lists[lists["kind"] == LISTS].sort_values("src")
        parts = {s: unpack(v) for s, v in zip(listed["src"].tolist(), listed["blob"], strict=True)}
        cat = lambda k, t=np.int64: np.concatenate([np.empty(0, t), *(p[k] for p in parts.values())])
        merged = [np.unique(cat(k, np.uint64), return_inverse=True) for k in (0, 3, 6)]
        add = lambda of, v: np.bincount(merged[of][1], weights=v, minlength=len(merged[of][0])).astype(np.int64)
        counts = [add(0, cat(1)), add(2, cat(7))]
        words = merged[0][0]
        if number:
            local = rows[rows["kind"] == LOCAL]
            by = {s: unpack(v) for s, v in zip(local["src"].tolist(), local["blob"], strict=True)}
            given = [[np.concatenate([np.empty(0, np.int32), *(by[s][4 * j + k] for s in parts)]) for k in range(4)] for j in range(samples)]
        else:
            given = [[cat(2), cat(4), cat(5), cat(8)]]
        known, old = _one(rows, KNOWN), _one(rows, FINAL)
        V, R, N = known[0].tolist() if known else (0, 0, 0)
        answers, tables = [], []
        for j, (m, K, T1, T2) in enumerate(given):
            m, r = add(0, m), np.minimum(add(0, m), 1)
            if V and old:
                d, s = ROOT
                some = np.flatnonzero(m > 1)
                even_ = even(words[some], number + j, 0)
                one = np.ones(len(some))
                r[some] = draw_tables(m[some], even_, s + d * np.maximum(R - old[0][some], 0), d, one / (V + 1), one, step=0)
            answers.append([(0, m), (0, r), (1, add(1, K)), (1, add(1, T1)), (2, add(2, T2))])
            tables.append(r)
        flat = [v for a in answers for v in a] + ([(0, counts[0]), (2, counts[1])] if last else [])
        spread = [(k, _short(v)[merged[k][1]]) for k, v in flat]
        cuts = [np.cumsum([0] + [len(p[k]) for p in parts.values()]) for k in (0, 3, 6)]
        out = [(s, me, OWN, pack(*(v[cuts[k][i] : cuts[k][i + 1]] for k, v in spread))) for i, s in enumerate(parts)]
        out.append((0, me, PART, pack(np.array([(counts[0] > 0).sum(), *(r.sum() for r in tables)], np.int64))))
        out.append((me, me, FINAL, pack(tables[0].astype(np.int32))))
        out += [(me, me, STATE, v) for v in rows.loc[rows["kind"] == STATE, "blob"]]
        sums = pd.concat([lists, rows])
        sums = sums.loc[sums["kind"] == SUMS] if not number else rows.loc[rows["kind"] == SUMS]
        if me == 0:
            total = np.sum([unpack(v)[0] for v in sums["blob"]], axis=0)
            fresh = _one(rows, FRESH)
            V, *R = fresh[0].tolist() if fresh else (0, 0)
            all_ = pack(np.array([*total[1:], N + total[0], V, R[0]], np.int64))
            out += [(b, me, ALL, all_) for b in range(n)]
        return pd.DataFrame(out, columns=["dest", "src", "kind", "blob"])

    return own


def _relay(n: int):
    """Hands the last answers on, and to all buckets the sum of all owners' tables."""

    def relay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], s, k, v) for s, k, v in zip(rows["src"], rows["kind"], rows["blob"], strict=True) if k in (OWN, STATE, ALL)]
        parts = rows.loc[rows["kind"] == PART, "blob"]
        if key[0] == 0:
            total = pack(np.sum([unpack(p)[0] for p in parts], axis=0))
            out += [(b, 0, PART, total) for b in range(n)]
        return pd.DataFrame(out, columns=["dest", "src", "kind", "blob"])

    return relay


# scores


def probability(b: Bucket, t2: np.ndarray, t1: np.ndarray, x: dict, c2: np.ndarray, M: int, R: int, V: int) -> np.ndarray:
    """The predictive probability of each leaf's word, given all tables."""
    (d2, s2), (d1, s1), (d0, s0) = LEAF, MIDDLE, ROOT
    p = (x["m"] - d0 * x["r"] + (s0 + d0 * R) / (V + 1)) / (s0 + M)
    p = (x["k"] - d1 * t1 + (s1 + d1 * x["T1"][b.first]) * p[b.word]) / (s1 + x["K"][b.first])
    return (b.c - d2 * t2 + (s2 + d2 * x["T2"][b.left_of]) * p[b.pair_of]) / (s2 + c2[b.left_of])


def _answerer(shared, n: int):
    """Each chunk's sums over this bucket's tokens, by document; for entries in many documents, theirs."""

    def answer(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        me = key[0]
        out = [(s, me, k, v) for s, k, v in zip(asked["src"], asked["kind"], asked["blob"], strict=True) if k in (DOCS, IDS)]
        if (asked["kind"] == ASK).any():
            b = Bucket(asked, *shared.value, n)
            state, replies = _one(rows, STATE), _replied(rows, len(SETS) * SAMPLES + 2)
            known, c2 = np.zeros(len(b.words), np.int64), b.c2.copy()
            known[b.lists[0][0]], c2[b.lists[2][0]] = replies[-2:]
            ((*M, N, _, _),), ((V, *R),) = ([v.tolist() for v in _one(rows, kind)] for kind in (ALL, PART))
            score = np.zeros(len(b.c))
            for s in range(SAMPLES):
                t2, t1 = b.tables(state[2 * s], state[2 * s + 1])
                score += probability(b, t2, t1, b.totals(t2, t1, replies[5 * s : 5 * s + 5]), c2, M[s], R[s], V)
                del t2, t1
            score = np.log10(score / SAMPLES)
            del c2, state, replies
            known = known[b.word]
            base = np.log10((known + 0.5) / (N + 0.5 * (V + 1)))
            at = at_pair = 0
            for chunk, entries, pairs in b.chunks:
                leaf, q = b.leaf_of[at : at + entries], slice(at_pair, at_pair + pairs)
                many, pair = b.many[at : at + entries], b.pair_of[leaf]
                at, at_pair = at + entries, at_pair + pairs
                which, times = np.repeat(np.arange(entries), many), b.pair_n[q]
                docs, of = np.unique(b.pair_doc[q], return_inverse=True)
                add = lambda v: np.bincount(of, weights=v[which] * times, minlength=len(docs))  # noqa: B023, E731
                out.append((chunk, me, SUMS, pack(np.diff(docs, prepend=0).astype(np.int32), add(known[pair] > 0).astype(np.int32), add(base[pair]), add(score[leaf]))))
                heavy = np.flatnonzero(many == 0)
                if len(heavy):
                    out.append((chunk, me, HEAVIES, pack((known[pair[heavy]] > 0).astype(np.int32), base[pair[heavy]], score[leaf[heavy]])))
            out += [(s, me, ALL, pack(np.array([N], np.int64))) for s in sorted({c for c, *_ in b.chunks})]
            trim()
        return pd.DataFrame(out, columns=["dest", "src", "kind", "blob"])

    return answer


def _collect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's documents with the sums of all buckets."""
    size, many, pair_doc, pair_n = _one(rows, DOCS)
    (trained,) = _one(rows, ALL)
    total = np.zeros((3, len(size)))
    for kind, blob in rows.loc[rows["kind"] == SUMS, ["src", "blob"]].sort_values("src").itertuples(index=False):
        docs, *values = unpack(blob)
        total[:, np.cumsum(docs)] += np.stack(values)
    heavies = [unpack(v) for v in rows[rows["kind"] == HEAVIES].sort_values("src")["blob"]]
    if heavies:
        of = np.repeat(np.arange(len(many)), many)
        for k in range(3):
            total[k] += np.bincount(pair_doc, weights=np.concatenate([h[k] for h in heavies])[of] * pair_n, minlength=len(size))
    ids = pa.ipc.open_stream(rows.loc[rows["kind"] == IDS, "blob"].iloc[0]).read_all()["doc_id"]
    return pd.DataFrame({"doc_id": ids.to_pandas(), "n_tokens": size, "n_known": total[0].round().astype(np.int64), "train_tokens": int(trained[0]), "base_score": total[1], "score": total[2]})


def _frequent(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a bounded sample of documents: the COMMON most frequent words, those first, and words that make up at least
    1 / (4 buckets) of the tokens, 4 buckets at most."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, rows.count()))

    def count(batches):
        for batch in batches:
            w, n = np.unique(tokens(list(batch["text"]))[0], return_counts=True)
            yield pd.DataFrame({"w": np.append(w.view(np.int64), 0), "n": np.append(n, 0), "all": np.append(np.zeros(len(w), np.int64), n.sum())})

    found = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < round(share * (1 << 20))).select("text").mapInPandas(count, "w long, n long, all long")
    found = found.groupBy("w").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).where("n > 1 or all > 0").orderBy(F.desc("all"), F.desc("n"), "w").limit(COMMON + 1).toPandas()
    total = int(found["all"].sum())
    found = found[found["n"] > 0]
    words = found["w"].to_numpy(np.int64).view(np.uint64)
    return words, np.sort(words[found["n"].to_numpy() * 4 * buckets >= total])


def score(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each text, a row for each row.

    `train` is SQL for the rows to learn from, over docs' columns; null counts as false. A null or empty text is its end
    alone. Repeated rows are counted and scored each. Without training rows every token has the base's probability.
    Perplexity is 10 ** (-score / n_tokens). Memory is bounded by a chunk of texts or the longest, and by a bucket's
    entries.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    common, hot = _frequent(rows, n)
    shared = spark.sparkContext.broadcast((Coder(common), hot))
    schema = pa.schema([("dest", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
    asked = rows.mapInArrow(_asker(shared, n, schema, chunk, heavy), MESSAGE).groupBy("dest")
    lists = asked.applyInPandas(_lister(shared, n), MESSAGE).groupBy("dest")
    answers = lists.applyInPandas(_first(n), MESSAGE)
    for number in range(1, BURN_IN + 2):
        last = number > BURN_IN
        samples = SAMPLES if last else 1
        given = lists.cogroup(answers.groupBy("dest")).applyInPandas(_sweeper(number, samples), MESSAGE)
        answers = lists.cogroup(given.groupBy("dest")).applyInPandas(_owner(n, number, samples, last), MESSAGE)
    answers = answers.groupBy("dest").applyInPandas(_relay(n), MESSAGE)
    sums = asked.cogroup(answers.groupBy("dest")).applyInPandas(_answerer(shared, n), MESSAGE)
    return sums.groupBy("dest").applyInPandas(_collect, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _first(n: int):
    own = _owner(n, 0, 1, False)

    def first(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        return own(key, lists, lists.iloc[:0])

    return first


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    scored = score(docs, "not held_out")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.expr("pow(10d, -score / n_tokens)").alias("perplexity"))
