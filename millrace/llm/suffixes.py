"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Any two equal strings of `length` bytes hold an anchor at the same place: the k-mer of smallest hash. Anchors whose
hash occurs once are left out by a first exchange of sorted hashes. Of the others, the suffixes from the anchor on are
sorted: each task sorts its own into a run, joins equal ones, and exchanges the run front-coded, cut at common
splitters; the runs that meet in a range are merged by a loser tree that carries the length of the prefix each head
shares with the last output, so that no known prefix is compared again. The merge yields the common prefixes of
neighbours; together with the sorted bytes to the left they give each string's class, of which the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, pack, partitions, unpack

LENGTH = 100
KMER = 32
BATCH = 1 << 20  # bytes hashed together
RUN = 200_000  # suffixes sorted together
SAMPLE_DOCUMENTS = 2_000  # to choose splitters by, at most SAMPLE_SUFFIXES of each
SAMPLE_SUFFIXES = 64
_MULTIPLIERS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slid(x: np.ndarray, span: int, best) -> np.ndarray:
    """The best of each `span` neighbours, starting at every place where so many are left."""
    done = 1
    while 2 * done <= span:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (span - done)], x[span - done :]) if span > done else x


def anchors(raw: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of k-mers that are smallest in some window of `length` bytes; none in shorter input."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(raw) - 7
    words = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = np.frombuffer(raw, "<u8", (len(raw) - o) // 8, o)
        words[o::8] = part
    count = len(raw) - kmer + 1
    h = np.zeros(count, np.uint64)
    for k in range(kmer // 8):
        h += words[8 * k : 8 * k + count] * _MULTIPLIERS[k]
    h = mixed(h)
    window = length - kmer + 1
    low = _slid(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    high = _slid(np.concatenate((edge, low, edge)), window, np.maximum)
    at = np.flatnonzero(high == h)
    return at, h[at]


def _joined(texts: list[bytes], before: int, after: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts in one buffer with zeros around each; where each starts, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.append(before, sizes[:-1] + after + before)) if len(texts) else sizes
    return bytes(before) + bytes(after + before).join(texts) + bytes(after), starts, sizes


def _batched(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    """Columns of about BATCH bytes of text at a time; texts as bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch[c] for c in names), strict=True):
            raw = row[0].encode("utf-8", "surrogatepass") if isinstance(row[0], str) else b""
            held.append((raw, *row[1:]))
            size += len(raw)
            if size >= BATCH:
                yield tuple(zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def _hash_runs(buckets: int, length: int, kmer: int):
    """Sorted anchor hashes for each bucket; anchors that repeat within the run need no answer and go ahead as found."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        ids: list[tuple[int, int]] = []
        size = 0

        def run() -> pd.DataFrame:
            h, at, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, at, doc = h[order], at[order], doc[order]
            start = np.append(True, h[1:] != h[:-1])
            single = start & np.append(start[1:], True)
            keys, rows = np.array(ids, np.int64), []
            for first, chosen in ((True, single), (False, ~single)):
                # one of each repeated hash is sent along, to answer for it elsewhere
                for b, own in _by_bucket((h[chosen] if first else doc[chosen].astype(np.uint64)) % np.uint64(buckets), buckets):
                    x = np.flatnonzero(chosen)[own]
                    docs, local = np.unique(doc[x], return_inverse=True)
                    rows.append((b, 0 if first else 2, pack(h[x] if first else np.empty(0, np.uint64), local.astype(np.int32), at[x].astype(np.int32), keys[docs, 0], keys[docs, 1])))
            x = np.flatnonzero(start & ~single)
            for b, own in _by_bucket(h[x] % np.uint64(buckets), buckets):
                rows.append((b, 1, pack(h[x[own]])))
            return pd.DataFrame(rows, columns=["bucket", "kind", "blob"])

        for texts, key, sum_ in _batched(batches, ["text", "id", "sum"]):
            raw, starts, sizes = _joined(list(texts), 0, 0)
            at, h = anchors(raw, length, kmer)
            doc = np.searchsorted(starts, at, side="right") - 1
            at = at - starts[doc]
            inside = at + kmer <= sizes[doc]  # not those across two texts
            held.append((h[inside], at[inside], doc[inside] + len(ids)))
            ids.extend(zip(key, sum_, strict=True))
            size += int(inside.sum())
            if size > 8 * RUN:
                yield run()
                held, ids, size = [], [], 0
        if held:
            yield run()

    return runs


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a bucket whose hash another run has too, and those found before."""
    single = [unpack(b) for b in rows["blob"][rows["kind"] == 0]]
    more = [unpack(b)[0] for b in rows["blob"][rows["kind"] == 1]]
    found = [unpack(b) for b in rows["blob"][rows["kind"] == 2]]
    every = np.sort(np.concatenate([x[0] for x in single] + more + [np.empty(0, np.uint64)]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for h, local, at, ids, sums in single:
        k = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
        x = np.flatnonzero(again[k] == h) if len(again) else np.empty(0, np.int64)
        out.append((ids[local[x]], sums[local[x]], at[x]))
    out += [(ids[local], sums[local], at) for _, local, at, ids, sums in found]
    ids, sums, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    return pd.DataFrame({"id": ids, "sum": sums, "at": at})


def common_prefixes(m: np.ndarray) -> np.ndarray:
    """Of each row with the row before; 0 for the first."""
    if not len(m):
        return np.empty(0, np.int64)
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1]) if m.shape[1] else np.zeros(len(m) - 1, np.int64)
    return np.append(0, lcp)


def front_code(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted run's common prefixes, and the bytes behind them."""
    lcp = common_prefixes(m)
    return lcp.astype(np.uint8), m[np.arange(m.shape[1]) >= lcp[:, None]]


def front_decode(lcp: np.ndarray, tails: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= lcp[:, None].astype(np.int64)
    if len(own):
        own[0] = True
    place = np.where(own, np.cumsum(own.ravel()).reshape(own.shape) - 1, 0)
    return tails[np.maximum.accumulate(place, axis=0)] if len(own) else np.empty((0, width), np.uint8)


def merge_runs(runs: list[tuple[bytes, list[int]]], width: int) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of fixed-width strings with their common prefixes: run and place of each, and its common
    prefix with the one before.

    A loser tree: of two heads the one that shares more with the last output is smaller, and nothing is compared; only
    heads that share the same length are, from there on. The loser keeps how much it shares with the winner.
    """
    k = max(1, len(runs))
    leaves = 1 << (k - 1).bit_length()
    data = [r[0] for r in runs] + [b""] * (leaves - len(runs))
    steps = [r[1] for r in runs] + [[]] * (leaves - len(runs))
    count = [len(s) for s in steps]
    at = [0] * leaves
    shared = [0 if c else -1 for c in count]  # with the last output; -1 behind the end
    loser = [0] * leaves

    def settle(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        i, j = at[a] * width, at[b] * width
        p, q = data[a][i + x : i + width], data[b][j + x : j + width]
        if p == q:
            shared[max(a, b)] = width
            return (a, b) if a < b else (b, a)
        far = width - (((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) >> 3)
        if p < q:
            shared[b] = far
            return a, b
        shared[a] = far
        return b, a

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        win, loser[node] = settle(play(2 * node), play(2 * node + 1))
        return win

    win = play(1) if leaves > 1 else 0
    out_run, out_at, out_lcp = [], [], []
    for _ in range(sum(count)):
        out_run.append(win)
        out_at.append(at[win])
        out_lcp.append(shared[win])
        at[win] += 1
        shared[win] = steps[win][at[win]] if at[win] < count[win] else -1
        node = (win + leaves) >> 1
        while node:
            other = loser[node]
            x, y = shared[win], shared[other]
            if y > x:
                win, loser[node] = other, win
            elif x == y and x >= 0:
                win, loser[node] = settle(win, other)
            node >>= 1
    return out_run, out_at, out_lcp


def _suffix_runs(splitters: np.ndarray, length: int, kmer: int):
    """Sorted, front-coded runs of suffixes, cut at the splitters; equal ones are joined, all but the earliest as spans."""
    left, ranges = length - kmer, len(splitters) + 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def run() -> pd.DataFrame:
            m, ids, sums, at, has_left, has_right = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = np.ascontiguousarray(np.concatenate((m[:, left:], m[:, :left][:, ::-1]), axis=1))
            order = np.lexsort((at, sums, ids, has_right, has_left))  # stable below: of equal ones the earliest first
            order = order[np.argsort(whole[order].view(f"S{whole.shape[1]}").ravel(), kind="stable")]
            whole, ids, sums, at, has_left, has_right = (x[order] for x in (whole, ids, sums, at, has_left, has_right))
            same = (whole[1:] == whole[:-1]).all(axis=1) & (has_left[1:] == has_left[:-1]) & (has_right[1:] == has_right[:-1])
            first = np.append(True, ~same)
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            later = ~first & ((ids != ids[head]) | (sums != sums[head]) | (at != at[head])) & (has_left + has_right >= length)
            rows = []
            x = np.flatnonzero(later)
            for b, own in _by_bucket(x % ranges, ranges):
                y = x[own]
                rows.append((b, 1, pack(ids[y], sums[y], at[y] - has_left[y], at[y] + has_right[y])))
            x = np.flatnonzero(first | ~later)
            right = np.ascontiguousarray(whole[x, :length])
            edges = np.searchsorted(np.ascontiguousarray(right[:, :kmer]).view(f"S{kmer}").ravel(), splitters, side="left")
            for b, (i, j) in enumerate(zip([0, *edges], [*edges, len(x)], strict=True)):
                if i < j:
                    y = x[i:j]
                    lcp, tails = front_code(right[i:j])
                    rows.append((b, 0, pack(lcp, tails, np.ascontiguousarray(whole[y, length:]).ravel(), ids[y], sums[y], at[y].astype(np.int32), has_left[y].astype(np.uint8), has_right[y].astype(np.uint8))))
            return pd.DataFrame(rows, columns=["range", "kind", "blob"])

        for texts, key, sum_, places in _batched(batches, ["text", "id", "sum", "places"]):
            raw, starts, sizes = _joined(list(texts), left, length)
            doc = np.repeat(np.arange(len(texts)), [len(p) for p in places])
            at = np.concatenate([np.asarray(p, np.int64) for p in places])
            buffer = np.frombuffer(raw, np.uint8)
            for k in range(0, len(at), RUN):
                a, d = at[k : k + RUN], doc[k : k + RUN]
                m = buffer[(starts[d] + a - left)[:, None] + np.arange(left + length)]
                held.append((m, np.array(key, np.int64)[d], np.array(sum_, np.int64)[d], a, np.minimum(a, left), np.minimum(sizes[d] - a, length)))
                size += len(a)
                if size >= RUN:
                    yield run()
                    held, size = [], 0
        if held:
            yield run()

    return runs


def _spans(length: int, kmer: int):
    """Merges the runs of a range and finds, around each anchor, the span of strings that start earlier elsewhere."""
    left = length - kmer

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        out = [unpack(b) for b in rows["blob"][rows["kind"] == 1]]
        runs, more = [], []
        for blob in rows["blob"][rows["kind"] == 0]:
            lcp, tails, before, *rest = unpack(blob)
            runs.append((front_decode(lcp, tails, length).tobytes(), lcp.tolist()))
            more.append((before.reshape(-1, left), *rest))
        if runs:
            run, at_run, lcp = merge_runs(runs, length)
            base = np.cumsum([0] + [len(r[1]) for r in runs])
            order = base[np.array(run)] + np.array(at_run)
            before, ids, sums, at, has_left, has_right = (np.concatenate(x)[order] for x in zip(*more, strict=True))
            lcp, at, has_left, has_right = np.array(lcp), at.astype(np.int64), has_left.astype(np.int64), has_right.astype(np.int64)
            group = np.cumsum(lcp < kmer)
            several = np.bincount(group)[group] > 1
            keep = np.flatnonzero(several)
            if len(keep):
                # a row left out is alone in its group, so its neighbours share less than a k-mer with each other
                lcp = np.where(np.append(True, group[keep][1:] != group[keep][:-1]), 0, lcp[keep])
                before, ids, sums, at, has_left, has_right = (x[keep] for x in (before, ids, sums, at, has_left, has_right))
                n = len(keep)
                early = np.lexsort((at, sums, ids))
                new = np.append(True, (np.diff(ids[early]) != 0) | (np.diff(sums[early]) != 0) | (np.diff(at[early]) != 0))
                rank = np.empty(n, np.int64)
                rank[early] = np.cumsum(new)
                by_left = np.argsort(np.ascontiguousarray(before).view(f"S{left}").ravel(), kind="stable")
                left_lcp = common_prefixes(before[by_left])
                least, most = np.full(n, length), np.full(n, -1)
                for d in range(left + 1):
                    own = early[((has_left >= d) & (has_right >= length - d))[early]]
                    if not len(own):
                        continue
                    kind = np.empty(n, np.int64)
                    kind[by_left] = np.cumsum(left_lcp < d)
                    key = np.cumsum(lcp < length - d)[own] * (n + 1) + kind[own]
                    _, first, which = np.unique(key, return_index=True, return_inverse=True)
                    again = own[rank[own] > rank[own[first[which]]]]
                    most[again] = d
                    least[again] = np.minimum(least[again], d)
                x = np.flatnonzero(most >= 0)
                out.append([ids[x], sums[x], at[x] - most[x], at[x] - least[x] + length])
        ids, sums, start, end = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
        return pd.DataFrame({"id": ids, "sum": sums, "start": start, "end": end})

    return spans


def _united(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((int(x["start"]), int(x["end"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _splitters(rows: DataFrame, ranges: int, length: int, kmer: int) -> np.ndarray:
    """Bounds of the ranges: quantiles of the first bytes of anchors in a bounded sample of documents."""
    count = max(1, rows.count())

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (texts,) in _batched(batches, ["text"]):
            for t in texts:
                at, h = anchors(t, length, kmer)
                chosen = at[np.argsort(h, kind="stable")[:SAMPLE_SUFFIXES]].tolist()
                yield pd.DataFrame({"k": [t[a : a + kmer] for a in chosen]})

    share = min(1.0, SAMPLE_DOCUMENTS / count)
    sample = rows.where(F.pmod(F.xxhash64("id", "sum"), F.lit(1 << 20)) < round(share * (1 << 20))).select("text")
    found = np.sort(np.array(sample.mapInPandas(some, "k binary").toPandas()["k"].map(bytes).tolist(), dtype=f"S{kmer}"))
    return np.unique(found[np.linspace(0, len(found) - 1, ranges + 1).astype(int)[1:-1]]) if len(found) else found


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, text, spans: array<struct<start,end>> of bytes of each text that a `length`-byte string covers which also
    starts earlier: in a document of smaller id, or before in the same text. A row for each row.

    Null texts count as empty, null ids as the smallest; texts shorter than `length` have no span. Rows that share an
    id are ordered by a hash of their texts; equal rows don't count as earlier than each other. Spans may overlap.
    """
    if kmer % 8 or not 8 <= kmer <= 32 or not kmer < length < 256:
        raise ValueError("kmer is a multiple of 8 up to 32, below length; length is below 256")
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sum", F.xxhash64("text"))
    hashes = rows.select("text", "id", "sum").mapInPandas(_hash_runs(parts, length, kmer), "bucket long, kind int, blob binary")
    again = hashes.groupBy("bucket").applyInPandas(_repeated, "id long, sum long, at int").groupBy("id", "sum").agg(F.collect_set("at").alias("places"))
    runs = rows.join(again, ["id", "sum"]).select("doc_id", "text", "id", "sum", "places").mapInPandas(_suffix_runs(_splitters(rows, parts, length, kmer), length, kmer), "range long, kind int, blob binary")
    found = runs.groupBy("range").applyInPandas(_spans(length, kmer), "id long, sum long, start long, end long")
    spans = found.groupBy("id", "sum").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(spans, ["id", "sum"], "left").select("doc_id", "text", "spans")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = _united(spans) if spans is not None else []
                rest, at = hashlib.sha256(), 0
                for s, e in runs:
                    rest.update(raw[at:s])
                    at = e
                rest.update(raw[at:])
                out.append((i, len(raw), sum(e - s for s, e in runs), len(runs), rest.hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInPandas(kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
