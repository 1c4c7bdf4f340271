"""Self-join of shingle sets by Jaccard similarity, with prefix filters under several global token orders.

Documents with equal sets are one class. Under any order of all tokens, two sets of at least the similarity share a
token among the first n - ceil(t n) + 1 of each; how many they must share there follows from their sizes. Two
independent orders are used, both with frequent tokens last, and only pairs that pass both filters are verified on the
whole sets. Classes made up of frequent tokens, such as thousands of copies with small changes, and those that share a
prefix token with more than GROUP classes, are compared with one leader for each such token first; then those outside the
largest component meet the others in blocks. So no group gives more than its GROUP^2 / 2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mixed, pack, partitions, small_batches, trim, unpack, word_hashes
from .graph import components

WIDTH = 5
LEAST = Fraction(3, 4)
FREQUENT = 8  # documents that make a token frequent, counted where a chunk of CHUNK tokens has it twice or more
GROUP = 1000  # classes that share a prefix token and meet in pairs; more of them go the way of frequent tokens
MAX_FREQUENT = 1 << 19  # of the most frequent ones are put last: 4 MB at most go to each executor
BITMAP_BITS = 27  # 16 MB whatever the number of ids; more ids let more texts through, which a join then drops
CHUNK_BITS = 19
CELL = 1000  # sets on either side of a block of comparisons
CHUNK = 2_000_000
STEP = np.uint64(0xD6E8FEB86659FD93)
SECOND = np.uint64(0xA0761D6478BD642F)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of the whole sequence if it is shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = mixed(w[: len(w) - k + 1] + np.uint64(k))
    for i in range(1, k):
        h = mixed(h * STEP + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signature(tokens: np.ndarray) -> int:
    """A set's identity: 64 bits of two sums of its tokens."""
    both = np.array([np.sum(mixed(tokens ^ STEP), dtype=np.uint64), np.bitwise_xor.reduce(mixed(tokens + SECOND), initial=np.uint64(0))])
    return int(mixed(both[:1] ^ (both[1:] * STEP) ^ np.uint64(len(tokens))).view(np.int64)[0])


def needed(n: int, least: Fraction) -> int:
    """Of a set's n tokens, those that any partner shares at least."""
    return -(-n * least.numerator // least.denominator)


def _profiles(width: int, buckets: int):
    """doc_id, size and signature of each set (kind 0); for each bucket the tokens that a chunk has twice or more (kind 1,
    the bucket as n)."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def frequent() -> pd.DataFrame:
            tokens, df = np.unique(np.concatenate(held), return_counts=True)
            tokens, df = tokens[df > 1], df[df > 1].astype(np.int32)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]
            return pd.DataFrame({"doc_id": None, "n": [b for b, _ in own], "sig": 0, "kind": 1, "blob": [pack(tokens[x], df[x]) for _, x in own]})

        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text if isinstance(text, str) else None, width)
                rows.append((i, len(s), signature(s), 0))
                held.append(s)
                size += len(s)
                if size > CHUNK:
                    yield frequent()
                    held, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "n", "sig", "kind"]).assign(blob=None)
        if size:
            yield frequent()
        held = []
        trim()

    return profile


def _often(least: int):
    """A bucket's tokens in at least so many documents, the most frequent ones if there are more than fit."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in rows["blob"]]
        tokens, which = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        df = np.bincount(which, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        x = np.flatnonzero(df >= least)
        x = x[np.argsort(-df[x], kind="stable")[:MAX_FREQUENT]]
        return pd.DataFrame({"token": tokens[x].view(np.int64), "df": df[x]})

    return count


def _postings(frequent, least: Fraction, width: int, buckets: int):
    """Prefix tokens of each set under both orders, as sorted runs for each bucket (kinds 0 and 1); and the frequent
    tokens in prefixes under the first (kind 2)."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = frequent.value
        held: list[tuple] = []
        known: set[int] = set()
        size = 0

        def runs() -> pd.DataFrame:
            out = []
            meta = np.array([x[:4] for x in held], np.int64).reshape(-1, 4)
            for order in (0, 1, 2):
                tokens = np.concatenate([x[4 + order] for x in held])
                owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[4 + order]) for x in held])
                bucket = (tokens % np.uint64(buckets)).astype(np.int64)
                at = np.lexsort((tokens, bucket))
                tokens, owner, bucket = tokens[at], owner[at], bucket[at]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in range(buckets):
                    i, j = edges[b], edges[b + 1]
                    if i < j:
                        own, local = np.unique(owner[i:j], return_inverse=True)
                        m = meta[own]
                        out.append((order, b, pack(tokens[i:j], local.astype(np.uint16 if len(own) <= 65536 else np.uint32), m[:, 0], m[:, 1].astype(np.int32), m[:, 2].astype(np.int32), m[:, 3].astype(np.int32))))
            return pd.DataFrame(out, columns=["kind", "bucket", "blob"])

        for batch in batches:
            for text in batch["text"]:
                s = shingles(text if isinstance(text, str) else None, width)
                if not len(s) or (sig := signature(s)) in known:
                    continue
                known.add(sig)
                n = len(s)
                at = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
                late = last[at] == s if len(last) else np.zeros(n, bool)
                own, often = s[~late], s[late]
                p = n - needed(n, least) + 1
                ph = max(0, p - len(own))
                held.append((sig, n, len(often), ph, own[:p], own[np.argsort(mixed(own ^ SECOND))[:p]] if len(own) > p else own, often[:ph]))
                size += 2 * p
            if size > CHUNK:
                yield runs()
                held, size, known = [], 0, set()
        if held:
            yield runs()
        held = []
        trim()

    return post


def _share(na, nb, least: Fraction):
    """The least size of an intersection of sets of these sizes."""
    t = least / (1 + least)
    return -(-(na + nb) * t.numerator // t.denominator)


def _pairs(least: Fraction, most: int):
    """Within a bucket: pairs of sets that share prefix tokens under each order, how many, and how many they need; and
    the tokens in prefixes that are frequent, or that more than `most` sets share, with their sets (kind 2, as a and b)."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        trim()  # of the bucket before
        found = []
        for order, own in rows.groupby("kind", sort=True):
            tokens, sigs, meta = [], [], {}
            for blob in own["blob"]:
                t, local, sig, n, h, ph = unpack(blob)
                tokens.append(t)
                sigs.append(sig[local])
                meta.update(zip(sig.tolist(), zip(n.tolist(), h.tolist(), ph.tolist(), strict=True), strict=True))
            token, sig = np.concatenate(tokens), np.concatenate(sigs)
            at = np.lexsort((sig, token))
            token, sig = token[at], sig[at]
            new = np.append(True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]))
            token, sig = token[new], sig[new]
            if order == 2:
                found.append(pd.DataFrame({"kind": 2, "a": token.view(np.int64), "b": sig, "need": [meta[x][0] for x in sig.tolist()], "c0": 0, "c1": 0}))
                continue
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            large = np.repeat(size > most, size)
            if large.any():
                found.append(pd.DataFrame({"kind": 2, "a": token[large].view(np.int64), "b": sig[large], "need": [meta[x][0] for x in sig[large].tolist()], "c0": 0, "c1": 0}))
            start, size = start[(size > 1) & (size <= most)], size[(size > 1) & (size <= most)]
            if not len(start):
                continue
            first, second = [], []
            for k in np.unique(size):  # all groups of one size together
                members = sig[start[size == k][:, None] + np.arange(k)]
                i, j = np.triu_indices(int(k), 1)
                for lo in range(0, len(i), 1 << 16):
                    first.append(members[:, i[lo : lo + (1 << 16)]].ravel())
                    second.append(members[:, j[lo : lo + (1 << 16)]].ravel())
            a, b = np.concatenate(first), np.concatenate(second)
            known = np.unique(np.concatenate((a, b)))
            n, _, ph = np.array([meta[x] for x in known.tolist()], np.int64).T
            ia, ib = np.searchsorted(known, a), np.searchsorted(known, b)
            fits = np.minimum(n[ia], n[ib]) * least.denominator >= np.maximum(n[ia], n[ib]) * least.numerator
            pair, count = np.unique(ia[fits] * len(known) + ib[fits], return_counts=True)
            ia, ib = pair // len(known), pair % len(known)
            rest = np.maximum(needed(n[ia], least), needed(n[ib], least)) - 1  # of the larger set behind its prefix
            need = np.maximum(1, _share(n[ia], n[ib], least) - rest) - np.minimum(ph[ia], ph[ib])
            x = pd.DataFrame({"kind": 0, "a": known[ia], "b": known[ib], "need": need, "c0": 0, "c1": 0})
            x[f"c{order}"] = count.astype(np.int64)
            found.append(x)
        if not found:
            return pd.DataFrame({"kind": [], "a": [], "b": [], "need": [], "c0": [], "c1": []})
        return pd.concat(found)

    return meet


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Of pairs (a, b) of signatures, those whose whole sets (sig, tokens) are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                (x,), (y,) = unpack(x), unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= _share(len(x), len(y), least))
            yield batch.loc[good, ["a", "b"]]
        trim()

    x = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")
    return x.select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << BITMAP_BITS))


def _bitmap(bits: DataFrame) -> np.ndarray:
    """2^BITMAP_BITS bits as bytes; made in chunks by the executors."""

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << CHUNK_BITS, bool)
        own[rows["bit"].to_numpy(np.int64) & ((1 << CHUNK_BITS) - 1)] = True
        return pd.DataFrame({"chunk": [key[0]], "bytes": [pack(np.packbits(own, bitorder="little"))]})

    out = np.zeros((1 << (BITMAP_BITS - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    made = bits.distinct().withColumn("chunk", F.floor(F.col("bit") / (1 << CHUNK_BITS))).groupBy("chunk").applyInPandas(chunk, "chunk long, bytes binary")
    for k, b in made.toPandas().itertuples(index=False):
        out[k] = unpack(bytes(b))[0]
    return out.ravel()


def _block(least: Fraction):
    """Similar pairs of sets in different components, of one side of a block with the other; one for each component."""

    def block(odd: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(odd) or not len(rows):
            return pd.DataFrame({"a": [], "b": []})
        sets = [unpack(b)[0] for b in rows["tokens"]]
        n = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        reps, parts, a, b = rows["rep"].to_numpy(), rows["component"].to_numpy(), [], []
        for rep, part, blob in zip(odd["rep"], odd["component"], odd["tokens"], strict=True):
            s = unpack(blob)[0]
            i, j = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
            at = np.repeat(i - np.append(0, np.cumsum(j - i)[:-1]), j - i) + np.arange((j - i).sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            x = np.flatnonzero((shared >= _share(n, len(s), least)) & (parts != part))
            _, first = np.unique(parts[x], return_index=True)  # the others of a component are joined already
            a += [rep] * len(first)
            b += reps[x[first]].tolist()
        return pd.DataFrame({"a": a, "b": b})

    return block


def _fits(na: Column, nb: Column, least: Fraction) -> Column:
    return F.least(na, nb) * least.denominator >= F.greatest(na, nb) * least.numerator


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: Fraction = LEAST, width: int = WIDTH, often: int = FREQUENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reached by links, itself included): a row for each row.

    Texts without words, null ones too, have no shingles and link with nothing. Equal texts and rows that repeat are one
    class. A row of a null doc_id links as others do but never names a component. Other columns are not read. A pair
    counts as linked when the similarity is exactly `least` or more; sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = checkpoint(rows.mapInPandas(_profiles(width, partitions(spark)), "doc_id long, n long, sig long, kind int, blob binary"))
    classes = seen.where("kind = 0").select("doc_id", "n", "sig")
    last = seen.where("kind = 1").groupBy("n").applyInPandas(_often(often), "token long, df long")
    last = last.orderBy(F.desc("df"), "token").limit(MAX_FREQUENT).select("token").toPandas()["token"]
    frequent = spark.sparkContext.broadcast(np.sort(last.to_numpy(np.int64).view(np.uint64)))
    reps = classes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))

    posted = rows.select("text").mapInPandas(_postings(frequent, least, width, partitions(spark)), "kind int, bucket long, blob binary")
    met = checkpoint(posted.groupBy("bucket").applyInPandas(_pairs(least, group), "kind int, a long, b long, need long, c0 long, c1 long"))
    heavy = met.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("sig"), F.col("need").alias("n")).distinct()
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    candidates = pairs.where("c0 >= need and c1 >= need").select("a", "b")

    # one leader for each frequent token: the class of the smallest document
    members = heavy.join(reps, "sig")
    leader = members.groupBy("token").agg(F.min(F.struct("rep", "sig", "n")).alias("l"))
    star = checkpoint(members.join(leader, "token").where(F.col("sig") != F.col("l.sig")).select("sig", "rep", "n", F.col("l.sig").alias("l_sig"), F.col("l.rep").alias("l_rep"), F.col("l.n").alias("l_n")).distinct())
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    first = checkpoint(candidates.union(star.where(_fits(F.col("n"), F.col("l_n"), least)).select(*ordered(F.col("sig"), F.col("l_sig")))).distinct())

    def sets_of(sigs: DataFrame) -> DataFrame:
        """sig, tokens of classes, from one document each, which a bitmap of hashed ids finds where the texts are."""
        wanted = checkpoint(sigs.select("sig").distinct().join(reps, "sig"))
        shared = spark.sparkContext.broadcast(pack(_bitmap(wanted.select(_bit(F.col("rep")).alias("bit")))))

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = unpack(shared.value)[0]
            for batch in batches:
                bit = batch.column("bit").to_numpy()
                sets = [shingles(t, width) for t in batch.filter(pa.array((bits[bit >> 3] >> (bit & 7)) & 1 == 1)).column("text").to_pylist()]
                sets = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in sets], pa.int64()), pa.array([pack(x) for x in sets], pa.binary())], ["sig", "tokens"])
            trim()

        found = rows.select(_bit(F.col("doc_id")).alias("bit"), "text").mapInArrow(made, "sig long, tokens binary")
        return found.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])

    both = first.select(F.col("a").alias("sig")).union(first.select(F.col("b").alias("sig")))
    good = _verified(first, sets_of(both), least)
    good = good.join(reps.select(F.col("sig").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("sig").alias("b"), F.col("rep").alias("rb")), "b")
    links = checkpoint(good.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if not star.isEmpty():
        # All sets that share a frequent prefix token, linked or not, are one cluster. Those outside its largest component
        # meet all of it in blocks.
        cluster = components(star.select(F.col("rep").alias("a"), F.col("l_rep").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
        own = star.select("sig", "rep").union(star.select("l_sig", "l_rep")).distinct().join(cluster, "rep")
        own = checkpoint(own.join(components(links).withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
        sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all"))
        sizes = sizes.where(F.col("all") > F.col("m.k")).select("cluster", F.col("m.component").alias("main"), F.ceil(F.col("all") / CELL).cast("int").alias("down"), F.ceil((F.col("all") - F.col("m.k")) / CELL).cast("int").alias("across"))
        held = own.join(sizes, "cluster")
        held = checkpoint(held.join(sets_of(held), "sig"))
        place = lambda n, salt: F.pmod(F.xxhash64("sig", F.lit(salt)), F.col(n)).cast("int")
        rows_ = held.select("cluster", place("down", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), "rep", "component", "tokens")
        odd = held.where("component <> main").select("cluster", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), place("across", 2).alias("j"), "rep", "component", "tokens")
        more = odd.groupBy("cluster", "i", "j").cogroup(rows_.groupBy("cluster", "i", "j")).applyInPandas(_block(least), "a long, b long")
        links = links.union(checkpoint(more))
    part = components(links)
    named = classes.withColumn("sig", F.when(F.col("n") > 0, F.col("sig"))).join(reps, "sig", "left").join(part.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < {WIDTH} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) end as g from d),
c as (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), '|')) as sum from s),
reps as (select sum, min(doc_id) as rep, any_value(n) as n from c where n > 0 group by sum),
tok as (select rep, n, unnest(g) as t from reps join s on doc_id = rep),
shared as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as k from tok a join tok b on a.t = b.t and a.rep <> b.rep where least(a.n, b.n) * {LEAST.denominator} >= greatest(a.n, b.n) * {LEAST.numerator} group by 1, 2, 3, 4),
links as (select a, b from shared where k * {LEAST.denominator} >= (na + nb - k) * {LEAST.numerator}),
reach(a, b) as (select rep, rep from reps union select reach.a, links.b from reach join links on links.a = reach.b),
part as (select a as rep, min(b) as component from reach group by a)
select doc_id, c.n as n_shingles, coalesce(component, doc_id) as component_id from c left join reps on c.sum = reps.sum and c.n > 0 left join part using (rep)
"""
