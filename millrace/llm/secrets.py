"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (assign, access, hex) stand alone. Weak candidates (a login name, a mixed-case key, a service address) are
reported only when the parts that complete a credential lie within a scope of `SCOPE` code points: a key needs an
identifier or an address, a name needs a secret, an address needs both. The join of intervals runs inside each row, over
runs of its spans in order, so no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("assign", "access", "hex", "name", "key", "address")
SCOPE = 200
RUN = 256
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 and more
NAME = r"""(?i:user|username|login|client_id|account|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)"""
KEY = r"[A-Za-z0-9/+_-]{20,}"
ADDRESS = r"(?:[a-z][a-z0-9+]*://[^\x00-\x20\x22\x27<>]+|[a-z0-9.-]+\.amazonaws\.com)"
SPAN = "struct<s:int,k:int,e:int>"



def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _spans(text: Column, regex: str, kind: int, group: int = 0, least: int = 1, fits: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as spans of code points; those whose group is too short or unfit are dropped.

    The pieces between matches, from split(), give the positions. They are added up within runs of RUN matches, and the
    runs after, so that a text with very many matches takes no time in the square of their number.
    """
    parts = F.arrays_zip(F.split(text, regex, -1).alias("g"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("v"))
    empty = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["g"])
        end = start + F.length(F.coalesce(p["m"], F.lit("")))
        good = p["m"].isNotNull() & (F.length(p["v"]) >= least)
        if fits is not None:
            good = good & fits(p["v"])
        one = F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def run(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(p, k * RUN + 1, RUN), empty, step))

    def joined(a: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda x: F.struct((x["s"] + a["at"]).alias("s"), x["k"].alias("k"), (x["e"] + a["at"]).alias("e")))
        return F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    runs = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.aggregate(run(parts), runs, joined, lambda a: F.flatten(a["out"]))


def _runs(spans: Column) -> Column:
    """Spans in order, in runs of about the square root of their number: where each run begins and ends at the latest."""

    def cut(o: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(o))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / size).cast("int")), lambda k: F.slice(o, k * size + 1, size))
        return F.transform(parts, lambda q: F.struct(F.get(q, F.lit(0))["s"].alias("s"), F.array_max(F.transform(q, lambda p: p["e"])).alias("e"), q.alias("spans")))

    return _let(F.sort_array(spans), lambda o: F.when(F.size(o) > 0, cut(o)).otherwise(F.array().cast(f"array<struct<s:int,e:int,spans:array<{SPAN}>>>")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), worked out once however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _meets(of: Column, others: Column, scope: int) -> Callable[[Callable], Column]:
    """The spans less than `scope` code points from one of the others, or with `not` those that are not: whole runs of the
    others are passed over, so that n spans take n times the square root of n."""
    close = lambda c, p: (p["s"] - c["e"] < scope) & (c["s"] - p["e"] < scope)
    return lambda keep: _let(_runs(others), lambda runs: F.filter(of, lambda c: keep(F.exists(runs, lambda r: close(c, r) & F.exists(r["spans"], lambda p: close(c, p))))))


def _near(of: Column, others: Column) -> Column:
    """The spans that have one of the others within the scope."""
    return _meets(of, others, SCOPE + 1)(lambda found: found)


def _apart(of: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return _meets(of, others, 0)(lambda found: ~found)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with a column `into`: an array of spans (s, k, e), from s up to e in code points, k an index of KINDS, sorted.

    Null and empty texts have none. Other columns pass through, a column named `into` is replaced; repeated rows are
    scanned each. Each stage looks only at rows that the one before leaves possible.
    """
    own = fresh(docs, "__")
    name = lambda k: f"{own}{k}"
    col = lambda k: F.col(name(k))
    t, low = col("t"), col("low")
    has = lambda *words: F.greatest(*(F.contains(low, F.lit(w)) for w in (*words, *words[:1])))
    mixed_case = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    x = docs.withColumn(name("t"), F.coalesce(F.col(text), F.lit("")))
    x = x.withColumn(name("low"), F.lower(t))
    x = x.withColumns({
        name("assign"): F.when(has("passw", "secret", "token", "api"), _spans(t, ASSIGN, 0, 2, 8)).otherwise(_none()),
        name("access"): F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1, 0, 16)).otherwise(_none()),
        name("hex"): F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none()),
        name("name"): F.when(has("user", "login", "client_id", "account", "access_key_id"), _spans(t, NAME, 3, 1, 3)).otherwise(_none()),
        name("address"): F.when(has("://", ".amazonaws.com"), _spans(t, ADDRESS, 5, 0, 8)).otherwise(_none()),
    })
    # by name, so that the spans found above are read, not found again
    ids, strong = F.concat(col("access"), col("name")), F.concat(col("assign"), col("hex"))
    x = x.withColumn(name("key"), F.when((F.size(ids) > 0) | (F.size(col("address")) > 0), _spans(t, KEY, 4, 0, 20, mixed_case)).otherwise(_none()))
    x = x.withColumn(name("key"), _near(_apart(col("key"), F.concat(strong, col("access"), col("address"))), F.concat(ids, col("address"))))
    secret = F.concat(strong, col("key"))
    x = x.withColumns({name("name"): _near(col("name"), secret), name("address"): _near(_near(col("address"), secret), ids)})
    parts = ["assign", "access", "hex", "name", "key", "address"]
    x = x.withColumn(name("all"), F.sort_array(F.concat(*map(col, parts))))
    return x.withColumn(into, col("all")).drop(*map(name, ("t", "low", "all", *parts)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda p: F.concat_ws(":", F.element_at(kinds, p["k"] + 1), p["s"].cast("string"), p["e"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", into: str = "secrets") -> DataFrame:
    """docs whose `text` has each run of overlapping spans of `into` replaced by the mark; null texts stay null.

    A text is put together from pieces of RUN spans each, so that very many spans don't copy it once a span.
    """
    t = F.col(text)

    def piece(spans: Column, k: Column) -> Column:
        own = F.slice(spans, k * RUN + 1, RUN)
        before = F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), k * RUN), lambda p: p["e"])), F.lit(0))
        after = F.get(spans, (k + 1) * RUN)["s"]
        last = F.greatest(before, F.array_max(F.transform(own, lambda p: p["e"])))
        start = F.when(k == 0, F.lit(0)).otherwise(F.greatest(before, F.get(spans, k * RUN)["s"]))
        end = F.when(after.isNull(), F.length(t)).otherwise(F.greatest(after, last))

        def put(b: Column) -> Column:
            def step(a: Column, p: Column) -> Column:
                given = F.substring(b["v"], F.greatest(a["at"] - b["start"], F.lit(0)) + 1, p["s"] - F.greatest(a["at"], b["start"]))
                return F.struct(F.greatest(a["at"], p["e"]).alias("at"), F.when(p["s"] >= a["at"], F.concat(a["out"], given, F.lit(mark))).otherwise(a["out"]).alias("out"))

            rest = lambda a: F.concat(a["out"], F.substring(b["v"], F.greatest(a["at"] - b["start"], F.lit(0)) + 1, F.length(b["v"])))
            return F.aggregate(own, F.struct(b["before"].alias("at"), F.lit("").alias("out")), step, rest)

        return _let(F.struct(before.alias("before"), start.alias("start"), F.substring(t, start + 1, end - start).alias("v")), put)

    done = _let(F.col(into), lambda spans: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int")), lambda k: piece(spans, k)), ""))
    return docs.withColumn(text, F.when(F.size(into) > 0, done).otherwise(t))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("secrets", lambda p: p["k"] == k)).cast("long")
    base = F.filter("secrets", lambda p: p["k"] <= 2)
    return docs.select("doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), (F.size("secrets") - F.size(base)).cast("long").alias("n_linked"))


def _sql_spans(regex: str, kind: int, group: int = 0, least: int = 1, also: str = "true") -> str:
    r = regex.replace("'", "''")
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{r}')) + 1), lambda i: struct_pack(
        g := list_sum(list_transform(string_split_regex(t, '{r}')[1:i], lambda x: length(x))), m := list_sum(list_transform(regexp_extract_all(t, '{r}')[1:i], lambda x: length(x))),
        w := length(regexp_extract_all(t, '{r}')[i]), v := regexp_extract_all(t, '{r}', {group})[i])), lambda x: length(x.v) >= {least} and ({also.replace('v~', 'x.v')})),
        lambda x: struct_pack(s := (x.g + x.m - x.w)::int, k := {kind}, e := (x.g + x.m)::int))"""


def _sql_near(of: str, others: str) -> str:
    return f"list_filter({of}, lambda c: len(list_filter({others}, lambda p: p.s - c.e <= {SCOPE} and c.s - p.e <= {SCOPE})) > 0)"


_MIXED = "regexp_matches(v~, '[A-Z]') and regexp_matches(v~, '[a-z]') and regexp_matches(v~, '[0-9]')"
_TEXT_OF = "array_to_string(list_transform({0}, lambda p: concat_ws(':', ['" + "', '".join(KINDS) + "'][p.k + 1], p.s, p.e)), ',')"
OP2_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as (select doc_id, t, {_sql_spans(ASSIGN, 0, 2, 8)} as assign, {_sql_spans(ACCESS, 1, 0, 16)} as access, {_sql_spans(HEX, 2)} as hex,
    {_sql_spans(NAME, 3, 1, 3)} as name, {_sql_spans(ADDRESS, 5, 0, 8)} as address from docs),
keys as (select *, case when len(access) + len(name) + len(address) > 0 then {_sql_spans(KEY, 4, 0, 20, _MIXED)} else [] end as raw from found),
linked as (select *, {_sql_near('list_filter(raw, lambda q: len(list_filter(assign || access || hex || address, lambda o: o.s < q.e and q.s < o.e)) = 0)', '(access || name || address)')} as key from keys),
every as (select doc_id, assign, access, hex, list_sort(assign || access || hex) as base, list_sort(assign || access || hex || {_sql_near('name', '(assign || hex || key)')} || key
    || {_sql_near(_sql_near('address', '(assign || hex || key)'), '(access || name)')}) as spans from linked)
select doc_id, len(assign)::bigint as n_assign, len(access)::bigint as n_access, len(hex)::bigint as n_hex, sha256({_TEXT_OF.format('base')}) as base_sha256,
    {_TEXT_OF.format('spans')} as spans, (len(spans) - len(base))::bigint as n_linked from every
"""
