"""Dictionaries, suggestions, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators import dictionary as D

from .tables import DOCS, PATTERN, TOKENS, docs, read

STOP = sorted({w for own in D.STOP_WORDS.values() for w in own})
ME = ["u1", "src3", "src4", "Everyone"]


def _built(spark, sf):
    return D.build(docs(spark, sf), STOP)


def _flat(d):
    return d.select("word", "freq", *(F.array_join(c, ",").alias(c) for c in ("acl_allow", "acl_denied", "collections")))


def dictionary_build(spark, sf):
    return _flat(_built(spark, sf))


def dictionary_top(spark, sf):
    return D.top(_built(spark, sf), 500).select("word", "freq")


def top_words(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "word").limit(1002)


def dictionary_text(spark, sf):
    return D.as_text(_built(spark, sf))


def dictionary_roundtrip(spark, sf):
    return _flat(D.from_text(D.as_text(_built(spark, sf))))


def aspell_list(spark, sf):
    return D.aspell_words(_built(spark, sf))


def suggest_prefix(spark, sf):
    return D.suggest(_built(spark, sf), "the on", ME, ["src3", "src4", "src5"])


def suggest_topk_table(spark, sf):
    return D.suggestion_table(_built(spark, sf), 5)


def stopword_filter(spark, sf):
    w = read(spark, sf, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("word"))
    return w.where((F.length("word") >= 2) & ~F.col("word").isin(*STOP)).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_words"))


def _asked(spark, sf):
    """Words of the benchmark, each without its second letter."""
    w = read(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("w")).where(F.length("w") >= 5)
    return w.select(F.concat(F.substring("w", 1, 1), F.substring("w", 3, 100)).alias("word")).distinct()


def spell_levenshtein(spark, sf):
    return D.correct(_asked(spark, sf), _built(spark, sf).where("freq >= 15"))


def spell_ascii(spark, sf):
    """As spell_levenshtein among words of ASCII letters, whose bytes SQL's distance counts."""
    plain = F.col("word").rlike("^[ -~]+$")
    return D.correct(_asked(spark, sf).where(plain), _built(spark, sf).where("freq >= 15").where(plain))


def spell_osa(spark, sf):
    return D.correct(_asked(spark, sf), _built(spark, sf).where("freq >= 15"), D.osa("word", "candidate"))


def language_by_stop_words(spark, sf):
    """Our definition: the language most of whose stop words a text holds, hits counted; ties by name, none without a hit."""
    w = read(spark, sf, "documents").select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("w"))
    n = {k: _hits(own) for k, own in D.STOP_WORDS.items()}
    best = F.greatest(*n.values())
    out = F.lit(None).cast("string")
    for k in sorted(n, reverse=True):
        out = F.when((n[k] == best) & (best > 0), F.lit(k)).otherwise(out)
    return w.select("doc_id", out.alias("language"), best.cast("long").alias("hits"))


def _hits(own):
    return F.size(F.filter("w", lambda x: x.isin(*own)))


QUERIES = {f.__name__: f for f in (dictionary_build, dictionary_top, top_words, dictionary_text, dictionary_roundtrip, aspell_list, suggest_prefix, suggest_topk_table, stopword_filter, spell_levenshtein, spell_ascii, spell_osa, language_by_stop_words)}

_S = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_BUILD = f"""{DOCS}, {TOKENS}, kept as (select t.term as word, d.acl_allow, d.acl_denied, d.collection from tok t join docs d using (doc_id) where strlen(t.term) >= 4 and t.term not in {_S}),
    dict as (select word, count(*) as freq, list_sort(list_distinct(flatten(list(acl_allow)))) as acl_allow, list_sort(list_distinct(flatten(list(acl_denied)))) as acl_denied, list_sort(list(distinct collection)) as collections from kept group by word)"""
_FLAT = "select word, freq, array_to_string(acl_allow, ',') as acl_allow, array_to_string(acl_denied, ',') as acl_denied, array_to_string(collections, ',') as collections from dict"
_COUNT = {k: "len(list_filter(w, lambda x: x in (" + ", ".join(f"'{v}'" for v in own) + ")))" for k, own in D.STOP_WORDS.items()}
# letters whose bytes SQL's distances would count, each as one byte that no word has
_ODD = "éèêëçàâäîïôöùûüßñáíóúœæåø"
_BYTES = "translate({0}, '" + _ODD + "', " + " || ".join(f"chr({k + 1})" for k in range(len(_ODD))) + ")"


def _spelled(distance: str, also: str = "") -> str:
    """SQL of a spelling by the nearest word within two edits."""
    d = distance.format("a.word", "k.word")
    return f"""with {_BUILD}, known as (select word, freq from dict where freq >= 15{also.format('word')}),
        asked as (select distinct w[1] || substr(w, 3, 100) as word from (select unnest(regexp_extract_all(lower(text), {PATTERN})) as w from benchmark) where length(w) >= 5{also.format('w[1] || substr(w, 3, 100)')}),
        near as (select a.word, k.word as c, {d} as d, k.freq from asked a join known k on a.word[1] = k.word[1] and abs(length(a.word) - length(k.word)) <= 2 where {d} <= 2),
        best as (select word, c, d from (select *, row_number() over (partition by word order by d, freq desc, c) as p from near) where p = 1)
        select a.word, case when k.word is not null or regexp_matches(a.word, '^[0-9]+$') then a.word else b.c end as correction, coalesce(case when k.word is not null or regexp_matches(a.word, '^[0-9]+$') then 0 else b.d end, -1)::int as distance
        from asked a left join known k using (word) left join best b using (word)"""


SQL = {
    "dictionary_build": f"with {_BUILD} {_FLAT}",
    "dictionary_top": f"with {_BUILD} select word, freq from dict order by freq desc, word limit 500",
    "top_words": f"with {TOKENS} select term as word, count(*) as freq from tok group by 1 order by freq desc, word limit 1002",
    "dictionary_text": f"with {_BUILD} select concat_ws(' ', word, freq, array_to_string(acl_allow, ','), array_to_string(acl_denied, ','), array_to_string(collections, ',')) as value from dict",
    "dictionary_roundtrip": f"with {_BUILD} {_FLAT}",
    "aspell_list": f"with {_BUILD} select word from dict where regexp_matches(word, '^[a-z][^''0-9]*$') and length(word) > 2",
    "suggest_prefix": f"with {_BUILD} select 'the ' || word as word, freq from dict where starts_with(word, 'on') and freq >= 15 and list_has_any(acl_allow, {ME}) and not list_has_any(acl_denied, {ME}) and list_has_any(collections, ['src3', 'src4', 'src5']) order by freq desc, word limit 10",
    "suggest_topk_table": f"with {_BUILD}, p as (select word, freq, unnest(list_transform(range(1, least(length(word), 5) + 1), lambda k: substr(word, 1, k))) as prefix from dict where freq >= 15) select prefix, place, word, freq from (select *, row_number() over (partition by prefix order by freq desc, word) as place from p) where place <= 10",
    "stopword_filter": f"with {TOKENS} select lang, count(*) as n, count(distinct term) as n_words from tok where length(term) >= 2 and term not in {_S} group by lang",
    "spell_ascii": _spelled("levenshtein({0}, {1})", " and regexp_full_match({0}, '[ -~]+')"),
    "spell_levenshtein": _spelled(f"levenshtein({_BYTES.format('{0}')}, {_BYTES.format('{1}')})"),
    "language_by_stop_words": f"""with {TOKENS}, n as (select doc_id, {', '.join(f'{v} as {k}' for k, v in _COUNT.items())} from words), m as (select *, greatest({', '.join(_COUNT)}) as best from n)
        select doc_id, case when best = 0 then null {' '.join(f"when {k} = best then '{k}'" for k in sorted(_COUNT))} end as language, best::bigint as hits from m""",
}
