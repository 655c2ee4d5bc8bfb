"""Dictionaries, label agreement, classifier metrics and data quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dictionaries as dic
from ..operators import labels, quality, ranking
from ..operators import relational as rel
from .q_matching import LCS_SQL
from .catalog import Tables, query
from .fixtures import congress_sql, orders_c
from .q_text import _rounded

CONG = congress_sql("o_orderdate")
TERMS = {"the": 1, "and": 1, "of the": 2, "eine": 3, "la": 2, "zzz": 3}
NORM = "trim(regexp_replace(regexp_replace(replace(lower(text), '-', ' '), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
TERMS_SQL = "terms(term, v) as (values " + ", ".join(f"('{t}', {v})" for t, v in TERMS.items()) + ")"
FREQ_SQL = f"""{TERMS_SQL}, nd as (select doc_id, lang, source, ' ' || {NORM} || ' ' as t from documents),
f as (select doc_id, lang, source, term, v, ((length(t) - length(replace(t, ' ' || term || ' ', ''))) // (length(term) + 2))::bigint as n, greatest(len(string_split(t, ' ')) - 2, 0)::bigint as n_words from nd cross join terms),
fr as (select *, round(n / greatest(n_words, 1)::double * 1000000, 3) as per_million from f)"""


def _freq(t: Tables) -> DataFrame:
    return dic.term_frequency(t.documents, ["doc_id", "lang", "source"], "text", list(TERMS))


def _versions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, v) for k, v in TERMS.items()], "term string, version int")


@query("text_normalize", sql=f"select doc_id, md5({NORM}) as digest from documents")
def text_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.normalize_terms(F.col("text"))).alias("digest"))


@query("term_frequency", sql=f"with {FREQ_SQL} select doc_id, term, n, n_words, per_million from fr")
def term_frequency(t: Tables) -> DataFrame:
    return _freq(t).drop("lang", "source")


#: Two thousand phrases of one to four words, drawn from the documents themselves.
_PHRASES = """ph as (select string_split({norm}, ' ') as w, doc_id from documents), pt as (
  select distinct array_to_string(w[7:6 + doc_id % 4 + 1], ' ') as term from ph where len(w) >= 10 order by term limit 2000)"""


@query(
    "term_frequency_many",
    sql=f"""with {_PHRASES.format(norm=NORM)}, nd as (select lang, ' ' || {NORM} || ' ' as t from documents),
e as (select lang, term, ((length(t) - length(replace(t, ' ' || term || ' ', ''))) // (length(term) + 2))::bigint as n, greatest(len(string_split(t, ' ')) - 2, 0)::bigint as w from nd, pt)
select lang, term, sum(n)::bigint as n, sum(w)::bigint as n_words from e group by all""",
)
def term_frequency_many(t: Tables) -> DataFrame:
    """Counts of two thousand phrases, of up to four words, in each language: one pass over the words whatever their number."""
    # Ten whole words of the head are the text's; only a text whose head has fewer is read to its end.
    head = t.documents.select("doc_id", "text", F.split(text.normalize_terms(F.substring("text", 1, 400)), " ", 11).alias("_head"))
    words = F.when(F.size("_head") > 10, F.col("_head")).otherwise(F.split(text.normalize_terms(F.col("text")), " ", 11))
    phrase = F.array_join(F.slice("_w", F.lit(7), (F.col("doc_id") % 4 + 1).cast("int")), " ")
    terms = head.withColumn("_w", words).filter(F.size("_w") >= 10).select(phrase.alias("term")).distinct().orderBy("term").limit(2_000)
    got = dic.term_frequency(t.documents, ["lang"], "text", dic.term_list(terms))
    return got.select("lang", "term", "n", "n_words")


@query(
    "dict_versions",
    sql=f"with {FREQ_SQL}, k as (select unnest([1, 2, 3])::int as version) select doc_id, version, round(avg(per_million), 6) as mean_rate from fr join k on v <= version group by 1, 2",
)
def dict_versions(t: Tables) -> DataFrame:
    r = dic.version_rates(_freq(t), ["doc_id"], _versions(t))
    return r.withColumn("mean_rate", F.round("mean_rate", 6))


@query(
    "dict_flags",
    sql=f"with {FREQ_SQL}, k as (select unnest([1, 2, 3])::int as version), r as (select doc_id, version, avg(per_million) as m from fr join k on v <= version group by 1, 2), w as (select *, avg(m) over (partition by version) as mm from r) select version, round(avg((m > 0)::int), 6) as above_zero, round(avg((m > mm)::int), 6) as above_mean, count(*)::bigint as n from w group by 1",
)
def dict_flags(t: Tables) -> DataFrame:
    return _rounded(dic.version_shares(dic.version_rates(_freq(t), ["doc_id"], _versions(t))))


@query(
    "variant_merge",
    sql=f"with {FREQ_SQL} select lang, case when term = 'la' then 'the' else term end as term, sum(n)::bigint as n from fr group by all",
)
def variant_merge(t: Tables) -> DataFrame:
    return dic.merge_variants(_freq(t), ["lang"], ["n"], {"la": "the"})


@query(
    "party_term_gap",
    sql=f"""with {FREQ_SQL}, g as (select term, sum(n) filter (lang = 'en') as e, sum(n) filter (lang = 'fr') as f, sum(n) filter (lang = 'en') / sum(n_words) filter (lang = 'en')::double * 1e6 as er, sum(n) filter (lang = 'fr') / sum(n_words) filter (lang = 'fr')::double * 1e6 as frr from fr group by 1)
select term, e::bigint as first_total, f::bigint as second_total, round(er, 3) as first_rate, round(frr, 3) as second_rate, (e - f)::bigint as diff_total, round(er - frr, 3) as diff_rate from g""",
)
def party_term_gap(t: Tables) -> DataFrame:
    g = dic.party_gap(_freq(t), "lang", "n_words", "n", "en", "fr")
    return g.withColumns({c: F.round(c, 3) for c in ("first_rate", "second_rate", "diff_rate")})


@query(
    "collocations",
    sql=f"""with w as (select list_filter(string_split({NORM}, ' '), lambda x: x <> '') as ws from conversations),
s as (select unnest(ws) as w from w), s1 as (select w, count(*) as n from s group by 1),
p as (select unnest(ws[1:len(ws) - 1]) as a, unnest(ws[2:len(ws)]) as b from w where len(ws) > 1), p1 as (select a, b, count(*) as n_ab from p group by 1, 2),
v as (select (select count(*) from s1) + (select count(*) from p1) as v)
select a, b, n_ab::bigint as n_ab, x.n::bigint as n_a, y.n::bigint as n_b, round((n_ab - 1) / x.n::double / y.n * v, 6) as score from p1 join s1 x on x.w = a join s1 y on y.w = b, v where (n_ab - 1) / x.n::double / y.n * v > 2""",
)
def collocations(t: Tables) -> DataFrame:
    return _rounded(dic.collocations(t.conversations, "text"))


# ---- agreement and metrics --------------------------------------------------------------------

PRED_SQL = "pr as (select l.doc_id, source, quality, toxic, (n_chars % 3 > 0)::int as pred, (n_chars % 1000) / 1000.0::double as score, (n_chars % 7 = 0)::int as tox_pred from labels l join documents d using (doc_id))"


def predictions(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars")
    n = F.col("n_chars")
    return t.labels.join(d, "doc_id").select(
        "doc_id", "source", "quality", "toxic", (n % 3 > 0).cast("int").alias("pred"), (n % 1000 / 1000).alias("score"), (n % 7 == 0).cast("int").alias("tox_pred")
    )


@query("confusion", sql=f"with {PRED_SQL}, g as (select a.v::int as quality, b.v::int as pred from (values (0), (1)) a(v), (values (0), (1)) b(v)) select g.quality, g.pred, count(pr.doc_id)::bigint as n from g left join pr on pr.quality = g.quality and pr.pred = g.pred group by 1, 2")
def confusion(t: Tables) -> DataFrame:
    return labels.confusion(predictions(t), "quality", "pred", [0, 1])


_PRF = """round(coalesce(ok / nullif(n, 0)::double, 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) as f1, (tp + fn)::bigint as support, n::bigint as n"""
_CELLS = "count_if({t} = 1 and {p} = 1) as tp, count_if({t} = 0 and {p} = 1) as fp, count_if({t} = 1 and {p} = 0) as fn, count_if({t} = {p}) as ok, count(*) as n"


@query("prf", sql=f"with {PRED_SQL}, c as (select {_CELLS.format(t='quality', p='pred')} from pr) select {_PRF} from c")
def prf(t: Tables) -> DataFrame:
    return _rounded(labels.binary_metrics(predictions(t), "quality", "pred"))


@query("eval_by_group", sql=f"with {PRED_SQL}, c as (select source, {_CELLS.format(t='quality', p='pred')} from pr group by 1) select source, {_PRF} from c")
def eval_by_group(t: Tables) -> DataFrame:
    return _rounded(labels.binary_metrics(predictions(t), "quality", "pred", ["source"]))


_METHODS = "m as (select source as hearing, 'model' as method, quality, pred from pr union all select source, 'always', quality, 1 from pr)"


@query(
    "eval_methods",
    sql=f"""with {PRED_SQL}, {_METHODS}, c as (select method, hearing, {_CELLS.format(t='quality', p='pred')} from m where hearing is not null group by 1, 2), e as (select method, hearing, {_PRF.replace("round(coalesce", "(coalesce").replace(", 6) as", ") as")} from c)
select method, hearing, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support, n from e
union all select method, null, round(avg(accuracy), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint, sum(n)::bigint from e group by method""",
)
def eval_methods(t: Tables) -> DataFrame:
    """Two methods on every source and their means over sources."""
    x = predictions(t).withColumn("always", F.lit(1))
    return _rounded(labels.method_metrics(x, "quality", {"model": "pred", "always": "always"}, "source"))


@query(
    "kappa",
    sql=f"with {PRED_SQL}, s as (select avg((quality = pred)::int) as po, avg(quality) * avg(pred) + (1 - avg(quality)) * (1 - avg(pred)) as pe from pr) select round(po, 6) as observed, round(pe, 6) as expected, round((po - pe) / (1 - pe), 6) as kappa from s",
)
def kappa(t: Tables) -> DataFrame:
    return _rounded(labels.kappa(predictions(t), "quality", "pred"))


@query(
    "roc_auc",
    sql=f"with {PRED_SQL}, r as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from pr), s as (select sum(r) filter (quality = 1) as sr, count(*) filter (quality = 1)::double as p, count(*) filter (quality = 0)::double as n from r) select round((sr - p * (p + 1) / 2) / (p * n), 6) as auc from s",
)
def roc_auc(t: Tables) -> DataFrame:
    return _rounded(ranking.auc(predictions(t), "quality", "score"))


@query(
    "roc_points",
    sql=f"with {PRED_SQL}, s as (select distinct score from pr) select score as threshold, round((select count_if(quality = 1 and pr.score >= s.score) / count_if(quality = 1)::double from pr), 6) as tpr, round((select count_if(quality = 0 and pr.score >= s.score) / count_if(quality = 0)::double from pr), 6) as fpr from s",
)
def roc_points(t: Tables) -> DataFrame:
    return _rounded(ranking.roc_points(predictions(t), "quality", "score", sample=50))


@query("agreement", sql=f"with {PRED_SQL} select source, round(avg((quality = pred)::int) * 100, 6) as agree_pct, round((1 - avg((quality = pred)::int)) * 100, 6) as disagree_pct, round(avg(quality), 6) as mean_a, round(avg(pred), 6) as mean_b from pr group by 1")
def agreement(t: Tables) -> DataFrame:
    return _rounded(labels.agreement(predictions(t), "quality", "pred", ["source"]))


@query("category_agreement", sql=f"with {PRED_SQL} select doc_id, quality, pred from pr where quality <> pred")
def category_agreement(t: Tables) -> DataFrame:
    """Rows on which two raters' category sets differ."""
    from ..functions import bills as b

    p = predictions(t)
    cats = lambda c: F.when(F.col(c) == 1, "Causal, Monetary").otherwise("monetary")
    p = p.withColumn("same", b.same_set(cats("quality"), F.when(F.col("pred") == 1, "monetary,causal").otherwise("Monetary")))
    return labels.disagreements(p, "same").select("doc_id", "quality", "pred")


_MULTI = f"with {PRED_SQL}, c as (select 'quality' as label, {_CELLS.format(t='quality', p='pred')} from pr union all select 'toxic', {_CELLS.format(t='toxic', p='tox_pred')} from pr)"


@query("per_label", sql=f"{_MULTI} select label, {_PRF} from c")
def per_label(t: Tables) -> DataFrame:
    return _rounded(labels.multilabel_metrics(predictions(t), {"quality": ("quality", "pred"), "toxic": ("toxic", "tox_pred")}))


@query(
    "macro_weighted",
    sql=f"{_MULTI}, m as (select coalesce(tp / nullif(tp + fp, 0)::double, 0) as pr, coalesce(tp / nullif(tp + fn, 0)::double, 0) as rc, tp + fn as s from c) select round(avg(pr), 6) as macro_precision, round(avg(rc), 6) as macro_recall, round(sum(pr * s) / sum(s)::double, 6) as weighted_precision, round(sum(rc * s) / sum(s)::double, 6) as weighted_recall from m",
)
def macro_weighted(t: Tables) -> DataFrame:
    m = labels.multilabel_metrics(predictions(t), {"quality": ("quality", "pred"), "toxic": ("toxic", "tox_pred")})
    return _rounded(labels.averaged(m, ["precision", "recall"]))


@query("multilabel", sql="select vec_id, list_transform(embedding, lambda x: (x > 0.1::float)::int) as hits, (embedding[1] > 0.1::float)::int as first_hit from embeddings")
def multilabel(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", labels.thresholded("embedding", 0.1).alias("hits"))
    return e.withColumn("first_hit", F.get("hits", F.lit(0)))


@query("category_rates", sql=f"with {PRED_SQL} select source, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from pr group by 1")
def category_rates(t: Tables) -> DataFrame:
    return predictions(t).groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


def vowel_share(s: pd.Series) -> pd.Series:
    """Stand-in scorer: share of vowels."""
    return s.str.count("[aeiou]") / s.str.len().clip(lower=1)


@query("score_batch", sql="select doc_id, round((length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) / greatest(length(text), 1)::double, 6) as probability, ((length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) / greatest(length(text), 1)::double > 0.3)::int as label from documents")
def score_batch(t: Tables) -> DataFrame:
    s = labels.score_text(t.documents.select("doc_id", "text"), "text", vowel_share, 0.3)
    return s.select("doc_id", F.round("probability", 6).alias("probability"), "label")


@query(
    "exact_titles",
    sql="""with r as (select lower(p_name) as t, min(p_partkey) as matched from part group by 1)
select p_partkey, matched, 'exact' as how from (select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) || '!' else p_name end as title from part) l join r on r.t = regexp_replace(lower(title), '!', '', 'g')""",
)
def exact_titles(t: Tables) -> DataFrame:
    left = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.col("p_name")).alias("title"))
    out = labels.closest_titles(left, t.part.select(F.col("p_name").alias("title"), "p_partkey"), "title", "p_partkey")
    return out.filter(F.col("how") == "exact").select("p_partkey", "matched", "how")


@query(
    "fuzzy_titles",
    sql=f"""with p as (select p_partkey, substr(p_name, 1, 2) || substr(p_name, 4) as title, p_name from part),
n as (select *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as a, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as b from p),
r as (select b, min(p_partkey) as matched from n group by 1),
open as (select distinct a from n where a not in (select b from r)),
near as (select a, b from open, r where levenshtein(a, b) <= 0.15 * (length(a) + length(b)) + 1e-9),
scored as (select a, b, 200.0::double * {LCS_SQL} / (length(a) + length(b)) as score from near),
best as (select a, arg_min(b, (-score, b)) as b, max(score) as score from scored where score >= 85 group by 1)
select p_partkey, title, coalesce(e.matched, m.matched) as matched, round(case when e.b is not null then 100.0 else best.score end, 6)::double as score,
       case when e.b is not null then 'exact' when m.matched is not null then 'closest' else 'none' end as how
from n left join r e on e.b = n.a left join best on best.a = n.a and e.b is null left join r m on m.b = best.b""",
)
def fuzzy_titles(t: Tables) -> DataFrame:
    """Titles that lost a letter, matched to the closest catalogue title."""
    name = F.col("p_name")
    left = t.part.select("p_partkey", F.concat(F.substr(name, F.lit(1), F.lit(2)), F.substr(name, F.lit(4))).alias("title"))
    out = labels.closest_titles(left, t.part.select(name.alias("title"), "p_partkey"), "title", "p_partkey")
    return out.withColumn("score", F.round("score", 6))


# ---- data quality ------------------------------------------------------------------------------


_PROFILED = {"documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}}
_PROFILED["labels"] = {"doc_id": "bigint", "quality": "int", "toxic": "int"}


def _profile_sql(table: str) -> str:
    """Counts of every column; of the samples, how many there are and how many of them are beginnings of values of the column."""
    return " union all ".join(
        f"""select '{table}' as "table", '{c}' as "column", '{kind}' as type, count(*)::bigint as rows, round(1 - count({c}) / count(*)::double, 6) as null_share, count(distinct {c})::bigint as n_distinct, least(3, count(distinct {c}))::int as n_samples, least(3, count(distinct {c}))::bigint as n_real from {table}"""
        for c, kind in _PROFILED[table].items())


@query("profile", sql=" union all ".join(map(_profile_sql, _PROFILED)))
def profile(t: Tables) -> DataFrame:
    """Every column of two tables, the texts included. Samples are looked up in the table they come from."""
    out = None
    for name in _PROFILED:
        df = getattr(t, name)
        p = quality.profile(df)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.substring(F.col(c).cast("string"), 1, quality.PREVIEW).alias("shown")) for c in df.columns])).alias("x")
        shown = df.select(cells).select("x.*")
        asked = p.select("column", F.explode("samples").alias("shown"))
        real = shown.join(asked, ["column", "shown"], "left_semi").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_real"))
        part = p.join(real, "column", "left").select(
            F.lit(name).alias("table"), "column", "type", "rows", F.round("null_share", 6).alias("null_share"), "n_distinct",
            F.size("samples").alias("n_samples"), F.coalesce("n_real", F.lit(0)).alias("n_real"))
        out = part if out is None else out.union(part)
    return out


@query(
    "profile_sketched",
    sql=" union all ".join(f"""select '{c}' as "column", count(*)::bigint as rows, round(1 - count({c}) / count(*)::double, 6) as null_share, true as close from documents""" for c in _PROFILED["documents"]),
)
def profile_sketched(t: Tables) -> DataFrame:
    """Sketches of two halves of the documents put together; distinct counts within 5 % of the exact ones."""
    halves = [quality.sketches(t.documents.filter(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    got = quality.from_sketches(halves[0].union(halves[1])).join(quality.profile(t.documents).select("column", F.col("n_distinct").alias("exact")), "column")
    return got.select("column", "rows", F.round("null_share", 6).alias("null_share"), (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("close"))


@query("overview", sql="select count(*)::bigint as rows, count_if(quality is null)::bigint as quality_nulls, count_if(toxic is null)::bigint as toxic_nulls, round(avg(n_chars), 6) as mean_score from documents left join labels using (doc_id)")
def overview(t: Tables) -> DataFrame:
    return _rounded(quality.overview(t.documents.drop("text").join(t.labels, "doc_id", "left"), ["quality", "toxic"], "n_chars"))


_OVERVIEW = "select {0} as item, {1} as value, count(*)::bigint as rows, count_if(toxic is null)::bigint as toxic_nulls, round(avg(n_chars), 6) as mean_score from documents left join labels using (doc_id) group by all"


@query("overview_by", sql=" union all ".join([_OVERVIEW.format("'all'", "null::varchar"), *(_OVERVIEW.format(f"'{c}'", f"{c}::varchar") for c in ("lang", "source", "quality"))]))
def overview_by(t: Tables) -> DataFrame:
    """The overview of all rows and of the values of three categories, the missing value among them."""
    d = t.documents.drop("text").join(t.labels, "doc_id", "left")
    return _rounded(quality.overview_by(d, ["lang", "source", "quality"], ["toxic"], "n_chars"))


@query(
    "required_cols",
    sql="""select 'doc_id' as "column", 'ok' as state, count(*)::bigint as rows, count(doc_id)::bigint as filled from documents union all select 'text', 'ok', count(*)::bigint, count(text)::bigint from documents
union all select 'never', 'empty', count(*)::bigint, 0 from documents union all select 'congress', 'absent', count(*)::bigint, 0 from documents""",
)
def required_cols(t: Tables) -> DataFrame:
    """Required columns that are there and filled, there and empty, and not there."""
    d = t.documents.withColumn("never", F.when(F.length("text") < 0, F.col("lang")))
    return quality.required_columns(d, ["doc_id", "text", "never", "congress"])


@query(
    "constraints",
    sql="select 'quantity_from_1' as rule, count_if(not l_quantity >= 1)::bigint as broken from lineitem union all select 'discount_small', count_if(not l_discount < 0.05)::bigint from lineitem union all select 'flag_known', count_if(l_returnflag not in ('A', 'R'))::bigint from lineitem",
)
def constraints(t: Tables) -> DataFrame:
    rules = {"quantity_from_1": F.col("l_quantity") >= 1, "discount_small": F.col("l_discount") < 0.05, "flag_known": F.col("l_returnflag").isin("A", "R")}
    return quality.violations(t.lineitem, rules)


@query(
    "enriched_rules",
    sql="""with x as (select l_linenumber - 1 as seniority, l_discount * 1100 as match_score, l_linenumber % 2 as minority, l_linenumber % 3 as dem, (l_returnflag = 'R')::int as leader from lineitem)
select 'seniority_from_1' as rule, count_if(not seniority >= 1)::bigint as broken from x union all select 'match_score_range', count_if(not (match_score between 0 and 100))::bigint from x
union all select 'minority_binary', count_if(minority not in (0, 1))::bigint from x union all select 'dem_binary', count_if(dem not in (0, 1))::bigint from x union all select 'leader_binary', count_if(leader not in (0, 1))::bigint from x
union all select r, 0::bigint from (values ('freshman_binary'), ('chairspeech_binary'), ('rankmemspeech_binary'), ('female_binary')) v(r)""",
)
def enriched_rules(t: Tables) -> DataFrame:
    """The rules of the enriched table, on columns of which some break them."""
    none = {c: F.lit(None).cast("int") for c in ("freshman", "chairspeech", "rankmemspeech", "female")}
    x = t.lineitem.select(
        (F.col("l_linenumber") - 1).alias("seniority"), (F.col("l_discount") * 1100).alias("match_score"), (F.col("l_linenumber") % 2).alias("minority"),
        (F.col("l_linenumber") % 3).alias("dem"), (F.col("l_returnflag") == "R").cast("int").alias("leader")).withColumns(none)
    return quality.violations(x, quality.enriched_rules())


@query(
    "null_share_rules",
    sql="""with x as (select case when l_linenumber > 1 then l_suppkey end as bioguide_id, case when l_quantity > 2 then l_quantity end as nominate_dim1 from lineitem)
select 'ideology_of_matched' as rule, count(bioguide_id)::bigint as n, round(count_if(bioguide_id is not null and nominate_dim1 is null) / count(bioguide_id)::double, 6) as share, count_if(bioguide_id is not null and nominate_dim1 is null) / count(bioguide_id)::double < 0.05 as ok from x
union all select 'matched', count(*)::bigint, round(count_if(bioguide_id is null) / count(*)::double, 6), count_if(bioguide_id is null) / count(*)::double < 0.1 from x union all select 'nobody', 0, null, true""",
)
def null_share_rules(t: Tables) -> DataFrame:
    """At most a twentieth of the matched rows lacks a score; a rule that fails and one about no row beside it."""
    x = t.lineitem.select(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("bioguide_id"), F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("nominate_dim1"))
    unmatched = F.col("bioguide_id").isNull()
    rules = {**quality.null_share_rules(), "matched": (F.lit(True), unmatched, 0.1), "nobody": (F.lit(False), unmatched, 0.5)}
    return _rounded(quality.share_violations(x, rules))


@query(
    "date_bounds",
    sql=f"with x as (select {CONG} as congress, l_shipdate::date as d from lineitem join orders on o_orderkey = l_orderkey) select congress::int as congress, count(*)::bigint as n, count_if(not (d >= make_date((1787 + 2 * congress)::int, 1, 3) and d < make_date((1789 + 2 * congress)::int, 1, 3) + 90))::bigint as outside from x group by 1",
)
def date_bounds(t: Tables) -> DataFrame:
    o = orders_c(t).select(F.col("o_orderkey").alias("l_orderkey"), "congress")
    x = t.lineitem.select("l_orderkey", F.col("l_shipdate").cast("date").alias("d")).join(o, "l_orderkey")
    return quality.outside_session(x, "d", "congress")


@query("join_guard", sql="select l_partkey, count(*)::bigint as n from lineitem left join part on p_partkey = l_partkey group by 1")
def join_guard(t: Tables) -> DataFrame:
    """A left join whose right keys are checked, so the row count cannot change."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    out = rel.lookup_join(t.lineitem.select("l_partkey"), p, ["l_partkey"], validate=True)
    return out.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("covariate_nulls", sql="select count(*)::bigint as rows, count_if(quality is null)::bigint as quality_nulls, count_if(toxic is null)::bigint as toxic_nulls from documents left join labels using (doc_id) where lang = 'en'")
def covariate_nulls(t: Tables) -> DataFrame:
    d = t.documents.filter(F.col("lang") == "en").select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return quality.overview(d, ["quality", "toxic"], "n_chars").drop("mean_score")


@query("null_chart", sql="""select 'quality' as "column", round(avg((quality is null)::int) * 100, 6) as missing_pct from documents left join labels using (doc_id) union all select 'lang', round(avg((lang is null)::int) * 100, 6) from documents""")
def null_chart(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return _rounded(quality.missing_percent(d, ["quality", "lang", "absent"]))


@query("unique_key", sql="select l_orderkey, l_linenumber, count(*)::bigint as count from lineitem group by 1, 2 having count(*) > 1")
def unique_key(t: Tables) -> DataFrame:
    return rel.duplicated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
