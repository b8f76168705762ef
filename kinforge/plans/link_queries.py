"""Queries of the linkage operators over the whole test tables, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.config import LEVELS, MatchConfig
from kinforge.functions.cleaning import clean_fname, clean_lname, remove_accents, soundex_key
from kinforge.functions.similarity import compare
from kinforge.operators import blocking, preprocess, report, resolve
from kinforge.operators import results as res
from kinforge.plans import clean_sql
from kinforge.plans import link_sql as L
from kinforge.plans.people import first, second
from kinforge.session import stash

DEDUP, LINK = MatchConfig(), MatchConfig(match_type="M2M")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sides(spark, d: str, dedup: bool) -> tuple[DataFrame, DataFrame | None]:
    return first(spark, d), None if dedup else second(spark, d)


def _candidates(spark, d: str, config: MatchConfig, dedup: bool = True) -> DataFrame:
    return blocking.candidates(*_sides(spark, d, dedup), config).select("passnum", "idx_a", "idx_b")


def _only(*passes: list[str], **more) -> MatchConfig:
    return MatchConfig(blocks_by_pass=list(passes), comp_names_by_pass=[[] for _ in passes], **more)


@query(f"{L.tables(True)} {L.pairs('1', [], True, label='0')}")
def block_single_key(spark, d):
    return _candidates(spark, d, _only(["common_id"]))


@query(f"{L.tables(True)} {L.pairs('2', [], True, label='0')}")
def block_multi_key(spark, d):
    return _candidates(spark, d, _only(["xf", "xl"]))


@query(f"{L.tables(False)} {L.pairs('3', [], False, label='0')}")
def block_inverted(spark, d):
    return _candidates(spark, d, _only(["xf_inv", "xl_inv"], match_type="M2M"), dedup=False)


@query(f"{L.tables(True)} {L.pairs('4', [], True, label='0')}")
def block_dedup_self(spark, d):
    return _candidates(spark, d, _only(["byear", "bmonth", "bday"]))


@query(f"{L.tables(True)} {L.all_pairs(True)}")
def block_exclude_past(spark, d):
    return _candidates(spark, d, DEDUP)


@query(f"{L.tables(False)} {L.all_pairs(False)}")
def block_link(spark, d):
    return _candidates(spark, d, LINK, dedup=False)


@query(f"{L.tables(True)} {L.pairs('1', [], True, label='dup_common_id')} union all {L.pairs('2', ['1'], True, label='0')}")
def block_ground_truth(spark, d):
    return _candidates(spark, d, _only(["xf", "xl"], ground_truth_ids=["common_id"]))


def _scores(spark, d: str, names: list[str], dedup: bool, block: list[str]) -> DataFrame:
    """Scores of the pairs of one pass, rounded to nine digits."""
    config = _only(block) if dedup else _only(block, match_type="M2M")
    pairs = blocking.all_passes(*_sides(spark, d, dedup), config)[0][2]
    return pairs.select(F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), *[F.round(compare(n, config.sim_param[n]), 9).alias(n) for n in names])


def _scores_sql(names: list[str], dedup: bool, number: str) -> str:
    cols = "a.idx idx_a, b.idx idx_b" + "".join(f", round({L.SIMS[n]}, 9) {n}" for n in names)
    return f"{L.tables(dedup)} select * exclude (passnum) from ({L.pairs(number, [], dedup, cols)})"


for _query, _names, _dedup, _number, _block in (
    ("sim_jaro_winkler", ["fname", "mname", "lname", "altlname"], False, "2", ["xf", "xl"]),
    ("sim_inverted_names", ["fnamelname", "lnamefname"], False, "3", ["xf_inv", "xl_inv"]),
    ("sim_levenshtein", ["common_id"], True, "2", ["xf", "xl"]),
    ("sim_exact", ["zipcode", "county"], True, "4", ["byear", "bmonth", "bday"]),
    ("sim_byear", ["byear"], False, "2", ["xf", "xl"]),
    ("sim_bmonthbday", ["bmonthbday"], False, "2", ["xf", "xl"]),
    ("sim_minitial", ["minitial"], False, "2", ["xf", "xl"]),
):
    QUERIES[_query] = lambda spark, d, n=_names, s=_dedup, b=_block: _scores(spark, d, n, s, b)
    SQL[_query] = _scores_sql(_names, _dedup, _number)


@query(f"{L.tables(False)} select idx_a, idx_b, case when x is null or y is null then cast(0.5 as double) else greatest(0, 1 - abs(x - y) / 2) end score from ({L.pairs('2', [], False, 'a.idx idx_a, b.idx idx_b, a.bday x, b.bday y')})")
def sim_numeric(spark, d):
    pairs = blocking.all_passes(*_sides(spark, d, False), _only(["xf", "xl"], match_type="M2M"))[0][2]
    return pairs.select(F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), compare("bday", {"comparer": "numeric", "missing_value": 0.5}).alias("score"))


_DATE_SQL = """with p as (select idx, common_id, cast(received_at as date) t from preprocess_file_template)
 select a.idx idx_a, b.idx idx_b, case when a.t is null or b.t is null then cast(0.5 as double) when a.t = b.t then 1
 when year(a.t) = year(b.t) and month(a.t) = day(b.t) and day(a.t) = month(b.t) then 0.5
 when year(a.t) = year(b.t) and day(a.t) = day(b.t) and abs(month(a.t) - month(b.t)) = 1 and least(month(a.t), month(b.t)) in (6, 9) then 0.5 else 0 end score
 from p a join p b on a.common_id = b.common_id and a.common_id <> '' and a.idx < b.idx"""


@query(_DATE_SQL)
def sim_date(spark, d):
    p = spark.read.parquet(f"{d}/preprocess_file_template.parquet").select("idx", "common_id", F.col("received_at").cast("date").alias("t"))
    a, b = blocking.side(p, "a"), blocking.side(p, "b")
    pairs = a.join(b, (F.col("a_common_id") == F.col("b_common_id")) & (F.col("a_common_id") != "") & (F.col("a_idx") < F.col("b_idx")))
    return pairs.select(F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), compare("t", {"comparer": "date", "missing_value": 0.5}).alias("score"))


def _results(spark, d: str, dedup: bool) -> DataFrame:
    return res.results(*_sides(spark, d, dedup), DEDUP if dedup else LINK)


def _found(spark, d: str, dedup: bool) -> DataFrame:
    """Results as a run has them, without the scores: written once, read by several consumers."""
    return stash(_results(spark, d, dedup).select("passnum", "pass_order", "indv_id_a", "indv_id_b", "idx_a", "idx_b", *res.FLAGS, "weight"), "results")


def _accepted(spark, d: str, dedup: bool, level: str) -> DataFrame:
    """The pairs of ids that a level accepts, written: what groups are made of."""
    found = res.results(*_sides(spark, d, dedup), DEDUP if dedup else LINK, level)
    return stash(found.select("indv_id_a", "indv_id_b", f"match_{level}"), "accepted")


_SHOWN = ["idx_a", "idx_b", *res.FLAGS]
for _n in range(5):
    QUERIES[f"accept_p{_n}"] = lambda spark, d, n=_n: _results(spark, d, True).where(F.col("pass_order") == n).select(*_SHOWN, F.round("weight", 6).alias("weight"))
    SQL[f"accept_p{_n}"] = f"{L.results(True)} select {', '.join(_SHOWN)}, round(weight, 6) weight from found where pass_order = {_n}"


@query(f"{L.results(False)} select passnum, {', '.join(_SHOWN)}, round(weight, 6) weight from found")
def accept_link(spark, d):
    return _results(spark, d, False).select("passnum", *_SHOWN, F.round("weight", 6).alias("weight"))


_COUNTS = " union all ".join(f"select passnum, '{level}' strictness, match_{level} m from found" for level in LEVELS)


@query(f"{L.results(True)}, long as ({_COUNTS}) select passnum, strictness, cast(sum(cast(m as int)) as bigint) n_matches from long group by all union all select 'all', strictness, cast(sum(cast(m as int)) as bigint) from long group by all")
def accept_counts(spark, d):
    return res.counts(_results(spark, d, True)).select("passnum", "strictness", "n_matches")


@query(f"{L.results(True)} select indv_id_a, indv_id_b, passnum, idx_a, idx_b from (select *, row_number() over (partition by indv_id_a, indv_id_b order by round(weight, 9) desc, pass_order, idx_a, idx_b) r from found) where r = 1")
def pair_first_seen(spark, d):
    found = _found(spark, d, True).withColumn("weight", F.round("weight", 9))
    return res.first_per_pair(found).select("indv_id_a", "indv_id_b", "passnum", "idx_a", "idx_b")


def _sample_sql(name: str | None = None) -> str:
    parts = []
    for stricter, laxer in report.STEPS:
        for side, where, key in (("in", f"match_{stricter}", "w"), ("out", f"match_{laxer} and not match_{stricter}", "-w")):
            parts.append(f"select '{stricter}_{laxer}' cutoff, '{side}' side, passnum, cast(r as int) rank, idx_a, idx_b from (select *, row_number() over (partition by passnum order by {key}, indv_id_a, indv_id_b, idx_a, idx_b) r from w where {where}) where r <= 100")
    sample = " union all ".join(parts)
    return f"{L.results(True)}, w as (select *, round(weight, 9) w from found)" + (f", {name} as ({sample})" if name else f" {sample}")


@query(_sample_sql())
def review_sample(spark, d):
    found = _found(spark, d, True).withColumn("weight", F.round("weight", 9))
    return report.review_sample(found).select("cutoff", "side", "passnum", "rank", "idx_a", "idx_b")


_RECORD = ["common_id", "fname", "mname", "lname", "altlname", "minitial", "xf", "xl", *[x for p in ("byear", "bmonth", "bday") for x in (f"{p}_txt", p)], "zipcode", "county"]
# doubles are read as text by Spark and written so here: whole numbers with one digit after the point
_SHOWN_RECORD = [f"printf('%.1f', {c}) {c}" if c in ("byear", "bmonth", "bday") else c for c in _RECORD]
_RECORDS_SQL = " union all ".join(f"select cutoff, side, passnum, rank, '{x}' record, a.idx, a.indv_id, {', '.join(_SHOWN_RECORD)} from sample join a on a.idx = sample.idx_{x}" for x in "ab")


@query(f"{_sample_sql('sample')} {_RECORDS_SQL}")
def review_records(spark, d):
    """The records behind the review sample, one under the other."""
    found = _found(spark, d, True).withColumn("weight", F.round("weight", 9))
    return report.review_records(report.review_sample(found), first(spark, d))


def _best_sql(one: str, many: str, level: str = "relaxed") -> str:
    return f"""{L.results(False)}, w as (select *, round(weight, 9) w from found where match_{level}),
 t as (select *, max(w) over (partition by indv_id_{many}) m from w),
 u as (select indv_id_{many} many, min(indv_id_{one}) lo, max(indv_id_{one}) hi, cast(min(pass_order) as varchar) passnum from t where w = m group by 1)
 select {'lo' if one == 'a' else 'many'} indv_id_a, {'many' if one == 'a' else 'lo'} indv_id_b, passnum from u where lo = hi"""


@query(_best_sql("a", "b"))
def resolve_12m(spark, d):
    return resolve.best_unique(_found(spark, d, False).withColumn("weight", F.round("weight", 9)), "a", "relaxed")


@query(_best_sql("b", "a"))
def resolve_m21(spark, d):
    return resolve.best_unique(_found(spark, d, False).withColumn("weight", F.round("weight", 9)), "b", "relaxed")


# weight by weight: r holds the ids settled so far with their weight, and under the key '' the number of the weight that was last
_ONE_TO_ONE_SQL = f"""with recursive{L.results(False).removeprefix("with")},
 p as (select 'a_' || indv_id_a a, 'b_' || indv_id_b b, round(weight, 9) w, arg_min(passnum, pass_order) passnum from found where match_relaxed group by all),
 lv as (select w, row_number() over (order by w desc) n from (select distinct w from p)),
 r(id, entry, n) using key (id) as (select '' id, cast('infinity' as double) entry, cast(0 as bigint) n union
  select unnest(ids), w, n from (select [''] ids, lv.w w, lv.n n from r join lv on r.id = '' and lv.n = r.n + 1
   union all select [p.a, p.b], p.w, lv.n from r join lv on r.id = '' and lv.n = r.n + 1 join p on p.w = lv.w left join recurring.r x on x.id = p.a left join recurring.r y on y.id = p.b where x.id is null and y.id is null)),
 k as (select p.*, x.entry ea, y.entry eb from p join r x on x.id = a join r y on y.id = b),
 free as (select *, count(*) over (partition by a) na, count(*) over (partition by b) nb from k where w = ea and w = eb),
 late as (select a, b from k where w = ea and w < eb or w = eb and w < ea)
 select substr(a, 3) indv_id_a, substr(b, 3) indv_id_b, passnum from free where na = 1 and nb = 1 and a not in (select a from late) and b not in (select b from late)"""


@query(_ONE_TO_ONE_SQL)
def resolve_121(spark, d):
    return resolve.one_to_one(_found(spark, d, False).withColumn("weight", F.round("weight", 9)), "relaxed")


_COMPONENTS = """s as (select x, y from e union select y, x from e),
 r(node, root) using key (node) as (select x, min(least(x, y)) from s group by x union select s.y, min(r.root) from r join s on s.x = r.node join recurring.r o on o.node = s.y where r.root < o.root group by s.y)"""


def _recursive(sql: str) -> str:
    return "with recursive" + sql.removeprefix("with")


_DEDUP_SQL = f"""{_recursive(L.results(True))}, e as (select distinct trim(indv_id_a) x, trim(indv_id_b) y from found where match_strict), {_COMPONENTS},
 every as (select distinct trim(indv_id) node from a), x as (select node, coalesce(root, node) root from every left join r using (node))
 select node orig_id, cast(dense_rank() over (order by root) - 1 as bigint) ch_id from x"""


@query(_DEDUP_SQL)
def resolve_dedup(spark, d):
    return resolve.dedup(_accepted(spark, d, True, "strict"), first(spark, d), "strict")


_M2M_SQL = f"""{_recursive(L.results(False))}, p as (select distinct trim(indv_id_a) indv_id_a, trim(indv_id_b) indv_id_b, passnum from found where match_strict),
 e as (select distinct 'a_' || indv_id_a x, 'b_' || indv_id_b y from p), {_COMPONENTS}
 select indv_id_a, indv_id_b, cast(dense_rank() over (order by root) - 1 as bigint) ch_id, passnum from p join r on node = 'a_' || indv_id_a"""


@query(_M2M_SQL)
def resolve_m2m(spark, d):
    return resolve.many_to_many(_found(spark, d, False), "strict")


@query(f"select size, cast(count(*) as bigint) n_groups from (select ch_id, count(*) size from ({_DEDUP_SQL}) group by 1) group by 1")
def group_sizes(spark, d):
    return report.group_sizes(resolve_dedup(spark, d))


@query(f"with x as ({_best_sql('a', 'b')}) select 'relaxed' strictness, t n_total, m n_matched, t - m n_unmatched, round(m * 100.0::double / t, 2) rate from (select count(distinct indv_id) t from match_input_b), (select count(*) m from x)")
def match_rate(spark, d):
    return report.match_rate(resolve_12m(spark, d), second(spark, d), "indv_id", "relaxed")


@query(f"with x as (select ch_id, count(distinct orig_id) n from ({_DEDUP_SQL}) group by 1) select 'strict' strictness, cast(sum(n) as bigint) n_total, count(*) filter (n = 1) n_unmatched, count(*) n_unique, cast(sum(n) as bigint) - count(*) n_duplicates, round((sum(n) - count(*)) * 100.0::double / sum(n), 2) rate from x")
def dedup_rate(spark, d):
    return report.dedup_rate(resolve_dedup(spark, d), "strict")


@query("select p.idx, p.source_id, x.ch_id new_ch_id from preprocess_file_template p left join (select distinct orig_id, ch_id from crosswalk) x on orig_id = source_id")
def join_to_original(spark, d):
    people = spark.read.parquet(f"{d}/preprocess_file_template.parquet").select("idx", "source_id")
    return report.join_to_original(people, spark.read.parquet(f"{d}/crosswalk.parquet"), "source_id", "orig_id", "ch_id")


_THEIRS = "select least(indv_id_a, indv_id_b) x, greatest(indv_id_a, indv_id_b) y from candidates where indv_id_a <> '' and indv_id_b <> ''"


def _theirs(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/candidates.parquet").where("indv_id_a <> '' and indv_id_b <> ''")


@query(f"{L.results(True)}, o as (select distinct least(indv_id_a, indv_id_b) x, greatest(indv_id_a, indv_id_b) y from found where match_strict), t as (select distinct x, y from ({_THEIRS})), s as (select (select count(*) from o semi join t using (x, y)) b, (select count(*) from o) o, (select count(*) from t) t) select b n_both, o - b n_ours_only, t - b n_theirs_only, round(b * 100.0::double / t, 2) share_of_theirs from s")
def crosswalk_diff(spark, d):
    canon = lambda df: df.select(F.least("indv_id_a", "indv_id_b").alias("x"), F.greatest("indv_id_a", "indv_id_b").alias("y"))
    return report.compare_crosswalks(canon(_found(spark, d, True).where("match_strict")), canon(_theirs(spark, d)), ["x", "y"])


_LOST = " union all ".join(f"select '{level}' strictness, count(*) n_lost from tried anti join (select distinct least(indv_id_a, indv_id_b) x, greatest(indv_id_a, indv_id_b) y from found where match_{level}) using (x, y)" for level in LEVELS)


@query(f"{L.results(True)}, cand as (select distinct least(i.indv_id, j.indv_id) x, greatest(i.indv_id, j.indv_id) y from ({L.all_pairs(True)}) c join a i on i.idx = c.idx_a join a j on j.idx = c.idx_b), tried as (select distinct x, y from ({_THEIRS}) semi join cand using (x, y)) {_LOST}")
def lost_pairs(spark, d):
    """Only pairs of the other matcher can be lost, so only rows of its pairs are blocked and compared."""
    theirs, people = _theirs(spark, d), first(spark, d)
    found = stash(res.results(people, None, DEDUP, among=theirs).select("indv_id_a", "indv_id_b", *res.FLAGS), "found-among")
    return report.lost_pairs(theirs, blocking.candidates(people, None, DEDUP, theirs), found, dedup=True)


# preparation

_RAW = ("idx", "fname", "mname", "lname", "altlname", "suffix")


def _raw(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/preprocess_file_template.parquet")


@query("select idx, lname, altlname from preprocess_file_template union all select idx, altlname, null from preprocess_file_template where altlname is not null")
def alias_melt(spark, d):
    return preprocess.name_aliases(_raw(spark, d).select("idx", "lname", "altlname"), "lname", "altlname").select("idx", "lname", "altlname")


@query("select distinct idx, mname from (select idx, mname from preprocess_file_template union all select idx, unnest(string_split(mname, ' ')) from preprocess_file_template) where mname is null or mname <> '' or (idx, mname) in (select (idx, mname) from preprocess_file_template)")
def mname_explode(spark, d):
    return preprocess.middle_aliases(_raw(spark, d).select("idx", "mname"))


@query("select source_id, fname, lname, idx from (select *, row_number() over (order by source_id nulls first, fname nulls first, lname nulls first) - 1 idx from (select distinct source_id, fname, lname from preprocess_file_template))")
def combine_dedupe_idx(spark, d):
    p = _raw(spark, d).select("source_id", "fname", "lname")
    return preprocess.combine([p, p], ["source_id", "fname", "lname"])


@query("select idx, case when common_id in ('0', 'n/a', 'NULL', '99999999') then '' else coalesce(common_id, '') end common_id, case when zipcode in ('00000', '99999') then '' else coalesce(zipcode, '') end zipcode from preprocess_file_template")
def bad_value_blanking(spark, d):
    df = _raw(spark, d).select("idx", F.coalesce("common_id", F.lit("")).alias("common_id"), F.coalesce("zipcode", F.lit("")).alias("zipcode"))
    return preprocess.blank(df, {"ids": ["0", "n/a", "NULL", "99999999"], "zipcode": ["00000", "99999"]}, {"idx", "zipcode"})


@query("select idx, case when length(zipcode) > 5 then substr(zipcode, 1, 5) else zipcode end zipcode from preprocess_file_template")
def zip_truncate(spark, d):
    return _raw(spark, d).select("idx", preprocess.short_zip(F.col("zipcode")).alias("zipcode"))


@query("select idx, cast(year(received_at) as varchar) byear, cast(month(received_at) as varchar) bmonth, cast(day(received_at) as varchar) bday from preprocess_file_template")
def dob_split(spark, d):
    return preprocess.split_dob(_raw(spark, d).select("idx", F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd").alias("dob")), "dob", "yyyy-MM-dd").select("idx", "byear", "bmonth", "bday")


@query("select idx, byear, bmonth, bday from (select idx, try_cast(substr(strftime(received_at, '%Y%m%d'), 1, 4) as double) byear, try_cast(substr(strftime(received_at, '%Y%m%d'), 5, 2) as double) bmonth, try_cast(substr(strftime(received_at, '%Y%m%d'), 7, 2) as double) bday from preprocess_file_template)")
def dob_text_split(spark, d):
    text = F.date_format(F.col("received_at").cast("timestamp"), "yyyyMMdd")
    parts = preprocess.split_dob_text(text)
    return _raw(spark, d).select("idx", *[c.alias(n) for n, c in parts.items()])


@query("select idx, coalesce(substr(mname, 1, 1), '') minitial from preprocess_file_template")
def minitial(spark, d):
    return _raw(spark, d).select("idx", preprocess.minitial(F.col("mname")).alias("minitial"))


def _soundex_sql(c: str) -> str:
    """Letters as digits (H and W, 7, are looked through; what is no letter ends a run like a vowel), runs of one digit once."""
    codes = f"regexp_replace(translate(upper({c}), '123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '00000000001230127022455012623017202'), '[^0-9]', '0', 'g')"
    runs = f"substr({codes}, 1, 1) || replace(substr({codes}, 2), '7', '')"
    for digit in "123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    whole = f"upper(substr({c}, 1, 1)) || substr(replace(substr({runs}, 2), '0', ''), 1, 3)"
    return f"trim(case when upper({c}) similar to '[A-Z].*' then {whole} else upper({c}) end, '0')"


@query(f"select idx, {_soundex_sql('fname')} xf, {_soundex_sql('lname')} xl from preprocess_file_template")
def soundex_keys(spark, d):
    return _raw(spark, d).select("idx", soundex_key(F.upper("fname")).alias("xf"), soundex_key(F.upper("lname")).alias("xl"))


@query("select idx, regexp_replace(strip_accents(lname), '[^\\x00-\\x7F]', '', 'g') lname from preprocess_file_template")
def accents(spark, d):
    return _raw(spark, d).select("idx", remove_accents(F.col("lname")).alias("lname"))


@query(clean_sql.FIRST)
def clean_first_names(spark, d):
    return _raw(spark, d).select("idx", clean_fname(F.col("fname"), F.col("mname")).alias("n")).select("idx", "n.*")


@query(clean_sql.LAST)
def clean_last_names(spark, d):
    return _raw(spark, d).select("idx", clean_lname(F.col("lname"), F.col("altlname")).alias("n")).select("idx", "n.*")


_SAME = ("source_id", "byear", "bmonth", "bday", "county")
_PREPROCESSED_SQL = f"""with f as (from ({clean_sql.FIRST})), l as (from ({clean_sql.LAST})),
 n as (select {', '.join(f"coalesce({c}, '') {c}" for c in _SAME)}, case when common_id in ('0', 'n/a', 'NULL', '99999999') then '' else coalesce(common_id, '') end common_id,
  case when zipcode in ('00000', '99999') then '' when length(zipcode) > 5 then substr(zipcode, 1, 5) else coalesce(zipcode, '') end zipcode,
  f.fname, f.mname, f.altfname, l.lname, l.altlname, coalesce(l.suffix, f.suffix) suffix from preprocess_file_template p join f using (idx) join l using (idx)),
 x as (select * replace (unnest(case when altfname is null then [fname] else [fname, altfname] end) as fname) from n),
 y as (select * exclude (lname, altlname), unnest(case when altlname is null then [{{'l': lname, 'o': altlname}}] else [{{'l': lname, 'o': altlname}}, {{'l': altlname, 'o': null}}] end) w from x)
 select distinct source_id, fname, {_soundex_sql('fname')} xf, mname, coalesce(substr(mname, 1, 1), '') minitial, w.l lname, {_soundex_sql('w.l')} xl, w.o altlname, suffix, byear, bmonth, bday, zipcode, county, common_id from y"""


@query(_PREPROCESSED_SQL)
def preprocessed(spark, d):
    """The whole preparation of the raw table."""
    names = ("source_id", "fname", "mname", "lname", "altlname", "byear", "bmonth", "bday", "zipcode", "county", "common_id")
    spec = preprocess.PreprocessSpec(vars={n: n for n in names}, bad_values={"zipcode": ["00000", "99999"], "ids": ["0", "n/a", "NULL", "99999999"]}, other_ids=["common_id"])
    return preprocess.preprocess(_raw(spark, d), spec)
