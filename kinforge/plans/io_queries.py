"""Queries of sources, sinks and reports on written results: each table is written, read back by the operator, and compared."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.config import LEVELS, DatasetSpec, MatchConfig
from kinforge.operators import report, resolve
from kinforge.operators import results as res
from kinforge.operators.preprocess import PreprocessSpec, combine, match_input, preprocess
from kinforge.plans import link_sql as L
from kinforge.plans.link_queries import _DEDUP_SQL, _M2M_SQL, _ONE_TO_ONE_SQL, DEDUP, LINK, _best_sql, _found, _results, resolve_12m, resolve_121, resolve_dedup, resolve_m2m
from kinforge.plans.people import first, second
from kinforge.session import shared_dir
from kinforge.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLS = ("idx", "source_id", "fname", "lname", "zipcode")
#: As text files bring them back: outer white space and empty texts aren't kept, line breaks don't occur.
def _edged(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g'), '')"


_TEXT = ", ".join(f"{_edged(c)} {c}" for c in _COLS[1:])


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _people(spark, d: str, cols: tuple = _COLS) -> DataFrame:
    return spark.read.parquet(f"{d}/preprocess_file_template.parquet").select(*cols)


def _folder(spark, name: str) -> str:
    """A new name in the shared folder, removed with the other written tables."""
    return f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select("idx", *map(_bare, _COLS[1:]))


def _bare(c: str):
    return F.nullif(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), F.lit("")).alias(c)


@query(f"select cast(idx as varchar) idx, {_TEXT} from preprocess_file_template")
def source_csv(spark, d):
    """CSV scan of the mapped columns only."""
    at = _folder(spark, "csv")
    files.write_csv(_trimmed(_people(spark, d)), at)
    spec = DatasetSpec("p", at, "csv", {c: c for c in _COLS})
    return files.load_dataset(spark, spec)


@query("select cast(idx as varchar) idx, source_id, nullif(trim(zipcode), '') zipcode from preprocess_file_template")
def source_fixed_width(spark, d):
    at = _folder(spark, "fwf")
    p = _people(spark, d)
    p.select(F.concat(F.rpad(F.col("idx").cast("string"), 12, " "), F.rpad("source_id", 16, " "), F.rpad(F.coalesce("zipcode", F.lit("")), 12, " "))).write.text(at)
    return files.load_dataset(spark, DatasetSpec("p", at, "fwf", {"idx": "i", "source_id": "s", "zipcode": "z"}, (12, 16, 12), ("i", "s", "z")))


@query("select idx, source_id indv_id, lname from preprocess_file_template")
def source_table(spark, d):
    """A catalog table, by its name and by its file type."""
    name = f"kinforge_{uuid.uuid4().hex}"
    _people(spark, d).createOrReplaceTempView(name)
    return files.load_dataset(spark, DatasetSpec("p", name, "table", {"indv_id": "source_id", "lname": "lname"}))


@query("select source_id, lname from preprocess_file_template")
def source_plugin(spark, d):
    """A source of the caller's own."""
    files.plugin("people of a test")(lambda s: _people(s, d))
    return files.load_dataset(spark, DatasetSpec("people of a test", "", "plugin", {"source_id": "source_id", "lname": "lname"})).select("source_id", "lname")


@query("select row_number() over (order by source_id) - 1 idx, source_id, try_cast(substr(dob, 1, 4) as double) byear, try_cast(substr(dob, 5, 2) as double) bmonth, try_cast(substr(dob, 7, 2) as double) bday from (select source_id, min(strftime(received_at, '%Y%m%d')) dob from preprocess_file_template group by 1)")
def import_prepared(spark, d):
    """A prepared file: control characters removed, date split, rows numbered."""
    at = _folder(spark, "prepared")
    p = spark.read.parquet(f"{d}/preprocess_file_template.parquet").groupBy("source_id").agg(F.min(F.date_format(F.col("received_at").cast("timestamp"), "yyyyMMdd")).alias("dob"))
    p.select(F.concat("source_id", F.lit("\x00")).alias("source_id"), "dob").write.parquet(at)
    return files.import_prepared(spark, DatasetSpec("p", at, vars={"source_id": "source_id", "dob": "dob"}), "dob").select("idx", "source_id", "byear", "bmonth", "bday")


@query(f"select row_number() over (order by source_id nulls first, fname nulls first, lname nulls first) - 1 idx, * from (select distinct source_id, fname, lname from (select {_TEXT} from preprocess_file_template union all select indv_id, {_edged('fname')}, {_edged('lname')}, null from match_input_b))")
def combine_earlier(spark, d):
    """A new table with a table and a CSV of earlier runs."""
    table, csv = _folder(spark, "earlier"), _folder(spark, "earlier-csv")
    some = ("source_id", "fname", "lname")
    files.write_csv(_trimmed(_people(spark, d)).select(*some), csv)
    b = spark.read.parquet(f"{d}/match_input_b.parquet")
    b.select(F.col("indv_id").alias("source_id"), *[_bare(c) for c in some[1:]]).write.parquet(table)
    return combine([*files.earlier(spark, [table], [csv]), _trimmed(_people(spark, d)).select(*some)], list(some)).select("idx", *some)


@query("select cast(idx as varchar) idx, coalesce(lname, '') lname from preprocess_file_template")
def sink_table(spark, d):
    """Bulk load: missing text is written as ''."""
    at = _folder(spark, "table")
    files.write_table(_people(spark, d).select(F.col("idx").cast("string").alias("idx"), "lname"), at)
    return files.load_raw(spark, DatasetSpec("p", at))


@query(f"{L.results(False)} select passnum, cast(idx_a as varchar) idx_a, cast(idx_b as varchar) idx_b, cast(match_strict as varchar) match_strict, round(weight, 6) weight from found")
def sink_scored_pairs(spark, d):
    """Scored pairs as CSV, read back."""
    at = _folder(spark, "scored")
    files.write_scored(_results(spark, d, False), at)
    return files.read_csv(spark, at).select("passnum", "idx_a", "idx_b", "match_strict", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query(_best_sql("a", "b"))
def sink_crosswalk(spark, d):
    """A crosswalk as CSV without header, read back by position."""
    at = _folder(spark, "crosswalk")
    resolve_12m(spark, d).write.csv(at)
    return files.read_crosswalk(spark, at, ["indv_id_a", "indv_id_b", "passnum"])


@query("select distinct least(indv_id_a, indv_id_b) indv_id_a, greatest(indv_id_a, indv_id_b) indv_id_b from candidates where indv_id_a <> '' and indv_id_b <> ''")
def source_pair_lines(spark, d):
    """Pairs of another matcher at fixed places of each line."""
    at = _folder(spark, "lines")
    pairs = spark.read.parquet(f"{d}/candidates.parquet").where("indv_id_a <> '' and indv_id_b <> ''")
    pairs.select(F.concat(F.lit("00"), F.rpad("indv_id_a", 16, " "), F.rpad("indv_id_b", 16, " "))).write.text(at)
    return files.read_pair_lines(spark, at, (2, 18), (18, 34), dedup=True).distinct()


@query(f"select cast(ch_id as varchar) group_id, orig_id item from ({_DEDUP_SQL})")
def groups_saved(spark, d):
    """A grouping saved and loaded."""
    at = _folder(spark, "groups")
    files.save_groups(resolve_dedup(spark, d), at, "ch_id", "orig_id")
    return files.load_groups(spark, at)


@query("select p.idx, p.source_id, cast(x.ch_id as varchar) new_ch_id from preprocess_file_template p left join (select distinct orig_id, ch_id from crosswalk) x on orig_id = source_id")
def sink_joined(spark, d):
    """The newest crosswalk of a folder joined to the people, as CSV."""
    at = _folder(spark, "joined")
    links = spark.read.parquet(f"{d}/crosswalk.parquet")
    links.limit(0).write.parquet(f"{at}/crosswalk_strict_1")
    links.write.parquet(f"{at}/crosswalk_strict_2")
    xwalk = spark.read.parquet(files.latest(spark, at, "crosswalk", "strict"))
    files.write_csv(report.join_to_original(_people(spark, d, ("idx", "source_id")), xwalk, "source_id", "orig_id", "ch_id"), f"{at}/joined")
    return files.read_csv(spark, f"{at}/joined").select(F.col("idx").cast("bigint").alias("idx"), "source_id", "new_ch_id")


@query(f"with x as ({_best_sql('b', 'a')}) select 'b' side, y.* from (select p.idx, p.indv_id, x.indv_id_b new_indv_id_b from ({L.first_sql()}) p left join (select distinct * from x) x on x.indv_id_a = p.indv_id) y")
def join_second(spark, d):
    """Join-back of an M21 crosswalk by its side a."""
    xwalk = resolve.best_unique(_found(spark, d, False).withColumn("weight", F.round("weight", 9)), "b", "relaxed")
    people = first(spark, d).select("idx", "indv_id")
    return report.join_to_original(people, xwalk, "indv_id", "indv_id_a", "indv_id_b").select(F.lit("b").alias("side"), "idx", "indv_id", "new_indv_id_b")


@query(f"select indv_id_a id, indv_id_b \"match\" from ({_ONE_TO_ONE_SQL})")
def final_matches_121(spark, d):
    return report.final_matches(resolve_121(spark, d), "121")


@query(f"select ch_id group_id, orig_id id from (select *, count(*) over (partition by ch_id) n from (select distinct ch_id, orig_id from ({_DEDUP_SQL}))) where n > 1")
def final_matches_dedup(spark, d):
    return report.final_matches(resolve_dedup(spark, d), "dedup")


@query(f"with x as ({_M2M_SQL.replace('with recursive', 'with recursive ', 1)}) select distinct ch_id group_id, unnest([indv_id_a || '_a', indv_id_b || '_b']) id from x")
def final_matches_m2m(spark, d):
    return report.final_matches(resolve_m2m(spark, d), "M2M")


def _rate_sql(level: str) -> str:
    return f"select '{level}' strictness, t n_total, m n_matched, t - m n_unmatched, round(m * 100.0::double / t, 2) rate from (select count(distinct indv_id) t from match_input_b), (select count(*) m from ({_best_sql('a', 'b', level)}))"


@query(" union all ".join(map(_rate_sql, LEVELS)))
def rates_by_level(spark, d):
    """The threshold driver: a rate for each level."""
    found = _found(spark, d, False).withColumn("weight", F.round("weight", 9))
    return report.rates({level: report.match_rate(resolve.best_unique(found, "a", level), second(spark, d), "indv_id", level) for level in LEVELS})


@query(f"{L.tables(True)} select 'dup_common_id' passnum, idx_a, idx_b, cast(1000000 as double) weight, true match_strict from ({L.pairs('1', [], True)})")
def ground_truth_weight(spark, d):
    """Pairs with one ground-truth id weigh more than any pass."""
    config = MatchConfig(ground_truth_ids=["common_id"])
    return res.results(first(spark, d), None, config).where("pass_order < 0").select("passnum", "idx_a", "idx_b", "weight", "match_strict")


@query(f"{L.results(False)} select cast(row_number() over (order by round(weight, 9) desc, pass_order, indv_id_a, indv_id_b, idx_a, idx_b) as int) place, idx_a, idx_b from found")
def heaviest_first(spark, d):
    """Results in their written order: the places that a scan of the sorted parts gives."""
    at = _folder(spark, "ordered")
    res.ordered(_results(spark, d, False).withColumn("weight", F.round("weight", 9))).write.parquet(at)
    rows = spark.read.parquet(at).select("idx_a", "idx_b", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "weight", "pass_order", "indv_id_a", "indv_id_b")
    part = rows.groupBy("f").agg(F.count("*").alias("n"))
    start = part.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("f").orderBy("i"))
    return rows.withColumn("w", within).join(start, "f").select((F.col("w") + F.col("before")).cast("int").alias("place"), "idx_a", "idx_b")


@query(f"{L.results(True)}, sample as (select * from found where match_strict) select {', '.join(f'greatest({len(c)}, max(length({c}))) {c}' for c in ('indv_id_a', 'indv_id_b', 'passnum'))} from sample")
def column_widths(spark, d):
    widths = report.widths(_found(spark, d, True).where("match_strict").select("indv_id_a", "indv_id_b", "passnum"))
    return widths.select(*[F.col(c).cast("bigint").alias(c) for c in widths.columns])


_OWN_RULES = """from pyspark.sql import functions as F


def accept_p2_strict(scores):
    return scores.is_one("fname", "lname")
"""


@query(f"{L.tables(False)} select idx_a, idx_b, x = 1 and y = 1 own from (select idx_a, idx_b, x, y from ({L.pairs('2', [], False, 'a.idx idx_a, b.idx idx_b, ' + L.SIMS['fname'] + ' x, ' + L.SIMS['lname'] + ' y')})) where x = 1 and y = 1")
def custom_rules(spark, d):
    """Acceptance rules from a file of the caller's own, for one run."""
    at = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / f"rules-{uuid.uuid4().hex}.py"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(_OWN_RULES)
    try:
        config = MatchConfig(match_type="M2M", blocks_by_pass=[[], [], ["xf", "xl"]], comp_names_by_pass=[[], [], ["fname", "lname"]], rules_path=str(at))
        found = res.results(first(spark, d), second(spark, d), config)
    finally:
        at.unlink()
    return found.where("match_strict").select("idx_a", "idx_b", F.lit(True).alias("own"))


@query(f"{L.tables(False)} select idx_a, idx_b, cast(x as double) own from (select idx_a, idx_b, case when coalesce(f, '') = '' or coalesce(g, '') = '' then 0.5 when substr(f, 1, 1) = substr(g, 1, 1) then 1 else 0 end x from ({L.pairs('2', [], False, 'a.idx idx_a, b.idx idx_b, a.fname f, b.fname g')}))")
def custom_comparer(spark, d):
    """A comparer of the caller's own."""
    from kinforge.functions.similarity import compare, register
    from kinforge.operators import blocking

    def initial(a, b, p):
        missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
        return F.when(missing, p["missing_value"]).otherwise((F.substring(a, 1, 1) == F.substring(b, 1, 1)).cast("double"))

    register("initial of a test", initial)
    config = MatchConfig(match_type="M2M", blocks_by_pass=[["xf", "xl"]], comp_names_by_pass=[[]])
    pairs = blocking.all_passes(first(spark, d), second(spark, d), config)[0][2]
    return pairs.select(F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), compare("fname", {"comparer": "initial of a test", "missing_value": 0.5}).alias("own"))


@query("select idx, try_cast(byear as double) byear, try_cast(bmonth as double) bmonth, try_cast(bday as double) bday, byear byear_txt, coalesce(substr(mname, 1, 1), '') minitial from preprocess_file_template")
def match_input_types(spark, d):
    """A person table as comparisons read it."""
    return match_input(_people(spark, d, ("idx", "mname", "byear", "bmonth", "bday"))).select("idx", "byear", "bmonth", "bday", "byear_txt", "minitial")


_SHAPE = ("source_id", "fname", "xf", "mname", "minitial", "lname", "xl", "altlname", "suffix", "byear", "bmonth", "bday", "zipcode", "county")


@query(f"select source_id, '{','.join(_SHAPE)}' cols, '7' file_type, '' fname, case when coalesce(zipcode, '') = '' then '' else substr(zipcode, 1, 5) end zipcode from preprocess_file_template group by all")
def preprocess_shape(spark, d):
    """Renaming, constants, placeholder columns, empty text for missing and the order of columns, without names."""
    spec = PreprocessSpec(vars={"source_id": "source_id", "zipcode": "zipcode"}, constants={"file_type": "7"}, other_ids=["file_type"])
    made = preprocess(_people(spark, d, ("source_id", "zipcode")), spec)
    return made.select("source_id", F.lit(",".join(made.columns[:-1])).alias("cols"), "file_type", F.coalesce("fname", F.lit("")).alias("fname"), "zipcode")


@query("select '2020' || '007' || lpad(cast(row_number() over (order by coalesce(zipcode, '')) - 1 as varchar), 7, '0') source_id, case when length(zipcode) > 5 then substr(zipcode, 1, 5) else coalesce(zipcode, '') end zipcode from preprocess_file_template")
def row_ids(spark, d):
    """Synthetic source ids: year, file and row number."""
    spec = PreprocessSpec(vars={"zipcode": "zipcode"}, year="2020", file_num="007")
    return preprocess(_people(spark, d, ("zipcode",)), spec).select("source_id", "zipcode")


@query("select 'dedup' match_type, 5 n_passes, 0.88::double name_high, true same")
def config_round_trip(spark, d):
    text = DEDUP.to_json()
    got = MatchConfig.from_json(text)
    row = (got.match_type, len(got.blocks_by_pass), got.thresholds["name_high"], got == DEDUP and json.loads(text)["match_type"] == "dedup" and LINK != DEDUP)
    return spark.createDataFrame([row], "match_type string, n_passes int, name_high double, same boolean")


@query()
def review_text(spark, d):
    """The clerical review file, a line a row."""
    found = _found(spark, d, True).withColumn("weight", F.round("weight", 9))
    text = report.review_text(report.review_records(report.review_sample(found, 20), first(spark, d)))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")
