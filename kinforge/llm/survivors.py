"""One surviving record for each group of duplicates, field by field.

A latent two-sided quality model says how far each source can be trusted: every value that a group's records offer for a
field is a fact, true or false; a source that has records in the group either states it or doesn't. Expectation-
maximisation infers each source's sensitivity (states true facts) and specificity (leaves out false ones). A
field may have several true values and all judged true are retained (survivor_facts). The survivor then takes, of the
usable values, the one that its rule prefers (fullest name, latest zip code); the model decides between values that the
rule leaves equal.

Records are reduced to facts by partial aggregates; a fact holds the sources that state it and those that don't, at most
one entry for each source. A round of the model joins the patterns of such sources with the sources' qualities and aggregates
by pattern, then by source; rounds go on until the qualities stand still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.session import drop_stash, stash

#: What stands for a missing middle name.
PLACEHOLDERS = ("NMN", "NMI", "NONE", "UNK", "UNKNOWN", "N/A", "NULL", "NO MIDDLE NAME", "NOT GIVEN", "XXX", "XX", "X", "TEST", "-", "MISSING", "BLANK")
#: How far a source's quality may still move, and rounds within which that must be reached.
TOLERANCE, ROUNDS = 1e-4, 1000
#: Patterns whose rounds one task takes on.
PATTERNS_PER_TASK = 200_000
#: Between the names of the sources of a pattern.
SEPARATOR = "\0"
#: Prior counts of the two Beta distributions (true positives, false negatives; true negatives, false positives) and of truth.
PRIOR_SENSITIVITY, PRIOR_SPECIFICITY, PRIOR_TRUE = (5.0, 5.0), (9.0, 1.0), 0.5


def middle_name(c: Column) -> Column:
    """Upper case, outer punctuation and white space removed, inner white space single; NULL if a placeholder or without a letter."""
    name = F.upper(F.regexp_replace(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"\s+", " "))
    return F.when(name.rlike(r"\p{L}") & ~name.isin(*PLACEHOLDERS), name)


def zip5(c: Column) -> Column:
    """First five digits of a zip code of 5 or 9 digits (a hyphen may stand between), else NULL; NULL too for one digit five times."""
    z = F.trim(c)
    return F.when(z.rlike(r"^\d{5}(-?\d{4})?$") & ~F.substring(z, 1, 5).rlike(r"^(\d)\1{4}$"), F.substring(z, 1, 5))


def latent_truth(facts: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS, patterns_per_task: int = PATTERNS_PER_TASK) -> DataFrame:
    """facts with (yes, no: arrays of source names) -> the same with p_true, by expectation-maximisation until no source's
    sensitivity or specificity moves by more than tolerance; RuntimeError if that takes more than rounds.

    Facts with equal yes and no are one pattern with a count, and only patterns take part in the rounds: up to patterns_per_task
    of them in one task, more as joins and aggregates. Sources are rows of a table, so neither their number nor that of the
    patterns is bounded; the driver sees one number a round."""
    sets = [F.array_join(F.array_sort(c), SEPARATOR) for c in ("yes", "no")]
    facts = facts.withColumn("pattern", F.concat_ws(SEPARATOR + SEPARATOR, *sets))
    patterns = facts.groupBy("pattern").agg(F.first("yes").alias("yes"), F.first("no").alias("no"), F.count("*").alias("n"))
    saying = lambda c, y: F.transform(c, lambda s: F.struct(s.alias("source"), F.lit(y).alias("said")))
    patterns = stash(patterns, "p4-counted")
    said = stash(patterns.select("pattern", "n", F.inline(F.concat(saying("yes", True), saying("no", False)))), "p4-patterns")
    (a1, a0), (b1, b0) = PRIOR_SENSITIVITY, PRIOR_SPECIFICITY
    quality = said.select("source").distinct().select("source", F.lit(a1 / (a1 + a0)).alias("sens"), F.lit(b1 / (b1 + b0)).alias("spec"))

    def believed(quality: DataFrame) -> DataFrame:
        weight = F.when(F.col("said"), F.ln(F.col("sens") / (1 - F.col("spec")))).otherwise(F.ln((1 - F.col("sens")) / F.col("spec")))
        logit = F.lit(math.log(PRIOR_TRUE / (1 - PRIOR_TRUE))) + F.sum(weight)
        return said.join(quality, "source").groupBy("pattern").agg((1 / (1 + F.exp(-logit))).alias("p_true"))

    if patterns.count() <= patterns_per_task:
        quality = stash(said.coalesce(1).mapInPandas(_maximised(tolerance, rounds), "source string, sens double, spec double"), "p4-quality")
        return facts.join(believed(quality), "pattern").drop("pattern")
    quality = stash(quality, "p4-quality")
    for _ in range(rounds):
        p, n = F.col("p_true"), F.col("n")
        total = lambda said, part: F.sum(F.when(F.col("said") == said, n * part).otherwise(0.0))
        sums = said.join(believed(quality), "pattern").groupBy("source").agg(total(True, p).alias("tp"), total(False, p).alias("fn"), total(False, 1 - p).alias("tn"), total(True, 1 - p).alias("fp"))
        sens, spec = (F.col("tp") + a1) / (F.col("tp") + F.col("fn") + a1 + a0), (F.col("tn") + b1) / (F.col("tn") + F.col("fp") + b1 + b0)
        old, quality = quality, stash(sums.select("source", sens.alias("sens"), spec.alias("spec")), "p4-quality")
        before = old.select("source", F.col("sens").alias("_s"), F.col("spec").alias("_t"))
        moved = quality.join(before, "source").agg(F.max(F.greatest(F.abs(F.col("sens") - F.col("_s")), F.abs(F.col("spec") - F.col("_t"))))).first()[0]
        drop_stash(old)
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(_RESTLESS.format(rounds))
    return facts.join(believed(quality), "pattern").drop("pattern")


_RESTLESS = "the sources' qualities still move after {} rounds"


def _maximised(tolerance: float, rounds: int):
    """(pattern, n, source, said) of all patterns -> the sources' qualities, by the same rounds in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"pattern": [], "n": [], "source": [], "said": []}), *batches])
        names, source = np.unique(rows["source"].to_numpy(str), return_inverse=True)
        _, pattern = np.unique(rows["pattern"].to_numpy(str), return_inverse=True)
        n, said = rows["n"].to_numpy(float), rows["said"].to_numpy(bool)
        (a1, a0), (b1, b0) = PRIOR_SENSITIVITY, PRIOR_SPECIFICITY
        sens, spec = np.full(len(names), a1 / (a1 + a0)), np.full(len(names), b1 / (b1 + b0))
        for _ in range(rounds if len(names) else 0):
            weight = np.where(said, np.log(sens / (1 - spec))[source], np.log((1 - sens) / spec)[source])
            p = 1 / (1 + np.exp(-(math.log(PRIOR_TRUE / (1 - PRIOR_TRUE)) + np.bincount(pattern, weight))))[pattern]
            total = lambda which, part: np.bincount(source, np.where(which, n * part, 0.0), len(names))
            tp, fn, tn, fp = total(said, p), total(~said, p), total(~said, 1 - p), total(said, 1 - p)
            was, sens, spec = (sens, spec), (tp + a1) / (tp + fn + a1 + a0), (tn + b1) / (tn + fp + b1 + b0)
            if max(np.abs(sens - was[0]).max(), np.abs(spec - was[1]).max()) <= tolerance:
                break
        else:
            if len(names):
                raise RuntimeError(_RESTLESS.format(rounds))
        yield pd.DataFrame({"source": names, "sens": sens, "spec": spec})

    return run


def survivor_facts(people: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(ch_id, field, value, n_rows, letters, last_at, last_idx, p_true) for each usable value of mname and zipcode in a
    group with at least two different ids. The source of a record is the file it came in: the first seven characters of
    its id (year and number of the file). Rows without id or group are left out; repeated rows of the crosswalk count
    once. A group none of whose records has a usable value has no fact."""
    links = crosswalk.select(F.col("orig_id").cast("string").alias("id"), "ch_id").where("id is not null and ch_id is not null").distinct()
    multi = links.groupBy("ch_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("ch_id")
    links = links.join(multi, "ch_id")
    rows = people.select(F.col("source_id").alias("id"), middle_name(F.col("mname")).alias("mname"), zip5(F.col("zipcode")).alias("zipcode"), "received_at", "idx")
    rows = rows.join(links, "id").withColumn("source", F.substring("id", 1, 7))
    each = F.array(F.struct(F.lit("mname").alias("field"), F.col("mname").alias("value")), F.struct(F.lit("zipcode").alias("field"), F.col("zipcode").alias("value")))
    said = rows.select("ch_id", "source", "received_at", "idx", F.inline(each)).where("value is not null")
    said = said.groupBy("ch_id", "field", "value", "source").agg(F.count("*").alias("n"), F.max(F.struct(F.col("received_at").alias("at"), "idx")).alias("last"))
    said = stash(said, "p4-said")
    facts = said.groupBy("ch_id", "field", "value").agg(F.sum("n").alias("n_rows"), F.max("last").alias("last"), F.collect_set("source").alias("yes"))
    present = said.groupBy("ch_id", "field").agg(F.collect_set("source").alias("all"))
    facts = facts.join(present, ["ch_id", "field"]).withColumn("no", F.array_except("all", "yes")).drop("all")
    facts = stash(facts, "p4-facts")
    letters = F.length(F.regexp_replace("value", r"[^\p{L}]", ""))
    return latent_truth(facts).select("ch_id", "field", "value", "n_rows", letters.alias("letters"), F.col("last.at").alias("last_at"), F.col("last.idx").alias("last_idx"), "p_true")


def survivors(people: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(ch_id, mname, zipcode) for each group with at least two different ids, NULL where no record has a usable value.

    mname is the value with most letters, then the most probable, then the last in the alphabet; zipcode the one in the most
    recently received row that has a usable one (ties: probability, then the greatest row id)."""
    facts = survivor_facts(people, crosswalk)
    name = F.max(F.when(F.col("field") == "mname", F.struct("letters", "p_true", "value")))["value"]
    code = F.max(F.when(F.col("field") == "zipcode", F.struct("last_at", "p_true", "last_idx", "value")))["value"]
    best = facts.groupBy("ch_id").agg(name.alias("mname"), code.alias("zipcode"))
    groups = crosswalk.where("orig_id is not null and ch_id is not null").groupBy("ch_id").agg(F.min("orig_id").alias("a"), F.max("orig_id").alias("b")).where("a < b").select("ch_id")
    return groups.join(best, "ch_id", "left").select("ch_id", "mname", "zipcode")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet"), spark.read.parquet(f"{sf_dir}/crosswalk.parquet")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return survivors(*_tables(spark, sf_dir))


def p4_facts(spark, sf_dir: str) -> DataFrame:
    """All values judged true, several for a field where several are."""
    facts = survivor_facts(*_tables(spark, sf_dir))
    return facts.where("p_true >= 0.5").select("ch_id", "field", "value", F.round("p_true", 6).alias("p_true"))
