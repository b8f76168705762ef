"""Persons of two sources matched without a common key, each match with a probability.

Candidates share a key made of birth parts and beginnings of names (all three parts with either name; two parts, or the
zip code, with both), so that one wrong or missing part or a misspelt name keeps the pair. A fixed-size bitmap of the smaller
source's keys keeps keys of the larger source that can't meet from being shuffled. A pair's evidence is a sum of log-likelihood
ratios: what agrees counts by how rare it is among all records, the prior is one match in a whole table.

Loopy belief propagation then weighs the candidates against each other. A record of the second source belongs to one
person of the first (all candidate rows with one birth date), a row of the first hardly to two records of the second. Each
pair gets a message from the factor of its second-source record and one from the factor of its first-source row: how far the rivals
leave room for it. Messages are exchanged through aggregates and joins until they stand still; pairs without rivals have nothing to
exchange and stay out of the rounds. The marginal of a pair is evidence plus both messages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.namebatch import FIELDS, Names, Slices, gathered, mixed, number
from kinforge.llm.personrows import NO_YEAR, name_statistics, numbers, packed, parts, text, unpacked, unpacked_numbers
from kinforge.session import drop_stash, small, stash

#: Bits of the key bitmap: 2 MB to 64 MB, by the number of keys; about so many keys a record.
LEAST_BITS, MOST_BITS, KEYS = 24, 29, 14
#: Evidence below which a candidate is no match whatever its rivals.
FLOOR = -4.0
#: How far a factor allows a second match: of a record with another person, of a row with another record.
RIVAL_PERSON, RIVAL_RECORD = 0.02, 0.15
#: How far messages may still move; rounds in which that must be reached, the first of them undamped.
TOLERANCE, ROUNDS, UNDAMPED = 0.01, 100, 6
#: Records or pairs that one batch compares.
BATCH = 60_000


def _prepared(df: DataFrame, id_col: str, county: Column) -> DataFrame:
    """id, the five names, born (see personrows), zip and county as numbers, 0 where missing."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[text(df, c).alias(c) for c in FIELDS], *numbers(df, county))


def county_name(c: Column) -> Column:
    """Lower case, without the word county or its abbreviation."""
    return F.trim(F.regexp_replace(F.lower(c), r"\b(county|co|cnty)\b\.?|[^\p{L}\p{N} ]", ""))


def keys(names: Names, born: np.ndarray, zips: np.ndarray, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the blocking keys of a batch of records; turned: also those with month and day exchanged.

    All birth parts with the beginning of either name or both initials; two of them with both beginnings; the month and another part with
    the zip code and either beginning; the zip code with both. Another family name stands in for the last name in each."""
    y, m, d = parts(born)
    has_y, has_m, has_d = y < NO_YEAR, m > 0, d > 0
    first, last = names.ends()
    w = names.words
    begin = lambda of, n: np.where(of >= 0, w.begin(n)[of], 0) if len(w.texts) else np.zeros(len(of), np.int64)
    rows, out = [], []

    def add(which: np.ndarray, *values) -> None:
        at = np.flatnonzero(which)
        rows.append(at)
        out.append(mixed(*[v[at] if isinstance(v, np.ndarray) else v for v in values]))

    f1, f3 = begin(first, 1), begin(first, 3)
    two = ((1, has_y & has_m, y, m), (2, has_y & has_d, y, d), (3, has_m & has_d, m, d))
    for kind, other, named in ((0, last, (first >= 0) & (last >= 0)), (1, names.of_other, (first >= 0) & (names.of_other >= 0))):
        l1, l3 = begin(other, 1), begin(other, 3)
        all_three = named & has_y & has_m & has_d
        for p, q, which in ((m, d, all_three), (d, m, all_three & (m != d) & turned)):
            if kind == 0:
                add(which, 10, y, p, q, f3)
            add(which & ((kind == 1) | (l3 != f3)), 10, y, p, q, l3)
            add(which, 11, y, p, q, np.minimum(f1, l1), np.maximum(f1, l1))
        for k, which, p, q in two:
            add(named & which, 20 + k, p, q, np.minimum(f3, l3), np.maximum(f3, l3))
            if k == 2:
                continue
            if kind == 0:
                add(named & which & (zips > 0), 30 + k, zips, p, q, f3)
            add(named & which & (zips > 0) & ((kind == 1) | (l3 != f3)), 30 + k, zips, p, q, l3)
        add(named & (zips > 0), 40, zips, np.minimum(f3, l3), np.maximum(f3, l3))
    return np.concatenate(rows), np.concatenate(out)


def _keys_of(t: pa.Table, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    none = pa.nulls(t.num_rows, pa.string())
    return keys(Names([t["fname"], none, t["lname"], t["altlname"], t["suffix"]]), number(t["born"]), number(t["zip"]), turned)


def _keyed(turned: bool, bitmap=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for t in gathered(batches, BATCH):
            at, h = _keys_of(t, turned)
            if bits is not None and len(h):
                slot = h & np.uint64(len(bits) * 8 - 1)
                hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                h, at = h[hit], at[hit]
            out = pa.table({"id": t["id"].take(pa.array(at)), "key": h.view(np.int64)})
            yield from out.to_batches(BATCH)

    return run


def _marked(bits: int):
    """The pieces of 4 KB of a bitmap of all keys of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((1 << bits) // 8, np.uint8)
        for t in gathered(batches, BATCH):
            _, h = _keys_of(t, True)
            slot = np.unique(h & np.uint64((1 << bits) - 1))
            np.bitwise_or.at(whole, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))
        pieces = whole.reshape(-1, 4096)
        some = np.flatnonzero(pieces.any(axis=1))
        for at in range(0, len(some), 1024):
            yield from pa.table({"b": some[at : at + 1024], "m": pa.array([pieces[k].tobytes() for k in some[at : at + 1024]], pa.binary())}).to_batches()

    return run


def _bitmap(b: DataFrame) -> bytes:
    """One bit for the low bits of each key of b, joined from the tasks' bitmaps."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * KEYS * b.count()).bit_length()))
    rows = b.mapInArrow(_marked(bits), "b bigint, m binary").groupBy("b").agg(F.bitmap_or_agg("m").alias("m")).collect()
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        whole[r["b"] * 4096 :][:4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return whole.tobytes()


class Shares:
    """How rare the values of a kind are: - log of their share of the records, by number."""

    def __init__(self, of: dict[int, float], otherwise: float):
        self.values = np.array(sorted(of), np.int64)
        self.logs = np.array([-math.log(of[int(v)]) for v in self.values] + [-math.log(otherwise)])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.full(len(values), self.logs[-1])
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.logs[at], self.logs[-1])


class Evidence:
    """Log-likelihood ratios of agreement, from the shares of values among the first source's records."""

    def __init__(self, names: dict[str, float], shares: dict[tuple[str, int], float], records: int):
        self.names = names
        of = lambda kind, otherwise: Shares({v: s for (k, v), s in shares.items() if k == kind}, otherwise)
        self.year, self.zip, self.county = of("y", 0.005), of("z", 0.002), of("c", 0.01)
        self.prior = -math.log(max(records, 10))
        self.rare = math.log(1 / 1.5e-4)

    def name(self, names: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The names' part; NaN if they can't be one person's."""
        w = names.words
        rarity = np.fromiter((-math.log(self.names[t]) if t in self.names else self.rare for t in w.texts), float, len(w.texts))
        rarity = np.where(w.sizes > 1, rarity, -1.0)

        def rarest(lists: Slices) -> np.ndarray:
            out = np.full(len(lists.at) - 1, -1.0)
            np.maximum.at(out, lists.owners(), rarity[lists.values])
            return np.where(out < 0, 3.0, out)

        of_unit = np.stack([rarest(p) for p in (names.first, names.last, names.rest)], axis=1)
        letters = np.stack([np.where(f >= 0, w.sizes[f], 0) if len(w.texts) else f for f in (names.of_first, names.of_last, names.of_rest)], axis=1)
        there, unit = names.found(i, j)
        back, other = names.found(j, i)
        turned = there < back
        unit = np.where(turned[:, None], other, unit)
        side = np.where(turned, j, i)
        loss = np.select([unit >= 1, unit >= 0.8, unit >= 0.65], [0.1, 2.0, 3.0], 4.5)
        each = np.where((np.abs(unit - 0.6) < 1e-6) | (letters[side] == 1), 0.6, np.minimum(of_unit[side], 8.0) - loss)
        total = np.where(np.isnan(unit), 0.0, each).sum(axis=1)
        apart = np.flatnonzero(np.maximum(there, back) < 0.5)
        total[apart] = np.where(names.new_surnames(i[apart], j[apart]), of_unit[i[apart], 0] - 4.5, np.nan)
        middle = names.middles(i, j)
        total[middle < 0] = np.nan
        agree = np.flatnonzero((middle > 0) & ~np.isnan(total))
        x, y, at = names._crossed(names.middle.take(i[agree]), names.middle.take(j[agree]))
        full = np.full(len(agree), -1.0)
        if len(x):
            fits = (w.sizes[x] > 2) & (w.sizes[y] > 2) & (names.comparer.alike(x, y) >= 0.7)
            np.maximum.at(full, at[fits], rarity[x[fits]])
        total[agree] += np.where(full >= 0, np.minimum(full, 5.0) - 0.5, 2.2)
        both = np.flatnonzero((names.of_other[i] >= 0) & (names.of_other[j] >= 0) & ~np.isnan(total))
        total[both] += np.where(names.most(names.other, i[both], names.other, j[both]) >= 0.75, 3.5, -0.5)
        return total

    def birth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (y1, m1, d1), (y2, m2, d2) = parts(a), parts(b)
        year = np.where(y1 == y2, self.year(y1) - 0.15, np.where(np.isin(np.abs(y1 - y2), (1, 99)), -1.6, -3.2))
        year = np.where((y1 < NO_YEAR) & (y2 < NO_YEAR), year, 0.0)
        month = np.where((m1 > 0) & (m2 > 0), np.where(m1 == m2, 2.4, -2.6), 0.0)
        day = np.where((d1 > 0) & (d2 > 0), np.where(d1 == d2, 3.3, -2.2), 0.0)
        turned = (m1 > 0) & (d1 > 0) & (m1 == d2) & (d1 == m2) & (m1 != d1)
        return year + np.where(turned, 5.9 - 2.8, month + day)

    def place(self, zip_a: np.ndarray, zip_b: np.ndarray, county_a: np.ndarray, county_b: np.ndarray) -> np.ndarray:
        same = (zip_a > 0) & (zip_a == zip_b)
        total = np.where((zip_a > 0) & (zip_b > 0), np.where(same, np.minimum(self.zip(zip_a), 6.0) - 0.5, -1.0), 0.0)
        county = np.where(county_a == county_b, np.minimum(self.county(county_a), 4.0) - 0.4, -1.3)
        return total + np.where((county_a > 0) & (county_b > 0) & ~same, county, 0.0)


def _scored(names: dict[str, float], shares: dict[tuple[str, int], float], records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(names, shares, records)
        for t in gathered(batches, BATCH):
            sides, at = [], []
            for s in "ab":  # each record of the batch is parsed once
                codes = t[f"id{s}"].combine_chunks().dictionary_encode().indices.to_numpy()
                _, rows = np.unique(codes, return_index=True)
                sides.append(rows)
                at.append(codes)
            columns = unpacked(pa.concat_arrays([t[f"{s}_names"].combine_chunks().take(pa.array(rows)) for s, rows in zip("ab", sides)]))
            parsed = Names(columns, names)
            (born_a, zip_a, county_a), (born_b, zip_b, county_b) = (unpacked_numbers(number(t[f"{s}_p"])) for s in "ab")
            total = evidence.birth(born_a, born_b) + evidence.place(zip_a, zip_b, county_a, county_b)
            i, j = at[0].astype(np.int64), at[1].astype(np.int64) + len(sides[0])
            some, name = np.flatnonzero(parsed.possible(i, j)), np.full(len(i), np.nan)
            name[some] = evidence.name(parsed, i[some], j[some])
            total += evidence.prior + name
            keep = pa.array(np.flatnonzero(total > FLOOR))
            yield from pa.table({"ida": t["ida"].take(keep), "idb": t["idb"].take(keep), "birth": pa.array(born_a[keep.to_numpy()], pa.int32()), "evidence": total[keep]}).to_batches()

    return run


def candidates(a: DataFrame, b: DataFrame, names: dict[str, float], shares: dict[tuple[str, int], float], records: int) -> DataFrame:
    """(ida, idb, birth of a, evidence): the pairs that a key brings together, with evidence above FLOOR."""
    types = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
    some = ("id", "fname", "lname", "altlname", "suffix", "born", "zip")
    bitmap = a.sparkSession.sparkContext.broadcast(_bitmap(b.select(*some)))
    key_b = b.select(*some).mapInArrow(_keyed(True), f"id {types[1]}, key bigint")
    key_a = a.select(*some).mapInArrow(_keyed(False, bitmap), f"id {types[0]}, key bigint")
    pairs = key_a.withColumnRenamed("id", "ida").join(key_b.withColumnRenamed("id", "idb"), "key").select("ida", "idb").repartition(F.col("ida")).distinct()
    side = lambda df, s: df.select("id", *packed(list(FIELDS))).toDF(f"id{s}", f"{s}_names", f"{s}_p")
    # pairs are already placed by ida, so only the rows of a move; b's rows come last, where they are few by a broadcast
    full = pairs.join(side(a, "a"), "ida").join(small(side(b, "b")), "idb")
    return full.mapInArrow(_scored(names, shares, records), f"ida {types[0]}, idb {types[1]}, birth int, evidence double")


def propagate(pairs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(ida, idb, birth, evidence) -> (ida, idb, probability), by loopy belief propagation with soft one-to-one factors.

    Pairs of one idb with the same birth are rows of one person and no rivals of each other."""
    pairs = stash(pairs, "p6-evidence")
    persons = pairs.groupBy("idb").agg(F.min("birth").alias("_p"), F.max("birth").alias("_q")).where("_p < _q").select("idb", F.lit(True).alias("_b"))
    records = pairs.groupBy("ida").agg(F.count("*").alias("_n")).where("_n > 1").select("ida", F.lit(True).alias("_a"))
    marked = stash(pairs.join(persons, "idb", "left").join(records, "ida", "left"), "p6-marked")
    alone = marked.where("_a is null and _b is null").select("ida", "idb", "evidence")
    state = marked.where("_a is not null or _b is not null").select("ida", "idb", "birth", "evidence", F.lit(0.0).alias("to_b"), F.lit(0.0).alias("to_a"))
    odds = lambda c: F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c)))
    room = lambda s, soft: F.log((1 + soft * s) / (1 + s))
    for n in range(rounds):
        believed = state.withColumn("o", odds(F.col("evidence") + F.col("to_a")))
        of_person = believed.groupBy("idb", "birth").agg(F.max("o").alias("mine"))
        of_record = of_person.groupBy("idb").agg(F.sum("mine").alias("all"))
        rivals = of_person.join(of_record, "idb").select("idb", "birth", F.greatest(F.lit(0.0), F.col("all") - F.col("mine")).alias("s"))
        new = state.join(rivals, ["idb", "birth"]).withColumn("new_b", room(F.col("s"), RIVAL_PERSON)).drop("s")
        new = new.withColumn("o", odds(F.col("evidence") + F.col("new_b")))
        of_row = new.groupBy("ida").agg(F.sum("o").alias("all"))
        new = new.join(of_row, "ida").withColumn("new_a", room(F.greatest(F.lit(0.0), F.col("all") - F.col("o")), RIVAL_RECORD))
        if n >= UNDAMPED:  # messages that swing to and fro meet half way
            new = new.withColumns({"new_a": (F.col("new_a") + F.col("to_a")) / 2, "new_b": (F.col("new_b") + F.col("to_b")) / 2})
        new = stash(new.select("ida", "idb", "birth", "evidence", "to_b", "to_a", "new_b", "new_a"), "p6-messages")
        moved = new.agg(F.max(F.greatest(F.abs(F.col("new_b") - F.col("to_b")), F.abs(F.col("new_a") - F.col("to_a"))))).first()[0]
        if n:
            drop_stash(state)
        state = new.select("ida", "idb", "birth", "evidence", F.col("new_b").alias("to_b"), F.col("new_a").alias("to_a"))
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"the messages still move by {moved} after {rounds} rounds")
    belief = state.select("ida", "idb", (F.col("evidence") + F.col("to_b") + F.col("to_a")).alias("evidence")).unionByName(alone)
    return belief.select("ida", "idb", (1 / (1 + F.exp(-F.col("evidence")))).alias("probability"))


def match(a: DataFrame, b: DataFrame, counties: DataFrame, id_a: str = "idx", id_b: str = "indv_id", least: float = 0.5) -> DataFrame:
    """(ida, idb, probability) of all pairs at or above least. b names its counties, counties says what a's codes are called.

    Rows with NULL id, or without any name word, match nothing; missing birth parts, places and middle names are no
    evidence. A row repeated under one id counts once. Several rows of a for one person, and several records of b, all
    come out."""
    named = counties.select(F.col("county").alias("_code"), county_name(F.col("county_name")).alias("_name")).where("_code is not null").dropDuplicates(["_code"])
    left = _prepared(a.join(small(stash(named, "p6-counties")), a["county"] == F.col("_code"), "left"), id_a, F.col("_name"))
    right = stash(_prepared(b, id_b, county_name(F.col("county"))), "p6-right")
    established, _ = name_statistics(a, ["fname", "mname", "lname", "altlname"])
    records = a.count()
    year = F.shiftright("born", 14)
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in (("y", F.when(year < NO_YEAR, year)), ("z", F.nullif("zip", F.lit(0))), ("c", F.nullif("county", F.lit(0))))])
    common = left.select(F.inline(kinds)).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, 5e-4 * records))
    shares = {(r["k"], r["v"]): r["n"] / records for r in common.collect()}
    found = propagate(candidates(left, right, established, shares, records))
    return found.where(F.col("probability") >= least).groupBy("ida", "idb").agg(F.max("probability").alias("probability"))


def p6_matches(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = match(read("preprocess_file_template"), read("match_input_b"), read("county_reference"))
    return found.select(F.col("ida").alias("idx"), F.col("idb").alias("indv_id"), F.round("probability", 4).alias("confidence"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("idx", "indv_id")
