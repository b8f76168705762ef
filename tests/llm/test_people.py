import random

import numpy as np
import pyarrow as pa
import pytest

from kinforge.llm import matching, namebatch, personrows, spellings, survivors
from kinforge.llm.namebatch import Names
from kinforge.llm.nameparts import Person, Speller, edits, plain

SPELLER = Speller({"diane": 0.01, "diana": 0.01, "smith": 0.02, "dorothy": 0.01, "lloyd": 0.01})


def test_edits():
    assert edits("noel", "neol") == 1 and edits("smith", "smyth") == 1 and edits("abc", "xyz") == 3


def test_words_and_names():
    assert SPELLER.alike("smith", "smyht") > 0.7 and SPELLER.alike("diane", "diana") == 0
    assert SPELLER.alike("bob", "robert") == 0.8 and SPELLER.alike("l", "lloyd") == 0.6
    a, b = Person("Lloyd", "", "Smith", None), Person("SMITH, Mr. LLOYD", "", "", "")
    assert SPELLER.same_name(a, b)[0] == 1
    assert SPELLER.same_name(a, Person("Dorothy", "", "Smith", None))[0] == 0
    assert SPELLER.same_name(Person("", "", "", ""), a)[0] == 0


def test_average_linkage_does_not_chain():
    sims = {(0, 1): 0.9, (1, 2): 0.6, (2, 3): 0.9}
    got = spellings.average_linkage(4, sims, 0.35)
    assert got[0] == got[1] != got[2] == got[3]


PEOPLE = "idx long, fname string, mname string, lname string, altlname string, suffix string, byear string, bmonth string, bday string, zipcode string, county string"


def people():
    rows = [
        ("Lloyd", "Ray", "Tammez", None, "", "1950", "1", "2", "60601", "1"),
        ("LLOYD", "R.", "TAMEZ", "", None, "50", "01", "02", "60601-1234", "1"),
        ("Tammez", None, "Lloyd", None, None, "1950", "1", "2", None, "1"),
        ("Dorothy", "May", "Tammez", None, None, "1950", "1", "2", "60601", "1"),
        ("LLOYD", "RAY", "TAMEZZ", None, None, "1950", "1", "3", "60601", "1"),
        ("Lloyd", "Ray", "Tammez", None, "", "1971", "7", "8", "60601", "1"),
        (None, None, None, None, None, None, None, None, None, None),
        ("", "", "", "", "", "", "", "", "", ""),
    ]
    return [(i, *r) for i, r in enumerate(rows)]


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["person"], set()).add(r["id"])
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_spellings(spark):
    df = spark.createDataFrame(people(), PEOPLE)
    want = groups(spellings.spellings(df))
    assert frozenset({0, 1, 2, 4}) in want and not any(3 in g or 5 in g for g in want)
    assert groups(spellings.spellings(df, max_block=2)) == want
    assert spellings.spellings(spark.createDataFrame([], PEOPLE)).count() == 0


def near_births():
    rows = [
        ("Lloyd", "Ray", "Tammez", None, None, "1950", "1", "2", "60601", "1"),
        ("Lloyd", "Ray", "Tamez", None, None, "1950", "1", "3", None, "1"),  # no zip code, same county
        ("Robert", None, "Quibble", None, None, "1961", "5", "20", "60601", "1"),
        ("Bob", None, "Quibble", None, None, "1961", "5", None, "60601", "1"),  # another initial, no day
        ("Gloria", "Xenia", "Vance", None, None, "1944", "3", "9", "60601", "1"),
        ("Gloria", "Xenia", "Vances", None, None, "1945", "3", "9", "73301", "2"),  # moved away, full middle name
        ("Harvey", "Milo", "Ostrow", None, None, "1933", "8", "7", "60601", "1"),
        ("Harvey", "Milo", "Ostrowe", None, None, "1933", None, "7", None, "1"),  # no month
        ("Lloyd", None, "Tammez", None, None, "1950", "1", "4", "73301", "2"),  # nothing but a common name
    ]
    return [(i, *r) for i, r in enumerate(rows)]


def test_spellings_across_births_without_equal_zip(spark):
    df = spark.createDataFrame(near_births(), PEOPLE)
    want = {frozenset({0, 1}), frozenset({2, 3}), frozenset({4, 5}), frozenset({6, 7})}
    assert groups(spellings.spellings(df)) == want
    assert groups(spellings.spellings(df, max_block=2)) == want


def test_block_size_does_not_change_links(spark):
    # an initial with a mistyped common last name against the full names: below the cosine, so no link, born on one day or a day apart
    low = [("L", None, "Smtih", "Wolfeschlegelzausenberg", None, "1950", "1", "2", "60601", "1"), ("Lloyd", "Bartholomew", "Smith", None, None, "1950", "1", "3", "60601", "1"), ("Lloyd", "Bartholomew", "Smith", None, None, "1950", "1", "2", "60601", "1")]
    # the same names, the last one typed alike: above it
    high = [("L", None, "Quibble", None, None, "1961", "1", "2", "60601", "1"), ("Lloyd", "Bartholomew", "Quibble", None, None, "1961", "1", "3", "60601", "1")]
    rows = [*low, *high, ("Luna", None, "Sorvino", None, None, "1970", "1", "9", "60601", "1")]
    rows += [("Lana", None, "Smith", None, None, str(1900 + i), "6", "28", None, None) for i in range(90)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PEOPLE)
    assert groups(spellings.spellings(df)) == {frozenset({1, 2}), frozenset({3, 4})}
    assert groups(spellings.spellings(df, max_block=2)) == {frozenset({1, 2}), frozenset({3, 4})}


def columns(people):
    return [pa.array(c, pa.string()) for c in zip(*people)]


def test_cosines_are_the_true_ones():
    people = [(f, None, last, None, None) for f in ("Lloyd", "Loyd", "Dorothy", "Doroteo", "Xena", "Roberta") for last in ("Tammez", "Tamez", "Smith", "Smyth", "Quibble")]
    idf = {"^l": 0.5, "ll": 2.5, "^sm": 1.5, "th$": 0.7}
    got = spellings.Vectors(Names(columns(people)), spellings._weights(idf))
    grams = []
    for f, _, last, _, _ in people:
        of = {}
        for w in (f"^{f.lower()}$", f"^{last.lower()}$"):
            for g in {w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)}:
                of[g] = of.get(g, 0) + idf.get(g, 2.5)
        grams.append(of)
    norm = [sum(w * w for w in g.values()) ** 0.5 for g in grams]
    i, j = np.triu_indices(len(people), 1)
    want = [sum(w * grams[b].get(k, 0) for k, w in grams[a].items()) / norm[a] / norm[b] for a, b in zip(i, j)]
    assert np.allclose(got.cosines(i, j), want)


def test_names_in_arrays_are_compared_as_one_by_one():
    rng = random.Random(2)
    words = "Lloyd Llyod Loyd L Robert Bob Rob Roberta Robret Smith Smyth Smithson Smi Sm Anna Ann Anne O'Hara OHara Dorothy Dot Dr Jr II Unknown Diane Diana Éva Eva xx".split()
    name = lambda most: rng.choice([None, "", *[" ".join(rng.choices(words, k=k)) for k in range(1, most + 1)]])
    people = [(name(3), name(2), name(3), name(1), rng.choice([None, "", "Jr", "Smith"])) for _ in range(220)] + [("x" * 60, None, "y" * 55 + "z", None, None), ("x" * 59, None, "y" * 55, None, None)]
    established = {"diane": 0.01, "diana": 0.01, "smith": 0.02, "robert": 0.01, "roberta": 0.01}
    names, one = Names(columns(people), established), Speller(established)
    parsed = [Person(*p) for p in people]
    i, j = (x.ravel() for x in np.meshgrid(range(len(people)), range(len(people))))
    cover, middle = np.maximum(names.found(i, j)[0], names.found(j, i)[0]), names.middles(i, j)
    changed, rare = names.new_surnames(i, j), names.rare_shared(i, j)
    for a, b, c, m, s, r in zip(i, j, cover, middle, changed, rare):
        want = one.same_name(parsed[a], parsed[b])
        assert abs(want[0] - c) < 1e-5 and want[1] == m, (people[a], people[b], want, c, m)
        assert one.new_surname(parsed[a], parsed[b]) == s
        assert r == any(len(w) > 2 and w not in established and w in parsed[b].joined for w in parsed[a].joined)
    assert len(Names(columns([(None,) * 5]), established).found(np.array([0]), np.array([0]))[0]) == 1


def test_no_pair_depends_on_the_size_of_its_block(spark):
    rng = random.Random(9)
    first, last = ["Jonathan", "Jonathanael", "J", "Lloyd", "Loyd", "Lana", "Luna"], ["Lopezgarcia", "L", "Lopez", "Smith", "Smtih", "Sorvino"]
    rows = [(rng.choice(first), rng.choice([None, "Ray", "R"]), rng.choice(last), rng.choice([None, "Wolfeschlegel"]), None, "1950", "1", str(rng.randint(12, 14)), rng.choice(["60601", "60602", None]), rng.choice(["1", "2"])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PEOPLE)
    got = [sorted(map(tuple, spellings.spellings(df, max_block=n).collect())) for n in (2, 100, 4096)]
    assert got[0] == got[1] == got[2] and got[0]


def test_a_hot_group_of_copies_is_one_node(spark):
    rows = [("Lloyd", "Ray", "Tammez", None, None, "1950", "1", "2", "60601", "1")] * 60 + [("Lloyd", "Ray", "Tamez", None, None, "1950", "1", "2", "60601", "1")]
    got = spellings.spellings(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PEOPLE), max_block=4).collect()
    assert len(got) == 61 and {r["person"] for r in got} == {0} and {r["spelling"] for r in got} == {0, 60}


def test_spelling_classes(spark):
    got = {r["id"]: r["spelling"] for r in spellings.spellings(spark.createDataFrame(people(), PEOPLE)).collect()}
    assert got[0] == got[2] and got[1] != got[0]


def test_matching(spark):
    a = spark.createDataFrame(people(), PEOPLE)
    b = spark.createDataFrame([("B1", "Lloyd", "R", "Tammez", None, 1950.0, 2.0, 1.0, "60601", "Pela County"), ("B2", "Xena", None, "Quibble", None, 1999.0, 3.0, 3.0, None, None), ("B3", None, None, None, None, None, None, None, None, None)], "indv_id string, fname string, mname string, lname string, altlname string, byear double, bmonth double, bday double, zipcode string, county string")
    counties = spark.createDataFrame([("1", "Pela"), (None, "x")], "county string, county_name string")
    got = {(r["ida"], r["idb"]): r["probability"] for r in matching.match(a, b, counties).collect()}
    assert {0, 2} <= {i for i, _ in got} and {j for _, j in got} == {"B1"} and (3, "B1") not in got
    assert matching.match(a, b.limit(0), counties).count() == 0
    assert matching.match(a.limit(0), b, counties).count() == 0


def test_propagation_prefers_the_better_rival(spark):
    rows = [(1, "x", "p", 3.0), (2, "x", "q", 1.0), (3, "y", "p", 2.0), (4, "z", "p", -1.0)]
    got = {(r["ida"], r["idb"]): r["probability"] for r in matching.propagate(spark.createDataFrame(rows, "ida long, idb string, birth string, evidence double")).collect()}
    assert got[1, "x"] > 0.8 > 0.5 > got[2, "x"] and abs(got[3, "y"] - 0.8808) < 1e-3 and len(got) == 4
    # without cycles the marginals are exact: two rivals of one record, soft factor
    o1, o2, soft = 2.718281828**3, 2.718281828, matching.RIVAL_PERSON
    assert abs(got[1, "x"] - (o1 + soft * o1 * o2) / (1 + o1 + o2 + soft * o1 * o2)) < 1e-6


def test_survivors(spark):
    p = spark.createDataFrame(
        [(1, "20200010000001", "M.", "60601", "2020-01-01"), (2, "20210010000002", "mary ann", "00000", "2021-01-01"), (3, "20210020000003", "UNKNOWN", "60602-1111", "2020-06-01"), (4, "20220010000004", None, None, None), (5, "20220010000005", "NMN", "12", "2022-01-01")],
        "idx long, source_id string, mname string, zipcode string, received_at string",
    )
    x = spark.createDataFrame([("20200010000001", 7), ("20210010000002", 7), ("20210020000003", 7), ("20210020000003", 7), ("20220010000004", 8), ("20220010000005", 8), ("20220010000005", 9), (None, 9)], "orig_id string, ch_id long")
    assert {tuple(r) for r in survivors.survivors(p, x).collect()} == {(7, "MARY ANN", "60602"), (8, None, None)}
    assert survivors.survivors(p.limit(0), x).count() == 2
    assert survivors.survivors(p, x.limit(0)).count() == 0
    facts = survivors.survivor_facts(p, x).collect()
    assert all(0 < r["p_true"] < 1 for r in facts) and {r["value"] for r in facts if r["field"] == "zipcode"} == {"60601", "60602"}


def test_planted_sources_are_recovered(spark):
    rng = random.Random(11)
    sens = {"f1": 0.95, "f2": 0.9, "f3": 0.8, "f4": 0.6, "f5": 0.9, "f6": 0.7}
    spec = {"f1": 0.98, "f2": 0.9, "f3": 0.95, "f4": 0.9, "f5": 0.7, "f6": 0.97}
    rows = []
    for g in range(1500):
        for v, true in (("t", True), ("u", g % 3 == 0), ("x", False), ("y", False)):  # every third group has two true values
            yes = [s for s in sens if rng.random() < (sens[s] if true else 1 - spec[s])]
            if yes:
                rows.append((f"{g}{v}", true, yes, [s for s in sens if s not in yes]))
    df = spark.createDataFrame(rows, "fact string, truth boolean, yes array<string>, no array<string>")
    facts = survivors.latent_truth(df).collect()
    by_joins = {r["fact"]: r["p_true"] for r in survivors.latent_truth(df, 0.01, patterns_per_task=0).collect()}
    assert all(abs(by_joins[r["fact"]] - r["p_true"]) < 0.05 for r in facts)
    with pytest.raises(Exception, match="still move"):
        survivors.latent_truth(df, rounds=2).count()
    assert sum((r["p_true"] >= 0.5) == r["truth"] for r in facts) / len(facts) > 0.97
    for s in sens:
        stated, left = [r["p_true"] for r in facts if s in r["yes"]], [r["p_true"] for r in facts if s in r["no"]]
        assert abs(sum(stated) / (sum(stated) + sum(left)) - sens[s]) < 0.04
        # false values that no source states are unseen, so specificity is checked against what was planted among those seen
        seen = [r for r in facts if not r["truth"]]
        assert abs(sum(1 - p for p in left) / (sum(1 - p for p in stated) + sum(1 - p for p in left)) - sum(s in r["no"] for r in seen) / len(seen)) < 0.04
    assert survivors.latent_truth(spark.createDataFrame([], "fact string, yes array<string>, no array<string>")).count() == 0


def test_messages_settle_on_loops_or_say_so(spark):
    rows = [(i, j, f"p{i}", 2.0 + (i == j)) for i in range(4) for j in range(4)]  # every record a rival of every other
    df = spark.createDataFrame(rows, "ida long, idb long, birth string, evidence double")
    got = {(r["ida"], r["idb"]): r["probability"] for r in matching.propagate(df).collect()}
    assert len(got) == 16 and all(max(got[i, j] for j in range(4)) == got[i, i] for i in range(4))
    with pytest.raises(RuntimeError, match="still move"):
        matching.propagate(df, rounds=1)


def test_probabilities_are_calibrated(spark):
    # pairs of one record each: among pairs with evidence e, a share of 1 / (1 + exp(-e)) is right
    rng = random.Random(3)
    rows, right = [], {}
    for k in range(3000):
        e = rng.uniform(-3, 3)
        rows.append((k, k, "p", e))
        right[k] = rng.random() < 1 / (1 + np.exp(-e))
    got = matching.propagate(spark.createDataFrame(rows, "ida long, idb long, birth string, evidence double")).collect()
    for low in np.arange(0.1, 0.9, 0.2):
        some = [(r["probability"], right[r["ida"]]) for r in got if low <= r["probability"] < low + 0.2]
        assert abs(np.mean([p for p, _ in some]) - np.mean([x for _, x in some])) < 0.06


def test_only_pairs_that_names_cannot_link_are_left_out_beforehand():
    rng = random.Random(4)
    words = "Lloyd Llyod Loyd L Robert Bob Rob Roberta Robret Smith Smyth Smithson Anna Ann Anne O'Hara OHara Dorothy Dot Quibble Ubikle Éva Eva Xena Zena".split()
    name = lambda most: rng.choice([None, "", *[" ".join(rng.choices(words, k=k)) for k in range(1, most + 1)]])
    people = [(name(3), name(2), name(3), name(1), rng.choice([None, "Jr", "Smith"])) for _ in range(250)] + [(None,) * 5]
    names = Names(columns(people), {"smith": 0.02, "robert": 0.01, "anna": 0.01})
    i, j = (x.ravel() for x in np.meshgrid(range(len(people)), range(len(people))))
    linked = (names.found(i, j)[0] > 0) | (names.found(j, i)[0] > 0) | names.new_surnames(i, j)
    assert names.possible(i, j)[linked].all()
    unlike = Names(columns([("Lloyd", None, "Tammez", None, None), ("Dorothy", None, "Quibble", None, None), ("Loyd", "R", "Tamez", None, None)]))
    assert unlike.possible(np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [False, True, False]


def test_a_record_packed_in_two_columns_comes_back_whole(spark):
    rows = [("Lloyd", "", "a\0b", None, "Jr", 127 << 14 | 12 << 7 | 31, 99999, (1 << 24) - 1), ("", "", "", "", "", 0, 0, 0)]
    df = spark.createDataFrame(rows, "fname string, mname string, lname string, altlname string, suffix string, born int, zip int, county int")
    got = df.select(*personrows.packed(["fname", "mname", "lname", "altlname", "suffix"])).toPandas()
    assert [c.to_pylist() for c in personrows.unpacked(pa.array(got["names"]))] == [["Lloyd", ""], ["", ""], ["a b", ""], ["", ""], ["Jr", ""]]
    assert [x.tolist() for x in personrows.unpacked_numbers(got["p"].to_numpy())] == [[r[k] for r in rows] for k in (5, 6, 7)]


def test_linkage_on_arrays_is_average_linkage():
    rng = random.Random(6)
    ids = np.array(rng.sample(range(1000), 60))
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if i // 5 == j // 5 and rng.random() < 0.7]
    sims = {p: rng.choice([0.2, 0.5, 0.6, 0.8, 0.95]) for p in pairs}
    i, j, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([sims[p] for p in pairs])
    root = spellings.local_components(60, i, j)
    got = spellings.local_linkage(ids, root, i, j, s)
    rank = {x: k for k, x in enumerate(sorted(ids.tolist()))}
    want = spellings.average_linkage(60, {tuple(sorted((rank[ids[a]], rank[ids[b]]))): v for (a, b), v in sims.items()}, spellings.LINKAGE)
    clusters = {}
    for x, k in rank.items():
        clusters.setdefault(want[k], []).append(x)
    assert {x: min(c) for c in clusters.values() for x in c} == dict(zip(ids.tolist(), got.tolist()))


def test_spelling_classes_on_arrays():
    names = [("Lloyd", "Smith", ""), ("SMITH", "Lloyd", ""), ("Lloyd", "Smiht", ""), ("LloydSmith", "", ""), ("Lloyd Smith", "", ""), ("Ann", "Mary", ""), ("Mary Ann", "", "")]
    person, ids = np.array([1, 1, 1, 1, 1, 9, 9]), np.array([5, 4, 3, 2, 1, 9, 8])
    got = spellings.spelling_classes(person, ids, columns(names))
    for p in (1, 9):
        at = [k for k in np.argsort(ids) if person[k] == p]
        assert [ids[at[c]] for c in spellings.name_classes([list(names[k]) for k in at])] == got[at].tolist()


def test_hot_keys_leave_their_bucket_with_every_row():
    rng = random.Random(8)
    born = [50 << 14 | 1 << 7 | d for d in (1, 2, 3, 9)]
    rows = np.array([(key, 7 << 32 | i, rng.choice(born) | 5 << 24, -i) for key in (-3, 4, 1 << 40) for i in range(40 if key == 4 else 6)] + [(77, -5, born[0], 1)], np.int64)
    rows = np.concatenate((rows, rows[:3] + [0, 1000, 0, 0]))  # equal records
    assert (spellings._grown(spellings._shrunk(rows[:6].copy()).tobytes(), 7)[:, 1] == rows[:6, 1]).all()
    at = lambda x: [pa.RecordBatch.from_pydict({"bucket": [1], "high": [h], "data": [spellings._shrunk(x[x[:, 1] >> 32 == h].copy()).tobytes()]}) for h in np.unique(x[:, 1] >> 32)]
    said = lambda most, held: pa.Table.from_batches([b for b in spellings._in_buckets(most, held)(iter(at(rows[:30]) + at(rows[30:])))]).to_pylist()
    whole, hot = said(100, 10_000), said(10, 10_000)
    pairs = lambda got, key=lambda k: True: {(r["a"], r["b"]) for r in got if r["b"] is not None}
    assert pairs(whole) and all(a >> 32 == 7 and b - (7 << 32) < 40 for a, b in pairs(whole))
    for got in (hot, said(10, 20)):
        left = [(r["a"], r["p"]) for r in got if r["b"] is None]
        assert len(set(left)) == 40 and {r["key"] for r in got if r["b"] is None} == {4}
        more = {(a, b) for a, p in left for b, q in left if a < b and spellings.births_near(np.array([p & (1 << 21) - 1]), np.array([q & (1 << 21) - 1]))[0]}
        assert pairs(got) | more == pairs(whole)


def test_long_ids_and_a_birth_date_too_large_for_one_block(spark):
    rows = [((9 << 40) - i, *r) for i, r in enumerate([("Lloyd", "Ray", "Tammez", None, None, "1950", "1", "2", "60601", "1")] * 20 + [("Lloyd", "Ray", "Tamez", None, None, "1950", "1", d, "60601", "1") for d in ("2", "3")] + [("Xena", None, "Quibble", None, None, "1950", "1", "2", "60601", "1")])]
    got = [sorted(map(tuple, spellings.spellings(spark.createDataFrame(rows, PEOPLE), max_block=n).collect())) for n in (2, 4096)]
    assert got[0] == got[1] and len(got[0]) == 22 and {p for _, p, _ in got[0]} == {(9 << 40) - 21} and len({c for _, _, c in got[0]}) == 2


def test_vectors_are_made_only_where_names_link(monkeypatch):
    rng = random.Random(5)
    first, last = ["Lloyd", "Loyd", "Mary", "Mark", "Dorothy", "Xena"], ["Smith", "Smyth", "Stone", "Tammez", "Quibble", "Qualm"]
    rows = [(rng.choice(first), rng.choice([None, "Ray", "May"]), rng.choice(last), None, None) for _ in range(60)]
    idf = {"^s": 0.5, "ra": 2.0}
    born = np.where(np.arange(60) % 2, 50 << 14 | 1 << 7 | 2, 50 << 14 | 1 << 7 | 3)
    people = spellings.People(columns(rows), born, np.full(60, 60601), np.full(60, 1), {"smith": 0.02}, spellings._weights(idf))
    i, j = np.triu_indices(60, 1)
    asked, near = [], spellings.People._near_vectors
    monkeypatch.setattr(spellings.People, "_near_vectors", lambda self, a, b: (asked.append(len(a)), near(self, a, b))[1])
    got = people.links(i, j)
    assert 0 < sum(asked) < 0.5 * len(i) and (got > 0).sum() <= sum(asked)
    # as by all cosines first, and each rule by itself
    cosine = spellings.Vectors(people.names, spellings._weights(idf)).cosines(i, j) >= spellings.COSINE - 1e-9
    middle = people.names.middles(i, j)
    want = np.where(cosine, np.where(born[i] == born[j], people._born_alike(i, j, middle), people._born_near(i, j, middle)), 0.0)
    assert np.allclose(got, want)


def test_only_what_needs_it_takes_the_slow_way(monkeypatch):
    texts = ["lloyd", "LLOYD", "mary ann", "mary  ann", " mary", "mary ", "O'Neil", "o`neil", "Ann-Marie", "José", "Łucja", "ß", "", None, "李", "a1 b2", "İpek", "-"]
    slow, of_odd = [], namebatch._plain_of_odd
    monkeypatch.setattr(namebatch, "_plain_of_odd", lambda v: (slow.extend(v.to_pylist()), of_odd(v))[1])
    assert namebatch.plain(pa.array(texts)).to_pylist() == [plain(t or "") for t in texts]
    assert slow and not {"lloyd", "mary ann", "", "a1 b2"} & set(slow)
    # names of the same tokens are of one spelling without a search for cuts
    monkeypatch.setattr(spellings, "same_parts", lambda *_: pytest.fail("searched"))
    assert spellings.name_classes([["Anna Maria", "Lopez", ""], ["Anna", "Maria-LOPEZ", ""], ["Lopez", "Maria", "Anna"]]) == [0, 0, 0]


def test_edits_and_grams_on_arrays():
    rng = random.Random(9)
    texts = list(dict.fromkeys("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 48]))) for _ in range(150)))
    texts += [t[:-2] + t[-1] + t[-2] for t in texts if len(t) > 2 and t[-1] != t[-2] and t[:-2] + t[-1] + t[-2] not in texts]
    w = namebatch.Words(texts)
    x, y = np.divmod(np.arange(len(texts) ** 2), len(texts))
    x, y = x[w.sizes[x] <= w.sizes[y]], y[w.sizes[x] <= w.sizes[y]]
    assert namebatch.edits(w, x, y).tolist() == [edits(texts[a], texts[b]) for a, b in zip(x, y)]
    assert namebatch.edits(w, x, y, w.sizes[x]).tolist() == [edits(texts[a], texts[b][: len(texts[a])]) for a, b in zip(x, y)]
    assert len(namebatch.edits(w, x[:0], y[:0])) == 0
    word, place, each = spellings._grams(texts[:20])
    code = lambda g: ord(g[0]) << 21 | ord(g[1]) if len(g) == 2 else ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    want = {(k, code(f"^{t}$"[a : a + n])) for k, t in enumerate(texts[:20]) for n in (2, 3) for a in range(len(t) + 3 - n)}
    assert len(word) == len(want) and set(zip(word.tolist(), each[place].tolist())) == want
    assert namebatch.distinct(np.array([3, 1, 3])).tolist() == [1, 3] and not len(namebatch.distinct(np.zeros(0)))


def test_squeezed_names_follow_field_by_field():
    texts = ["Anna-Maria", "O'Neil 3rd", "José", "J o s e", "İpek", "", "--", "Σίσυφος", "é", "Straße"]
    assert spellings._squeezed(pa.array(texts)).to_pylist() == [spellings._field(t).replace(" ", "") for t in texts]


def test_word_counts_split_each_text_once(spark):
    rows = [("Anna Maria", None, "López"), ("Anna Maria", "", "O'Neil"), ("ANNA", "x-y", "Ärger"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    counts = personrows.word_counts(df, ["a", "b", "c"])
    assert {r["word"]: r["n"] for r in counts.collect()} == {"anna": 3, "maria": 2, "lopez": 1, "oneil": 1, "x": 1, "y": 1, "arger": 1}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.rindex("Aggregate")  # the plan is read from below: texts are grouped before they are split
