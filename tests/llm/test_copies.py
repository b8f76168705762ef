import itertools
import random

from kinforge.llm.copies import EQUAL, collapse, copy_pairs, same_parts, tokens

COLS = "idx long, fname string, lname string, suffix string, " + ", ".join(f"{c} string" for c in EQUAL) + ", extra string"


def rows_of(names):
    same = ("M", None, "1980", "1", "2", "60601", "1", "")
    return [(i, *n, *same, f"x{i}") for i, n in enumerate(names)]


def test_same_parts():
    assert same_parts(["anna", "smith", ""], ["smith anna", "", ""])
    assert same_parts(["anna", "smithjones"], ["smith jones", "anna"])
    assert same_parts(["zeldaklintum"], ["klintum zelda"])
    assert not same_parts(["neol", "smith"], ["noel", "smith"])
    assert same_parts(["", "", ""], ["", ""]) and not same_parts(["a"], [""])


def test_same_parts_of_long_names():
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    for n in (14, 15, 16, 17, 26):  # one part is joined and moved, whatever the number of tokens
        assert same_parts([" ".join(words[:n]), "anna smith"], [" ".join(reversed(words[:n])) + " annasmith", ""])
        assert not same_parts([" ".join(words[:n]), "anna smith"], [" ".join(reversed(words[:n])) + " annasmiht", ""])
    assert same_parts(["b pb q"], ["b", "qb p"])  # only with the token that both have
    assert same_parts(["a " * 40 + "b"], ["aa " * 20 + "b"])


def test_copies_against_brute_force(spark):
    rng = random.Random(5)
    base = [("Anna", "Smith", "Jr"), ("Neol", "Smith", ""), ("Noel", "Smith", None), ("Lee Ann", "O'Hara", ""), ("", "", None), (None, None, None)]
    typed = []
    for f, l, s in base:
        parts = [p or "" for p in (f, l, s)]
        typed.append((f, l, s))
        for _ in range(6):
            rng.shuffle(parts)
            typed.append(tuple(p.upper() if rng.random() < 0.5 else f" {p}." for p in parts))
        typed.append((None, f"{l or ''},{f or ''} {s or ''}", ""))
    rng.shuffle(typed)
    df = spark.createDataFrame(rows_of(typed), COLS)
    got = {(r["keeper"], r["id"]) for r in copy_pairs(df).collect()}
    norm = {r["idx"]: [r["a"], r["b"], r["c"]] for r in df.select("idx", tokens(df["fname"]).alias("a"), tokens(df["lname"]).alias("b"), tokens(df["suffix"]).alias("c")).collect()}
    keeper = {}
    for i in sorted(norm):
        keeper[i] = next((k for k in sorted(set(keeper.values())) if same_parts(norm[k], norm[i])), i)
    want = {(k, i) for i, k in keeper.items() if sum(v == k for v in keeper.values()) > 1}
    assert got == want
    kept = collapse(df).collect()
    assert sum(r["n_copies"] for r in kept) == len(typed) and len(kept) == len(set(keeper.values())) and "extra" in kept[0].asDict()


def test_edges(spark):
    assert copy_pairs(spark.createDataFrame([], COLS)).count() == 0
    one = rows_of([("A", "B", "")])[0]
    other = (1, *one[1:4], "N", *one[5:])
    assert copy_pairs(spark.createDataFrame([one, other], COLS)).count() == 0
    long = rows_of([("a " * 3000, "b", ""), ("b", "a " * 3000, "")])
    assert copy_pairs(spark.createDataFrame(long, COLS)).count() == 2


def test_orders_of_parts():
    for a in itertools.permutations(["anna maria", "lopez", "jr"]):
        assert same_parts(list(a), ["annamaria lopez", "jr", ""])
