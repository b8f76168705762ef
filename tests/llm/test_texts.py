import random

import regex

from kinforge.llm import leakage, packing, spam


def test_longest_repeats_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randrange(25))]
        want = []
        for i in range(len(s)):
            best = 0
            for n in range(1, i + 2):
                run = s[i - n + 1 : i + 1]
                if sum(s[k : k + n] == run for k in range(len(s) - n + 1)) > 1:
                    best = n
            want.append(best)
        assert spam.longest_repeats(s) == want


PROSE = "We counted 12 pieces of the market and kept the rest in early spring. Nobody saw the harbour at night, although the lamps were lit. "


def test_spam(spark):
    list_page = "Home | Contact | Shop | Blog\n" + "\n".join(f"garden hose Town{i}" for i in range(30))
    stuffed = "garden hose price garden hose best garden hose. " * 12
    stars = " ★ ".join(f"best lamp {i % 3}" for i in range(40))
    rows = [(1, list_page), (2, PROSE * 4), (3, stuffed), (4, stars), (5, "Error\nPage not found."), (6, ""), (7, None), (8, PROSE + "\nlamp: 3\nhose: 4\n" + PROSE * 2), (None, list_page), (1, list_page)]
    got = {r["id"] for r in spam.judged(spark.createDataFrame(rows, "doc_id long, text string")).where("spam").collect()}
    assert got == {1, 3, 4}
    assert spam.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spam_of_one_line_and_of_long_repeats():
    keywords = [f"{a}{b}" for a in ("garden", "lamp", "hose", "chair", "table") for b in ("price", "shop", "sale", "best", "cheap", "online", "buy", "store", "deal", "offer", "town", "home")]
    assert spam.judge(" ".join(keywords * 20))[4] and spam.judge(", ".join(keywords))[4]
    phrase = "Garden hose lamp chair table sofa carpet curtain mirror. "
    assert spam.judge(phrase * 50)[4] and not spam.judge(PROSE * 4)[4]
    towns = "".join(f"Cheap garden hose lamp chair table sofa carpet curtain mirror Town{i}. " for i in range(50))
    assert spam.judge(towns)[4]
    assert not spam.judge("The market was counted again in early spring and then the\n" + PROSE * 2)[4]


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(30)] for _ in range(6)]
    docs = []
    for d in range(40):
        body = [rng.choice(vocab) for _ in range(60)]
        if d % 2:
            p = rng.choice(passages)
            n = rng.choice([10, 11, 12, 13, 30])
            at = rng.randrange(30 - n + 1)
            body[20:20] = p[at : at + n]
        docs.append((d, ", ".join(body).upper().replace("W1", "W­1")))
    docs += [(90, None), (91, ""), (None, "x"), docs[1]]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(50, "too short"), (51, None)]
    word = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower().replace("­", ""))
    want = {}
    for d, t in docs:
        for i, p in items:
            a, b = word(t), word(p)
            best = max((next((n for n in range(min(len(a) - x, len(b) - y) + 1) if n == min(len(a) - x, len(b) - y) or a[x + n] != b[y + n])) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]), default=0)
            if best >= 12 and d is not None:
                want[d, i] = best
    rows = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).where("kind = 'phrase'").collect()
    got = {(r["doc_id"], r["item_id"]): r["longest_run"] for r in rows}
    for r in rows:  # the run is where it is said to be
        there, passage = word(next(t for d, t in docs if d == r["doc_id"])), word(dict(items)[r["item_id"]])
        n = r["longest_run"]
        assert there[r["doc_word"] : r["doc_word"] + n] == passage[r["item_word"] : r["item_word"] + n] and r["n_words"] == len(passage)
    assert got == want and want
    assert leakage.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).count() == 0


def test_proximity_matches(spark):
    passage = [f"term{i}" for i in range(40)]
    changed = [w if i % 8 else "other" for i, w in enumerate(passage)]  # no 12 in a row are left
    spread = [*passage[:10], "put", "in", *passage[10:20], "more", *passage[20:30]]
    few = [w if i % 3 == 0 else "other" for i, w in enumerate(passage)]
    docs = [(1, " ".join(["lead"] * 50 + changed)), (2, " ".join(spread)), (3, " ".join(few)), (4, " ".join(passage[:11]))]
    items = [(7, " ".join(passage)), (8, " ".join(f"far{i}" for i in range(20)))]
    got = {r["doc_id"]: r for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert set(got) == {1, 2} and all(r["kind"] == "proximity" and r["item_id"] == 7 for r in got.values())
    assert (got[1]["longest_run"], got[1]["near_words"], got[1]["doc_word"], got[1]["item_word"]) == (7, 35, 51, 1) and got[2]["near_words"] == 30


def test_fill_keeps_proportions():
    rng = random.Random(1)
    items = [(q, rng.randrange(1, 300), i) for i, q in enumerate(["a"] * 400 + ["b"] * 200)]
    shares = {"a": 0.5, "b": 0.5}
    rows = packing.fill(items, shares, {}, 1000, 8)
    assert sorted(r[0] for r in rows) == list(range(600))
    used = {}
    for i, c, w, start in rows:
        assert start == used.get(c, 0)
        used[c] = start + items[i][1]
    assert max(used.values()) <= 1000 and sum(used.values()) / (1000 * len(used)) > 0.97
    first = [items[i] for i, _, w, _ in rows if w == 0]
    assert abs(sum(n for q, n, _ in first if q == "a") / sum(n for _, n, _ in first) - 0.5) < 0.1


def test_pack(spark):
    rows = [(i, "word " * (5 * i), "en" if i % 3 else None) for i in range(30)] + [(100, "long text " * 200, "de"), (101, "", "de"), (102, None, ""), (5, "again", "en"), (None, "x", "en")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string"), capacity=128, window=4, shard_tokens=600).collect()
    by_id = {}
    for r in packed:
        by_id[r["id"]] = by_id.get(r["id"], 0) + r["n_tokens"]
    enc = packing.encoder(packing.VOCABULARY)
    want = {}
    for i, t, _ in rows:
        if i is not None:
            want[i] = want.get(i, 0) + len(enc.encode_ordinary(t or ""))
    assert by_id == want
    held = {}
    for r in packed:
        held[r["shard"], r["container"]] = held.get((r["shard"], r["container"]), 0) + r["n_tokens"]
    assert max(held.values()) <= 128 and len({(r["shard"], r["container"], r["start"]) for r in packed if r["n_tokens"]}) == sum(r["n_tokens"] > 0 for r in packed)
    assert all(sum(x["id"] == r["id"] for x in packed) == 1 for r in packed if r["n_tokens"] < 128 and r["piece"] == 0 and r["id"] != 5)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_mixture_over_shards(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["word", "text", "more"], k=rng.randrange(1, 400))), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    rows += [(2000 + i, "long text " * 700, "b") for i in range(12)]  # long pages of one queue
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    targets = {"a": 0.6, "b": 0.25, "c": 0.15}
    packed = packing.pack(df, targets=targets, capacity=512, window=8, shard_tokens=40_000).collect()
    assert len({r["shard"] for r in packed}) > 3 and {r["id"] for r in packed} == {r[0] for r in rows}
    assert sum(r["n_tokens"] == 512 for r in packed) >= 12 * 2 and all(r["window"] >= 0 for r in packed)
    own, windows = {}, {}
    for r in packed:
        windows.setdefault((r["shard"], r["window"]), {}).setdefault(r["queue"], []).append(r["n_tokens"])
        own[r["shard"]] = max(own.get(r["shard"], 0), r["window"])
    off = [abs(sum(w.get(q, [0])) / sum(map(sum, w.values())) - t) for (s, n), w in windows.items() if n < own[s] // 2 for q, t in targets.items()]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.06  # while all queues have items
    # without targets the windows have the proportions of the texts
    natural = packing.pack(df, capacity=512, window=8, shard_tokens=40_000).collect()
    total = sum(r["n_tokens"] for r in natural)
    share = {q: sum(r["n_tokens"] for r in natural if r["queue"] == q) / total for q in targets}
    by_shard = {}
    for r in natural:
        by_shard.setdefault(r["shard"], {}).setdefault(r["queue"], []).append(r["n_tokens"])
    # deficits go from shard to shard: over the shards so far every queue has had its share, but for what chance put in the last one
    assert all(abs(sum(map(sum, (w.get(q, [0]) for w in by_shard.values()))) / total - share[q]) < 1e-9 for q in targets)


def test_credits_carry_over_shards(spark):
    table = spark.createDataFrame([(s, q, n) for s, row in enumerate([(10, 30), (20, 20), (35, 5), (0, 40)]) for q, n in zip("ab", row) if n], "shard long, queue string, n long")
    got = {(r["shard"], r["queue"]): (r["share"], round(r["credit"], 6)) for r in packing._credits(table, {"a": 1.0, "b": 1.0}).collect()}
    assert got[0, "a"] == (0.5, 0) and got[1, "a"] == (0.5, 10) and got[2, "b"] == (0.5, -10) and got[3, "b"] == (0.5, 5)
    assert packing._credits(table.limit(0), None).count() == 0
