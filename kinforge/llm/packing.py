"""Texts into containers of a fixed number of tokens, with the sources mixed in target proportions.

Texts are measured in tokens in Arrow batches. A text longer than a container is cut into full pieces and a rest, all of which
take their place in their source's queue; nothing else is cut. Items are hashed into shards of about shard_tokens tokens, each packed by one call. A shard keeps
one queue for each source, sorted by size. Deficit round-robin: at each window (a number of containers) every queue is credited
its share of the window's tokens; the next item comes from the queue with the greatest credit that has an item for the
space left, and is the largest such item. What a window can't give a queue stays as its deficit for the next one.
Across shards the deficits come from prefix sums over a small table of tokens by shard and source, so that shards
are packed in parallel and still continue each other's mixture; at most half a window's share is carried, as a source with
less than its target would owe without end.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.session import stash

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CAPACITY = 2048
WINDOW = 16
SHARD_TOKENS = 4_000_000
#: Shards in one block of the prefix sums.
BLOCK = 4096

_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a .tiktoken file, read once in each process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def token_counts(df: DataFrame, id_col: str, text: str, queue: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, queue, n_tokens); NULL text has no tokens, a NULL or empty queue is 'und'."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "queue": pdf["queue"], "n_tokens": n})

    name = F.coalesce(F.nullif(F.trim(F.col(queue).cast("string")), F.lit("")), F.lit("und"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), name.alias("queue"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "id bigint, queue string, n_tokens bigint")


def fill(items: list[tuple[str, int, int]], shares: dict[str, float], credit: dict[str, float], capacity: int, window: int) -> list[tuple[int, int, int, int]]:
    """items (queue, size, id), none larger than capacity -> (position in items, container, window, start) for each."""
    queues: dict[str, list[tuple[int, int, int]]] = {}
    for i, (queue, size, key) in enumerate(items):
        queues.setdefault(queue, []).append((size, key, i))
    for q in queues.values():
        q.sort()
    debt = {q: credit.get(q, 0.0) for q in queues}
    out, container = [], 0
    while queues:
        if container % window == 0:
            whole = sum(shares.get(q, 0.0) for q in queues) or 1.0
            for q in queues:
                debt[q] += shares.get(q, 0.0) / whole * window * capacity
        used = 0
        while queues:
            left = capacity - used
            fits = [q for q in queues if queues[q][0][0] <= left]
            if not fits:
                break
            q = max(fits, key=lambda name: (debt[name], name))
            size, _, i = queues[q].pop(bisect_right(queues[q], (left, float("inf"), 0)) - 1)
            if not queues[q]:
                del queues[q]
            debt[q] -= size
            out.append((i, container, container // window, used))
            used += size
        container += 1
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", queue: str = "lang", targets: dict[str, float] | None = None, capacity: int = CAPACITY, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, queue, shard, container, window, start, n_tokens): where each piece of each text stands.

    A container is named by (shard, container). A text over capacity is cut into pieces of capacity, each of which fills a container of its
    queue's turn, and a rest. targets are the token proportions of the queues; by default those of the texts themselves. Queues that
    targets leave out come last in a window. Every text comes out, empty ones with 0 tokens; rows with NULL id don't. Rows with
    the same id are packed each.
    """
    sized = stash(token_counts(df, id_col, text, queue, vocabulary), "p7-sized")
    full = F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0).cast("bigint")
    last = F.when(F.col("n_tokens") - full * capacity > 0, full).otherwise(F.greatest(full - 1, F.lit(0).cast("bigint")))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")
    pieces = sized.select("id", "queue", full.alias("n_full"), "n_tokens", piece)
    size = F.when(F.col("piece") < F.col("n_full"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("n_full") * capacity).cast("bigint")
    total = sized.agg(F.sum(F.greatest("n_tokens", F.lit(8).cast("bigint")))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    items = pieces.select("id", "piece", "queue", size.alias("size"), F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).alias("shard"))
    table = stash(items.groupBy("shard", "queue").agg(F.sum("size").alias("n")), "p7-mixture")
    credits = _credits(table, targets)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, pieces = left["id"].tolist(), left["piece"].tolist()
        items = list(zip(left["queue"].tolist(), left["size"].tolist(), ids))
        shares = dict(zip(right["queue"], right["share"]))
        # a queue that can't meet its target would owe ever more: half a window's share is carried at most
        most = {q: s * window * capacity / 2 for q, s in shares.items()}
        credit = {q: max(-most[q], min(most[q], c)) for q, c in zip(right["queue"], right["credit"])}
        rows = fill(items, shares, credit, capacity, window)
        return pd.DataFrame([(ids[i], pieces[i], items[i][0], key[0], c, w, s, items[i][1]) for i, c, w, s in rows], columns=_COLUMNS)

    return items.groupBy("shard").cogroup(credits.groupBy("shard")).applyInPandas(one, _SCHEMA)


_COLUMNS = ["id", "piece", "queue", "shard", "container", "window", "start", "n_tokens"]
_SCHEMA = "id bigint, piece bigint, queue string, shard bigint, container bigint, window bigint, start bigint, n_tokens bigint"


def _before(table: DataFrame, of: list[str], value: str, name: str) -> DataFrame:
    """table with the sum of value over the earlier shards of the same keys, by two levels of prefix sums."""
    rows = table.withColumn("_block", F.floor(F.col("shard") / BLOCK))
    blocks = rows.groupBy(*of, "_block").agg(F.sum(value).alias("_d"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("bigint")
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_d").over(earlier(of, "_block")), nothing)).drop("_d")
    within = F.coalesce(F.sum(value).over(earlier([*of, "_block"], "shard")), nothing)
    return rows.withColumn("_within", within).join(blocks, [*of, "_block"]).withColumn(name, F.col("_within") + F.col("_base")).drop("_block", "_within", "_base")


def _credits(table: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(shard, queue, share, credit): each queue's share of the tokens, and what the earlier shards owe it: its share of all their tokens less
    its own. Queues are rows of a table, however many there are."""
    tokens = table.groupBy("queue").agg(F.sum("n").alias("wanted"))
    if targets is not None:
        given = table.sparkSession.createDataFrame(list(targets.items()), "queue string, wanted double")
        tokens = tokens.select("queue").join(given, "queue", "left").select("queue", F.coalesce("wanted", F.lit(0.0)).alias("wanted"))
    whole = tokens.agg(F.sum("wanted").alias("whole"))
    shares = tokens.join(F.broadcast(whole)).select("queue", F.when(F.col("whole") > 0, F.col("wanted") / F.col("whole")).otherwise(0.0).alias("share"))
    of_shard = table.groupBy("shard").agg(F.sum("n").alias("m")).withColumn("_all", F.lit(1))
    whole_before = _before(of_shard, ["_all"], "m", "all_before").select("shard", "all_before")
    own = _before(table, ["queue"], "n", "own_before")
    return own.join(whole_before, "shard").join(shares, "queue").select("shard", "queue", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("credit"))


#: Target proportions and shard size of the registered mixture.
TARGETS, MIXED_SHARD = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}, 100_000


def p7_packed(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def p7_mixed(spark, sf_dir: str) -> DataFrame:
    """The texts packed in stated proportions of their languages, over several shards."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(documents, targets=TARGETS, shard_tokens=MIXED_SHARD).withColumnRenamed("id", "doc_id")


def p7_windows(spark, sf_dir: str) -> DataFrame:
    """Per window of the mixture: each queue's share and its target, and the tokens."""
    rows = p7_mixed(spark, sf_dir).groupBy("shard", "window", "queue").agg(F.sum("n_tokens").alias("n"))
    per = Window.partitionBy("shard", "window")
    target = F.coalesce(*[F.when(F.col("queue") == q, F.lit(t)) for q, t in TARGETS.items()], F.lit(0.0))
    return rows.select("shard", "window", "queue", F.round(F.col("n") / F.sum("n").over(per), 6).alias("share"), target.alias("target"), F.sum("n").over(per).alias("n_tokens"))
