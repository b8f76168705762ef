"""Evaluation passages inside corpus documents, by a distributed positional inverted index.

Only terms that can start a match are posted. The corpus frequency of every passage term is counted over all documents;
each window of min_run passage words is represented by its two rarest terms, and only these terms get postings (document,
position). A posting minus the term's offset in the passage is the diagonal on which a match must lie; only diagonals
that two terms agree on, give or take a few words, go on. For each of them the stretch of the document where the passage would stand is cut out of the
document's words once and compared with the passage in place, which gives the longest run of consecutive words exactly, where it
is, and the words that match near it. Passage terms are broadcast only below a
size that is checked; the corpus is never shuffled as a whole, and neither are the positions of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.session import small, stash

MIN_RUN = 12
#: Diagonals that far apart still count as one place for proximity matches.
SLOP = 3
#: Share of a passage's words that must stand near their place for a proximity match.
NEAR_SHARE = 0.6


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; invisible characters vanish, everything else separates."""
    seen = F.regexp_replace(F.lower(text), r"[\p{Cf}\p{Cc}&&[^\s]]", "")
    return F.filter(F.split(F.regexp_replace(seen, r"[^\p{L}\p{N}\p{M}]+", " "), " "), lambda w: w != "")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_run: int = MIN_RUN, slop: int = SLOP, near_share: float = NEAR_SHARE) -> DataFrame:
    """(doc_id, item_id, kind, longest_run, near_words, n_words, item_word, doc_word): kind 'phrase' for documents with at least min_run
    consecutive words of a passage, 'proximity' for others in which at least near_share of the passage's words stand near their place.

    longest_run is the greatest number of consecutive words in common, beginning at item_word of the passage and doc_word of the
    document (from 0; of several the first diagonal); near_words the number of passage words found at
    their place, give or take slop words, around the best place. Rows with NULL id or text, empty texts, and passages
    of fewer than min_run words give nothing. A repeated document or item counts once.
    """
    asked = items.select(F.col(item_id).alias("item"), words(F.col(passage)).alias("w")).where(F.size("w") >= min_run).dropDuplicates(["item"])
    asked = stash(asked, "p8-passages")
    terms = stash(asked.select("item", F.posexplode("w").alias("off", "word")), "p8-terms")
    vocabulary = stash(terms.select("word").distinct(), "p8-vocabulary")
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    counts = docs.select(F.explode(words(F.col("t"))).alias("word")).join(small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("freq"))
    # terms that no document has can't be matched, but a window with such a term has no match either: its frequency is 0
    known = terms.join(counts, "word", "left").select("item", "off", "word", F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq"))
    ahead = Window.partitionBy("item").orderBy("off").rowsBetween(0, min_run - 1)
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("freq", "word", F.col("off").alias("at"))).over(ahead)), 1, 2)
    windows = known.select("item", "off", rarest.alias("r"), F.max("off").over(Window.partitionBy("item")).alias("last"))
    windows = windows.where((F.col("off") + min_run - 1 <= F.col("last")) & (F.col("r")[1 if min_run > 1 else 0]["freq"] > 0))
    anchors = stash(windows.select("item", F.inline("r")).where("freq > 0").select("item", F.col("at").alias("off"), "word").distinct(), "p8-anchors")
    postings = docs.select("doc", F.posexplode(words(F.col("t"))).alias("pos", "word")).join(small(anchors), "word")
    hits = postings.select("doc", "item", (F.col("pos") - F.col("off")).alias("diagonal")).repartition(F.col("doc"), F.col("item"))
    lines = hits.groupBy("doc", "item", "diagonal").agg(F.count("*").alias("n"))
    # a whole window brings both its terms to its diagonal, a passage with words changed or put in brings them near it
    beside = Window.partitionBy("doc", "item").orderBy("diagonal").rangeBetween(-slop, slop)
    diagonals = lines.withColumn("n", F.sum("n").over(beside)).where(F.col("n") >= min(2, min_run)).select("doc", "item", "diagonal")
    sizes = asked.select("item", F.size("w").alias("size"))
    of_doc = diagonals.join(small(sizes), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "diagonal", "size")).alias("lines"))
    of_doc = stash(of_doc, "p8-diagonals")
    held = docs.join(small(of_doc.select("doc")), "doc", "left_semi").select("doc", words(F.col("t")).alias("w")).dropDuplicates(["doc"])
    cut = lambda x: F.struct(x["item"].alias("item"), x["diagonal"].alias("diagonal"), F.slice("w", F.greatest(x["diagonal"], F.lit(0)) + 1, F.greatest(x["size"] + F.least(x["diagonal"], F.lit(0)), F.lit(0))).alias("piece"))
    pieces = held.join(small(of_doc), "doc").select("doc", F.inline(F.transform("lines", cut))).join(small(asked.withColumnRenamed("w", "p")), "item")
    begin = F.greatest(-F.col("diagonal"), F.lit(0))
    agree = F.array_join(F.zip_with("piece", F.slice("p", begin + 1, F.size("piece")), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    places = pieces.select("doc", "item", "diagonal", F.size("p").alias("n_words"), begin.alias("begin"), agree.alias("agree"))
    run = F.array_max(F.transform(F.split("agree", "0"), F.length))
    places = places.withColumn("run", run).withColumn("hits", F.length(F.replace("agree", F.lit("0"), F.lit("")))).where("hits > 0")
    places = places.withColumn("item_word", F.col("begin") + F.instr("agree", F.repeat(F.lit("1"), F.col("run"))) - 1)
    around = Window.partitionBy("doc", "item").orderBy("diagonal").rangeBetween(-slop, slop)
    places = places.withColumn("near", F.least(F.sum("hits").over(around), F.col("n_words")))
    best = F.max(F.struct(F.col("run").alias("run"), (-F.col("diagonal")).alias("first"), "item_word"))
    found = places.groupBy("doc", "item").agg(best.alias("best"), F.max("near").alias("near"), F.max("n_words").alias("n_words"))
    found = found.withColumn("kind", F.when(F.col("best.run") >= min_run, "phrase").when(F.col("near") >= near_share * F.col("n_words"), "proximity")).where("kind is not null")
    long = lambda c: F.col(c).cast("bigint")
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "kind", long("best.run").alias("longest_run"), long("near").alias("near_words"), long("n_words").alias("n_words"), long("best.item_word").alias("item_word"), (F.col("best.item_word") - F.col("best.first")).cast("bigint").alias("doc_word"))


def p8_matches(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).where("kind = 'phrase'").select("doc_id", "item_id")


def p8_items(spark, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of pages that hold them."""
    return p8_matches(spark, sf_dir).where("kind = 'phrase'").groupBy("item_id").agg(F.count("*").alias("n_pages"))
