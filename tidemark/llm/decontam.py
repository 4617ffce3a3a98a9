"""Benchmark decontamination: size-partitioned MinHash containment search, with built-in functions only.

A text's words are its runs of letters and digits in lower case; its shingles are five words (the
whole sequence, for an item with fewer). A document leaks an item when it holds at least 80 % of
the item's distinct shingles.

Items are partitioned by the power of two of their number of shingles q. An item's sketch is the
q - ceil(0.8 q) + 1 shingles of smallest hash: a document that holds 80 % of the shingles must hold
one of the sketch, so no leak is lost. A partition is only searched in documents that have enough
words for its smallest item. Candidates are verified on the words themselves.

Null or empty texts and items have no shingles and match nothing; equal items are reported each;
repeated rows of a document count once; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import broadcast_if_small, by_row, own_ids, read, texts_of
from tidemark.session import pin

SHINGLE = 5
PERCENT = 80
NOT_WORD = "[^\\p{L}\\p{N}]+"


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda x: x != "")


def _normal(text: Column) -> Column:
    """Words, without a lambda: one space between them and none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def _with_words(df: DataFrame, key: str) -> DataFrame:
    df = df.select(key, _normal(F.col("text")).alias("_t")).filter("_t <> ''")
    return df.select(key, F.explode_outer(F.array(F.split("_t", " "))).alias("_w"))


def _shingles(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    """A row (keep…, g) for each place of a shingle of k words; g holds the words."""
    w, n = F.col("_w"), F.size("_w")
    parts = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(n - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)])
    return df.filter(n >= k).select(*keep, F.explode(parts).alias("g"))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item_shingles), a row for each leak. A document without an id has none to report.

    The sketches are broadcast only after their size has been measured; past the limit the join
    shuffles by hash. Matches are reduced to (document, item) before they are shuffled.
    """
    words = _with_words(items.select("item_id", "text").dropna(subset=["item_id"]), "item_id")
    words = pin(words.dropDuplicates().withColumn("k", F.least(F.size("_w"), F.lit(shingle))))
    lengths = sorted(r[0] for r in words.select("k").distinct().collect())  # at most `shingle` values
    texts = _with_words(texts_of(docs), "doc_id")
    found = None
    for k in lengths:
        own = _shingles(words.filter(F.col("k") == k), ["item_id"], k).distinct()
        own = own.withColumn("h", F.xxhash64("g"))
        need = F.ceil(F.lit(percent) * F.col("q") / 100)
        sets = own.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.count("*").alias("q"))
        sketch = sets.withColumn("part", F.floor(F.log2("q"))).select(
            "item_id", "part", F.explode(F.slice("hs", 1, (F.col("q") - need + 1).cast("int"))).alias("h")
        )
        # Items of a partition have 2^part shingles at least, and a leak holds `percent` of them.
        least = F.ceil(F.pow(F.lit(2.0), F.col("part")) * percent / 100) + (k - 1)
        sketch = broadcast_if_small(pin(sketch.withColumn("least_words", least)))
        places = _shingles(texts.withColumn("n", F.size("_w")), ["doc_id", "n"], k).withColumn("h", F.xxhash64("g"))
        hits = places.join(sketch, "h").filter("n >= least_words").select("doc_id", "item_id").distinct()
        candidates = pin(hits)
        some = broadcast_if_small(pin(candidates.select("doc_id").distinct()))
        inside = _shingles(texts.join(some, "doc_id"), ["doc_id"], k)
        exact = own.join(sets.select("item_id", "q"), "item_id").select("item_id", "q", "g")
        pairs = candidates.join(exact, "item_id").join(inside.distinct(), ["doc_id", "g"])
        part = pairs.groupBy("doc_id", "item_id").agg(
            F.count("*").alias("n_shared"), F.first("q").alias("n_item_shingles")
        )
        part = part.filter(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item_shingles long")
    return found


def query(spark, folder: str) -> DataFrame:
    return leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that leak no benchmark item. If ids are null or come twice, each row is judged by itself."""
    rows, own = by_row(docs)
    bad = pin(leaks(rows, read(spark, folder, "benchmark")).select("doc_id").distinct())
    return own_ids(rows.join(broadcast_if_small(bad), "doc_id", "left_anti"), own, docs.columns)


SQL = f"""
WITH words AS (
  SELECT doc_id, NULL AS item_id, list_filter(string_split_regex(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT NULL, item_id, list_filter(string_split_regex(lower(text), '{NOT_WORD}'), lambda x: x <> '') FROM benchmark),
items AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS k FROM words WHERE item_id IS NOT NULL AND len(w) > 0),
own AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM items, unnest(range(1, len(w) - k + 2)) AS t(i)),
sizes AS (SELECT item_id, count(*) AS q FROM own GROUP BY 1),
ks AS (SELECT DISTINCT k FROM items),
inside AS (SELECT DISTINCT doc_id, k, list_slice(w, i, i + k - 1) AS g FROM words, ks, unnest(range(1, len(w) - k + 2)) AS t(i)
  WHERE doc_id IS NOT NULL)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(q) AS n_item_shingles
FROM inside JOIN own USING (k, g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(q) * {PERCENT}
"""
