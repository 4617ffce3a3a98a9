"""Quality rules by line-first cleaning, with built-in functions only.

Each line with a word is judged alone: it fails when it ends without sentence punctuation and is
short, when it reads as navigation (mostly separators) or as boilerplate (fixed phrases), when
shouting or symbols fill it, or when it repeats an earlier line. Failing lines go; the document is
rejected when too little of its text is left. Windows of repeated words are judged on the whole text.

Null and empty texts have zero counts and fail the base rule (fewer than ten words). Repeated rows
give repeated results; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import WORD_SPACE, texts_of

# What marks a symbol, a sentence end, a separator of menus, and boilerplate phrases.
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?\"'”»…:;)"
BOILERPLATE = ("cookie", "all rights reserved", "terms of use", "privacy policy", "javascript", "subscribe", "lorem ipsum", "released under the")
# Parameters of the method.
MIN_LINE_WORDS = 4
MIN_KEPT_PERCENT = 50
WINDOW = 5


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPACE))


def _in_line(line: Column, symbols: str) -> Column:
    return F.length(line) - F.length(F.translate(line, symbols, ""))


def lines_of(text: Column) -> Column:
    """Lines with a word, each with its text without white space (`bare`) and its number of words."""
    read = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(x.alias("line"), F.regexp_replace(x, WORD_SPACE, "").alias("bare"), F.size(_words(x)).alias("n")),
    )
    return F.filter(read, lambda x: x["n"] > 0)


def line_fails(x: Column) -> Column:
    """True for an entry of lines_of() that the cleaning removes."""
    bare, words = x["bare"], x["n"]
    open_end = (words < MIN_LINE_WORDS) & ~F.right(bare, F.lit(1)).isin(*ENDINGS)
    menu = F.lit(5) * _in_line(bare, "|>»·") > words
    symbols = F.lit(10) * _in_line(bare, SYMBOLS) > F.length(bare)
    shouting = (words >= MIN_LINE_WORDS) & (F.upper(bare) == bare) & (F.lower(bare) != bare)
    phrase = (words < 40) & F.lower(x["line"]).rlike("|".join(BOILERPLATE))
    return open_end | menu | symbols | shouting | phrase


def repeated_words(frame: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """Add the number of words inside a window of `window` words that occurs twice or more in the row.

    All inside the row: windows are hashed once, rows without a repeat stop at a distinct count,
    and the others sort (hash, place). The generators keep Spark from computing the arrays again.
    """
    spare = [f"_{out}_{x}" for x in ("h", "s", "p")]
    h, s, p = spare
    w = F.col(words)
    n = F.size(w)
    parts = [F.slice(w, F.lit(i + 1), F.greatest(n - window + 1, F.lit(0))) for i in range(window)]
    zipped = F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(parts)])
    hashes = F.when(n > window, F.transform(zipped, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    frame = frame.select("*", F.explode_outer(F.array(hashes)).alias(h))
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    frame = frame.select("*", F.explode_outer(F.array(F.when(repeats, placed).otherwise(none))).alias(s))
    last = F.size(s) - 1

    def twice(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(s, i - 1)["h"])
        after = F.when(i < last, F.get(s, i + 1)["h"])
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(F.col(s), twice), lambda x: x["i"]))
    frame = frame.select("*", F.explode_outer(F.array(places)).alias(p))
    covers = F.transform(
        F.col(p), lambda x, i: F.least(F.lit(window), F.when(i < F.size(p) - 1, F.get(p, i + 1) - x).otherwise(window))
    )
    total = F.aggregate(covers, F.lit(0), lambda a, x: a + x)
    return frame.withColumn(out, total.cast("long")).drop(*spare)


def quality(docs: DataFrame) -> DataFrame:
    """Counts, the base rule and the verdict of each document, beside what the cleaning keeps.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_bad_lines, kept_chars and clean_text (the remaining lines).
    """
    frame = texts_of(docs).select("doc_id", "text", F.explode_outer(F.array(_words(F.col("text")))).alias("_w"))
    frame = repeated_words(frame, "_w", "n_repeat_words")
    frame = frame.select("*", F.explode_outer(F.array(lines_of(F.col("text")))).alias("_lines"))
    # Equal lines are found by 64-bit hashes, which Spark keeps in a hash set.
    hashes = F.transform("_lines", lambda x: F.xxhash64(x["line"]))
    frame = frame.select("*", F.explode_outer(F.array(hashes)).alias("_h"))
    first = F.transform("_lines", lambda x, i: x.withField("first", F.array_position("_h", F.get("_h", i)) == i + 1))
    repeats = F.size("_h") - F.size(F.array_distinct("_h"))
    distinct = F.when(repeats == 0, F.transform("_lines", lambda x: x.withField("first", F.lit(True)))).otherwise(first)
    good = F.filter(distinct, lambda x: x["first"] & ~line_fails(x))
    chars = F.length(F.array_join("_w", ""))
    frame = frame.select("*", chars.cast("long").alias("word_chars"), F.explode_outer(F.array(good)).alias("_good"))
    kept_chars = F.length(F.array_join(F.transform("_good", lambda x: x["bare"]), "")).cast("long")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    frame = frame.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        _in_line(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_h") - F.size(F.array_distinct("_h"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_bad_lines"),
        kept_chars.alias("kept_chars"),
        F.array_join(F.transform("_good", lambda x: x["line"]), "\n").alias("clean_text"),
    )
    enough = F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT
    return frame.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)


def digest(docs: DataFrame) -> DataFrame:
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_bad_lines", "kept_chars",
    )


def _sql() -> str:
    endings = "".join(ENDINGS).replace("'", "''")
    phrases = " OR ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
    symbols = "#*$%&|<>"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{WORD_SPACE}'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{WORD_SPACE}', '', 'g') <> '') AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT DISTINCT doc_id, i + k AS at FROM r, unnest(range(0, {WINDOW})) AS t(k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY 1),
lines AS (SELECT doc_id, unnest(list_distinct(ls)) AS l FROM w),
m AS (SELECT doc_id, l, regexp_replace(l, '{WORD_SPACE}', '', 'g') AS bare,
  len(list_filter(string_split_regex(l, '{WORD_SPACE}'), lambda x: x <> '')) AS n FROM lines),
f AS (SELECT doc_id, l, bare, (position(right(bare, 1) IN '{endings}') = 0 AND n < {MIN_LINE_WORDS})
  OR 5 * (length(l) - length(translate(l, '|>»·', ''))) > n
  OR 10 * (length(l) - length(translate(l, '{symbols}', ''))) > length(bare)
  OR (upper(bare) = bare AND lower(bare) <> bare AND n >= {MIN_LINE_WORDS})
  OR (({phrases}) AND n < 40) AS bad FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE NOT bad) AS n_good, coalesce(sum(length(bare)) FILTER (WHERE NOT bad), 0) AS kept_chars FROM f GROUP BY 1),
o AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{symbols}', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) - coalesce(n_good, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND kept_chars * 100 >= word_chars * {MIN_KEPT_PERCENT} AS kept FROM v
"""


SQL = _sql()
