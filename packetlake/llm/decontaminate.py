"""Benchmark decontamination (operator 2): winnowing, in DataFrame functions only.

The hashes of all runs of GRAM words of a text are slid over by a window of
REACH hashes, and the smallest of each window is kept, so any shared stretch of
GRAM + REACH - 1 = 10 words has a kept hash at the same place of it in both
texts. Kept hashes of the documents meet those of the items; each meeting is
checked word by word, extended to both sides as far as a window of ten words
around the gram can reach, and counts if ten words in a row agree. As every
window holds a kept hash, the extents together are exactly the words of all
occurrences of item windows. Items of one to nine words are one window; the
runs of their lengths (at most nine different ones) are joined whole.

Item contexts that are the same text are joined once, with the list of their
items. They are broadcast only if their count is under BROADCAST_ROWS;
beyond it the documents' kept hashes are shuffled with their fifteen words.

Null texts have no words, as have texts of separators only; a document without
words has no hits, an item without words has no window, an item with a null id
is left out of the lists. Repeated rows each give a row (item ids are counted
once); empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, REACH = 5, 6
WINDOW = GRAM + REACH - 1
#: A position takes the low 31 bits of a kept value, its hash the rest.
BITS = 31
SPAN = WINDOW - GRAM  # words to look at on both sides of a gram
#: Contexts of fifteen words each, so under some 60 MB.
BROADCAST_ROWS = 200_000
#: Beyond all hashes; from here on come the values that only mark a document.
EXTRA, SALTS = 1 << 40, 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Runs of 0-9, a-z and anything beyond ASCII, after lower-casing A-Z."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n)


def grams(df: DataFrame, size: int, out: str) -> DataFrame:
    """Adds ``out``: for each run of ``size`` words a value with its hash in the high bits and its position in the low ones."""
    n = F.size("__hashes")
    value = lambda i: F.shiftleft(F.xxhash64(F.lit(size), *(F.get("__hashes", i + j) for j in range(size))), BITS).bitwiseOR(i.cast("long"))
    return df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).withColumn(out, F.when(n >= size, F.transform(_upto(n - size), value)).otherwise(F.array().cast("array<bigint>")))


# Explode is always given a null or the outer form: for a plain column Spark infers a filter on the
# array's size and pushes it below, where the lambdas nest and are computed again for every word.


def winnowed(df: DataFrame) -> DataFrame:
    """Adds ``__kept``: the smallest value of every REACH neighbouring ones, each once."""
    df = grams(df, GRAM, "__grams")
    least = lambda i: F.least(*(F.get("__grams", i + j) for j in range(REACH)))
    kept = F.when(F.size("__grams") >= REACH, F.array_distinct(F.transform(_upto(F.size("__grams") - REACH), least))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__kept", kept).drop("__hashes", "__grams")


def _hash(v: Column) -> Column:
    return F.shiftright(v, BITS)


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _first_miss(same: Column, size: int) -> Column:
    """How many leading entries of ``same`` (``size`` booleans) are true."""
    at = F.array_position(same, False)
    return F.when(at == 0, size).otherwise(at - 1).cast("int")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    items = bench.select(F.col(item_col).cast("string").alias("__item"), word_array(F.col(item_text_col)).alias("__words")).where(F.size("__words") > 0)
    long_ = winnowed(items.where(F.size("__words") >= WINDOW)).select("__item", "__words", F.explode_outer("__kept").alias("__v"))
    # the gram's words and SPAN on both sides, null beyond the item
    around = F.transform(F.sequence(F.lit(-SPAN), F.lit(GRAM + SPAN - 1)), lambda d: F.get("__words", _place(F.col("__v")) + d))
    contexts = long_.select(_hash(F.col("__v")).alias("__h"), around.alias("__ctx"), "__item").groupBy("__h", "__ctx").agg(F.array_sort(F.collect_set("__item")).alias("__items"))
    short = items.where(F.size("__words") < WINDOW)
    n_contexts, lengths = contexts.count(), sorted(r[0] for r in short.select(F.size("__words")).distinct().collect())  # nine at most

    # a row is known by its id and a hash of its text, which every branch below works out alike; equal rows are
    # counted by their extra values and come back as many.
    # an entry that meets every document's own extra value, so that each has a row; salted for the shuffled way
    extra = docs.sparkSession.range(SALTS).select((F.lit(EXTRA) + F.col("id")).alias("__h"), F.lit(None).cast("array<string>").alias("__ctx"), F.lit(None).cast("array<string>").alias("__items"))
    contexts = contexts.unionByName(extra)

    base = docs.select(F.col(id_col).alias("__id"), word_array(F.col(text_col)).alias("__words"), F.xxhash64(id_col, text_col).alias("__row"))
    base = base.withColumn("__n", F.size("__words").cast("long"))
    rows = winnowed(base).select("__row", "__id", "__n", "__words", F.explode(F.concat("__kept", F.array(F.lit(None).cast("bigint")))).alias("__v"))
    rows = rows.select("__row", "__id", "__n", "__words", F.coalesce(_hash(F.col("__v")), F.lit(EXTRA) + F.pmod("__row", F.lit(SALTS))).alias("__h"), F.coalesce(_place(F.col("__v")), F.lit(0)).alias("__p"))
    if n_contexts <= broadcast_rows:
        # the words stay in place: the join's generated code copies them for the few rows that meet only
        met = rows.join(F.broadcast(contexts), "__h")
        words, at = F.col("__words"), F.col("__p")
    else:
        near = F.transform(F.sequence(F.lit(-SPAN), F.lit(GRAM + SPAN - 1)), lambda d: F.get("__words", F.col("__p") + d))
        met = rows.select("__row", "__id", "__n", "__h", "__p", F.when(F.col("__h") < EXTRA, near).alias("__near")).join(contexts, "__h")
        words, at = F.col("__near"), F.lit(SPAN)
    same = F.transform(F.sequence(F.lit(-SPAN), F.lit(GRAM + SPAN - 1)), lambda d: F.coalesce(F.get(words, at + d) == F.get("__ctx", d + SPAN), F.lit(False)))
    met = met.select("__row", "__id", "__n", "__p", "__items", (F.col("__h") >= EXTRA).alias("__extra"), F.when(F.col("__h") < EXTRA, same).alias("__same"))
    left = _first_miss(F.reverse(F.slice("__same", 1, SPAN)), SPAN)
    right = _first_miss(F.slice("__same", SPAN + GRAM + 1, SPAN), SPAN)
    met = met.select("__row", "__id", "__n", "__p", "__items", "__extra", F.array_contains(F.slice("__same", SPAN + 1, GRAM), False).alias("__miss"), left.alias("__left"), right.alias("__right"))
    hit = F.struct((F.col("__p") - F.col("__left")).alias("s"), (F.col("__p") + GRAM + F.col("__right") - 1).alias("e"), F.col("__items").alias("items"))
    good = ~F.col("__miss") & (F.col("__left") + F.col("__right") + GRAM >= WINDOW)
    met = met.select("__row", "__id", "__n", "__extra", F.when(good, hit).alias("__hit"))

    for size in lengths:
        keys = grams(short.where(F.size("__words") == size), size, "__grams").select(_hash(F.get("__grams", F.lit(0))).alias("__h"), F.col("__words").alias("__ctx"), "__item")
        keys = keys.groupBy("__h", "__ctx").agg(F.array_sort(F.collect_set("__item")).alias("__items"))
        runs = grams(base, size, "__grams").select("__row", "__id", "__n", "__words", F.explode_outer("__grams").alias("__v"))
        runs = runs.select("__row", "__id", "__n", F.slice("__words", _place(F.col("__v")) + 1, size).alias("__ctx"), _place(F.col("__v")).alias("__p"), _hash(F.col("__v")).alias("__h"))
        found = runs.join(keys, ["__h", "__ctx"])
        met = met.unionByName(found.select("__row", "__id", "__n", F.lit(False).alias("__extra"), F.struct(F.col("__p").alias("s"), (F.col("__p") + size - 1).alias("e"), F.col("__items").alias("items")).alias("__hit")))

    by = met.groupBy("__row", "__id", "__n").agg(F.collect_set("__hit").alias("__hits"), F.count_if("__extra").alias("__copies"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("__hits", lambda x: x["items"]))))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("__hits", lambda x: F.sequence(x["s"], x["e"]))))).cast("long")
    by = by.select("__id", "__n", n_hit.alias("n_hit"), ids.alias("__ids"), F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return by.select(F.col("__id").alias(id_col), F.col("__n").alias("n_words"), "n_hit", F.size("__ids").cast("long").alias("n_items"), F.sha2(F.array_join("__ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))



def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of documents without hits, in their own columns. An id that has a contaminated row goes whole."""
    bad = contaminated(docs, bench, id_col, text_col, item_col, item_text_col).where("contaminated").select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
