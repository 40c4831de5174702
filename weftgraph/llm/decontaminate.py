"""Benchmark decontamination, in DataFrame functions only.

Texts are lower-cased words (runs of letters and digits); a shingle is five words (a text of fewer
words is one shingle); a shingle weighs as often as it occurs; similarity is the sum of the smaller
weights over the sum of the larger ones. A window of a document matches an item of as many words
when that is 0.8 or more.

1. Windows. A window with a similarity above zero shares a shingle with the item, and its start is
   then given by the shingle's place in the item: only such item-sized windows are cut. A filter of
   the items' shingle hashes, sent as a constant, drops nearly all positions inside the row they
   stand in, so neither the corpus nor its shingles are shuffled. The benchmark is the stated query
   set; beyond ``BLOCK`` shingles it is taken in blocks.
2. Equal windows for items of one size are one text from here on, however many documents hold it.
3. A SimHash of each window and item over their weighted shingles. Four blocks of 16 bits: two
   fingerprints within ``RADIUS`` bits differ by ``RADIUS // 4`` bits at most in one block. Items are
   listed under every value of each block that is all but one of these bits away, windows under
   their own and those one bit away, together with the item's size: a window meets items of its size only.
4. The exact weighted similarity of each candidate pair, over the shingles themselves.
5. Matches go back to their documents by the window's text, both sides being written tables, so
   that a passage that a third of all documents hold is split.

Edge cases: null texts are empty; an item without words matches nothing; a document shorter than
the item is one window; null doc_ids and repeated ids are reported under their id, once per item;
ties go to the first window cut; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCK_BITS, BLOCKS = 19, 16, 4
#: Items' shingles that go out in one filter (of SLOTS slots each at least).
BLOCK, SLOTS = 250_000, 32


def words(text: str = "text") -> Column:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")


def kept(col: Column) -> Column:
    """The array as a column of its own: what reads it later does not compute it again."""
    return F.explode(F.array(col))


def shingles(col: Column, of) -> Column:
    """``of`` the words of every shingle of the words in col, in order."""
    n = F.size(col)
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: of([F.get(col, i + k) for k in range(SHINGLE)]))
    short = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(col, " ")))
    if of is key:
        short = F.transform(short, lambda s: F.xxhash64(s))
    return F.when(n >= SHINGLE, full).otherwise(short)


def key(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def joined(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def simhash(hashes: Column) -> Column:
    """A bit is set if the shingles with it outweigh those without."""

    def bit(acc: Column, b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.call_function("getbit", h, b) == 1, 1).otherwise(-1))
        return acc.bitwiseOR(F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def block_values(fp: Column, changes: int) -> Column:
    """(block, value) of the fingerprint's four blocks, with all values ``changes`` bits away or less."""
    masks = [sum(1 << b for b in bits) for k in range(changes + 1) for bits in combinations(range(BLOCK_BITS), k)]
    low = (1 << BLOCK_BITS) - 1
    own = [F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit(low)).cast("int") for k in range(BLOCKS)]
    if not changes:
        return F.array(*(F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(own)))
    listed = F.expr(f"array({','.join(map(str, masks))})")

    def changed(k: int, v: Column):
        return lambda m: F.struct(F.lit(k).alias("block"), v.bitwiseXOR(m).alias("value"))

    return F.concat(*(F.transform(listed, changed(k, v)) for k, v in enumerate(own)))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words, hashes) of the items with words, written."""
    own = benchmark.select("item_id", kept(words()).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    return common.materialize(own.select("item_id", "n", "words", shingles(F.col("words"), key).alias("hashes")), "items")


def windows(docs: DataFrame, own: DataFrame, n_shingles: int) -> DataFrame:
    """(doc_id, start, n, text) of the windows for items of n words that share a shingle with such an
    item, written."""
    found = None
    whole = own.filter(F.col("n") >= SHINGLE)
    cut = docs.select("doc_id", kept(words()).alias("words"))
    blocks = -(-n_shingles // BLOCK)
    for block in range(blocks):
        some = whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        places = common.materialize(some.select("n", F.posexplode("hashes").alias("place", "hash")).distinct(), "places")
        slots = 1 << max(10, (SLOTS * BLOCK if blocks > 1 else SLOTS * n_shingles).bit_length())
        marks = bytearray(slots // 4)  # four slots a byte, which stays below 16
        for r in places.select("hash").distinct().toLocalIterator():
            for at in (r["hash"] & slots - 1, r["hash"] >> 32 & slots - 1):
                marks[at >> 2] |= 1 << (at & 3)
        table = F.lit(bytes(marks))

        long_ = cut.filter(F.size("words") >= SHINGLE)
        hashes = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.struct(i.alias("at"), key([F.get("words", i + k) for k in range(SHINGLE)]).alias("hash")))
        hits = long_.select("doc_id", "words", F.filter(hashes, _marked(table, slots)).alias("hits"))
        hits = hits.select("doc_id", "words", F.explode("hits").alias("hit")).select("doc_id", "words", "hit.at", "hit.hash")
        met = hits.join(F.broadcast(places) if places.count() <= 2 * BLOCK else places, "hash")
        found = _cut(met, F.col("at") - F.col("place")) if found is None else found.unionByName(_cut(met, F.col("at") - F.col("place")))
    short = own.filter(F.col("n") < SHINGLE).select("n", "words").distinct()
    for n in range(1, SHINGLE):  # an item of fewer words is one shingle; its windows are its own copies
        if not (few := short.filter(F.col("n") == n)).isEmpty():
            text = few.select(F.array_join("words", " ").alias("text"))
            part = cut.filter(F.size("words") >= n).select("doc_id", F.posexplode(_runs(n)).alias("start", "text"))
            part = part.join(text, "text", "left_semi").select("doc_id", "start", F.lit(n).alias("n"), "text").distinct()
            found = part if found is None else found.unionByName(part)
    return common.materialize(found, "windows")


def _marked(table: Column, slots: int):
    """Whether both halves of a position's hash are marked in the filter."""

    def one(h: Column, shift: int) -> Column:
        at = F.shiftright(h, shift).bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")
        byte = F.ascii(F.substring(table, F.shiftright(at, 2) + 1, F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(3))).bitwiseAND(F.lit(1)) == 1

    return lambda x: one(x["hash"], 0) & one(x["hash"], 32)


def _runs(n: int) -> Column:
    """Every n words in a row, as text."""
    return F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.concat_ws(" ", *(F.get("words", i + k) for k in range(n))))


def _cut(met: DataFrame, start: Column) -> DataFrame:
    first = F.greatest(F.lit(0), F.least(start, F.size("words") - F.col("n")))
    return met.select("doc_id", first.alias("start"), "n", F.array_join(F.slice("words", first + 1, F.col("n")), " ").alias("text")).distinct()


def candidates(texts: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(n, text, item_id) of the windows (n, text, fp) and items (item_id, n, item_fp) of one size whose
    fingerprints differ by ``radius`` bits or fewer; written."""
    far = radius // BLOCKS
    listed = prints.select("*", F.explode(block_values(F.col("item_fp"), max(0, far - 1))).alias("b")).select("*", "b.block", "b.value").drop("b")
    probes = texts.select("*", F.explode(block_values(F.col("fp"), min(1, far))).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    listed = listed.hint("merge")  # thousands of rows an item, which Spark's estimate doesn't know
    return common.materialize(probes.join(listed, ["n", "block", "value"]).filter(near).select("n", "text", "item_id").distinct(), "candidates")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document and item."""
    own = items(benchmark)
    n_shingles = own.agg(F.sum(F.size("hashes"))).first()[0] or 0
    if not n_shingles:
        return docs.select("doc_id").limit(0).select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("similarity", "double"), ("start", "int"), ("n_words", "int"))))
    cut = windows(docs, own, n_shingles)
    texts = cut.select("n", "text").distinct().select("n", "text", kept(F.split("text", " ")).alias("words"))
    texts = common.materialize(texts.select("n", "text", "words", simhash(shingles(F.col("words"), key)).alias("fp")), "window-texts")
    prints = common.materialize(own.select("item_id", "n", simhash(F.col("hashes")).alias("item_fp")), "item-prints")
    pairs = candidates(texts.select("n", "text", "fp"), prints, radius)
    weigh = lambda df, *by: df.select(*by, F.explode(shingles(F.col("words"), joined)).alias("shingle")).groupBy(*by, "shingle").agg(F.count("*").alias("weight"))
    left = weigh(texts.join(pairs.select("n", "text").distinct(), ["n", "text"], "left_semi"), "n", "text")
    right = weigh(own.join(pairs.select("item_id").distinct(), "item_id", "left_semi"), "item_id").withColumnRenamed("weight", "item_weight")
    shared = pairs.join(left, ["n", "text"]).join(right, ["item_id", "shingle"]).groupBy("n", "text", "item_id").agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    sizes = own.select("item_id", F.size("hashes").alias("item_total"))
    total = F.greatest(F.size(F.split("text", " ")) - SHINGLE + 1, F.lit(1))
    scored = shared.join(sizes, "item_id").withColumn("similarity", F.col("shared") / (total + F.col("item_total") - F.col("shared")))
    good = common.materialize(scored.filter(F.col("similarity") >= similarity).select("n", "text", "item_id", "similarity"), "matches")
    best = cut.join(good, ["n", "text"]).withColumnRenamed("n", "n_words").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.s")).alias("start"), "m.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that hold no item of the benchmark."""
    own = common.numbered(docs)
    found = matches(own.select(F.col("_row").alias("doc_id"), "text"), benchmark)
    return common.without(own, common.materialize(found.select(F.col("doc_id").alias("_row")).distinct(), "leaks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same matches without fingerprints: every window that shares a shingle with an item of its
#: size, compared as it is; an item of fewer than five words is found where it stands as it is.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 1),
ds AS (SELECT doc_id, len(w) AS size, unnest(range(len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
s AS (SELECT item_id, n, unnest(range(n - 4)) AS place, unnest(list_transform(range(1, n - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE n >= 5),
win AS (SELECT DISTINCT doc_id, n, greatest(0, least(pos - place, size - n)) AS start FROM ds JOIN (SELECT DISTINCT s, n, place FROM s) USING (s)),
ws AS (SELECT doc_id, n, start, x.s, count(*) AS c FROM win JOIN d USING (doc_id), LATERAL (SELECT unnest(list_transform(range(start + 1, greatest(start + 2, least(start + n, len(w)) - 3)), lambda k: array_to_string(w[k:least(k + 4, start + n)], ' '))) AS s) x GROUP BY ALL),
wt AS (SELECT doc_id, n, start, sum(c) AS total FROM ws GROUP BY ALL),
si AS (SELECT item_id, n, s, count(*) AS c FROM s GROUP BY ALL),
p AS (SELECT ws.doc_id, ws.n, ws.start, si.item_id, sum(least(ws.c, si.c)) AS shared FROM ws JOIN si ON si.s = ws.s AND si.n = ws.n GROUP BY ALL),
r AS (SELECT doc_id, item_id, CAST(shared AS DOUBLE) / CAST(total + n - 4 - shared AS DOUBLE) AS similarity, start, n FROM p JOIN wt USING (doc_id, n, start)),
sh AS (SELECT doc_id, item_id, 1.0::DOUBLE AS similarity, start, n FROM (SELECT doc_id, w, unnest(range(len(w))) AS start FROM d) JOIN (SELECT item_id, n, w AS iw FROM i WHERE n < 5) ON iw[1] = w[start + 1] AND w[start + 1:start + n] = iw)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, (similarity, -start)) AS INTEGER) AS start, CAST(any_value(n) AS INTEGER) AS n_words
FROM (SELECT * FROM r UNION ALL SELECT * FROM sh) WHERE similarity >= 0.8 GROUP BY 1, 2
"""
