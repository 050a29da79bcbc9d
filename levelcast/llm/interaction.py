"""How five document filters interact: for every order of the filters, what each one removes.

The filters: A, under ``LEAST_WORDS`` words; B, under half of the words distinct; C, over 3 % capitals A-Z; D, a mark
of ``MARKS``; E, the text of a smaller id. Words are maximal runs without the six ASCII white space characters.

A to D are expressions on the text. E comes by partition refinement: documents are split by code-point length, the classes
by hashes of successive blocks of the texts (each sixteen times as long as the one before), and a class of one document
is dropped as soon as it appears, so that most documents leave after a round or two. The surviving texts are compared in full
and all but the smallest id of equal ones are marked.

After that a document is its part and a mask of five bits. Counts by part and mask answer every order: a filter at a step removes the masks that have
its bit and none of the earlier ones, so eighty (set of earlier filters, filter) pairs a part are summed and the 600 steps look them up.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
LEAST_WORDS = 200
MARKS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points of the first block, growth of the blocks, and their number: the last one ends beyond the longest possible string.
FIRST, GROWTH, BLOCKS = 64, 16, 8
_BLOCK_NAMES = [f"b{k}" for k in range(BLOCKS)]
_E = 1 << FILTERS.index("E")


def block_bounds(k: int) -> tuple[int, int]:
    """Start and length of a text's k-th block, in code points."""
    start = 0 if k == 0 else FIRST * sum(GROWTH**i for i in range(k))
    return start, min(FIRST * GROWTH**k, 2**31 - 2 - start)


def block_hash(text: Column, k: int) -> Column:
    """Hash of the k-th block; null where the text ends before it."""
    start, size = block_bounds(k)
    return F.when(F.char_length(text) > start, F.xxhash64(F.substring(text, start + 1, size)))


def refined(key: Column, block: Column) -> Column:
    """The class after a block: unchanged where the text has ended."""
    return F.when(block.isNull(), key).otherwise(F.xxhash64(key, block))


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and mask (bits of A to D) of every row; null texts and languages are empty strings."""
    common.missing_columns(docs, "doc_id", "text", "lang")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("lang").alias("part"), filled("text").alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    length, words = F.char_length("text"), F.size("words")
    capitals = length - F.char_length(F.translate("text", CAPITALS, ""))
    fails = [words < LEAST_WORDS, 100 * F.size(F.array_distinct("words")) < 50 * words, 100 * capitals > 3 * length, F.translate("text", MARKS, "") != F.col("text")]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", "text", mask.alias("mask"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, length in code points and block hashes of every row."""
    return masked(docs).select("doc_id", "part", "mask", F.char_length("text").alias("length"), *[block_hash(F.col("text"), k).alias(b) for k, b in enumerate(_BLOCK_NAMES)])


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, part and mask of the ``rows`` (``measured`` of ``docs``, staged) whose text a smaller id has.

    Rows without an id, and repeated rows of one id, have no smaller id by themselves and are not marked for each other.
    """
    left, key, used = rows.withColumn("key", F.xxhash64("length")), F.xxhash64(F.char_length("text")), 0
    while True:
        # rows that are alone in their class leave
        sizes = common.staged(left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("longest")).filter("rows > 1"), "audit-classes")
        left = common.staged(common.keyed_join(left, sizes.drop("longest"), ["key"], "rows", "left_semi"), "audit-left")
        longest = sizes.agg(F.max("longest")).first()[0]
        if longest is None or used == BLOCKS or longest <= block_bounds(used)[0]:
            break
        left = left.withColumn("key", refined(F.col("key"), F.col(_BLOCK_NAMES[used])))
        key = refined(key, block_hash(F.col("text"), used))
        used += 1
    # the whole texts of the classes that are left; equal ones are combined before they are sent
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = common.keyed_join(texts.withColumn("key", key), sizes.drop("longest"), ["key"], "rows", "left_semi")
    same = common.staged(texts.groupBy("key", "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "audit-texts")
    classes = common.staged(same.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("rows").alias("rows")), "audit-same")
    pure = classes.filter("texts = 1 AND rows > 1").drop("texts")
    found = common.keyed_join(left.select("doc_id", "part", "mask", "key"), pure, ["key"], "rows").filter("doc_id > first").select("doc_id", "part", "mask")
    mixed = common.staged(classes.filter("texts > 1").select("key", "rows"), "audit-mixed")
    if not mixed.isEmpty():
        # hashes of different texts met: here rows are told apart by the texts themselves
        own = common.keyed_join(masked(docs).withColumn("key", key), mixed, ["key"], "rows", "left_semi")
        found = found.unionByName(own.join(same.select("key", "text", "first"), ["key", "text"]).filter("doc_id > first").select("doc_id", "part", "mask"))
    return found


def tallied(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic, of each part and mask of five bits.

    A document with several label rows is good, or toxic, if one of them says so.
    """
    rows = common.staged(measured(docs), "audit-rows")
    alike = duplicates(docs, rows)
    counted = rows.select("doc_id", "part", "mask", F.lit(1).alias("w"))
    moved = alike.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("w")), F.struct((F.col("mask") + _E).alias("mask"), F.lit(1).alias("w")))).alias("m"))
    counted = counted.unionByName(moved.select("doc_id", "part", "m.mask", "m.w")).groupBy("doc_id", "part", "mask").agg(F.sum("w").alias("w"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id have no label, and are not sent to where null keys meet
    joined = counted.filter("doc_id IS NOT NULL").join(told, "doc_id", "left").unionByName(counted.filter("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    of = lambda c: F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return joined.groupBy("part", "mask").agg(F.sum("w").alias("n"), of("good"), of("toxic")).filter("n > 0")


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the earlier filters, number of the filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, before, f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language), filter_order and step, zeros included.

    kept: documents left after the step; removed: by it; redundant: failing its filter but gone before;
    unique_fails: failing its filter only; good_lost and toxic_lost: removed documents labelled so; shapley: what its filter removes,
    summed over all orders. Null texts are empty, null languages the part of the empty string, whole texts of any length are read; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    tally = tallied(docs, labels)
    pairs = [(before, f) for f in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> f & 1]
    wide = tally.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("f")) for b, f in pairs])))
    wide = wide.select("part", "mask", "n", "good", "toxic", "pair.before", "pair.f").withColumn("bit", F.expr("shiftleft(1, f)"))
    fails, reached = (F.col("mask").bitwiseAND(F.col("bit")) != 0), (F.col("mask").bitwiseAND(F.col("before")) == 0)
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    orders = len(list(permutations(FILTERS)))
    # of a document's failed filters each one comes first in an equal share of the orders
    first = F.sum(F.when(fails, F.col("n") * F.expr(f"{orders} div bit_count(mask)")).otherwise(0)).cast("long")
    sums = wide.groupBy("part", "before", "f").agg(
        total("n", ~fails & reached).alias("kept"), total("n", fails & reached).alias("removed"), total("n", fails & ~reached).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", fails & reached).alias("good_lost"), total("toxic", fails & reached).alias("toxic_lost"), first.alias("shapley"),
    )
    table = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, before int, f int")
    out = sums.join(F.broadcast(table), ["before", "f"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
