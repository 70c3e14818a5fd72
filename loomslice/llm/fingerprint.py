"""Homomorphic multiset hash of a text's paragraphs, by built-in expressions only.

A paragraph (a ``\\n``-separated line that isn't empty) hashes to 120 lanes of 10 bits; a text's
fingerprint is their sum, each lane modulo 2**20, and the number of paragraphs modulo 2**40. Order
doesn't matter, equal multisets have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its lanes. As lanes are near-independent random weights, the inner product of two
centred fingerprints estimates the paragraphs in common, which gives a likeness from 0 to 1.

Six lanes share two longs, three to a long, each with a guard bit above it that is masked off, so that
sums never carry from lane to lane nor overflow.

A null text counts as empty, an empty one has no paragraphs and the zero fingerprint. The whole text is
read, however long. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import let, materialize, pick

LONGS = 40
_BITS = 20
_LANES = sum(((1 << _BITS) - 1) << k for k in (0, 21, 42))
_GUARDS = sum(1 << (_BITS + k) for k in (0, 21, 42))
_VALUES = sum(1023 << k for k in (0, 21, 42))
_COUNT = (1 << 40) - 1


def paragraphs(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "\n"), "")


def _mix(item: Column, k: Column) -> Column:
    """The k-th long of a paragraph's lanes, drawn from the paragraph itself: each pair of longs has a seed of its own."""
    own = F.xxhash64(F.shiftright(k, 1), item)
    return F.when(k % 2 == 0, own).otherwise(F.shiftrightunsigned(own, 10)).bitwiseAND(_VALUES)


def multiset_hash(items: Column) -> Column:
    """Array of strings to the fingerprint: LONGS longs and the count."""

    def lanes(b: Column) -> Column:
        one = lambda k: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: (acc + _mix(x, k)).bitwiseAND(_LANES))
        return F.concat(F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), one), F.array(F.size(b).cast("long")))

    return let(items, lanes)


def fingerprint(text: Column) -> Column:
    return multiset_hash(paragraphs(text))


def insert(fp: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.concat(
        F.zip_with(F.slice(fp, 1, LONGS), F.slice(other, 1, LONGS), lambda a, b: (a + b).bitwiseAND(_LANES)),
        F.array((fp[LONGS] + other[LONGS]).bitwiseAND(_COUNT)),
    )


def delete(fp: Column, other: Column) -> Column:
    """The fingerprint of fp's multiset without other's."""
    return F.concat(
        F.zip_with(F.slice(fp, 1, LONGS), F.slice(other, 1, LONGS), lambda a, b: (a.bitwiseOR(_GUARDS) - b).bitwiseAND(_LANES)),
        F.array((fp[LONGS] - other[LONGS]).bitwiseAND(_COUNT)),
    )


def to_hex(fp: Column) -> Column:
    """LONGS numbers of 16 digits and the count of 10."""
    lanes = F.array_join(F.transform(F.slice(fp, 1, LONGS), lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.lower(F.concat(lanes, F.lpad(F.hex(fp[LONGS]), 10, "0")))


def likeness(a: Column, b: Column) -> Column:
    """2<a,b> / (|a|^2 + |b|^2) over centred lanes, within 0 to 1; equal fingerprints give 1."""
    sums = F.zip_with(F.slice(a, 1, LONGS), F.slice(b, 1, LONGS), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def lane(v: Column, n: Column, k: int) -> Column:
        # twice the lane less its mean, as a number around zero
        wide = 2 * F.shiftrightunsigned(v, k).bitwiseAND((1 << _BITS) - 1) - 1023 * n
        half = 1 << _BITS
        return F.pmod(wide + half, F.lit(2 * half)) - half

    def step(acc: Column, s: Column) -> Column:
        xs, ys = [lane(s["x"], a[LONGS], k) for k in (0, 21, 42)], [lane(s["y"], b[LONGS], k) for k in (0, 21, 42)]
        dot = sum((x * y for x, y in zip(xs, ys)), F.lit(0))
        own = sum((x * x + y * y for x, y in zip(xs, ys)), F.lit(0))
        return F.struct((acc["dot"] + dot).cast("double").alias("dot"), (acc["own"] + own).cast("double").alias("own"))

    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("own"))
    score = F.aggregate(sums, zero, step, lambda r: F.when(r["own"] > 0, 2 * r["dot"] / r["own"]).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def next_keys(ids: DataFrame, key: str, chunks: int) -> DataFrame:
    """(key, next): each distinct key's follower, the last one's being the first; ``ids`` is narrow and written out.

    Ranges of keys are cut, followers are found within each, and a table of one row a range joins them.
    """
    cut = ids.select(key).distinct().repartitionByRange(chunks, key).withColumn("part", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    w = Window.partitionBy("part").orderBy(key)
    inner = cut.withColumn("next", F.lead(key).over(w))
    firsts = cut.groupBy("part").agg(F.min(key).alias("first"))
    # a row per range: their number is a parameter, not the input's size
    ends = Window.orderBy("part")
    after = firsts.select("part", F.lead("first").over(ends).alias("after"), F.min("first").over(Window.partitionBy(F.lit(0))).alias("least"))
    joined = inner.join(F.broadcast(after), "part")
    return joined.select(key, F.coalesce("next", "after", "least").alias("next"))


def edit_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by as many first ones
    of the next document, in ascending order of id, the first following the last. Rows with a null id come
    before the others; rows that share an id all have the next id's row with the least text as their next.
    """
    spark = docs.sparkSession
    low = F.lit(-(1 << 63)).cast("long")
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), low).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = materialize(rows.groupBy("key").agg((F.max(F.length("text")) / 4).cast("long").alias("need")), "sizes")
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    follow = next_keys(sizes, "key", chunks)
    follow = materialize(follow.join(sizes, "key").select(F.col("key").alias("for"), F.col("next"), "need"), "next")
    hashed = rows.withColumn("fp", fingerprint(F.col("text")))
    # Texts are shuffled by key once: both joins read the same exchange, as they need the same columns. What
    # followers lend is a quarter of the texts.
    lent = hashed.select("key", "doc_id", "text", "fp").join(follow, F.col("key") == F.col("next"))
    lent = lent.groupBy("for").agg(F.min(F.struct(F.expr("substring(text, 1, need)").alias("head"), "fp", "doc_id")).alias("lent"))
    both = hashed.select("key", "doc_id", "text", "fp").join(lent, F.col("key") == F.col("for"), "left")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    head = F.expr("substring(lent.head, 1, cast(floor(length(text) / 4) as int))")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.when(cut > 0, head).otherwise("")))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited")).alias("edited_fp"), F.col("lent.fp").alias("next_fp"), F.col("lent.doc_id").alias("next_id"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.col("fp")[LONGS].alias("n_paragraphs"), "next_id",
    )
