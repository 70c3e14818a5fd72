"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Sizes are summed by source and bucket of a hash; the running sums give the bucket in which a source's
budget ends; only that bucket is split by the hash's next bits, and again, so the threshold is known to
a document or so without sorting any. A document is in if its hash is below its source's threshold.
Thresholds nest: a larger budget takes all that a smaller one takes. A budget of more than a source has
takes all of it and a second copy below the threshold for the rest.

A null text or one without words has size 0. A null source is a source of its own, after the others.
Whole texts are read, however long. Documents with the same doc_id and text share a hash and go together;
so do those with a null doc_id and the same text, and then a source's words may miss its target by theirs.
Empty tables and sources without words take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, count_words, materialize, pick

#: Bits of the hash that each histogram adds, and how often the boundary bucket is refined.
_BITS, _LEVELS = 10, 3
_SALTS = 64


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in order of their names' code points, null last, have the weights in turn. share times all
    sizes are dealt by weight; a target stops at cap times its source's size and the excess is dealt
    again, which comes to min(cap * size, level * weight) with the level at which the sum is right.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))).withColumn("limit", cap * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.col("rest"))
    # sources fill up in order of limit / weight; the first that doesn't gives the level
    s = s.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))).over(whole)["level"]
    return s.select("source", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _with_sources(docs: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """docs with table's columns by source: by broadcast if table is counted to be small, else salted by shuffle."""
    t = table.withColumnRenamed("source", "of")
    if rows <= BROADCAST_ROWS // 5:
        return docs.join(F.broadcast(t), _same(docs["source"], t["of"])).drop("of")
    t = t.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    d = docs.withColumn("salt", F.pmod(F.col("hash"), F.lit(_SALTS)))
    return d.join(t, _same(d["source"], t["of"]) & (d["salt"] == t["salt_of"])).drop("of", "salt", "salt_of")


def thresholds(sized: DataFrame, goals: DataFrame, sources: int) -> DataFrame:
    """(source, copies, below): all documents ``copies`` times, and once more those with hash < below.

    sized: (source, size, hash), hash from 0 below 2**(bits * levels). goals: (source, source_size, target).
    """
    state = goals.select("source", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long").alias("copies"), "source_size", "target")
    state = state.select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for level in range(_LEVELS):
        down = _BITS * (_LEVELS - 1 - level)
        own = _with_sources(sized, state.select("source", "prefix"), sources)
        own = own.where(F.shiftright("hash", down + _BITS) == F.col("prefix"))
        bars = own.groupBy("source", F.shiftright("hash", down).alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        bars = bars.withColumn("upto", run)
        joined = state.join(bars.withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of")), "left")
        under = F.col("upto") <= F.col("budget")
        found = joined.groupBy("source", "copies", "budget", "prefix").agg(
            F.coalesce(F.max(F.when(under, F.col("upto"))), F.lit(0)).alias("taken"),
            F.min(F.when(~under, F.col("bucket"))).alias("edge"),
            F.min(F.when(~under, F.struct("bucket", "size")))["size"].alias("edge_size"),
        )
        # no bar is over the budget: the threshold lies behind the last one
        edge = F.coalesce(F.col("edge"), F.shiftleft(F.col("prefix") + 1, _BITS))
        left = F.col("budget") - F.col("taken")
        if level == _LEVELS - 1:
            edge = edge + F.when(F.col("edge_size") < 2 * left, 1).otherwise(0)  # the nearer side of the last bucket
        state = materialize(found.select("source", "copies", left.alias("budget"), edge.cast("long").alias("prefix")), "edges")
    return state.select("source", "copies", F.col("prefix").alias("below"))


def doc_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """The first _BITS * _LEVELS bits of the MD5 sum of seed, id and text, which other engines can compute too; null and empty texts are alike."""
    said = F.concat_ws("\n", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long"), 32 - _BITS * _LEVELS)


def _plan(sized: DataFrame, **weights) -> tuple[DataFrame, int]:
    """sized: (source, size, hash), written out. The table of sources, and how many there are."""
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    sources = sizes.count()
    goals = materialize(targets(sizes, **weights), "targets")
    cuts = thresholds(sized, goals, sources)
    table = goals.join(cuts.withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of"))).drop("of")
    return materialize(table, "mix"), sources


def _copies() -> Column:
    return F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)


def mix_report(docs: DataFrame, *, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **weights) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every document. Texts are read once."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = materialize(rows.select("doc_id", "source", count_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")), "sized")
    table, sources = _plan(sized.select("source", "size", "hash"), **weights)
    out = _with_sources(sized, table, sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), _copies().alias("copies"), "source")


def mix(docs: DataFrame, *, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **weights) -> DataFrame:
    """The rows of the mix with all their columns, repeated as often as they are taken."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    h = doc_hash(F.col("doc_id"), F.col("text"), seed)
    sized = materialize(rows.select("source", count_words(F.col("text")).alias("size"), h.alias("hash")), "sized")
    table, sources = _plan(sized, **weights)
    n = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    at = {c: f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col)}
    keyed = plain.withColumn("source", F.col(at[source_col])).withColumn("hash", doc_hash(F.col(at[id_col]), F.col(at[text_col]), seed))
    taken = _with_sources(keyed, table.drop("source_size", "target"), sources)
    taken = taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))))
    return taken.select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
