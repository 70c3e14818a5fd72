"""SimHash near-duplicates by pigeonhole blocks.

A text's shingles are hashed; a fingerprint bit is 1 if it is set in over half of the hashes. Equal
fingerprints collapse to one representative, the least id. Fingerprints split into blocks so that close
ones share some; representatives join on blocks, and Hamming distance verifies what the join brings up.

* Exact: with a fingerprint of 64 bits in k + 3 blocks, two that differ in k bits or fewer agree on at
  least three, so joining on all triples of blocks finds every pair.
* Wide: 768 bits over a text's distinct shingles. A link is what has a Jaccard similarity of 0.8 or more by
  the sets of shingles themselves, compared as 64-bit hashes. Candidates share one of 32 bands of 6 minima of
  the set under 192 hash functions: by estimate 9999 in 10000 pairs at 0.8 do, and nearly no unlike ones.

Blocks that many representatives share aren't joined. In exact mode their members are grouped by every
value within one bit of them: two fingerprints share such a value just if they differ in two bits or
fewer, and no value has over 65 members. In wide mode a block's members are compared with its least, and
those that this doesn't connect with all others: as pairs in small blocks, in large ones in tiles, each of
which gives a spanning forest. Either finds all links without a large group's pairs ever being rows. Links
then become components by star contraction, in written tables; nothing is collected to the driver.

Null and empty texts and ones without words have fingerprint zero, which links like any other. With fewer
words than a shingle has, all words are one shingle. Rows with a null id get a fingerprint, and the
component of the rows with ids that share it (else null). Repeated rows repeat. An empty table gives none.
Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, materialize, pick, tidy

#: Shingles whose bits are unpacked at a time.
_CHUNK = 1 << 15
#: Members of a block up to which it is joined in exact mode.
_JOINED = 128
#: The same in wide mode, where pairs are rows with their shingles: at most some times the members.
_PAIRED = 16
#: Members compared at a time in a wide block.
_TILE = 256
_ODD = 0x9E3779B97F4A7C15
#: Bands of the wide mode, and minima in each.
_BANDS, _MINIMA = 32, 6
#: Jaccard similarity from which texts are near-duplicates in wide mode, as a fraction.
_SIMILAR = (4, 5)
#: Share of differing bits up to which candidates of the wide mode are compared exactly; 0.19 is the most to be expected of similar sets, small ones included.
_SIEVE = 0.3


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(size)])))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash from a hash; lane 0 is the hash itself."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(_ODD * lane & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of all shingles, repeats included."""
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join([xxh64_digest(g, 42) for g in shingles(text, size)]), ">u8").astype("u8")


def bits_of(h: np.ndarray, lanes: int) -> list[int]:
    """The fingerprint of hashes: its lanes of 64 bits, as signed integers."""
    ones = np.zeros((lanes, 64), np.int64)
    for i in range(0, len(h), _CHUNK):
        for k in range(lanes):
            bits = np.unpackbits(_mixed(h[i : i + _CHUNK], k).astype(">u8").view("u1")).reshape(-1, 64)
            ones[k] += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), axis=1).view(">i8").ravel().tolist()


def simhash(text: bytes, size: int, lanes: int = 1) -> list[int]:
    """The fingerprint's lanes. One lane counts shingles as often as they occur, more count each once."""
    h = shingle_hashes(text, size)
    return bits_of(h if lanes == 1 else np.unique(h), lanes)


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions, and the factors that fold a band's minima to a key."""
    z = _mixed(np.arange(1, 2 * _BANDS * _MINIMA + _MINIMA + 1, dtype="u8"), 1)
    n = _BANDS * _MINIMA
    return z[:n] | np.uint64(1), z[n : 2 * n], z[2 * n :] | np.uint64(1)


_FACTOR, _SUMMAND, _FOLD = _functions()


def band_keys(h: np.ndarray) -> list[int]:
    """A key per band, which two sets share as often as their minima there agree; none for an empty set."""
    if not len(h):
        return []
    least = np.full(len(_FACTOR), 0xFFFFFFFFFFFFFFFF, "u8")
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 512):
            least = np.minimum(least, (h[i : i + 512, None] * _FACTOR + _SUMMAND).min(0))
        return _mixed((_mixed(least.reshape(_BANDS, _MINIMA), 2) * _FOLD).sum(1, dtype="u8"), 1).view("i8").tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as ascending arrays, have a Jaccard similarity of _SIMILAR or more."""
    part, whole = _SIMILAR
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * whole >= (len(a) + len(b) - common) * part


def fingerprints(docs: DataFrame, *, shingle_words: int, lanes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and l0, l1, ... for every row."""
    names = [f"l{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = np.array([simhash(t or b"", shingle_words, lanes) for t in part.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, lanes)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(rows[:, k]) for k in range(lanes)]], ["doc_id", *names])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _banded(rows: DataFrame, *, shingle_words: int, lanes: int) -> DataFrame:
    """row, l0, l1, ... and the keys of the bands for every row."""
    names = [f"l{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                bits, keys = [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    h = np.unique(shingle_hashes(t or b"", shingle_words))
                    bits.append(bits_of(h, lanes))
                    keys.append(band_keys(h))
                bits = np.array(bits, np.int64).reshape(-1, lanes)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(bits[:, k]) for k in range(lanes)], pa.array(keys, pa.list_(pa.int64()))], ["row", *names, "keys"])

    return rows.select("row", "text").mapInArrow(tidy(run), "row long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>")


def distance(a: str, b: str, lanes: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.l{k}").bitwiseXOR(F.col(f"{b}.l{k}"))) for k in range(lanes)])


def _masks(blocks: int, agree: int) -> list[int]:
    """Masks of all ways to choose ``agree`` of ``blocks`` blocks of 64 bits, as signed integers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def exact_keys(max_distance: int) -> Column:
    masks = _masks(max_distance + 3, 3)
    return F.array(*[F.struct(F.lit(i).alias("kid"), F.col("l0").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])


def _near_values(hot: DataFrame) -> DataFrame:
    """Links among fingerprints at most two bits apart, without pairs: by shared values within one bit."""
    flips = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    values = F.array(*[F.col("l0").bitwiseXOR(F.lit(f).cast("long")) for f in flips])
    groups = hot.select("rep", F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_list("rep")).alias("reps"))  # 65 at most
    stars = groups.where(F.size("reps") > 1).select(F.col("reps")[0].alias("a"), F.explode(F.slice("reps", 2, 64)).alias("b"))
    return stars.distinct()


class _Forest:
    """Which numbers are connected."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = self.top
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.top[max(x, y)] = min(x, y)


def _shingle_sets(rows: DataFrame, wanted: DataFrame, shingle_words: int, lanes: int) -> DataFrame:
    """rep, the fingerprint's lanes, and the distinct shingles' hashes in ascending order, for the rows wanted."""
    names = [f"l{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                grams = [np.unique(shingle_hashes(t or b"", shingle_words)).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in ["rep", *names]], pa.array(grams, pa.binary())], ["rep", *names, "grams"])

    texts = rows.select(F.col("row").alias("rep"), "text").join(wanted.select("rep", *names), "rep").select("rep", *names, "text")
    return materialize(texts.mapInArrow(tidy(run), "rep long, " + ", ".join(f"{n} long" for n in names) + ", grams binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, lanes: int, max_distance: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                both = zip(part.column("ga"), part.column("gb"))  # views, not copies, of the sets
                hit = pa.array([similar(np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")) for x, y in both], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(hit), part.column("b").filter(hit)], ["a", "b"])

    bits = F.struct(*[f"l{k}" for k in range(lanes)])
    found = pairs.join(sets.select(F.col("rep").alias("a"), bits.alias("x"), F.col("grams").alias("ga")), "a")
    found = found.join(sets.select(F.col("rep").alias("b"), bits.alias("y"), F.col("grams").alias("gb")), "b")
    return found.where(distance("x", "y", lanes) <= max_distance).select("a", "b", "ga", "gb").mapInArrow(tidy(run), "a long, b long")


def _tiled(both: DataFrame, sets: DataFrame, lanes: int, max_distance: int) -> DataFrame:
    """Links of blocks' odd members with all members, by tiles of both."""
    cols = [f"l{k}" for k in range(lanes)]
    tiles = lambda n: F.ceil(F.col(n) / _TILE).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), tiles(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    left = both.where("odd").select("kid", "key", "rep", "comp", F.lit(True).alias("odd_side"), own("n_odd", 1).alias("i"), every("n").alias("j"))
    right = both.select("kid", "key", "rep", "comp", F.lit(False).alias("odd_side"), every("n_odd").alias("i"), own("n", 2).alias("j"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        side = g["odd_side"].to_numpy(bool)
        bits, ids, comps = g[cols].to_numpy(np.int64), g["rep"].to_numpy(np.int64), g["comp"].to_numpy(np.int64)
        grams = [np.frombuffer(x, "u8") for x in g["grams"]]
        others = np.flatnonzero(~side)
        joined, edges = _Forest(), []
        for at in np.flatnonzero(side):
            d = np.bitwise_count((bits[others] ^ bits[at]).view(np.uint64)).sum(1)
            for to in others[(d <= max_distance) & (comps[others] != comps[at])]:
                x, y = int(comps[at]), int(comps[to])
                if joined.root(x) != joined.root(y) and similar(grams[at], grams[to]):
                    joined.join(x, y)
                    edges.append((min(ids[at], ids[to]), max(ids[at], ids[to])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return left.unionByName(right).join(sets, "rep").groupBy("kid", "key", "i", "j").applyInPandas(compare, "a long, b long")


def similar_links(rows: DataFrame, reps: DataFrame, keys: Column, *, shingle_words: int, lanes: int, max_distance: int) -> DataFrame:
    """(a, b) with a < b: enough links between representatives to connect all that are similar and share a block."""
    every = reps.select("rep", F.inline(keys))
    blocks = materialize(every.groupBy("kid", "key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "blocks")
    members = materialize(every.join(blocks, ["kid", "key"]), "members")
    sets = _shingle_sets(rows, reps.join(members.select("rep").distinct(), "rep", "left_semi"), shingle_words, lanes)
    stars = members.where("rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    near = materialize(_verified(stars, sets, lanes, max_distance), "stars")
    # what stars have connected needs no other links
    named = components(near).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    at = materialize(members.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "placed")
    pivots = at.where("rep = pivot").select("kid", "key", F.col("comp").alias("own"))
    at = at.join(pivots, ["kid", "key"]).withColumn("odd", F.col("comp") != F.col("own"))
    odd = materialize(at.groupBy("kid", "key").agg(F.count_if("odd").alias("n_odd")).where("n_odd > 0"), "odd")
    both = materialize(at.join(odd, ["kid", "key"]).select("kid", "key", "rep", "n", "comp", "odd", "n_odd"), "both")
    calm = both.where(F.col("n") <= _PAIRED)
    on = (F.col("a.kid") == F.col("b.kid")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp"))
    pairs = calm.where("odd").alias("a").join(calm.alias("b"), on).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    more = _verified(pairs, sets, lanes, max_distance).unionByName(_tiled(both.where(F.col("n") > _PAIRED), sets, lanes, max_distance))
    return materialize(near.unionByName(more).distinct(), "links")


def links(reps: DataFrame, keys: Column, max_distance: int) -> DataFrame:
    """(a, b) with a < b: enough links between representatives (rep, l0) to connect all that are close and share a block."""
    if max_distance < 2:
        raise ValueError("a maximum distance under 2 isn't provided for")
    rows = reps.select("rep", "l0", F.inline(keys))
    crowded = materialize(rows.groupBy("kid", "key").agg(F.count("*").alias("n")).where(F.col("n") > _JOINED).drop("n"), "crowded") if max_distance == 2 else None
    n = crowded.count() if crowded is not None else 0
    calm = rows
    if n:
        small = broadcast_if_small(crowded, n)
        calm = rows.join(small, ["kid", "key"], "left_anti")
    on = (F.col("a.kid") == F.col("b.kid")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep"))
    pairs = calm.alias("a").join(calm.alias("b"), on & (distance("a", "b", 1) <= max_distance)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    if n:
        hot = rows.join(small, ["kid", "key"], "left_semi")
        pairs = pairs.unionByName(_near_values(hot.select("rep", "l0").distinct()))
    return materialize(pairs, "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node reachable, by alternating stars.

    Each round halves paths at least; a round's tables are written, and rounds end when one changes nothing.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def similar_rows(rows: DataFrame, *, shingle_words: int, lanes: int, max_distance: int | None = None) -> DataFrame:
    """row, l0 .., component (the least row of it) by the wide mode, for rows of a written table (row, text)."""
    if max_distance is None:
        max_distance = round(64 * lanes * _SIEVE)
    cols = [f"l{k}" for k in range(lanes)]
    prints = materialize(_banded(rows, shingle_words=shingle_words, lanes=lanes), "fingerprints")
    reps = materialize(prints.groupBy(*cols).agg(F.min("row").alias("rep"), F.min_by("keys", "row").alias("keys")), "representatives")
    keys = F.transform("keys", lambda key, i: F.struct(i.alias("kid"), key.alias("key")))
    found = components(similar_links(rows, reps, keys, shingle_words=shingle_words, lanes=lanes, max_distance=max_distance))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select(*cols, F.coalesce("component", "rep").alias("component")), "named")
    return prints.join(named, cols).select("row", *cols, "component")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, lanes: int = 12, max_distance: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, l0 .. (the fingerprint's lanes), component_id for every row.

    lanes=1 with max_distance=2 is the exact mode; by default the wide one, where max_distance is how far
    candidates may be apart to be compared exactly.
    """
    cols = [f"l{k}" for k in range(lanes)]
    if lanes > 1:
        rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = similar_rows(rows, shingle_words=shingle_words, lanes=lanes, max_distance=max_distance)
        found = materialize(found.join(rows.select("row", "doc_id"), "row"), "found")
        named = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return found.join(named, "component").select("doc_id", *cols, "component_id")
    max_distance = 2 if max_distance is None else max_distance
    prints = materialize(fingerprints(docs, shingle_words=shingle_words, lanes=lanes, id_col=id_col, text_col=text_col), "fingerprints")
    reps = materialize(prints.groupBy(*cols).agg(F.min("doc_id").alias("rep")).where("rep is not null"), "representatives")
    found = components(links(reps, exact_keys(max_distance), max_distance))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select(*cols, F.coalesce("component", "rep").alias("component_id")), "named")
    return prints.join(named, cols, "left").select("doc_id", *cols, "component_id")


def hex64(lane: Column) -> Column:
    return F.lower(F.lpad(F.hex(lane), 16, "0"))


def simhash_report(docs: DataFrame, *, shingle_words: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, in exact mode."""
    out = near_duplicates(docs, shingle_words=shingle_words, lanes=1, max_distance=max_distance, id_col=id_col, text_col=text_col)
    return out.select("doc_id", hex64(F.col("l0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle_words: int = 5, lanes: int = 12, max_distance: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns, by the wide mode.

    It is that with the least id; null ids come last, and of rows with equal ids the first one stays. Rows
    are told apart by a number of their own, so a repeated id removes no text that has no like.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = F.col(names[docs.columns.index(id_col)]).cast("long"), F.col(names[docs.columns.index(text_col)])
    full = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = similar_rows(full.select("row", text.alias("text")), shingle_words=shingle_words, lanes=lanes, max_distance=max_distance)
    found = materialize(found.select("row", "component").join(full.select("row", at.alias("doc_id")), "row"), "found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("first"))
    # by rows, which are unique: a component may hold a third of them
    lost = materialize(found.select(F.col("row").alias("lost")).join(first.select(F.col("first").alias("lost")), "lost", "left_anti"), "lost")
    return full.join(broadcast_if_small(lost), full["row"] == F.col("lost"), "left_anti").select(*names).toDF(*docs.columns)
