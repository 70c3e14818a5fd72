"""Quality classifier: cumulative-link (ordered logit) regression on graded ratings.

A text's score is linear in hashed features, with weights that all grades share, and ordered thresholds
part the grades: P(grade <= k) = 1 / (1 + exp(score - threshold_k)). A document gets its expected grade
and the probability of the top grade, which selection goes by. Features are the distinct words (in
lower case, without marks around them) and their beginnings, the shares of word shapes, and coarse counts.

Grades from labels: 0 for low quality, 1 for toxic, 2 for neither; the lowest of a document's labels.
The model is fitted in the driver on at most ``sample`` labelled documents, those with the least hash of
the id; scoring covers all documents and is done within a row, without a shuffle.

Whole texts are graded, however long; what a worker remembers of words is bounded. A null or empty text
has no words and only the coarse counts. Labels that are null or without a document
don't count; without any, the model has no weights and every document gets the top grade. Null ids are
kept, repeated rows repeat, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import kept, materialize, pick, tidy

DIM = 1 << 18
#: Weights from here on are for shapes and coarse counts, those before for words and their beginnings.
_LAST = DIM - (1 << 14)
_MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_RUNS = re.compile(rb"A+|a+|0+|w+|([^Aa0w])\1*")
#: A letter for each byte: upper and lower case, digits, bytes beyond ASCII, and marks as they are.
_SHAPE = bytes(ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 else ord("0") if 48 <= c < 58 else ord("a") if c > 127 else c for c in range(256))
#: Words kept per worker process, some 250 bytes each, and the longest one kept.
_MEMORY, _LONGEST = 80_000, 64


def _bucket(kind: bytes, what: bytes) -> int:
    h = xxh64_intdigest(kind + what)
    return _LAST + h % (DIM - _LAST) if kind in b"sn" else h % _LAST


class _Shapes(dict):
    """Buckets of shapes by the beginning of a word in _SHAPE's letters, of which there are few."""

    def __missing__(self, form: bytes) -> int:
        if len(self) > _MEMORY:
            self.clear()
        out = self[form] = _bucket(b"s", _RUNS.sub(lambda m: m[0][:2], form)[:12])
        return out


_shapes = _Shapes()


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Of its shape, of the word itself, and of its first 3 to 6 characters, which inflected and compound forms share."""
    own = word.strip(_MARKS)
    if own.isascii():
        own = own.lower()
        starts = [own[:n] for n in (3, 4, 5, 6)[: max(0, len(own) - 2)]]
    else:
        text = own.decode("utf-8", "replace").lower()
        own = text.encode("utf-8", "replace")
        starts = [text[:n].encode("utf-8", "replace") for n in (3, 4, 5, 6)[: max(0, len(text) - 2)]]
    return _shapes[word.translate(_SHAPE)[:64]], xxh64_intdigest(b"w" + own) % _LAST, *[xxh64_intdigest(b"%d" % n + x) % _LAST for n, x in enumerate(starts, 3)]


def coarse(n: int, distinct: int) -> int:
    return _bucket(b"n", b"%d %d" % (n.bit_length(), 8 * distinct // n if n else -1))


def split_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space; one of over _LONGEST bytes counts as stretches of 12 characters, so that all of it is graded."""
    words = text.split()
    if not words or len(max(words, key=len)) <= _LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= _LONGEST:
            out.append(w)
        else:
            long = w.decode("utf-8", "replace")
            out += [long[i : i + 12].encode() for i in range(0, len(long), 12)]
    return out


def features(text: bytes, memory: dict) -> tuple[list[int], list[float]]:
    words = split_words(text)
    distinct = set(words)
    out: dict[int, float] = {coarse(len(words), len(distinct)): 1.0}
    for w in distinct:
        for b in (memory.get(w) or memory.setdefault(w, word_buckets(w)))[1:]:
            out[b] = out.get(b, 0.0) + 1.0
    for w in words:
        b = memory[w][0]
        out[b] = out.get(b, 0.0) + 10 / len(words)
    return list(out), list(out.values())


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade or better)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[grade - 1] - score, -50, 50)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return sum(self.tail(score, k) for k in range(1, len(self.thresholds) + 1))


def telling_features(by_grade: np.ndarray, grades: np.ndarray, *, rare: int = 8, telling: float = 0.09, chance: float = 3.5) -> np.ndarray:
    """Which features get a weight, from their rows by grade (grades x DIM) and all rows by grade.

    Words that fewer than ``rare`` rows have get none: they would learn their rows by heart. Nor do those
    whose correlation with every grade is under ``telling``, or could be a chance finding among so many words
    (under ``chance`` standard deviations, which decides where there are few labels).
    """
    total, n = max(1, int(grades.sum())), by_grade.sum(0)
    part = (grades / total)[:, None]
    z = np.abs(by_grade - n * part) / np.sqrt(np.maximum(n * part * (1 - part), 1e-9))
    return (n >= min(rare, total // 10)) & ((z.max(0) >= max(telling * np.sqrt(total), chance)) | (np.arange(DIM) >= _LAST))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, grades: int = 3, rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> OrdinalModel:
    """Adam on the likelihood of (feature indices, values, grade) rows, all at once; grades weigh by the root of their rarity."""
    y = np.array([g for *_, g in rows], int)
    seen = np.bincount(y, minlength=grades) + np.array([0.01] * (grades - 1) + [1.0])
    share = np.cumsum(seen)[:-1] / seen.sum()
    theta, w = np.log(share / (1 - share)), np.zeros(DIM)
    if len(rows) < 2 or len(set(y.tolist())) < 2:
        return OrdinalModel(w, np.minimum(theta, -1.0) if not len(rows) else theta)
    order = [len(i) for i, *_ in rows]
    index, value = np.concatenate([i for i, *_ in rows]).astype(np.int64), np.concatenate([v for _, v, _ in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), order)
    used, index = np.unique(index, return_inverse=True)
    weight = np.sqrt(len(y) / (grades * seen[y]))
    weight /= weight.sum()
    v, gaps = np.zeros(len(used)), np.log(np.maximum(np.diff(theta), 1e-2))
    p = np.concatenate([v, theta[:1], gaps])  # thresholds stay in order: a first one and the logs of the gaps
    m, s = np.zeros_like(p), np.zeros_like(p)
    k = len(used)
    for t in range(1, rounds + 1):
        cuts = np.concatenate([[-np.inf], p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]), [np.inf]])
        score = np.bincount(owner, p[:k][index] * value, minlength=len(rows))
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        hi, lo = logistic(cuts[y + 1] - score), logistic(cuts[y] - score)
        hi, lo = np.where(y == grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        q = np.maximum(hi - lo, 1e-12)
        dhi, dlo = weight * hi * (1 - hi) / q, weight * lo * (1 - lo) / q
        dscore = dhi - dlo
        grad = np.empty_like(p)
        grad[:k] = np.bincount(index, dscore[owner] * value, minlength=k) + decay * p[:k]
        dcut = np.zeros(grades + 1)
        np.add.at(dcut, y + 1, -dhi)
        np.add.at(dcut, y, dlo)
        dcut = dcut[1:grades]
        grad[k] = dcut.sum()
        for j in range(grades - 2):
            grad[k + 1 + j] = dcut[j + 1 :].sum() * np.exp(p[k + 1 + j])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    w[used] = p[:k]
    return OrdinalModel(w, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 8000, seed: int = 7, rare: int = 8, telling: float = 0.09, id_col: str = "doc_id", text_col: str = "text", **how) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents (labels: doc_id, quality, toxic).

    Features are made and counted on the executors; the driver gets a row of counts for each of at most DIM
    features, and then, of at most ``sample`` documents, the features that are worth a weight.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    graded = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)  # so many rows at most, whatever the input
    schema = "doc_id long, grade int, at array<int>, value array<float>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [features(t or b"", memory) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))], ["doc_id", "grade", "at", "value"])
                if len(memory) > _MEMORY // 2:
                    memory.clear()

    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "grade")
    made = materialize(texts.mapInArrow(tidy(make), schema), "features")
    by = [F.count(F.when(F.col("grade") == g, 1)).alias(f"g{g}") for g in range(3)]
    seen = made.select("grade", F.explode("at").alias("at")).groupBy("at").agg(*by).toArrow()
    counts = np.zeros((3, DIM))
    for g in range(3):
        counts[g, seen["at"].to_numpy()] = seen[f"g{g}"].to_numpy()
    every = made.agg(*by).first()
    use = telling_features(counts, np.array(every[:], float), rare=rare, telling=telling)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, at, value = batch.slice(i, 256), [], []
                for a, v in zip(part.column(2), part.column(3)):
                    a, v = a.values.to_numpy(), v.values.to_numpy()
                    at.append(a[use[a]])
                    value.append(v[use[a]])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "grade", "at", "value"])

    got = made.mapInArrow(narrow, schema).toArrow().combine_chunks().sort_by("doc_id")
    rows = [(a.values.to_numpy(), v.values.to_numpy(), g) for a, v, g in zip(got["at"], got["value"], got["grade"].to_pylist())]
    return fit(rows, **how)


def _scorer(model: OrdinalModel):
    """texts to scores, with the weights of words that were met before at hand."""
    weights = model.weights.tolist()

    class Shaped(dict):
        """Each word's weight of its shape."""

        def __missing__(self, w: bytes) -> float:
            self[w] = out = 10 * weights[_shapes[w.translate(_SHAPE)[:64]]]
            return out

    class Words(dict):
        """Each word's weights of itself and its beginnings."""

        def __missing__(self, w: bytes) -> float:
            self[w] = out = sum([weights[b] for b in word_buckets(w)[1:]])
            return out

    shaped, own = Shaped(), Words()

    def score(text: bytes) -> float:
        words = split_words(text)
        distinct = set(words)
        total = weights[coarse(len(words), len(distinct))]
        if words:
            total += sum(map(own.__getitem__, distinct)) + sum(map(shaped.__getitem__, words)) / len(words)
        if len(own) > _MEMORY:
            own.clear()
            shaped.clear()
        return total

    return score


def _scores(model: OrdinalModel, key: str, column) -> np.ndarray:
    score = kept(("scorer", key), lambda: _scorer(model))
    return np.array([score(t or b"") for t in column.cast(pa.binary()).to_pylist()], float)


def rate(docs: DataFrame, model: OrdinalModel, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, p_top (probability of the top grade), kept for every document."""
    from uuid import uuid4

    key, top = uuid4().hex, len(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = _scores(model, key, part.column(1))
                p = model.tail(s, top)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(model.expected(s)), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "expected_grade", "p_top", "kept"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), "doc_id long, score double, expected_grade double, p_top double, kept boolean")


def keep_top(docs: DataFrame, model: OrdinalModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that the model selects, with all their columns."""
    from uuid import uuid4

    key, top, at = uuid4().hex, len(model.thresholds), docs.columns.index(text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(model.tail(_scores(model, key, part.column(at)), top) >= threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*names)
