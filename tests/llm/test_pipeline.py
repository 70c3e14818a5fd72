import random

import corpus_pipeline
from conftest_llm import rows
from pyspark.sql import functions as F

from loomslice.llm import classifier, mixing, packing, rules, simhash


def test_stages_are_their_operators(spark, sf, docs, tmp_path):
    """Each stage on its predecessor's rows, against the operator's own report on them; the last is run()'s result."""
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = at
        stage(spark, at, sf).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, before, at))
    for name, _, after in seen[:-1]:
        assert after.columns == docs.columns, name
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    model = classifier.learn(a, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(b) == ids(classifier.rate(a, model).where("kept"))
    assert ids(c) == ids(rules.rule_report(b).where("kept"))
    assert ids(d) == ids(simhash.near_duplicates(c).where("doc_id = component_id"))
    assert d.count() < c.count()
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(d).where("copies > 0").collect()}
    assert {r["doc_id"]: r["n"] for r in e.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(f, *cols) == rows(packing.pack(e), *cols)
    assert rows(corpus_pipeline.run(spark, sf), *cols) == rows(f, *cols)


def test_an_empty_table_goes_through(spark, sf, none):
    at = none
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
    assert at.count() == 0


def test_clean_documents_stay(spark):
    """Of documents labelled good and not toxic, the classifier keeps nearly all; of toxic ones few. The least table has too few labels."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    kept = corpus_pipeline.quality_classifier(spark, docs, sf)
    good, bad = labels.where("q = 1 and t = 0"), labels.where("t = 1")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.9 * good.count()
    assert kept.join(bad, "doc_id", "left_semi").count() <= 0.2 * bad.count()


def test_near_dedup_is_brute_force(spark, sf, docs):
    """Components by exact similarity of five-word shingles, on the documents and made pairs from 0.7 to 0.9 and repeated lines."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9000)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = max(texts) + 1
    for k in range(60):
        base = rng.choices(words, k=204)
        same = 165 + k  # of 200 shingles: similarities of 0.70 and more
        line = " ".join(base[:8])
        near = base[: same + 4] + rng.choices(words, k=200 - same) if same < 200 else base
        more = [" ".join(base), " ".join(near), f"{line} " * 9 + " ".join(rng.choices(words, k=50)), f"{line} " * 9 + " ".join(rng.choices(words, k=50))]
        texts |= {at + i: t for i, t in enumerate(more)}
        at += len(more)
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf).collect()}
    assert kept == {i for i in ids if root(i) == i}
