"""Quality rules as weak supervision, in DataFrame operations only.

Statistics of a whole text give each rule a vote: good, bad, or none. Documents with the same votes are
counted (there are at most 3 ** rules of such patterns, however many documents); expectation-maximisation
over those counts estimates how often each rule votes rightly; a document is kept if its posterior probability of being good reaches a threshold.
The statistics are computed within a row, so nothing is shuffled but the pattern counts.

Words are runs of anything but ASCII white space. A null text has none and fails the base rules, like an
empty one. Whole texts are read, however long. Rows repeat if they are repeated, null ids are kept, an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import exp, log
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, materialize, pick, words_of

GOOD, BAD = 1, -1


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, by position.

    Windows are compared by a 64-bit hash within one text.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(h[i - 1], h[i], h[i + 1]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["at"]))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda acc, at: F.struct((acc["n"] + at + 3 - F.greatest(at, acc["end"])).alias("n"), (at + 3).alias("end"))
        return F.aggregate(let(pairs, places), zero, add, lambda r: r["n"])

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))

    hashed = lambda w: let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), count)
    return F.when(F.size(words) < 4, 0).otherwise(hashed(words))


def statistics(text: Column) -> Column:
    """A struct of the counts that the rules vote on."""

    def of(t: Column) -> Column:
        def lines(x: Column) -> Column:
            return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

        def counts(w: Column) -> Column:
            own = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines)
            letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), own.alias("lines"), repeated_words(w).cast("long").alias("n_repeat_words"),
                letters.cast("long").alias("n_letters"), F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
                F.length(F.regexp_replace(t, r"[^!?]+", "")).cast("long").alias("n_shouts"),
            )

        return let(words_of(t), counts)

    return let(F.coalesce(text, F.lit("")), of)


def votes(s: Column) -> dict[str, Column]:
    """The rules: each a column that is 1 (good), -1 (bad) or 0 (no vote).

    A rule that looks for a fault votes bad or not at all: that one fault is missing says little. Two rules
    look for the marks of prose, and only where there is no fault: they hold for nearly every document, so
    that otherwise no fault could ever outweigh them, however few documents have it.
    """
    n, chars = s["n_words"], s["word_chars"]
    faults = {
        "length": n < 50,
        "word_length": (chars < 2 * n) | (chars > 16 * n),
        "symbols": s["n_symbols"] >= 0.25 * n,
        "capitals": s["n_upper"] >= 0.4 * s["n_letters"],
        "letters": s["n_letters"] < 0.65 * chars,
        "shouting": s["n_shouts"] >= 0.4 * n,
        "lines": (s["lines"]["n"] >= 4) & (s["lines"]["dup"] >= 0.4 * s["lines"]["n"]),
        "repeats": s["n_repeat_words"] >= 0.5 * n,
    }
    sound = ~reduce(or_, faults.values())
    good = lambda c: F.when(sound & c, GOOD).otherwise(0)
    return {r: F.when(c, BAD).otherwise(0) for r, c in faults.items()} | {
        "prose": good((s["n_letters"] >= 0.85 * chars) & (s["n_symbols"] <= 0.05 * n) & (s["n_upper"] <= 0.3 * s["n_letters"]) & (s["n_shouts"] <= 0.1 * n)),
        "fresh": good((n >= 50) & (s["n_repeat_words"] <= 0.2 * n) & (s["lines"]["dup"] <= 0.2 * s["lines"]["n"]) & (s["n_symbols"] <= 0.05 * n)),
    }


#: What a rule's accuracy is taken to be before any vote is counted.
_START = 0.95


@dataclass
class VoteModel:
    """right: how often each rule's votes are right; share: of good documents, before any vote.

    The share is given, not estimated: at even odds a document is judged by its votes alone, while the
    large share of good ones in most collections would outweigh a single well-founded vote against one.
    """

    share: float = 0.5
    right: dict[str, float] = field(default_factory=dict)

    def weight(self, rule: str) -> float:
        """Log odds that a vote of the rule adds to its side."""
        a = self.right.get(rule, _START)
        return log(a / (1 - a))

    def posterior(self, pattern: dict[str, int]) -> float:
        odds = log(self.share / (1 - self.share)) + sum(v * self.weight(r) for r, v in sorted(pattern.items()))
        return 1 / (1 + exp(-odds))

    def column(self, votes: dict[str, Column]) -> Column:
        """The posterior as an expression."""
        odds = F.lit(log(self.share / (1 - self.share)))
        for rule, v in sorted(votes.items()):
            odds = odds + v * F.lit(self.weight(rule))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[dict[str, int], int]], *, rounds: int = 100, prior: float = 0.01) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    prior: votes per rule, as a share of all documents, that are counted besides and right as often as
    _START says; they decide where a rule never votes, and keep good and bad from changing places.
    """
    model, total = VoteModel(), sum(n for _, n in patterns)
    if not total:
        return model
    patterns = sorted(patterns, key=lambda p: sorted(p[0].items()))
    rules, extra = sorted(patterns[0][0]), prior * total
    for _ in range(rounds):
        hits = {r: [_START * extra, extra] for r in rules}  # right votes, votes
        for pattern, n in patterns:
            p = model.posterior(pattern)
            for r in rules:
                if v := pattern[r]:
                    hits[r][0] += n * (p if v > 0 else 1 - p)
                    hits[r][1] += n
        new = VoteModel(right={r: min(0.999, max(0.5, a / b)) for r, (a, b) in hits.items()})
        moved = max(abs(new.right[r] - model.right.get(r, _START)) for r in rules)
        model = new
        if moved < 1e-9:
            break
    return model


def learn(stats: DataFrame, name: str = "stats") -> VoteModel:
    """The model from a frame with a statistics column. At most 3 ** rules rows come to the driver."""
    v = votes(F.col(name))
    rows = stats.select(*[c.cast("int").alias(r) for r, c in v.items()]).groupBy(*v).agg(F.count("*").alias("n")).collect()
    return fit([({r: row[r] for r in v}, row["n"]) for row in rows])


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def rule_report(docs: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior, for every document."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    stats = materialize(rows.select("doc_id", statistics(F.col("text")).alias("stats")), "stats")
    model, s = learn(stats), F.col("stats")
    p = model.column(votes(s))
    return stats.select(
        "doc_id", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["lines"]["dup"].alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"), base_failed(s).alias("base_failed"), (~base_failed(s) & (p >= threshold)).alias("kept"), p.alias("posterior"),
    )


def keep_good(docs: DataFrame, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns. Rows are written once with their statistics, to learn from and to filter."""
    n, at = len(docs.columns), f"c{docs.columns.index(text_col)}"
    stats = materialize(docs.toDF(*[f"c{i}" for i in range(n)]).withColumn("stats", statistics(F.col(at))), "stats")
    model = learn(stats)
    s = F.col("stats")
    kept = stats.where(~base_failed(s) & (model.column(votes(s)) >= threshold))
    return kept.select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
