"""Quality rules: learned decision lists over text statistics, as ordered Spark conditionals.

Statistics are higher-order SQL functions inside each row: nothing is shuffled and no Python runs on
executors.  Sequential covering grows a conjunction of thresholds on one part of a bounded labelled
sample (by FOIL's gain), prunes it on the other part, keeps it while it is precise there, and removes
what it covers.  The list becomes one ``CASE`` expression.

Defined results: null text has no words and fails the base rule; null labels are not learned from; a
document labelled both ways counts as good; without labels the list is empty and only the base rule
rejects; an empty table gives no rows; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

#: Labelled rows that rules are fitted on, at most.
TRAIN_ROWS = 6000
#: Share of low-quality rows among those a rule covers in the pruning part.
MIN_PRECISION = 0.95
SPACE = r"\x20\x09-\x0D"
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "capital_share", "exclaim_share", "n_words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` with word, symbol, line and repetition counts of its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = require(docs, "doc_id", "text").select("doc_id", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    split = base.select(
        "doc_id",
        F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[A-Z][A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclaims"),
        lines.alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "n_symbols",
        "n_capitals",
        "n_exclaims",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    counts = [c for c in hashed.columns if c != "h"]
    # Hashes of 2, 4 and 5 words from shifted copies: no index arithmetic for each word.
    joined = {"h2": ("h", "h", 1), "h4": ("h2", "h2", 2), "win": ("h4", "h", 4)}
    windows = hashed
    for name, (left, right, shift) in joined.items():
        n = F.size(right) - shift
        both = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))
        kept = ["h", name] if name != "win" else ["win"]
        windows = windows.withColumn(name, F.when(n > 0, both).otherwise(F.array().cast("array<long>"))).select(*counts, *dict.fromkeys(kept))
    # Only texts in which a window repeats are sorted; neighbours in the order are equal windows.
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    placed = windows.select(*counts, F.when(repeats, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("win"))

    def repeated(s: Column, j: Column) -> Column:
        same = [F.get("win", j + k)["h"].eqNullSafe(s["h"]) for k in (-1, 1)]
        return F.when(same[0] | same[1], s["i"])

    starts = placed.select(*counts, F.sort_array(F.filter(F.transform("win", repeated), lambda i: i.isNotNull())).alias("at"))
    step = F.transform("at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("at", j + 1) - p, F.lit(5))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.struct(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # A generator keeps filters on the results above it: pushed down, they would repeat the nested
    # expressions, doubled at every step.
    return starts.select(F.inline(F.array(found)))


def with_features(stats: DataFrame) -> DataFrame:
    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return stats.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "mean_word": share("word_chars", "n_words"),
            "capital_share": share("n_capitals", "word_chars"),
            "exclaim_share": share("n_exclaims", "n_words"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]
Row = tuple[dict[str, float], bool]


def _counts(rule: Rule, rows: list[Row]) -> tuple[int, int]:
    """Low-quality and good rows that the rule covers."""
    covered = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(covered), len(covered) - sum(covered)


def _best_condition(rows: list[Row], features: tuple[str, ...]) -> tuple[float, Condition | None]:
    """The threshold of the highest FOIL gain, from one sweep over each feature's sorted values."""
    p0, n0 = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
    start = math.log2(p0 / (p0 + n0)) if p0 else 0.0
    best: tuple[float, Condition | None] = (1e-9, None)
    for feature in features:
        ordered = sorted((row[feature], bad) for row, bad in rows)
        p = n = 0
        for (value, bad), (after, _) in zip(ordered, ordered[1:]):
            p, n = p + bad, n + (not bad)
            if after > value:
                for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = pp * (math.log2(pp / (pp + nn)) - start) if pp else 0.0
                    if gain > best[0]:
                        best = gain, Condition(feature, above, (value + after) / 2)
    return best


def grow(rows: list[Row], features: tuple[str, ...] = FEATURES, most: int = 4) -> Rule:
    rule: Rule = ()
    while len(rule) < most and any(not bad for _, bad in rows):
        gain, condition = _best_condition(rows, features)
        if condition is None:
            break
        rule += (condition,)
        rows = [(row, bad) for row, bad in rows if condition.holds(row)]
    return rule


def prune(rule: Rule, rows: list[Row]) -> Rule:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on other rows."""

    def worth(k: int) -> float:
        p, n = _counts(rule[:k], rows)
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(rows: list[Row], features: tuple[str, ...] = FEATURES, most_rules: int = 12) -> list[Rule]:
    """Sequential covering; every third row is for pruning."""
    growing = [r for i, r in enumerate(rows) if i % 3]
    pruning = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(bad for _, bad in growing):
        rule = prune(grow(growing, features), pruning)
        p, n = _counts(rule, pruning) if rule else (0, 0)
        if not rule or p < 3 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule)
        growing, pruning = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (growing, pruning))
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list[Row]:
    """Features of a bounded hash sample of the labelled documents."""
    known = require(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null")
    # At most ``most`` rows are broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = require(docs, "doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = with_features(with_statistics(chosen)).select("doc_id", *FEATURES).join(F.broadcast(sample), "doc_id")
    found = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(most).collect()
    return [({f: float(r[f]) for f in FEATURES}, r["quality"] == 0) for r in found]


def rule_index(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, 0 for none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        both = rule[0].column()
        for c in rule[1:]:
            both &= c.column()
        out = F.when(both, i).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_features(with_statistics(docs)).withColumns({"base_failed": failed, "rule": rule_index(rules)})
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, learn(training_rows(docs, labels)))


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
