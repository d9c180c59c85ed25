"""Quality rules: learned decision lists (sequential covering), run as Spark conditionals.

The statistics of a text are built-in expressions over one row; no shuffle, no
Python. Labelled statistics of a bounded sample are collected; covering grows a
conjunction of thresholds on two thirds of them, prunes it on the last third, removes
what it covers and repeats. The list comes back as one ordered CASE expression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import SPACE, labelled_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Columns that a rule may test.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "marks_per_word", "stops_per_word", "digit_share", "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _only(text: Column, kept: str) -> Column:
    """Number of characters of a class in the text."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and features of every whole text.

    Columns: the id, ``keep`` columns, COUNTS and FEATURES. A null or empty text has
    no words and zero for every column. Repeated rows stay; a column of the input
    whose name is that of a statistic is not read unless it is in ``keep``, where
    such a name is an error.
    """
    clash = set(keep) & ({*COUNTS, *FEATURES} | {id_col})
    if clash:
        raise ValueError(f"names taken by statistics: {sorted(clash)}")
    text = F.col("__text")
    rows = docs.select(F.col(id_col), *[F.col(k) for k in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumns({
        "__words": F.array_remove(F.split(text, f"[{SPACE}]+"), ""),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "n_symbols": _only(text, SYMBOLS),
        "__upper": _only(text, "A-Z"),
        "__marks": _only(text, "!?"),
        "__stops": _only(text, ".,;:"),
        "__digits": _only(text, "0-9"),
    })
    words = F.col("__words")
    rows = rows.drop("__text").withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__distinct": F.size(F.array_distinct(words)).cast("long"),
        "__keys": F.when(
            F.size(words) >= WINDOW + 1,
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])),
        ),
    })
    rows = rows.drop("__words", "__lines")
    # Only texts with a repeated window are sorted: windows by key, then repeated ones by place.
    keys = F.col("__keys")
    rows = rows.withColumn("__placed", F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    rows = rows.drop("__keys")
    placed = F.col("__placed")

    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(placed, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(placed, i + 1)["k"] == x["k"], F.lit(False))

    rows = rows.withColumn("__at", F.sort_array(F.transform(F.filter(placed, again), lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(
        F.col("__at"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        id_col,
        *keep,
        *COUNTS,
        per("word_chars", "n_words").alias("mean_word"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "__n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("__distinct", "n_words").alias("distinct_share"),
        per("__upper", "word_chars").alias("upper_share"),
        per("__marks", "n_words").alias("marks_per_word"),
        per("__stops", "n_words").alias("stops_per_word"),
        per("__digits", "word_chars").alias("digit_share"),
        per("n_words", "__n_lines").alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_rules(
    rows: list[dict], bad: list[bool], in_prune: list[bool], features: tuple[str, ...] = FEATURES,
    cuts: int = 48, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.95, min_cover: int = 3,
) -> list[Rule]:
    """Sequential covering. Sets of rows are the bits of integers, so a test is one AND.

    Ties go to the earlier feature and the smaller threshold. Without bad or good
    rows the list is empty.
    """
    n = len(rows)
    every = (1 << n) - 1
    mask = lambda flags: sum(1 << i for i, f in enumerate(flags) if f)
    bads, prune = mask(bad), mask(in_prune)
    if not bads or bads == every:
        return []
    tests: list[tuple[Condition, int]] = []
    for f in features:
        values = sorted(r[f] for r in rows)
        for t in sorted({values[min(n - 1, k * n // cuts)] for k in range(1, cuts)} | {values[-1]}):
            above = mask(r[f] >= t for r in rows)
            tests += [(Condition(f, True, t), above), (Condition(f, False, t), every & ~above)]
    left, rules = every, []

    def score(covered: int) -> tuple[int, int]:
        return (covered & bads).bit_count(), (covered & ~bads).bit_count()

    def worth(p: int, q: int) -> float:
        return (p + 1) / (p + q + 2)

    while len(rules) < max_rules and left & bads:
        grow, held = left & ~prune, left & prune
        picked: list[tuple[Condition, int]] = []
        covered = grow
        while len(picked) < max_conditions:
            p0, q0 = score(covered)
            if not q0 or not p0:
                break
            before, best, gain = worth(p0, q0), None, 0.0
            for c, m in tests:
                p, q = score(covered & m)
                if p >= min_cover and (g := p * (worth(p, q) - before)) > gain:
                    best, gain = (c, m), g
            if best is None:
                break
            picked.append(best)
            covered &= best[1]
        if not picked:
            break

        def held_worth(part: list[tuple[Condition, int]]) -> float:
            m = held
            for _, x in part:
                m &= x
            p, q = score(m)
            return (p - q) / (p + q) if p + q else -1.0

        while len(picked) > 1:  # reduced-error pruning, last condition first
            shorter = [picked[:i] + picked[i + 1 :] for i in reversed(range(len(picked)))]
            best = max(shorter, key=held_worth)
            if held_worth(best) < held_worth(picked):
                break
            picked = best
        whole = left
        for _, m in picked:
            whole &= m
        p, q = score(whole)
        if p < min_cover or p < min_precision * (p + q) or held_worth(picked) < 2 * min_precision - 1.1:
            break
        rules.append(tuple(c for c, _ in picked))
        left &= ~whole
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> list[Rule]:
    """Learn a list from at most ``max_labelled`` labelled rows (a documented bound); of an id's texts the first by code point."""
    sample = labelled_sample(labels, max_labelled)
    chosen = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__raw")).join(F.broadcast(sample), "__id")
    chosen = chosen.groupBy("__id", "__label").agg(F.min("__raw").alias("__raw"))
    got = text_statistics(chosen, "__id", "__raw", keep=("__label",)).collect()
    got.sort(key=lambda r: (r["__id"], r["n_words"], r["word_chars"]))
    rows = [r.asDict() for r in got]
    return learn_rules(rows, [r["__label"] == 0 for r in rows], [zlib.crc32(b"prune%d" % r["__id"]) % 3 == 0 for r in rows])


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    case = F
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        case = case.when(test, F.lit(k))
    return case.otherwise(F.lit(0))


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics plus base_failed, rule (which fired) and kept; one row per input row.

    A null or empty text has no words, so it fails the base rule. An empty table gives
    an empty table.
    """
    rows = text_statistics(docs, id_col, text_col, keep)
    rows = rows.withColumns({"base_failed": base_failed(), "rule": rejected_by(rules)})
    # Always true, and unknown to the optimizer: a filter on kept would otherwise be moved below the statistics
    # and work each of them out anew wherever another refers to it.
    barrier = F.monotonically_increasing_id() >= 0
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0) & barrier)
