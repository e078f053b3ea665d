"""Learned decision lists over text statistics: built-in functions only.

Statistics of every text are column expressions. Rules are learned from labelled ones by sequential
covering: a conjunction of thresholds grows on one part of the rows until it is pure, is pruned on
the other part, and if it holds there, the rows it covers are set aside and the next one is
grown. Each step asks Spark for one small table of counts. The result is an ordered list of rules
that reads as text and becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import BLANKS, crc_mod, let, named, others, packed, unpacked

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
_BLANK = r"[\x20\x09-\x0D]"
#: Thresholds tried for each statistic: quantiles of its values.
CUTS = 24
#: The size of the model: conditions of a rule and rules of a list. They bound what is learned and read, not the rows.
MAX_CONDITIONS = 4
MAX_RULES = 12
#: Share of right decisions that a rule must have on the rows it was pruned on, and rows it must cover there.
MIN_PRECISION = 0.9
MIN_COVERED = 3


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the array, the first time included."""
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), window)).otherwise(F.array().cast("array<bigint>"))

    def again(placed: Column) -> Column:
        """Sorted positions of the windows whose hash occurs again: those with an equal neighbour."""
        equal = lambda p, k: (F.get(placed, k - 1)["h"] == p["h"]) | (F.get(placed, k + 1)["h"] == p["h"])
        found = F.filter(placed, lambda p, k: F.coalesce(equal(p, k), F.lit(False)))
        return F.sort_array(F.transform(found, lambda p: p["i"]))

    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at"))

    def count(hashes: Column) -> Column:
        # Most texts repeat no window; their distinct windows are as many as all.
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        covered = F.aggregate(let(placed, again), zero, step, lambda s: s["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)

    return let(windows, count)


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but the text and those named like the results) and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_upper, n_marks of the whole text; a null text is empty.

    Words are runs of characters other than space and \\x09 to \\x0D. word_chars: code points in
    words; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: see `repeated_words`; n_upper: capitals; n_marks: exclamation and question marks.
    """
    keep = others(docs.columns, (text, *STATISTICS)) if keep is None else keep
    own = docs.select(packed(keep).alias("row"), F.coalesce(named(text), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = F.array_remove(F.split("text", f"{_BLANK}+", -1), "")
    count = lambda regexp: F.regexp_count("text", F.lit(regexp)).cast("bigint")
    facts = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeated_words(w).cast("bigint").alias("n_repeat_words"),
    ))
    return own.select(
        "row", facts.alias("facts"), count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        count(r"\p{Lu}").alias("n_upper"), count(r"[!?]").alias("n_marks"),
    ).select(
        *unpacked("row", keep), "facts.n_words", "facts.word_chars", "n_symbols", "n_dup_lines", "facts.n_repeat_words", "n_upper", "n_marks",
    )


def ratios() -> dict[str, Column]:
    """What rules are about: statistics relative to the size of the text."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "chars_a_word": part("word_chars", "n_words"),
        "symbols_a_word": part("n_symbols", "n_words"), "dup_lines_a_100_words": part("n_dup_lines", "n_words") * 100,
        "repeated": part("n_repeat_words", "n_words"), "capitals": part("n_upper", "word_chars"),
        "marks_a_word": part("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # name > cut, or else name <= cut
    cut: float

    def expression(self) -> Column:
        return (F.col(self.name) > F.lit(self.cut)) if self.above else (F.col(self.name) <= F.lit(self.cut))

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression()
        return out

    def __str__(self) -> str:
        return "drop if " + " and ".join(map(str, self.conditions))


def _cuts(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Quantiles of each statistic over the bad and over all rows."""
    at = F.array(*[F.lit((i + 0.5) / CUTS) for i in range(CUTS)])
    found = rows.agg(*[
        F.percentile_approx(F.when(F.col("bad"), F.col(n)) if bad else F.col(n), at, 1000).alias(f"{n}_{int(bad)}")
        for n in names for bad in (False, True)
    ]).first()
    return {n: sorted({float(x) for b in (0, 1) for x in found[f"{n}_{b}"] or []}) for n in names}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Gain of information about the bad rows that are kept covered."""
    if p == 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best(rows: DataFrame, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition, int, int] | None:
    """The condition with the largest gain, from counts per statistic and interval between cuts."""
    def cell(name: str, own: list[float]) -> Column:
        below = F.filter(F.array(*[F.lit(c) for c in own]), lambda c: c < F.col(name))
        return F.struct(F.lit(name).alias("name"), F.size(below).alias("cell"))

    cells = [cell(n, own) for n, own in cuts.items() if own]
    counts: dict[str, dict[int, list[int]]] = {n: {} for n in cuts}
    table = rows.select("bad", F.explode(F.array(*cells)).alias("x")).groupBy("x.name", "x.cell").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    for r in table.collect():  # a row per statistic and interval
        counts[r["name"]][r["cell"]] = [r["p"], r["n"]]
    best = None
    for name, own in sorted(cuts.items()):
        p = n = 0
        for i, cut in enumerate(own):
            a, b = counts[name].get(i, (0, 0))
            p, n = p + a, n + b
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(x, y, p0, n0)
                if x + y < p0 + n0 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(name, above, cut), x, y)
    return best


def learn(rows: DataFrame, min_precision: float = MIN_PRECISION, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules for rows to drop, in order. `rows`: the columns of `ratios`, bad (boolean) and grow (boolean).

    Rows with grow are for growing, the others for pruning. Only counts reach the driver. Without bad
    rows, or if no rule holds on the pruning rows, the list is empty.
    """
    names = list(ratios())
    cuts = _cuts(rows, names)
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, check = left.where("grow"), left.where("not grow")
        total = grow.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        p, n = total["p"], total["n"]
        if p < MIN_COVERED:
            break
        conditions: list[Condition] = []
        covered = grow
        while n > 0 and len(conditions) < MAX_CONDITIONS:
            found = _best(covered, cuts, p, n)
            if found is None or found[0] <= 0:
                break
            _, condition, p, n = found
            conditions.append(condition)
            covered = covered.where(condition.expression())
        if not conditions:
            break
        # Prune: of all beginnings of the conjunction the one that serves best on rows it hasn't seen.
        prefixes = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        row = check.agg(*[
            F.count_if(r.expression() & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{k}_{int(bad)}")
            for k, r in enumerate(prefixes) for bad in (True, False)
        ]).first()
        worth = [((row[f"{k}_1"] - row[f"{k}_0"]) / max(1, row[f"{k}_1"] + row[f"{k}_0"]), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        right, wrong = row[f"{k}_1"], row[f"{k}_0"]
        if right + wrong < MIN_COVERED or right < min_precision * (right + wrong):
            break
        rules.append(prefixes[k])
        left = left.where(~prefixes[k].expression())
    return rules


def training_rows(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Labelled rows as `learn` takes them: label 0 is bad; a third, by a hash of the key, is for pruning."""
    known = labels.where(named(label).isNotNull()).select(named(key).alias("of"), (named(label) == 0).alias("bad"))
    own = stats.select(named(key).alias("id"), F.struct(*[c.alias(n) for n, c in ratios().items()]).alias("facts")).join(known, F.col("id") == F.col("of"))
    return own.select("bad", (crc_mod(F.col("id"), 3) != 0).alias("grow"), "facts.*")


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of `stats` and base_failed, rule (number of the first that applies, from 1; null: none) and kept.

    The list becomes one conditional expression, tried in order. Rows that fail the base limits or meet a
    rule aren't kept. A null text has no words, so it fails. Repeated rows are judged each.
    """
    plain = others(stats.columns, ("base_failed", "rule", "kept"))
    facts = stats.select(packed(plain).alias("row"), base_failed().alias("base_failed"), *[c.alias(n) for n, c in ratios().items()])
    rule = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        rule = F.when(r.expression(), F.lit(i)).otherwise(rule)
    out = facts.select("row", "base_failed", rule.alias("rule"))
    return out.select(*unpacked("row", plain), "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
