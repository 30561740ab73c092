"""Quality rules as a learned decision list.

Statistics of a text are whole numbers: counts, and levels of at most 1,000 steps made of them
(per mille shares, tenths of a character). From labelled rows sequential covering learns one rule
at a time: it grows a conjunction of thresholds by information gain over the rows that no earlier
rule covers, prunes it on rows held back for that, and stops when a rule no longer holds there.
Every step needs only counts per (statistic, level, label), one grouped sum over the labelled rows;
its result has a bounded size, whatever the number of rows. The list is applied as one ordered
conditional expression.

Nulls and blank texts have no words and fail the base test. Repeated rows each get the same verdict
and count each as a sample; ties between thresholds go to the statistic listed first, then to the
smaller threshold. Very long texts are read whole, in near-linear time; windows of words are
compared by 64-bit hashes. Samples of one class only, or none, give an empty list, which keeps
every text that passes the base test.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import bind
from fieldspark.sources.stage import materialise

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30          # per cent of words in repeated windows
SYMBOLS = "#*$%&|<>"
TOP = 1000                  # highest level
RULES, CONDITIONS = 12, 4
LEAST_ROWS = 5              # low-quality rows that a rule has to cover while it grows
PRECISE = 0.8               # smoothed share of low-quality rows among those that a rule covers
HELD = 3                    # one row of so many prunes
SPACE = r"[\\x20\\x09-\\x0D]"


def repeated(words: str) -> str:
    """SQL: how many words lie in windows of ``WINDOW`` words that occur twice or more."""
    k = WINDOW
    before, at, after = "get(s, j - 1).h", "get(s, j).h", "get(s, j + 1).h"
    covered = bind(
        f"sort_array(transform(filter(transform(s, (x, j) -> if(coalesce({before} = {at}, false) or coalesce({after} = {at}, false), x.i, -1)), v -> v >= 0), v -> v))",
        f"p -> {k} + aggregate(transform(p, (v, j) -> if(j = 0, 0, least({k}, v - get(p, j - 1)))), 0, (a, v) -> a + v)")
    found = bind("sort_array(transform(g, (x, i) -> struct(x as h, i as i)))", f"s -> {covered}")
    windows = bind(f"transform({words}, x -> xxhash64(x))",
                   f"e -> transform(sequence(0, size(e) - {k}), i -> xxhash64(slice(e, i + 1, {k})))")
    some = bind(windows, f"g -> if(size(array_distinct(g)) = size(g), 0, {found})")
    return f"if(size({words}) <= {k}, 0, {some})"


def removed(text: str, characters: str) -> str:
    """SQL: how many of ``characters`` are in ``text``."""
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


def statistics(text: str) -> str:
    """SQL struct of the counts of ``text``."""
    lines = bind(f"filter(split(t, '\\\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')",
                 "l -> struct(size(l) as lines, size(l) - size(array_distinct(l)) as again)")
    fields = {
        "n_words": "size(w)",
        "word_chars": "aggregate(w, 0L, (a, x) -> a + length(x))",
        "n_symbols": removed("t", SYMBOLS),
        "n_repeat_words": repeated("w"),
        "n_kinds": "size(array_distinct(w))",
        "n_capitals": "length(regexp_replace(t, '[^\\\\p{Lu}]+', ''))",
        "n_calls": removed("t", "!?"),
        "n_digits": removed("t", "0123456789"),
    }
    counts = ", ".join(f"cast({e} as bigint) as {n}" for n, e in fields.items())
    row = bind(lines, f"m -> struct({counts}, cast(m.again as bigint) as n_dup_lines, cast(m.lines as bigint) as n_lines)")
    split = f"filter(split(t, '{SPACE}+', -1), x -> x <> '')"
    return bind(f"coalesce({text}, '')", f"t -> {bind(split, f'w -> {row}')}")


def share(part: str, whole: str, scale: int = TOP) -> str:
    return f"cast(if({whole} > 0, least({TOP}, {scale} * {part} div {whole}), 0) as int)"


# What rules can ask for, all whole numbers from 0 to ``TOP``.
LEVELS = {
    "symbols": ("n_symbols", "word_chars", TOP),
    "repeats": ("n_repeat_words", "n_words", TOP),
    "same_lines": ("n_dup_lines", "n_lines", TOP),
    "capitals": ("n_capitals", "word_chars", TOP),
    "calls": ("n_calls", "n_words", TOP),
    "kinds": ("n_kinds", "n_words", TOP),
    "digits": ("n_digits", "word_chars", TOP),
    "word_length": ("word_chars", "n_words", 10),
    "line_words": ("n_words", "n_lines", 1),
}


def level(name: str, prefix: str = "") -> Column:
    part, whole, scale = LEVELS[name]
    return F.expr(share(prefix + part, prefix + whole, scale))


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: int

    def holds(self, column: Column) -> Column:
        return column > self.cut if self.above else column <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects a text, and none keeps it."""
    rules: tuple[tuple[Condition, ...], ...]

    def fires(self, prefix: str = "") -> Column:
        """Number of the first rule that holds, from 1, else null; ``prefix`` names the struct of
        statistics."""
        out = F.lit(None).cast("int")
        for i in reversed(range(len(self.rules))):
            out = F.when(conjunction(self.rules[i], lambda n: level(n, prefix)), i + 1).otherwise(out)
        return out

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules)


def conjunction(rule, column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(column(c.name))
    return out


def best_condition(counts: dict, taken: tuple) -> tuple[Condition, tuple] | None:
    """The threshold of most information gain, and (low, good, held low, held good) beyond it.

    ``counts`` is {statistic: {level: [low, good, held low, held good]}}. A cut lies halfway between two
    levels that occur, so rows near neither side decide it.
    """
    best = None
    for name in LEVELS:
        at = counts.get(name, {})
        order = sorted(at)
        total = [sum(at[v][i] for v in order) for i in range(4)]
        if not total[0]:
            continue
        now = math.log2(total[0] / (total[0] + total[1]))
        below = [0, 0, 0, 0]
        for a, b in zip(order, order[1:]):
            below = [x + y for x, y in zip(below, at[a])]
            for above in (True, False):
                got = [t - x for t, x in zip(total, below)] if above else below
                if got[0] < LEAST_ROWS:
                    continue
                gain = got[0] * (math.log2(got[0] / (got[0] + got[1])) - now)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(name, above, (a + b) // 2), tuple(got))
    return best[1:] if best and best[1] not in taken else None


def train(samples: DataFrame, rules: int = RULES) -> DecisionList:
    """Learn from ``samples``: a struct ``stats``, ``quality`` (0 or 1) and ``held`` (rows that
    prune). Rows without a label or that fail the base test teach nothing."""
    rows = samples.where(F.col("quality").isNotNull() & ~base_failed("stats."))
    rows = rows.select(*[level(n, "stats.").alias(n) for n in LEVELS], (F.col("quality") == 0).alias("low"), "held")
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    which = 2 * F.col("held").cast("int") + F.when(F.col("low"), 0).otherwise(1)

    def counts(where: Column) -> dict:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("name"), F.col(n).alias("level")) for i, n in enumerate(LEVELS)]))
        out: dict = {}
        names = list(LEVELS)
        for r in rows.where(where).select(pairs.alias("p"), which.alias("k"), "n").groupBy("p.name", "p.level", "k").agg(F.sum("n").alias("n")).collect():
            out.setdefault(names[r["name"]], {}).setdefault(r["level"], [0, 0, 0, 0])[r["k"]] = r["n"]
        return out

    learned: list[tuple[Condition, ...]] = []
    free = F.lit(True)
    start = counts(free)
    while len(learned) < rules and start:
        rule: tuple[Condition, ...] = ()
        worth = []
        seen = start
        while len(rule) < CONDITIONS:
            got = best_condition(seen, rule)
            if got is None:
                break
            rule += (got[0],)
            worth.append(got[1])
            if not got[1][1]:
                break
            seen = counts(free & conjunction(rule, F.col))
        # Prune to the prefix that tells held-back rows apart best; ties to the shorter one.
        if not rule:
            break
        value = [(h - g) / (h + g) if h + g else -1.0 for _, _, h, g in worth]
        size = max(range(len(rule)), key=lambda i: (value[i], -i)) + 1
        low, good, held_low, held_good = worth[size - 1]
        if (held_low + 0.5) / (held_low + held_good + 1) < PRECISE or low / (low + good) < PRECISE:
            break
        learned.append(rule[:size])
        free = free & ~conjunction(rule[:size], F.col)
        start = counts(free)
    return DecisionList(tuple(learned))


def held(text: Column) -> Column:
    """Rows that prune: by text alone, so that copies are on one side."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(HELD)) == 0


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stage table of (key, stats, held), a row per row of ``docs``: the only scan of the texts."""
    return materialise(docs.select(F.col(key).alias(key), F.expr(statistics(f"`{text}`")).alias("stats"), held(F.col(text)).alias("held")))


def judge(rows: DataFrame, rules: DecisionList) -> DataFrame:
    """``rows`` of ``measured`` with base_failed, the rule that rejects (else null) and kept."""
    rule = F.when(~base_failed("stats."), rules.fires("stats."))
    out = rows.withColumn("base_failed", base_failed("stats.")).withColumn("rule", rule)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
