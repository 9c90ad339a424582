"""Words of CJK text, by a lexicon that is learned from the texts themselves.

A group of two to ``longest`` characters is a word if it is frequent, if its parts stand together far more often than by chance
(cohesion: the least pointwise mutual information over its cuts), and if many different characters stand on either side of it
(branching: the smaller entropy; the border of a run counts as a new neighbour each time). Counts cover all texts; the lexicon keeps
the ``size`` most frequent words. A run of characters is cut along the cheapest path over its lattice of words, each word at the cost
of its rarity, single characters at theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.tokens import CJK
from hirelake.session import Scratch

LONGEST, LEAST_COUNT, COHESION, BRANCHING, SIZE = 4, 5, 2.0, 0.6, 100_000
# Stand for the borders of a run.
FIRST, LAST = "^", "$"
RUNS = re.compile(f"[{CJK}]+")
PARTS = re.compile(f"[A-Za-z][A-Za-z0-9+#.-]*|[{CJK}]+")
# Different groups that a task counts before it tells them.
TOLD = 500_000


def _count(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"gram": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for found in RUNS.findall(text or ""):
                    run = FIRST + found + LAST
                    counts.update(found)
                    for n in range(2, longest + 2):
                        counts.update(run[k:k + n] for k in range(len(run) - n + 1))
                if len(counts) > TOLD:
                    yield told()
        yield told()

    return run


@dataclass(frozen=True)
class Lexicon:
    """Costs of words and characters in thousandths of a natural logarithm, and the cost of a character that was never seen."""

    costs: dict[str, int]
    unknown: int
    longest: int = LONGEST
    kept: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    def cut(self, run: str) -> tuple[str, ...]:
        """The cheapest words that make up a run; of equally cheap ones the fewest, then the longest first."""
        best: list[tuple] = [(0, 0, (), 0)] * (len(run) + 1)
        for at in range(len(run) - 1, -1, -1):
            ways = []
            for n in range(1, min(self.longest, len(run) - at) + 1):
                cost = self.costs.get(run[at:at + n], self.unknown if n == 1 else None)
                if cost is not None:
                    rest = best[at + n]
                    ways.append((cost + rest[0], 1 + rest[1], -n))
            cost, words, n = min(ways)
            best[at] = (cost, words, n)
        made, at = [], 0
        while at < len(run):
            made.append(run[at:at - best[at][2]])
            at -= best[at][2]
        return tuple(made)

    def words(self, text: str | None) -> list[str]:
        """Latin words, and words of two or more characters, in order."""
        made = []
        for part in PARTS.findall(text or ""):
            if part[0].isascii():
                made.append(part)
                continue
            if part not in self.kept:
                if len(self.kept) > 100_000:
                    self.kept.clear()
                self.kept[part] = self.cut(part)
            made += [w for w in self.kept[part] if len(w) > 1]
        return made


def learn(df: DataFrame, text: str, longest: int = LONGEST, least_count: int = LEAST_COUNT, cohesion: float = COHESION,
          branching: float = BRANCHING, size: int = SIZE) -> Lexicon:
    """The lexicon of a column of texts. What reaches the driver is the lexicon and the characters."""
    scratch = Scratch(df.sparkSession, "lexicon")
    counted = df.select(F.col(text).alias("text")).mapInArrow(_count(longest), "gram string, n long")
    grams = scratch.table(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    inside = ~F.col("gram").startswith(FIRST) & ~F.col("gram").endswith(LAST)
    total = grams.filter(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = grams.filter(inside & (F.length("gram") > 1) & (F.length("gram") <= longest) & (F.col("n") >= least_count))
    found = scratch.table(found, "candidates")
    halves = found.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at")).select(
        "gram", "n", F.substring("gram", F.lit(1), F.col("at")).alias("left"),
        F.substring("gram", F.col("at") + 1, F.length("gram")).alias("right"))
    for side in ("left", "right"):
        halves = halves.join(grams.select(F.col("gram").alias(side), F.col("n").alias(f"n_{side}")), side)
    chance = F.log(F.col("n") * float(total or 1) / (F.col("n_left") * F.col("n_right")))
    bound = halves.groupBy("gram").agg(F.min(chance).alias("cohesion")).filter(F.col("cohesion") >= cohesion)
    kept = found.join(bound, "gram", "left_semi")
    for border, neighbour in ((LAST, 1), (FIRST, -1)):  # what stands behind, then before
        start = F.lit(1) if neighbour == 1 else F.lit(2)
        word = F.substring("gram", start, F.length("gram") - 1)
        alone = F.col("gram").endswith(border) if neighbour == 1 else F.col("gram").startswith(border)
        sides = grams.filter(F.length("gram") > 2).select(word.alias("word"), "n", F.when(alone, 0.0).otherwise(
            F.col("n") * F.log("n")).alias("weight"))
        entropy = sides.groupBy("word").agg((F.log(F.sum("n")) - F.sum("weight") / F.sum("n")).alias("h"))
        kept = kept.join(entropy.filter(F.col("h") >= branching).select(F.col("word").alias("gram")), "gram", "left_semi")
    words = kept.orderBy(F.desc("n"), "gram").limit(size).collect()
    signs = grams.filter(F.length("gram") == 1).collect()  # as many as there are characters
    scratch.drop()
    costs = {r["gram"]: round(1000 * math.log(total / r["n"])) for r in [*signs, *words]}
    return Lexicon(costs, round(1000 * math.log(total + 1)), longest)


def segmenter(lexicon: Lexicon) -> Callable[[Column], Column]:
    """A segmenter for :func:`hirelake.functions.tokens.keyword_rows`. Null texts have no words."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.words)

    return words


def whole_runs(df: DataFrame, text: str, words: Callable[[Column], Column]) -> DataFrame:
    """``tokens, whole``: CJK tokens, and those that are a whole run of two or more characters of their text."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    rows = df.select(runs.alias("runs"), F.filter(words(F.col(text)), lambda w: w.rlike(f"^[{CJK}]")).alias("words"))
    whole = F.size(F.filter("words", lambda w: F.array_contains("runs", w)))
    return rows.agg(F.sum(F.size("words")).alias("tokens"), F.sum(whole).alias("whole"))
