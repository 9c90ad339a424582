"""Duplicate removal. ``pos`` is any orderable column; the smallest position is the first row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.operators.components import components
from hirelake.operators.ranking import number_rows, top_per_group
from hirelake.operators.skew import HOT_ROWS, grouped, hot_hashes, hot_keys, hot_of, salted_left_join
from hirelake.session import Scratch, shuffles_removed, stored

# Rounds before what is left is cut into connected groups.
FIRST_ROUNDS = 2
# A group of at most so many rows is settled by one task.
SETTLED_ROWS = 100_000


def first_per_key(df: DataFrame, keys: list[str], pos: str = "pos", counted: list[str] | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """First row of each key.

    A rank with a limit, which Spark applies before the shuffle, too: a hot key costs one row per task. Rows are moved as they are; an
    aggregate that keeps them in a struct sorts as often, moves ``pos`` twice and is not compiled. With ``counted``, keys that are
    cheap to compute, only hot keys are combined; see :func:`hirelake.operators.skew.grouped`.
    """

    def reduce(part: DataFrame) -> DataFrame:
        return top_per_group(part, keys, [F.col(pos).asc_nulls_last()], 1, "__rank").drop("__rank")

    return reduce(df) if counted is None else grouped(df, keys, reduce, counted, hot_rows)


def dedupe_business(df: DataFrame, pos: str = "pos", keys: list[str] = V.BUSINESS_KEY) -> DataFrame:
    """Keep the first row of each business key."""
    return first_per_key(df, keys, pos)


def dedupe_links(df: DataFrame, batch: str = "batch_path", pos: str = "pos") -> DataFrame:
    """First row per link inside a batch; the title stands in for a blank link."""
    link = F.coalesce(F.nullif(F.col("job_link"), F.lit("")), F.col("title"))
    return first_per_key(df.withColumn("__link", link), [batch, "__link"], pos).drop("__link")


def one_detail_per_link(df: DataFrame, pos: str = "pos") -> DataFrame:
    """First row per link over everything; rows without a link are skipped."""
    return first_per_key(df.filter(F.coalesce(F.col("job_link"), F.lit("")) != ""), ["job_link"], pos, ["job_link"])


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """The greedy rule itself, over one small group in order."""
    ids, keys, kept = set(), set(), []
    for n, i, k in group.sort_values("__n").itertuples(index=False):
        if k in keys or i in ids:
            continue
        keys.add(k)
        if not pd.isna(i):
            ids.add(i)
        kept.append(n)
    return pd.DataFrame({"__n": kept}, dtype="int64")


def _round(undecided: DataFrame, scratch: Scratch, hot_ids: DataFrame | None, hot: DataFrame | None) -> tuple:
    """Rows kept in this round, and those still undecided."""

    def attach(rows: DataFrame, of_id: DataFrame, of_key: DataFrame) -> DataFrame:
        """Values per id and per key. Blank ids match nothing; being one null key, they are spread like a hot one."""
        return salted_left_join(salted_left_join(rows, of_id, ["__i"], ["__n"], hot_ids), of_key, ["__k"], ["__n"], hot)

    id_first = undecided.filter(F.col("__i").isNotNull()).groupBy("__i").agg(F.min("__n").alias("id_first"))
    key_first = undecided.groupBy("__k").agg(F.min("__n").alias("key_first"))
    keep = (F.col("__i").isNull() | (F.col("__n") == F.col("id_first"))) & (F.col("__n") == F.col("key_first"))
    own = Scratch(undecided.sparkSession, "greedy-round")
    judged = own.table(attach(undecided, id_first, key_first).select("__n", "__i", "__k", keep.alias("keep")), "judged")
    winners = judged.filter("keep")
    taken_ids = winners.filter(F.col("__i").isNotNull()).select("__i", F.lit(True).alias("id_taken"))
    taken_keys = winners.select("__k", F.lit(True).alias("key_taken"))
    rest = attach(judged.filter(~F.col("keep")).drop("keep"), taken_ids, taken_keys)
    rest = rest.filter(F.col("id_taken").isNull() & F.col("key_taken").isNull()).select("__n", "__i", "__k")
    made = scratch.table(winners.select("__n"), "winners"), scratch.table(rest, "undecided")
    own.drop()
    return made


def _settle_small(undecided: DataFrame, scratch: Scratch, settled_rows: int) -> tuple:
    """Rows kept of all connected groups of at most ``settled_rows`` rows, and the rows of larger groups. So few rows in all
    are one group."""
    if undecided.count() <= settled_rows:
        whole = undecided.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
            lambda g: _settle(g[["__n", "__i", "__k"]]), "__n long")
        return scratch.table(whole, "settled"), undecided.limit(0)
    ends = undecided.filter(F.col("__i").isNotNull()).select((F.col("__i") * 2).alias("a"), (F.col("__k") * 2 + 1).alias("b"))
    roots = components(ends, scratch).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    node = F.col("__k") * 2 + 1
    grouped = undecided.withColumn("__node", node).join(roots, "__node", "left").withColumn(
        "__root", F.coalesce("__root", "__node")).drop("__node")
    grouped = scratch.table(grouped, "grouped")
    large = grouped.groupBy("__root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > settled_rows).select("__root")
    large = scratch.table(large, "large")
    small = grouped.join(large, "__root", "left_anti").groupBy("__root").applyInPandas(
        lambda g: _settle(g[["__n", "__i", "__k"]]), "__n long")
    return scratch.table(small, "settled"), scratch.table(
        grouped.join(large, "__root", "left_semi").select("__n", "__i", "__k"), "undecided")


def dedupe_greedy(df: DataFrame, row_id: str = "job_id", keys: list[str] = V.BUSINESS_KEY, pos: str = "pos",
                  hot_rows: int = HOT_ROWS, first_rounds: int = FIRST_ROUNDS, settled_rows: int = SETTLED_ROWS) -> DataFrame:
    """In order of ``pos``, keep a row unless its id or its business key is already kept.

    A dropped row blocks nothing, so two plain duplicate removals give another answer. Rows that share both id and key
    reduce to their first at once. What is left gets numbers in order, and ids and keys are replaced by the number of
    their first row, so that the work is on three integers. In a round, an undecided row that is first both in its id and
    in its key is kept, and rows that share an id or key with a kept row are dropped; blank ids block nothing. After a few
    rounds, the rest is cut into groups that are connected by ids and keys: small ones are settled in one step each, only
    larger ones go on in rounds. Each round keeps at least the smallest number, so it ends.

    Until it is known what is kept, only ids, keys and ``pos`` are moved; ``df`` is read again for the rows, which move once.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    floats = {c for c in keys if kinds[c] in ("float", "double")}
    # As text, numbers that Spark takes for equal are equal. Then, and with the type that a stored key has, rows that have been moved by
    # the key need not be moved again for the join.
    key = F.struct(*[(F.col(c).cast("double") + 0.0).cast("string").alias(c) if c in floats else F.col(c) for c in keys])
    key = key.cast(f"struct<{', '.join(f'`{c}`: {'string' if c in floats else kinds[c]}' for c in keys)}>")
    marked = df.select(*[c for c in df.columns if c not in keys or c in floats or c == row_id],
                       F.coalesce(F.col(row_id), F.lit("")).alias("__own"), key.alias("__key"))
    group = ["__own", "__key"]
    scratch = Scratch(spark, "greedy")
    hot = hot_hashes(marked, ["__own"], hot_rows)

    def firsts(part: DataFrame) -> DataFrame:
        return top_per_group(part, group, [F.col(pos).asc_nulls_last()], 1, "__rank").drop("__rank")

    with shuffles_removed(spark):
        pairs = grouped(marked.select(*group, pos), group, firsts, ["__own"], hot=hot)
        kept = stored(_kept_groups(pairs, pos, scratch, hot_rows, first_rounds, settled_rows), "kept")
    scratch.drop()
    found = grouped(marked, group, lambda part: firsts(part).join(kept, group, "left_semi"), ["__own"], hot=hot)
    own = {c: F.col(f"__key.`{c}`").alias(c) for c in keys if c not in floats and c != row_id}
    return found.select(*[own.get(c, F.col(f"`{c}`")) for c in df.columns])


def _kept_groups(pairs: DataFrame, pos: str, scratch: Scratch, hot_rows: int, first_rounds: int, settled_rows: int) -> DataFrame:
    """``__own, __key`` of the rows kept, from the first row of each of these; an id is "" where it is blank. Each step is written, and what it was made from goes, so that
    rows lie on disk once or twice at a time."""
    spark, size = pairs.sparkSession, F.count(F.lit(1)).alias("n")
    early, named = Scratch(spark, "greedy-pairs"), Scratch(spark, "greedy-names")
    firsts = number_rows(early.table(pairs, "pairs"), [pos], "__n", scratch, ["__own", "__key"])
    early.drop()
    facts = firsts.withColumn("__own", F.nullif("__own", F.lit("")))
    by_id = named.table(facts.groupBy("__own").agg(F.min("__n").alias("__i"), size), "by_id")
    by_key = named.table(facts.groupBy("__key").agg(F.min("__n").alias("__k"), size), "by_key")
    hot_ids, hot = hot_of(by_id, ["__own"], "n", hot_rows), hot_of(by_key, ["__key"], "n", hot_rows)
    with_id = salted_left_join(facts, by_id.filter(F.col("__own").isNotNull()).drop("n"), ["__own"], ["__n"], hot_ids)
    with_id = named.table(with_id.select("__n", "__i", "__key"), "with_id")
    with_key = salted_left_join(with_id, by_key.drop("n"), ["__key"], ["__n"], hot)
    undecided = scratch.table(with_key.select("__n", "__i", "__k"), "undecided")
    named.drop()
    # The same groups by number. They only shrink from round to round, so the heavy ones are looked up once.
    hot_ids = None if hot_ids is None else hot_keys(undecided, ["__i"], hot_rows)
    hot = None if hot is None else hot_keys(undecided, ["__k"], hot_rows)
    kept, rounds = [], 0
    while not undecided.isEmpty():
        if rounds == first_rounds:
            settled, undecided = _settle_small(undecided, scratch, settled_rows)
            kept.append(settled)
        else:
            winners, undecided = _round(undecided, scratch, hot_ids, hot)
            kept.append(winners)
        rounds += 1
    every = firsts.select("__n").limit(0)
    for part in kept:
        every = every.unionByName(part)
    return firsts.join(every, "__n", "left_semi").select("__own", "__key")


def upsert_keep(existing: DataFrame, incoming: DataFrame, key: str = "job_id", pos: str = "pos") -> DataFrame:
    """All existing rows, then the first incoming row of every key that is new. A null key counts as ``""``."""
    named = incoming.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    known = existing.select(F.coalesce(F.col(key), F.lit("")).alias(key)).distinct()
    fresh = first_per_key(named, [key], pos).join(known, key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_override(existing: DataFrame, incoming: DataFrame, key: str = "job_id", pos: str = "pos") -> DataFrame:
    """Last row per key over existing, then incoming; ``pos`` becomes the place where the key was first seen.

    Rows without a key are dropped.
    """
    columns = [c for c in existing.columns if c != pos]
    both = (
        existing.withColumn("__at", F.struct(F.lit(0).alias("source"), F.col(pos).alias("pos")))
        .unionByName(incoming.withColumn("__at", F.struct(F.lit(1).alias("source"), F.col(pos).alias("pos"))))
        .filter(F.coalesce(F.col(key), F.lit("")) != "")
    )
    latest = both.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in columns if c != key]), F.col("__at")).alias("__row"),
        F.min("__at").alias("__at"),
    )
    picked: list[Column] = [F.col(c) if c == key else F.col(f"__row.`{c}`").alias(c) for c in columns]
    return latest.select(*picked, F.col("__at").alias(pos))
