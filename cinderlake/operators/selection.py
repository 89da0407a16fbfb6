"""Splits, folds, balanced and greedy selection; every order is a hash's, so reruns agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.hashing import hex_mod, salted
from cinderlake.operators.joins import overlapping
from cinderlake.operators.numbering import numbered
from cinderlake.staging import discard, staged


def ranked(ids: DataFrame, salt: str, key: str) -> DataFrame:
    """ids with rank from 1 by salted hash."""
    return numbered(ids.withColumn("_h", salted(salt, F.col(key))), "_h", key, out="rank").drop("_h")


def split_by_fire(chips: DataFrame, share: float, salt: str, fire: str = "fire") -> DataFrame:
    """chips with partition: the first max(1, round(n share)) of them by hash are 'val' (halves round to even)."""
    groups = chips.select(fire).distinct()
    n = groups.agg(F.count("*").alias("_n"))
    cut = F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(share)))
    marked = ranked(groups, salt, fire).crossJoin(F.broadcast(n)).select(fire, F.when(F.col("rank") <= cut, "val").otherwise("train").alias("partition"))  # one row
    return chips.join(marked, fire)


def three_way(ids: DataFrame, holdout: float, val: float, salt: str, key: str) -> DataFrame:
    n = ids.agg(F.count("*").alias("_n"))
    a = F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(holdout)))
    b = a + F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(val)))
    part = F.when(F.col("rank") <= a, "holdout").when(F.col("rank") <= b, "val").otherwise("train")
    return ranked(ids, salt, key).crossJoin(F.broadcast(n)).withColumn("partition", part).drop("_n", "rank")  # one row


def folds(ids: DataFrame, k: int, salt: str, key: str) -> DataFrame:
    """ids with fold: every k-th by hash."""
    return ranked(ids, salt, key).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank")


def calibration_part(folded: DataFrame, fold: int, share: float, key: str, salt: str) -> DataFrame:
    """The other folds' ids with calibration: the first share of them by another hash, salted by `salt` and the fold."""
    rest = folded.where(F.col("fold") != fold)
    n = rest.agg(F.count("*").alias("_n"))
    cut = F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(share)))
    return ranked(rest, f"{salt}:{fold}", key).crossJoin(F.broadcast(n)).withColumn("calibration", F.col("rank") <= cut).drop("rank", "_n")  # one row


def hash_partition(key: Column) -> Column:
    """60 / 20 / 20 by the hash's remainder."""
    m = hex_mod(F.sha2(key.cast("string"), 256), 10)
    return F.when(m < 6, "train").when(m < 8, "val").otherwise("test")


def balanced(rows: DataFrame, group: str, bin_: str, key: str, per_group: int, most: int, salt: str) -> DataFrame:
    """At most per_group rows of each group, its bins in turn; then the groups in turn, `most` rows in all."""
    h = salted(salt, F.col(key))
    in_bin = F.row_number().over(Window.partitionBy(group, bin_).orderBy("_h", key))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_r", bin_, "_h", key))
    picked = rows.withColumn("_h", h).withColumn("_r", in_bin).withColumn("turn", turn).where(F.col("turn") <= per_group)
    return picked.withColumn("_g", salted(salt, F.col(group))).orderBy("turn", "_g", "_h", key).limit(most).drop("_h", "_r", "_g")


def hard_background(rows: DataFrame, score: str, key: str, share: float = 0.25) -> DataFrame:
    """rows with weight 2 for the share of largest scores (rounded up), else 1."""
    n = rows.agg(F.count("*").alias("_n"))
    return numbered(rows, F.desc(score), key, out="_k").crossJoin(F.broadcast(n)).withColumn("weight", F.when(F.col("_k") <= F.ceil(F.col("_n") * share), 2).otherwise(1)).drop("_k", "_n")  # one row


def half_hard(rows: DataFrame, by: str, score: str, key: str, budget: int, salt: str) -> DataFrame:
    """Groups of at most `budget` rows whole; of others, the half (rounded down) of largest scores and the rest by hash.

    Of equal scores, and of equal hashes, the smaller keys come first."""
    n = F.count("*").over(Window.partitionBy(by))
    hard = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)) <= budget // 2
    marked = rows.withColumns({"_n": n, "_hard": hard, "_h": salted(salt, F.col(key))})
    turn = F.row_number().over(Window.partitionBy(by, "_hard").orderBy("_h", key))
    kept = (F.col("_n") <= budget) | F.col("_hard") | (F.col("_turn") <= budget - budget // 2)
    return marked.withColumn("_turn", turn).where(kept).drop("_n", "_hard", "_h", "_turn")


def per_class(rows: DataFrame, by: str, class_: str, key: str, most: int, salt: str) -> DataFrame:
    """At most so many rows of each class in each group, by hash."""
    w = Window.partitionBy(by, class_).orderBy(salted(salt, F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def replicated(rows: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its weight says, numbered by copy."""
    return rows.where(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))))


def isolate(candidates: DataFrame, prior: DataFrame, used: DataFrame, most: int, cell: float, ahead: int = 8) -> DataFrame:
    """Candidates in order with a reason: chosen, used_event, prior_overlap, event_taken, chosen_overlap or enough.

    candidates: ordinal (different ones), event, w, s, e, n; prior: w, s, e, n; used: event, which is not to be used again.
    Each candidate is chosen unless an earlier choice has its event or overlaps it, and the first `most` choices stand.

    Choices are made in rounds, each over all candidates that are left: one is chosen once no earlier one that is left has
    its event or overlaps it. Of a grid cell only the `ahead` earliest are compared, and of an event only the earliest is
    looked at, so no group's pairs are listed; what a choice rules out goes at once. The earliest candidate of all is always
    chosen, so rounds end; they stop as soon as `most` choices precede all that is left. A null event is nobody else's."""
    box = ["w", "s", "e", "n"]
    hits = overlapping(candidates.select(F.col("ordinal").alias("id"), *box), prior.select(F.monotonically_increasing_id().alias("id"), *box), cell).select(F.col("a_id").alias("ordinal")).distinct()
    marked = candidates.join(used.select("event").distinct().withColumn("_used", F.lit(True)), "event", "left").join(hits.withColumn("_hit", F.lit(True)), "ordinal", "left")
    known = F.when(F.col("_used"), "used_event").when(F.col("_hit"), "prior_overlap")
    marked = staged(marked.select("ordinal", "event", *box, known.alias("reason")), "marked")
    left = marked.where("reason is null").drop("reason")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    celled = lambda df: df.withColumn("x", span("w", "e")).withColumn("y", span("s", "n"))
    met = lambda a, b: (a["w"] < b["e"]) & (b["w"] < a["e"]) & (a["s"] < b["n"]) & (b["s"] < a["n"])

    def against(rows: DataFrame, choices: DataFrame) -> DataFrame:
        """Rows (ordinal) that overlap one of the choices, which don't overlap each other: few of them share a cell."""
        a, b = celled(rows).alias("a"), celled(choices).alias("b")
        inside = (F.col("a.w") < F.col("b.e")) & (F.col("b.w") < F.col("a.e")) & (F.col("a.s") < F.col("b.n")) & (F.col("b.s") < F.col("a.n"))
        return a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & inside & (F.col("b.ordinal") < F.col("a.ordinal"))).select("a.ordinal").distinct()

    rounds: list[DataFrame] = []
    open_ = left
    while True:
        first = open_.where("event is not null").groupBy("event").agg(F.min("ordinal").alias("ordinal")).select("ordinal").unionByName(open_.where("event is null").select("ordinal"))
        at = F.row_number().over(Window.partitionBy("x", "y").orderBy("ordinal"))
        near = celled(open_.withColumn("cells", (F.floor(F.col("e") / cell) - F.floor(F.col("w") / cell) + 1) * (F.floor(F.col("n") / cell) - F.floor(F.col("s") / cell) + 1)))
        near = near.withColumn("_k", at).where(F.col("_k") <= ahead).groupBy("x", "y").agg(F.collect_list(F.struct("ordinal", "cells", *box)).alias("all"))
        # at most `ahead` in a cell: each looks for an earlier one that it overlaps
        seen = F.transform("all", lambda a: F.struct(a["ordinal"].alias("ordinal"), a["cells"].alias("cells"), F.exists("all", lambda b: (b["ordinal"] < a["ordinal"]) & met(a, b)).alias("blocked")))
        clear = near.select(F.inline(seen)).groupBy("ordinal").agg(F.count("*").alias("_n"), F.max("cells").alias("cells"), F.bool_or("blocked").alias("blocked")).where("_n = cells and not blocked")
        chosen = staged(open_.join(clear.select("ordinal"), "ordinal", "left_semi").join(first, "ordinal", "left_semi"), "chosen")
        rounds.append(chosen)
        gone = against(open_, chosen).unionByName(chosen.select("ordinal"))
        rest = staged(open_.join(gone, "ordinal", "left_anti").join(chosen.where("event is not null").select("event"), "event", "left_anti"), "open")
        if open_ is not left:
            discard(open_)
        open_ = rest
        earliest = open_.agg(F.min("ordinal").alias("least")).first().least
        done = rounds[0].select("ordinal") if len(rounds) == 1 else reduce(lambda a, b: a.unionByName(b), [r.select("ordinal") for r in rounds])
        if earliest is None or done.where(F.col("ordinal") < F.lit(earliest)).count() >= most:
            break
    final = staged(reduce(lambda a, b: a.unionByName(b), rounds).orderBy("ordinal").limit(most), "final")
    for r in (*rounds, open_):
        discard(r)
    others = left.join(final.select("ordinal"), "ordinal", "left_anti")
    taken = others.select("ordinal", "event").join(final.where("event is not null").select("event", F.col("ordinal").alias("_first")), "event").where("_first < ordinal").select("ordinal", F.lit(True).alias("_taken"))
    hit = against(others, final).withColumn("_over", F.lit(True))
    told = others.join(taken, "ordinal", "left").join(hit, "ordinal", "left").select("ordinal", "event", F.when(F.col("_taken"), "event_taken").when(F.col("_over"), "chosen_overlap").otherwise("enough").alias("reason"))
    known = marked.where("reason is not null").select("ordinal", "event", "reason")
    return known.unionByName(final.select("ordinal", "event", F.lit("chosen").alias("reason"))).unionByName(told)


def greedy_members(scores: DataFrame, member: str, key: str, value: str, truth: DataFrame, least_gain: float = 1e-4, most: int = 10) -> list[str]:
    """Forward selection of ensemble members by accuracy of their mean at one half; each step is one aggregate."""
    chosen: list[str] = []
    best = 0.0
    while len(chosen) < most:
        base = scores.where(F.col(member).isin(chosen)).groupBy(key).agg(F.sum(value).alias("b")) if chosen else None
        rest = scores.where(~F.col(member).isin(chosen)) if chosen else scores
        joined = rest.join(base, key) if base is not None else rest.withColumn("b", F.lit(0.0))
        mean = (F.col("b") + F.col(value)) / (len(chosen) + 1)
        step = joined.join(truth, key).groupBy(member).agg(F.avg(((mean >= 0.5) == F.col("truth")).cast("double")).alias("acc")).orderBy(F.desc("acc"), F.desc(member)).first()
        if step is None or step["acc"] - best <= least_gain:
            break
        best = step["acc"]
        chosen.append(step[member])
    return chosen
