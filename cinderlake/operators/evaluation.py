"""Pooled metrics, confusion tables, grouped bootstrap and decisions over metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators.numbering import numbered


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def pooled_f1(rows: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, precision, recall, f1, summed over all pixels before any ratio is taken."""
    t, p = F.col(truth), F.col(pred)
    sums = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn), "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn)})


def iou(tp: Column, fp: Column, fn: Column) -> Column:
    """Intersection over union; null for an empty union."""
    return F.when(tp + fp + fn != 0, tp / (tp + fp + fn))


def confusion(rows: DataFrame, by: list[str], classes: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Rows (by, truth, pred, n) over valid pixels, zeros included. A class out of range is an error."""
    within = lambda c: F.when(F.col(c).between(0, classes - 1), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("class out of range: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int"))
    counts = rows.where("valid").withColumns({truth: within(truth), pred: within(pred)}).groupBy(*by, truth, pred).agg(F.count("*").alias("n"))
    grid = [F.struct(F.lit(t).alias(truth), F.lit(p).alias(pred)) for t in range(classes) for p in range(classes)]
    dense = rows.select(*by).distinct().withColumn("_g", F.explode(F.array(*grid))).select(*by, f"_g.{truth}", f"_g.{pred}")
    return dense.join(counts, [*by, truth, pred], "left").fillna(0, ["n"])


def class_ious(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, class, iou) from a confusion table; null for classes that are in neither."""
    truth = table.groupBy(*by, F.col("truth").alias("class")).agg(F.sum("n").alias("t"))
    pred = table.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("p"))
    both = table.where("truth = pred").select(*by, F.col("truth").alias("class"), F.col("n").alias("i"))
    joined = truth.join(pred, [*by, "class"]).join(both, [*by, "class"])
    union = F.col("t") + F.col("p") - F.col("i")
    return joined.select(*by, "class", F.when(union != 0, F.col("i") / union).alias("iou"))


def burn_score(table: DataFrame, by: list[str]) -> DataFrame:
    """Burn IoU (any class above 0), mean IoU of the severity classes that are present, and both weighted."""
    burn = table.groupBy(*by).agg(
        F.sum(F.when((F.col("truth") > 0) & (F.col("pred") > 0), F.col("n")).otherwise(0)).alias("i"),
        F.sum(F.when((F.col("truth") > 0) | (F.col("pred") > 0), F.col("n")).otherwise(0)).alias("u"),
    )
    sev = class_ious(table, by).where("class > 0").groupBy(*by).agg(F.avg("iou").alias("severity_miou"))
    out = burn.join(sev, by).withColumn("burn_iou", F.when(F.col("u") != 0, F.col("i") / F.col("u")))
    return out.select(*by, "burn_iou", "severity_miou", ((F.col("burn_iou") * 0.35 + F.col("severity_miou") * 0.30) / 0.65).alias("weighted"))


def gated(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, if no row is bad; the check runs now, as an action of its own."""
    if not df.where(bad).isEmpty():
        raise ValueError(message)
    return df


def group_sums(rows: DataFrame, group: str, model: str = "model") -> DataFrame:
    return rows.groupBy(group, model).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def draw(kind: str, number: Column, place: Column, n: Column) -> Column:
    """A place from 1 to n, drawn with replacement: the remainder of a hash, so that reruns and other engines agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(kind), number.cast("string"), place.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") % n + 1


def drawn_groups(groups: DataFrame, draws: int, kind: str) -> DataFrame:
    """Rows (draw, place): for each draw as many places, from 1, as there are groups.

    groups: one row per group. The places of all draws are made in parallel, draws x groups rows."""
    n = groups.count()
    picks = groups.sparkSession.range(draws * n).select((F.floor(F.col("id") / F.lit(n)) + 1).alias("draw"), (F.col("id") % n + 1).alias("pick"))
    return picks.select("draw", draw(kind, F.col("draw"), F.col("pick"), F.lit(n)).alias("place"))


def paired_bootstrap(rows: DataFrame, first: str, second: str, group: str = "group_id", draws: int = 1000, kind: str = "pairs") -> DataFrame:
    """IoU of `second` less that of `first`, with a 95 % interval over resampled groups, and a verdict.

    Groups are drawn with replacement; a draw's counts are the sums of its groups', and each draw is an aggregate of its
    own, so no table of groups or draws is in one task. A draw without a pixel in either is an error, as is a negative count."""
    total = lambda model, c: F.sum(F.when(F.col("model") == model, F.col(c)).otherwise(0)).alias(f"{c}_{'ab'[model == second]}")
    own = rows.where(F.col("model").isin(first, second)).groupBy(group).agg(*[total(m, c) for m in (first, second) for c in ("tp", "fp", "fn")])

    def ratio(k: str) -> Column:
        union = F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col(f"fn_{k}")
        return F.when(union > 0, F.col(f"tp_{k}") / union).otherwise(F.raise_error(F.lit("IoU of an empty union")).cast("double"))

    gated(rows, ~F.coalesce((F.col("tp") >= 0) & (F.col("fp") >= 0) & (F.col("fn") >= 0), F.lit(False)), "counts must be there and not negative")
    return resampled(own, group, [f"{c}_{k}" for k in "ab" for c in ("tp", "fp", "fn")], ratio("b") - ratio("a"), draws, kind)


def resampled(own: DataFrame, group: str, sums: list[str], delta: Column, draws: int, kind: str) -> DataFrame:
    """One row (groups, delta, low, high, verdict): a difference of two scores over summed columns, with a 95 % interval.

    own: one row per group. Groups are drawn with replacement; a draw's columns are the sums of its groups', and each draw
    is an aggregate of its own, so no table of groups or draws is in one task, nor on the driver: the groups' join is by merge."""
    own = numbered(own, group, out="place")
    gated(own.agg(F.count("*").alias("n")), F.col("n") < 2, "a comparison needs at least two groups")
    added = [F.sum(c).alias(c) for c in sums]
    each = drawn_groups(own, draws, kind).join(own.hint("merge"), "place").groupBy("draw").agg(*added).select(delta.alias("d"))
    ends = each.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    whole = own.agg(F.count("*").alias("groups"), *added).select("groups", delta.alias("delta"))
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("inconclusive")
    return whole.crossJoin(F.broadcast(ends)).withColumn("verdict", verdict)  # one row each


def severity_miou(prefix: str, classes: int = 4) -> Column:
    """Mean IoU of the classes above 0 from columns prefix_truth_pred; a class that is in neither raises."""
    cell = lambda t, p: F.col(f"{prefix}_{t}_{p}")
    out = F.lit(0.0)
    for k in range(1, classes):
        union = sum((cell(k, j) + cell(j, k) for j in range(classes) if j != k), cell(k, k))
        out = out + F.when(union > 0, cell(k, k) / union).otherwise(F.raise_error(F.lit(f"class {k} is absent")).cast("double"))
    return out / (classes - 1)


def severity_bootstrap(tables: DataFrame, group: str, first: str, second: str, classes: int = 4, draws: int = 2000, kind: str = "severity") -> DataFrame:
    """paired_bootstrap of the mean IoU of severity classes. tables: group, model, truth, pred, n."""
    cells = [(k, t, p) for k in "ab" for t in range(classes) for p in range(classes)]
    one = lambda k, t, p: F.sum(F.when((F.col("model") == (second if k == "b" else first)) & (F.col("truth") == t) & (F.col("pred") == p), F.col("n")).otherwise(0)).alias(f"{k}_{t}_{p}")
    own = tables.groupBy(group).agg(*[one(*c) for c in cells])
    return resampled(own, group, [f"{k}_{t}_{p}" for k, t, p in cells], severity_miou("b", classes) - severity_miou("a", classes), draws, kind)


def f1_bootstrap(rows: DataFrame, unit: str, first: str, second: str, draws: int = 2000, kind: str = "f1") -> DataFrame:
    """paired_bootstrap of F1 over single units (chips) of counts per model."""
    total = lambda model, c: F.sum(F.when(F.col("model") == model, F.col(c)).otherwise(0)).alias(f"{c}_{'ab'[model == second]}")
    own = rows.where(F.col("model").isin(first, second)).groupBy(unit).agg(*[total(m, c) for m in (first, second) for c in ("tp", "fp", "fn")])
    f1 = lambda k: ratio_or_zero(2 * F.col(f"tp_{k}"), 2 * F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col(f"fn_{k}"))
    return resampled(own, unit, [f"{c}_{k}" for k in "ab" for c in ("tp", "fp", "fn")], f1("b") - f1("a"), draws, kind)


def window_bootstrap(rows: DataFrame, unit: str, draws: int = 1000, kind: str = "windows") -> DataFrame:
    """Pooled IoU of b less that of a over windows, with its interval; better only if the difference itself is above 0.

    rows: unit, inter_a, union_a, inter_b, union_b, one row per window."""
    ratio = lambda k: F.when(F.col(f"union_{k}") > 0, F.col(f"inter_{k}") / F.col(f"union_{k}"))
    out = resampled(rows, unit, [f"{c}_{k}" for k in "ab" for c in ("inter", "union")], ratio("b") - ratio("a"), draws, kind)
    verdict = F.when((F.col("delta") > 0) & (F.col("low") > 0), "better").when(F.col("high") < 0, "worse").otherwise("level")
    return out.withColumn("verdict", verdict)


def group_influence(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Per model and group: IoU of all, IoU without the group, and the difference."""
    own = group_sums(rows, group)
    total = own.groupBy("model").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    joined = own.join(total, "model")
    whole = iou(F.col("all_tp"), F.col("all_fp"), F.col("all_fn"))
    rest = iou(F.col("all_tp") - F.col("tp"), F.col("all_fp") - F.col("fp"), F.col("all_fn") - F.col("fn"))
    return joined.select("model", group, whole.alias("iou"), rest.alias("iou_without"), (whole - rest).alias("influence"))


def error_report(rows: DataFrame, sample: str = "sample_id", group: str = "group_id") -> DataFrame:
    """Per model: totals, IoU, missed samples and groups, and whether all models saw the same truth in each sample."""
    # one pass over the rows gives the groups' sums, which give the models'
    missed = (F.col("tp") == 0) & (F.col("fn") > 0)
    own = rows.groupBy(group, "model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count_if(missed).alias("missed_samples"))
    sums = own.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "missed_samples")], F.count_if(missed).alias("missed_groups"))
    seen = rows.groupBy(sample).agg((F.min(F.col("tp") + F.col("fn")) == F.max(F.col("tp") + F.col("fn"))).alias("same")).agg(F.bool_and("same").alias("shared_truth"))
    return sums.crossJoin(F.broadcast(seen)).withColumn("iou", iou(F.col("tp"), F.col("fp"), F.col("fn")))  # one row


def size_bin(ha: Column) -> Column:
    return F.when(ha < 1, F.raise_error(F.lit("area below 1 ha")).cast("string")).when(ha < 25, "1-25").when(ha < 250, "25-250").otherwise("250+")


def class_weights(counts: DataFrame, most: float = 4.0) -> DataFrame:
    """Weights in proportion to 1/sqrt(n), with mean 1, capped."""
    raw = counts.withColumn("r", 1 / F.sqrt("n"))
    mean = raw.agg(F.avg("r").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("class", F.least(F.col("r") / F.col("m"), F.lit(most)).alias("weight"))  # one row


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """Expected calibration error and sharpness over equal bins; 1 falls into the last."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"), F.sum(F.col(p) * (1 - F.col(p))).alias("v"))
    return per.agg((F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("n")) / F.sum("n")).alias("ece"), (F.sum("v") / F.sum("n")).alias("sharpness"))


def q_statistic(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Double faults and Yule's Q of two members' correctness."""
    x, y = F.col(a), F.col(b)
    n = rows.agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"), F.count("*").alias("n"))
    same, other = F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01")
    return n.select((F.col("n00") / F.col("n")).alias("double_fault"), F.when(same + other != 0, (same - other) / (same + other)).alias("q"))


def best_cutoff(rows: DataFrame, score: str, truth: str, cutoffs: list[float]) -> DataFrame:
    """The cutoff of largest F1; of equal ones the largest."""
    spread = rows.select(score, truth, F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"))
    scored = pooled_f1(spread.withColumn("pred", F.col(score) >= F.col("cutoff")).withColumn("truth", F.col(truth)), ["cutoff"])
    return scored.orderBy(F.desc("f1"), F.desc("cutoff")).limit(1)


def decision(metrics: DataFrame, required: list[str]) -> DataFrame:
    """One row (passed, missing): passed only if all required metrics are there and hold; nulls don't hold.

    metrics: name, ok."""
    want = metrics.sparkSession.createDataFrame([(x,) for x in required], "name string")
    joined = want.join(metrics, "name", "left")
    return joined.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("passed"), F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("name")))).alias("missing"))


def spectral_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    fine = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(fine, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return rows.groupBy(*by).agg(q.alias("_q"), F.count_if(fine.isNull()).alias("undefined")).select(*by, F.get("_q", F.lit(0)).alias("q10"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q90"), "undefined")


def retention(original: DataFrame, survivors: DataFrame, accepted: float = 0.7) -> DataFrame:
    """Share of the original events that survive, a lower bound as missing ones count as lost."""
    joined = original.select("event_key").distinct().join(survivors.select("event_key", F.lit(1).alias("s")).distinct(), "event_key", "left")
    return joined.agg(F.count("*").alias("events"), F.count("s").alias("kept")).withColumn("bound", ratio_or_zero(F.col("kept"), F.col("events"))).withColumn("accepted", F.col("bound") >= accepted)


def attribute(rows: DataFrame, classes: int = 4) -> DataFrame:
    """Counts by raw code, truth and prediction, with each code's share of all errors. Codes are whole numbers from 0 on and
    predictions the classes from 0 on, so that the counts by code add up to those of all; anything else is an error."""
    fine = (F.col("raw") >= 0) & (F.col("raw") == F.floor("raw")) & F.col("pred").isin(*range(classes))
    gated(rows, ~F.coalesce(fine, F.lit(False)), "invalid raw code or prediction")
    counts = rows.groupBy("raw", "truth", "pred").agg(F.count("*").alias("n"))
    wrong = F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0)
    w = Window.partitionBy("raw")
    total = counts.agg(F.sum(wrong).alias("errors"))
    return counts.withColumn("raw_errors", F.sum(wrong).over(w)).crossJoin(F.broadcast(total)).withColumn("share", ratio_or_zero(F.col("raw_errors"), F.col("errors"))).drop("errors")


def pixel_survival(pixels: DataFrame, proof: str, valid: str, by: str) -> DataFrame:
    """Per sample: whether a pixel of the known event (1) survives, its protected pixels (2) and how many of them are lost."""
    p = F.col(proof)
    gated(pixels, ~F.coalesce(p.isin(0, 1, 2), F.lit(False)), "proof codes are 0, 1 and 2")
    return pixels.groupBy(by).agg(F.coalesce(F.bool_or((p == 1) & F.col(valid)), F.lit(False)).alias("known_event_survives"), F.count_if(p == 2).alias("protected_pixels"), F.count_if((p == 2) & ~F.col(valid)).alias("lost_protected_pixels"))


def false_positive_share(rows: DataFrame, by: str = "model") -> DataFrame:
    """False positives over the known background pixels. rows: by, fp, valid_pixels, tp, fn."""
    return rows.groupBy(by).agg(ratio_or_zero(F.sum("fp"), F.sum(F.col("valid_pixels") - F.col("tp") - F.col("fn"))).alias("fp_share"))


def listing_summary(records: DataFrame, declared: int, countries: list[str]) -> DataFrame:
    """One row over activation records (code, countries, unknown_country, wildfire, activated): how many, of unknown country,
    of the given countries, wildfires among these, and the bounds in time. Another number of records than declared, or a
    code that occurs twice, is an error."""
    checked = records.agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))
    gated(checked, F.col("n") != declared, "incomplete listing")
    gated(checked, F.col("n") != F.col("codes"), "a code occurs twice")
    own = F.exists("countries", lambda c: F.lower(c).isin(*[c.lower() for c in countries]))
    return records.agg(
        F.count("*").alias("records"), F.count_if("unknown_country").alias("unknown_country"), F.count_if(own).alias("declared"), F.count_if(own & F.col("wildfire")).alias("declared_wildfires"),
        F.min("activated").alias("first"), F.max("activated").alias("last"),
    )


def band_statistics(pixels: DataFrame, value: str, position: str = "pos", every: int = 37, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of every 37th pixel, a fixed grid of them."""
    return pixels.where((F.col(position) - 1) % every == 0).groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def visibility(observations: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, decision). A frame is assessable with two usable dates at least that span 14 days; it is supported if one of
    them separates. Fewer than two assessable frames tell nothing; two supported ones pass.

    observations: sample_id, taken, usable, extra_separation; samples: sample_id."""
    used = observations.where(F.coalesce("usable", F.lit(False))).groupBy("sample_id").agg(
        F.countDistinct("taken").alias("usable_dates"), ((F.unix_micros(F.max("taken")) - F.unix_micros(F.min("taken"))) / 86_400_000_000).alias("span_days"), F.bool_or("extra_separation").alias("_extra")
    )
    frames = samples.join(used, "sample_id", "left").fillna(0, ["usable_dates"])
    frames = frames.withColumn("assessable", (F.col("usable_dates") >= 2) & F.coalesce(F.col("span_days") >= 14, F.lit(False)))
    frames = frames.withColumn("supported", F.col("assessable") & F.coalesce("_extra", F.lit(False))).drop("_extra")
    sums = frames.agg(F.count_if("assessable").alias("assessable_frames"), F.count_if("supported").alias("supported_frames"))
    status = F.when(F.col("assessable_frames") < 2, "INSUFFICIENT_EVIDENCE").when(F.col("supported_frames") >= 2, "PASS").otherwise("FAIL")
    return frames, sums.withColumn("status", status)


def lags(rows: DataFrame, source: str, taken: str, published: str) -> DataFrame:
    """Per source: scenes, median and 90 % of the hours from taking to publication."""
    hours = (F.unix_micros(published) - F.unix_micros(taken)) / 3_600_000_000
    return rows.withColumn("_h", hours).groupBy(source).agg(F.count("_h").alias("n"), F.percentile("_h", 0.5).alias("median_h"), F.percentile("_h", 0.9).alias("p90_h"))
