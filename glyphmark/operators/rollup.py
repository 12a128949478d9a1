"""Group statistics over score rows: by stratum and over all, in one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups of more than WHOLE values look for an order statistic only between sketched bounds, MARGIN of all ranks to either side.
WHOLE, MARGIN, ACCURACY = 2_000, 0.002, 10_000
RATE = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))


def p95_exclusive(values: Column) -> Column:
    """The exclusive 95th of 100 quantiles of an array without nulls: null for none, the value for one; it may lie above the maximum."""
    d, n = F.array_sort(values), F.size(values)
    m = n + 1
    j = F.greatest(F.lit(1), F.least(F.floor(95 * m / 100), n - 1)).cast("int")
    delta = (95 * m - 100 * j).cast("double")
    return F.when(n == 1, F.get(d, F.lit(0))).when(n > 1, (F.get(d, j - 1) * (100 - delta) + F.get(d, j) * delta) / 100)


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """__total, __key, median, p95: exact quantiles by one column and (where __total) over all, nulls left out; p95 is the exclusive one.

    A mergeable sketch bounds each quantile's place.  Equal values are counted before the
    shuffle, all below the bounds become one row, and only the few between them are put in
    order, so no group is held in one task.  A group without values has no row.
    """
    part = lambda total, key: F.struct(F.lit(total).alias("__total"), key.cast("string").alias("__key"))
    sides = rows.where(F.col(value).isNotNull()).select(F.explode(F.array(part(False, F.col(by)), part(True, F.lit(None)))).alias("s"), F.col(value).cast("double").alias("v")).select("s.*", "v")
    places = [f + d for f in (0.5, 0.95) for d in (-MARGIN, MARGIN)]
    found = sides.groupBy("__total", "__key").agg(F.count("*").alias("n"), F.percentile_approx("v", places, ACCURACY).alias("q"))
    n = F.col("n")
    ranks = (F.floor((n + 1) / 2), F.greatest(F.lit(1), F.least(F.floor(95 * (n + 1) / 100), n - 1)))
    wide = lambda k: F.when(n > WHOLE, F.get("q", F.lit(k)))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("rank"), wide(2 * k).alias("lo"), wide(2 * k + 1).alias("hi")) for k, r in enumerate(ranks)])
    limits = found.select(F.col("__total").alias("t"), F.col("__key").alias("g"), "n", F.explode(wanted).alias("x")).select("t", "g", "n", "x.*")
    counted = sides.groupBy("__total", "__key", "v").agg(F.count("*").alias("c"))
    near = counted.join(limits, (F.col("__total") == F.col("t")) & F.col("__key").eqNullSafe(F.col("g"))).where("hi IS NULL OR v <= hi")
    near = near.groupBy("__total", "__key", "k", "n", "rank", F.when(F.col("v") < F.col("lo"), None).otherwise(F.col("v")).alias("v")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__total", "__key", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k, r: F.max(F.when((F.col("k") == k) & (F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("v")))
    rank = F.col("rank")
    picked = near.withColumn("upto", upto).groupBy("__total", "__key", "n").agg(at(0, rank).alias("m0"), at(0, rank + 1).alias("m1"), at(1, rank).alias("p0"), at(1, rank + 1).alias("p1"), F.max(F.when(F.col("k") == 1, rank)).alias("j"))
    delta = (95 * (n + 1) - 100 * F.col("j")).cast("double")
    median = F.when(n % 2 == 1, F.col("m0")).otherwise((F.col("m0") + F.col("m1")) / 2)
    p95 = F.when(n == 1, F.col("p0")).otherwise((F.col("p0") * (100 - delta) + F.col("p1") * delta) / 100)
    return picked.select("__total", "__key", median.alias("median"), p95.alias("p95"))


def grouped(scores: DataFrame, by: str, *aggregates: Column, told: bool = False) -> DataFrame:
    """Aggregates by one column and over all; the total's group is 'ALL', told by grouping() and not by null, and kept as __total if `told`.

    Grouping sets give no total for no rows; a row of the aggregates over nothing, which
    costs no scan, stands in for it.
    """
    sets = scores.groupingSets([[by], []], by)
    rows = sets.agg(F.grouping(by).alias("__all"), *aggregates).withColumn("grp", F.when(F.col("__all") == 1, "ALL").otherwise(F.col(by))).drop(by)
    nothing = scores.limit(0).agg(F.lit(2).cast("byte").alias("__all"), *aggregates).withColumn("grp", F.lit("ALL"))
    order = Window.partitionBy("grp", F.col("__all") > 0).orderBy("__all")
    out = rows.unionByName(nothing).withColumn("__first", F.row_number().over(order)).where("__first = 1")
    return (out.withColumn("__total", F.col("__all") > 0) if told else out).drop("__first", "__all")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def _costs(scores: DataFrame) -> list[Column]:
    """Sum and mean of the column `cost`, where there is one: 0 and null for no image."""
    if "cost" not in scores.columns:
        return []
    spent = F.coalesce(F.sum("cost"), F.lit(0.0))
    return [spent.alias("cost_sum"), F.try_divide(spent, F.count("*").cast("double")).alias("cost_mean")]


def _diagnostics(scores: DataFrame) -> list[Column]:
    """Macro means of `cer` and `wer` over the images that have one, and the censored characters; never a ranking signal."""
    if not {"cer", "wer"} <= set(scores.columns):
        return []
    chars = F.struct(total("keep_chars_total").alias("total"), total("keep_chars_censored").alias("censored"))
    return [F.avg("cer").alias("cer_mean"), F.avg("wer").alias("wer_mean"), F.count("cer").alias("n_cer_images"), chars.alias("char_censor")]


def run_summary(scores: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """The headline table: redaction and exact rates over KEEP tokens, found and added counts, floor, latency, and where
    scores have the columns cost (dollars), cer and wer, their sums and means.

    latencies: stratum and elapsed of the same images, where that is cheaper to read again than the scores.
    """
    out = grouped(
        scores, "stratum", F.count("*").alias("n_images"), total("keep_total").alias("keep_total"), total("false_redaction_count").alias("false_redaction_count"), total("keep_exact_match_count").alias("keep_exact_match_count"),
        total("found_count").alias("found_count"), total("omission_count").alias("omission_count"), total("gt_total").alias("gt_total"), total("added_count").alias("added_count"),
        F.count_if("negative_control").alias("n_blank"), total("floor_count").alias("floor_count"), F.round(F.avg("elapsed"), 6).alias("latency_mean"),
        F.count_if(F.col("keep_exact_match_all")).alias("images_all_exact"), *_costs(scores), *_diagnostics(scores), told=True,
    )
    q = quantiles(scores if latencies is None else latencies, "stratum", "elapsed").select(F.col("__total").alias("__t"), "__key", F.col("median").alias("latency_median"), F.col("p95").alias("latency_p95"))
    out = out.join(q, (F.col("__total") == F.col("__t")) & (F.col("__total") | F.col("grp").eqNullSafe(F.col("__key"))), "left").drop("__total", "__t", "__key")
    if "char_censor" in out.columns:
        out = out.withColumns({"char_censor_rate": RATE(F.col("char_censor.censored"), F.col("char_censor.total")), "keep_chars_total": F.col("char_censor.total"), "keep_chars_censored": F.col("char_censor.censored")}).drop("char_censor")
    return out.withColumns({"false_redaction_rate": RATE(F.col("false_redaction_count"), F.col("keep_total")), "keep_exact_rate": RATE(F.col("keep_exact_match_count"), F.col("keep_total")), "floor_per_image": RATE(F.col("floor_count"), F.col("n_blank"))})


def detection_view(scores: DataFrame) -> DataFrame:
    """Recall and precision over boxed images with text, the floor over boxed blanks; what is left out is counted."""
    able = ~F.col("box_free") & F.col("iou_thr").isNotNull()
    text = able & ~F.col("negative_control")
    blank = able & F.col("negative_control")
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    out = grouped(
        scores, "stratum", F.count_if(text).alias("n_text"), F.count_if(blank).alias("n_blank"), F.count_if(F.col("box_free")).alias("n_box_free"), F.count_if(~F.col("box_free") & F.col("iou_thr").isNull()).alias("n_no_matcher"),
        pick(text, "found_count").alias("found"), pick(text, "gt_total").alias("tokens"), pick(text, "added_count").alias("added"), pick(blank, "floor_count").alias("floor"),
        F.when(F.count_distinct(F.struct("iou_thr")) == 1, F.max("iou_thr")).alias("common_iou_thr"),
    )
    out = out.withColumns({"recall": RATE(F.col("found"), F.col("tokens")), "precision": RATE(F.col("found"), F.col("found") + F.col("added")), "floor_per_image": RATE(F.col("floor"), F.col("n_blank"))})
    left_out = F.col("n_box_free") + F.col("n_no_matcher")
    more = F.when(left_out > 0, F.format_string("; %d left out", left_out)).otherwise("")
    why = F.when((F.col("n_box_free") > 0) & (F.col("n_no_matcher") == 0), "box-free output").when((F.col("n_no_matcher") > 0) & (F.col("n_box_free") == 0), "no matcher ran").otherwise(F.format_string("%d box-free, %d without a matcher", "n_box_free", "n_no_matcher"))

    def reason(rate: str, nothing: str) -> Column:
        """Which zero a missing rate comes from."""
        none = F.when(left_out + F.col("n_text") + F.col("n_blank") == 0, "no image").when(F.col("n_text") + F.col("n_blank") == 0, why)
        none = none.when(F.col("n_text") > 0, F.concat(F.lit(nothing), more)).otherwise(F.concat(F.format_string("all %d boxed images are blank", "n_blank"), more))
        return F.when(F.col(rate).isNull(), none)

    return out.withColumns({"recall_na": reason("recall", "no ground-truth tokens"), "precision_na": reason("precision", "nothing predicted")})
