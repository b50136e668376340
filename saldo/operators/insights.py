"""Pattern analytics: recurrence, anomalies, forecast, suggestions, freshness. Everything is relative to an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def recurring(rows: DataFrame, keys: list[str], as_of: str, min_support: int = 3) -> DataFrame:
    """Recurrence statistics of each group of rows (date, id, amount, *keys) up to `as_of`.

    confidence: high for min_support rows with a variation of amounts up to .10 and of intervals up to .40, medium for
    min_support rows, else low with the class Abstain. Groups of one row are left out. next_date is the first date at or
    after `as_of` that lies whole median steps after the last one. Rows with a description give `title`, that of the last row by
    date and id. Medians come from counts of distinct values, so that a hot group's rows never meet in one task. Null keys are left out.
    """
    day = F.lit(as_of).cast("date")
    past = rows.filter(F.col("date") <= day)
    amount = F.col("amount").cast("double")
    # Dates of a group are few against its rows: gaps are taken between its distinct dates, each date's other rows have gaps of 0.
    dates = past.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    gaps = dates.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))))
    steps = (gaps.filter("gap is not null").select(*keys, F.col("gap").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
             .unionByName(gaps.filter("n > 1").select(*keys, F.lit(0.0).alias("value"), (F.col("n") - 1).alias("n"))).groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    mid_gap = weighted_median(steps, keys, "median_gap")
    spread = steps.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_gap"), F.sum("n").alias("_k"), F.sum(F.col("value") * F.col("value") * F.col("n")).alias("_squares"))
    sd = F.when(F.col("_k") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("_squares") - F.col("_k") * F.col("mean_gap") * F.col("mean_gap")) / (F.col("_k") - 1)))).otherwise(F.lit(0.0))
    spread = spread.select(*keys, "mean_gap", sd.alias("sd_gap"))
    mid = weighted_median(past.groupBy(*keys, amount.alias("value")).agg(F.count("*").alias("n")), keys, "median_amount")
    last = [F.max_by("description", F.struct("date", "id")).alias("title")] if "description" in rows.columns else []
    g = past.groupBy(*keys).agg(F.count("*").alias("support"), F.avg(amount).alias("mean_amount"), F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("sd_amount"), F.max("date").alias("last_date"), *last).filter("support >= 2")
    for part in (mid, mid_gap, spread):
        g = g.join(part, keys)
    cv = lambda sd, mean: F.when(F.col(mean) > 0, F.col(sd) / F.col(mean)).otherwise(F.lit(0.0))
    step = F.greatest(F.lit(1), F.bround("median_gap").cast("int"))
    nxt = F.date_add("last_date", (step * F.greatest(F.lit(1), F.ceil(F.datediff(day, "last_date") / step).cast("int"))).cast("int"))
    df = g.withColumn("amount_cv", cv("sd_amount", "mean_amount")).withColumn("interval_cv", cv("sd_gap", "mean_gap")).withColumn("step", step).withColumn("next_date", nxt)
    confidence = F.when(F.col("support") < min_support, "low").when((F.col("amount_cv") <= 0.10) & (F.col("interval_cv") <= 0.40), "high").otherwise("medium")
    return df.withColumn("confidence", confidence).withColumn("pattern", F.when(F.col("support") < min_support, "Abstain").otherwise("Recurring"))


def weighted_median(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The exact median (mean of the two middle values) of each group of (value, n), from running counts over its distinct values."""
    w = Window.partitionBy(*keys).orderBy("value")
    up = counts.withColumn("_up", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda k: F.min(F.when(F.col("_up") >= k, F.col("value")))
    return up.groupBy(*keys).agg(((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias(name))


def containments(needles: DataFrame, stacks: DataFrame, size: int = 4) -> DataFrame:
    """(needle, stack) for each non-empty string of `needles` (needle) and each of `stacks` (stack) that contains it.

    One way at every size, by equal keys: a string of `size` characters or more can only stand where its first `size`
    characters do, so it is keyed by these and the other side by each of its distinct runs; contains decides. A shorter
    string is keyed whole and meets the runs of its own length.
    """
    starts = lambda n: F.when(F.length("stack") >= n, F.sequence(F.lit(1), F.length("stack") - n + 1)).otherwise(F.array().cast("array<int>"))
    runs_of = lambda n: F.transform(starts(n), lambda i: F.substring(F.col("stack"), i, F.lit(n)))
    runs = F.explode(F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in range(1, size + 1)]))))
    keyed = needles.filter("needle != ''").distinct().withColumn("key", F.substring("needle", 1, size))
    return keyed.join(stacks.filter("stack != ''").distinct().withColumn("key", runs), "key").filter(F.col("stack").contains(F.col("needle"))).select("needle", "stack")


OPEN_STATUSES = ("Upcoming", "Confirmed", "Tentative")


def match_upcoming(patterns: DataFrame, upcoming: DataFrame, size: int = 4) -> DataFrame:
    """Patterns with the smallest upcoming id whose title contains the merchant or the other way round (null if none). An empty
    string stands in all."""
    titles = upcoming.filter(F.col("status").isin(*OPEN_STATUSES)).groupBy(F.lower("title").alias("title")).agg(F.min("id").alias("upcoming_id")).filter("title is not null")
    names = patterns.select("merchant").filter("merchant is not null").distinct()
    needle, stack = lambda df, c: df.select(F.col(c).alias("needle")), lambda df, c: df.select(F.col(c).alias("stack"))
    inside = containments(needle(names, "merchant"), stack(titles, "title"), size).select(F.col("needle").alias("merchant"), F.col("stack").alias("title")).join(titles, "title")
    around = containments(needle(titles, "title"), stack(names, "merchant"), size).select(F.col("stack").alias("merchant"), F.col("needle").alias("title")).join(titles, "title")
    any_title = names.filter("merchant = ''").crossJoin(F.broadcast(titles.agg(F.min("upcoming_id").alias("upcoming_id"))))  # one row each
    any_name = names.crossJoin(F.broadcast(titles.filter("title = ''").select("upcoming_id")))
    pairs = inside.select("merchant", "upcoming_id").unionByName(around.select("merchant", "upcoming_id")).unionByName(any_title).unionByName(any_name)
    return patterns.join(pairs.groupBy("merchant").agg(F.min("upcoming_id").alias("upcoming_id")), "merchant", "left")


def planned(patterns: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Patterns (merchant, title, ..) with the smallest id of an open upcoming row that stands for them, null if none.

    It does if its normalized title stands in the merchant, the merchant in it (neither empty), or its title as it is, in
    lower case, in the pattern's.
    """
    from saldo.functions.text import normalize_merchant

    due = upcoming.filter(F.col("status").isin(*OPEN_STATUSES) & F.col("title").isNotNull()).select("id", normalize_merchant("title").alias("norm"), F.lower("title").alias("low"))
    norms, lows = (due.groupBy(c).agg(F.min("id").alias("upcoming_id")) for c in ("norm", "low"))
    p = patterns.withColumn("_low", F.lower("title"))
    names, shown = p.select("merchant").distinct(), p.select("_low").distinct()
    one = containments(norms.select(F.col("norm").alias("needle")), names.select(F.col("merchant").alias("stack"))).select(F.col("stack").alias("merchant"), F.col("needle").alias("norm"))
    two = containments(names.select(F.col("merchant").alias("needle")), norms.select(F.col("norm").alias("stack"))).select(F.col("needle").alias("merchant"), F.col("stack").alias("norm"))
    three = containments(lows.select(F.col("low").alias("needle")), shown.select(F.col("_low").alias("stack"))).select(F.col("stack").alias("_low"), F.col("needle").alias("low")).join(lows, "low")
    by_name = one.unionByName(two).join(norms, "norm").groupBy("merchant").agg(F.min("upcoming_id").alias("_a"))
    by_title = three.groupBy("_low").agg(F.min("upcoming_id").alias("_b"))
    every = lows.filter("low = ''").agg(F.min("upcoming_id").alias("_c"))  # an empty title stands in all
    return (p.join(by_name, "merchant", "left").join(by_title, "_low", "left").crossJoin(F.broadcast(every))
            .withColumn("upcoming_id", F.least("_a", "_b", "_c")).drop("_low", "_a", "_b", "_c"))


def anomalies(rows: DataFrame, keys: list[str], as_of: str, min_support: int = 3, lookback: int = 30, least: float = 10_000.0) -> DataFrame:
    """Rows of the last `lookback` days that stand off the median of their group, by the median absolute deviation.

    With a deviation of 0 a row stands off beyond half or one and a half times the median, else beyond three deviations;
    in either case by `least` at least. Both medians are exact, and come from counts of distinct values.
    """
    day = F.lit(as_of).cast("date")
    past = rows.filter(F.col("date") <= day).withColumn("x", F.col("amount").cast("double"))
    values = past.groupBy(*keys, F.col("x").alias("value")).agg(F.count("*").alias("n"))
    support = values.groupBy(*keys).agg(F.sum("n").alias("support")).filter(F.col("support") >= min_support)
    mid = weighted_median(values, keys, "median").join(support, keys)
    diffs = values.join(mid.select(*keys, "median"), keys).groupBy(*keys, F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))
    mad = weighted_median(diffs, keys, "mad")
    off = past.join(mid, keys).withColumn("diff", F.abs(F.col("x") - F.col("median")))
    recent = off.filter(F.col("date") >= F.date_sub(day, lookback)).join(mad, keys)
    far = F.when(F.col("mad") == 0, (F.col("x") > 1.5 * F.col("median")) | (F.col("x") < 0.5 * F.col("median"))).otherwise(F.col("diff") / F.col("mad") >= 3)
    return recent.filter(far & (F.col("diff") >= least))


def forecast(opening: DataFrame, events: DataFrame, as_of: str, horizon: int) -> DataFrame:
    """Cash curve of dated signed amounts in [as_of, as_of + horizon] from a one-row opening balance.

    `events` has (date, seq, signed, kind); within a date confirmed ones (seq) come first. Daily sums are aggregated before
    the running sum, so that the one ordered window sees horizon + 1 rows at most.
    """
    day = F.lit(as_of).cast("date")
    daily = (events.filter((F.col("date") >= day) & (F.col("date") <= F.date_add(day, horizon))).groupBy("date", "kind").agg(F.sum("signed").alias("signed"), F.count("*").alias("n"), F.min("seq").alias("seq")))
    w = Window.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = daily.crossJoin(F.broadcast(opening)).withColumn("balance", F.col("opening") + F.sum("signed").over(w))
    return curve.withColumn("lowest", F.least("opening", F.min("balance").over(w)))


def estimated_events(patterns: DataFrame, as_of: str, horizon: int) -> DataFrame:
    """(date, seq, signed, kind) of patterns (transaction_type, next_date, median_amount, confidence, title, upcoming_id) that are highly
    confident, not planned already (upcoming_id null) and due within the horizon."""
    day = F.lit(as_of).cast("date")
    due = patterns.filter((F.col("confidence") == "high") & F.col("upcoming_id").isNull() & F.col("transaction_type").isin("Income", "Expense") & F.col("next_date").between(day, F.date_add(day, horizon)))
    amount = F.round("median_amount", 2).cast(MONEY)
    return due.select(F.col("next_date").alias("date"), F.lit(None).cast("long").alias("seq"), F.when(F.col("transaction_type") == "Income", amount).otherwise(-amount).alias("signed"), F.lit("estimated").alias("kind"))


def suggest(rows: DataFrame, keys: list[str], field: str, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """The most frequent non-empty value of `field` per group, with its share; none on a tie, little support or share."""
    n = rows.filter(F.col(field) != "").groupBy(*keys, field).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), field)
    top = n.withColumn("support", F.sum("n").over(Window.partitionBy(*keys))).withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).filter("rn = 1")
    share = F.col("n") / F.col("support")
    return top.filter((F.col("support") >= min_support) & (F.coalesce("second", F.lit(0)) < F.col("n")) & (share >= min_confidence)).select(*keys, F.col(field).alias("suggested"), "support", share.alias("confidence"))


def account_freshness(accounts: DataFrame, postings: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Days since each account was last seen: by a snapshot, else a posting; 999 and `never` if neither."""
    day = F.lit(as_of).cast("date")
    last = postings.filter(F.col("date") <= day).groupBy("account").agg(F.max("date").alias("last_tx"))
    seen = snapshots.filter(F.col("snapshot_date") <= day).groupBy(F.col("account_name").alias("account")).agg(F.max("snapshot_date").alias("last_snapshot"), F.count("*").alias("snapshots"))
    df = accounts.select(F.col("name").alias("account"), "kind", "active").join(last, "account", "left").join(seen, "account", "left")
    age = F.datediff(day, F.greatest("last_tx", "last_snapshot"))
    state = F.when(age.isNull(), "never").when(age <= 3, "fresh").otherwise("stale")
    return df.select("account", "kind", "last_tx", "last_snapshot", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.coalesce(age, F.lit(999)).alias("age"), state.alias("state"))


def holdout_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Marks the first `share` of the rows in (date, id) order as training rows, by the exact quantile row.

    The split row is found by counting rows per day (a groupBy), so that only the split day's rows are ranked.
    """
    days = rows.groupBy("date").agg(F.count("*").alias("n"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("date", "before")
    total = rows.agg(F.floor(F.count("*") * share).alias("train"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy("id"))
    return rows.join(before, "date").crossJoin(F.broadcast(total)).withColumn("is_train", rank <= F.col("train")).drop("before", "train")


def precision_recall(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    both = (predicted & truth).cast("int")
    return df.agg(F.count("*").alias("n"), F.sum(both).alias("hits"), F.sum(predicted.cast("int")).alias("predicted"), F.sum(truth.cast("int")).alias("positive"))
