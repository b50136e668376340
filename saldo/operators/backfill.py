"""Backfill of a mailbox in months and pages: which page each thread is on, how far a run comes, where the next one goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 25


def page_plan(messages: DataFrame, size: int = PAGE) -> DataFrame:
    """(month, page, threads, messages, failed): the pages of threads that a search of each month gives, newest thread first.

    Messages are rows (thread, ts, trusted, failed). A thread is found in each month it has a trusted message in, and only its
    trusted messages of that month are taken; ties in time go by thread. Rows without a thread or a time have no page.
    Threads are numbered in two levels, by hour and within the hour, so that no task gets a whole month.
    """
    src = messages.filter(F.col("trusted") & F.col("thread").isNotNull() & F.col("ts").isNotNull())
    threads = (src.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "thread").agg(F.max("ts").alias("newest"), F.count("*").alias("messages"), F.sum(F.coalesce("failed", F.lit(False)).cast("long")).alias("failed"))
               .withColumn("hour", F.date_trunc("hour", "newest")))
    later = Window.partitionBy("month").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)  # 744 rows a month at most
    hours = threads.groupBy("month", "hour").agg(F.count("*").alias("n")).select("month", "hour", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("month", "hour").orderBy(F.desc("newest"), "thread")) - 1
    numbered = threads.withColumn("place", place).join(hours, ["month", "hour"])
    page = F.floor((F.col("before") + F.col("place")) / size)
    return numbered.groupBy("month", page.alias("page")).agg(F.count("*").alias("threads"), F.sum("messages").alias("messages"), F.sum("failed").alias("failed"))


def progress(plan: DataFrame, first: str, last: str, size: int = PAGE) -> DataFrame:
    """The pages of the months `first` to `last` with an outcome and the cursor (next_month, next_offset) that is stored after them.

    Pages are taken in order. The first with a failed message stops the run: it is not counted as done, its cursor stays on it,
    and later pages wait. A page that is full moves the offset, a short one ends its month.
    """
    pages = plan.filter(F.col("month").between(first, last))
    stop = pages.filter("failed > 0").agg(F.min(F.struct("month", "page")).alias("stop"))  # one row
    here = F.struct("month", "page")
    outcome = F.when(F.col("stop").isNull() | (here < F.col("stop")), "done").when(here == F.col("stop"), "stopped").otherwise("waiting")
    following = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    done, full = F.col("outcome") == "done", F.col("threads") == size
    return (pages.crossJoin(stop).withColumn("outcome", outcome)
            .select("month", "page", "threads", "messages", "failed", "outcome", F.when(~done, F.col("stop.month")).when(full, F.col("month")).otherwise(following).alias("next_month"),
                    F.when(~done, F.col("stop.page") * size).when(full, (F.col("page") + 1) * size).otherwise(0).alias("next_offset")))
