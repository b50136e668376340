"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 13 hexadecimal digits: 52 bits, exact in a double.
_DIGITS, _SCALE = 13, float(1 << 52)


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the md5 of the parts, the same on every engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") + 0.5) / _SCALE


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), .. as far as 52 random bits can tell; summed in logarithms, so that large rates work."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(logp.alias("logp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(logp))).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5,
                total: float | None = None, seed: int = 17, most_sources: int = 10_000) -> DataFrame:
    """Rows of `docs` repeated so that sources take their target shares, in a global random order.

    Adds `copy_no` (int, from 1) and `shuffle_key` (double). The target share of a source is its entry in `weights`
    (sources without one get none), or in proportion to its number of rows to the power `power`. `total` is the expected
    number of rows out; the number of rows in if it is not given. Each row of a source comes Poisson(rate) times, rate =
    total * share / rows of the source: the count inverts the Poisson distribution at a uniform number hashed from the
    seed, the id and the text of the source, so it is the same wherever the row is computed. Rows with equal id and source
    share their count; rows with a null id are told apart by a hash of all their columns, and a null source is a source of its
    own. An input column named copy_no or shuffle_key gives way to the result's; columns of any other name stay as they are. An
    empty table gives no rows. The rows are dealt over all partitions by a hash of their random key and sorted by it within each.

    Source counts are aggregated before the shuffle. Their table is broadcast if it has at most `most_sources` rows, so that
    the rows need not move by source; beyond that it is a keyed join, whose hot keys Spark can split.
    """
    names = docs.columns
    mix = "_mix"
    while any(c.startswith(mix) for c in names):
        mix += "_"
    row = F.col(f"{mix}_row")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    id_source = [F.coalesce(row[id_col].cast("string"), F.concat(F.lit("null "), F.xxhash64(*[row[c] for c in plain]).cast("string"))), row[source_col]]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(f"{mix}_row"))  # so that no name of ours meets one of theirs
    source = row[source_col]
    sizes = docs.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        want = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        want = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    whole = sizes.select("n", want.alias("want")).agg(F.sum("n").cast("double").alias("rows"), F.sum("want").alias("all"))
    expected = F.col("rows") if total is None else F.lit(float(total))
    rates = (sizes.withColumn("want", want).crossJoin(F.broadcast(whole))  # one row
             .withColumn("rate", F.coalesce(F.try_divide(expected * F.col("want"), F.col("all")) / F.col("n"), F.lit(0.0)))
             .select(F.col("source").alias(f"{mix}_source"), F.when(F.col("rate") > 0, poisson_cdf(F.col("rate"))).otherwise(F.array(F.lit(1.0))).alias(f"{mix}_cdf")))
    if sizes.limit(most_sources + 1).count() <= most_sources:
        rates = F.broadcast(rates)
    u = uniform(F.lit(seed), F.lit("count"), *id_source)
    counted = (docs.join(rates, source.eqNullSafe(F.col(f"{mix}_source"))).withColumn(f"{mix}_u", u)
               .withColumn(f"{mix}_count", F.size(F.filter(f"{mix}_cdf", lambda c: c < F.col(f"{mix}_u")))).filter(F.col(f"{mix}_count") > 0))
    rows = counted.select(f"{mix}_row", F.explode(F.sequence(F.lit(1), F.col(f"{mix}_count"))).alias("copy_no"))
    keyed = rows.withColumn("shuffle_key", uniform(F.lit(seed), F.lit("order"), *id_source, F.col("copy_no")))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", row[id_col], "copy_no")
    return dealt.select(*[row[c].alias(c) for c in names if c not in ("copy_no", "shuffle_key")], "copy_no", "shuffle_key")
