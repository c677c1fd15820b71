"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, hide, join_hot, materialize, numbered, scratch, without

#: Fixed weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes; the most copies of a source's size.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sums(source, source_size) plus target: share of all sizes by weight, at most times the source's size.

    Sources weigh by their place in code-point order, null last, the weights repeating. What a cap cuts
    off is dealt again by weight among the sources below theirs: the words a unit of weight gets only
    grow from round to round, until no further source is capped. The driver holds sums alone, so the
    number of sources is not bounded.
    """
    last = F.col("source").isNull().alias("last")
    placed, pieces = numbered(sums.select(last, "source", "source_size"), "last", "source")
    place = F.col("at") + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    dealt = materialize(placed.join(pieces, "piece").select("source", "source_size", weight.alias("weight")))
    all_words, unit = (dealt.agg(F.sum("source_size")).first()[0] or 0), 0.0
    capped = lambda u: F.lit(u) * F.col("weight") > F.lit(most) * F.col("source_size")
    while True:
        taken, rest = dealt.agg(F.sum(F.when(capped(unit), F.col("source_size")).otherwise(0)), F.sum(F.when(capped(unit), 0.0).otherwise(F.col("weight")))).first()
        new = (share * all_words - most * taken) / rest if rest else unit
        if new <= unit:
            break
        unit = new
    return dealt.select("source", "source_size", F.when(capped(unit), F.lit(most) * F.col("source_size")).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def uniform(ident: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the row's ident (null: the seed alone)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_plan(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", sized: str | None = None) -> DataFrame:
    """df plus size, source_size, target and copies: how often the mix takes each row.

    copies is floor(rate) plus one with the probability of the rate's fraction, drawn from a hash of
    the seed and ident, with rate = target / source_size; reruns and lost tasks agree. sized names a
    column that holds the words of each row already; else they are counted in the whole text, however
    long. Null texts have no words; null sources form one source, the last; a source without words gets
    target 0 and no copies; rows that repeat an ident are drawn alike; an empty table gives an empty
    result; clashing columns of df are replaced. df is read several times, so it should be a written
    table.
    """
    size = F.col(f"`{sized}`") if sized else n_words(F.col(f"`{text}`"))
    rows = without(df.withColumn("__size", size), ["size", "source_size", "target", "copies"]).withColumnRenamed("__size", "size")
    # null sources meet under a key of their own
    rows = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("-")))
    with scratch() as keep:
        sums = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("source_size"))
        filled = fill_targets(sums)
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        rates = keep(materialize(filled.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("__source"), "source_size", "target", rate.alias("__rate"))))
        joined = join_hot(rows, rates, "__source")
    copies = F.floor("__rate") + (uniform(F.col(f"`{ident}`")) < F.col("__rate") - F.floor("__rate")).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("__source", "__rate")


def mix(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows of df: each row as often as mix_plan takes it, with all of df's columns as they are,
    also those named like the plan's. Odd rows are treated as mix_plan says."""
    rows, show = hide(df, ident=ident, text=text, source=source)
    plan = mix_plan(rows, "ident", "text", "source")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return show(plan.filter(F.col("copies") > 0).withColumn("__copy", times))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    plan = mix_plan(materialize(words), sized="size")  # texts are read once
    return plan.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), r AS (
  SELECT *, 2.0 * source_size / weight AS full_at,
         1.5 * sum(source_size) OVER () AS pot,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w
), u AS (
  SELECT min_by((pot - used) / rest, full_at) FILTER ((pot - used) / rest <= full_at) AS unit FROM r
), t AS (
  SELECT source, source_size, least(2.0 * source_size, unit * weight)::DOUBLE AS target FROM w, u
), p AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": ORACLE_SQL}
