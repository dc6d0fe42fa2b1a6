"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: sources sorted by code point (null last) weigh 5, 2, 1, 5, 2, 1, ...; together they take ``percent`` % of
all words; a target stops at ``most_epochs`` times its source's size and the excess goes to the others by weight
until none is above (the closed form of that water-filling, by sources sorted by size over weight).

Each source gives complete epochs first; the rest of its target goes to its documents in the order of their
exponential keys ``-ln(u) / quality`` (u from a hash of the id and `tie`, so reruns agree), up to the budget: words
before a document are prefix sums. The document at the boundary gives the words that remain.

Prefix sums never gather a source: logarithms of keys fall into buckets so narrow that none holds more than some
thousand documents of a source (a thousandth of a percent of them in large tables), whatever their quality; sums by
bucket find the bucket of the boundary, and only that bucket's documents are sorted. Null texts have size 0 and take
nothing; null sources are a source; repeated rows count each and share a key; so rows with null or equal ids are told
apart by `tie`, a hash of their text. Very long texts count whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
LEAST_ROWS, MOST_BUCKETS = 1000, 100_000  # rows of a bucket: so many, or n / MOST_BUCKETS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Share of letters in a text's characters other than spaces, between 0.1 and 1."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = solid - F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.when(solid > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.1), letters / solid))), F.lit(0.1))


def targets(sizes: DataFrame, percent: int = 150, most_epochs: int = 2) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place + 1).cast("int"))
    cap = F.col("source_size") * float(most_epochs)
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("left", F.sum("source_size").over(everything) * (percent / 100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(after))
    capped = F.col("ratio") <= F.col("level")
    x = x.withColumn("first", F.max(F.when(~capped, F.col("level"))).over(everything))
    return x.select("source", "source_size", "weight", F.when(capped, F.col("cap")).otherwise(F.least("cap", F.col("first") * F.col("weight"))).alias("target"))


def mix(df: DataFrame, id_col: str, source_col: str, size: Column, weight: Column, tie: Column, keep: list[str] | None = None, prefix: str = "", percent: int = 150, most_epochs: int = 2, seed: int = 7) -> DataFrame:
    """df's columns (or those of keep), size, source_size, target (of its source) and taken (words that the mix takes).

    prefix goes before the four new names, for tables that have columns of those names.
    size, weight and tie are computed once, in the one pass over df; what follows reads the table of kept columns.
    """
    keep = df.columns if keep is None else keep
    u = (F.xxhash64(F.col(id_col), tie, F.lit(seed)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    src = F.struct(F.col(source_col).isNull().alias("n"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"))
    own = {"_mix_src": src, "_mix_size": size, "_mix_key": -F.log(u) / weight, "_mix_id": F.col(id_col), "_mix_tie": tie}
    keyed = df.select(*[F.col(c).alias(f"_keep_{n}") for n, c in enumerate(keep)], *[v.alias(k) for k, v in own.items()])  # df's own names may be any
    keyed = stored(keyed, "mix-keys")
    n = keyed.count()
    wide = max(LEAST_ROWS, n / MOST_BUCKETS) / max(1, n) * math.e  # the logarithm of an exponential key has a density of 1 / e at most
    bucket = F.floor(F.log("_mix_key") / wide).cast("long")
    by_bucket = keyed.groupBy("_mix_src", bucket.alias("_mix_bucket")).agg(F.sum("_mix_size").alias("w"))
    by_bucket = stored(by_bucket, "mix-buckets")
    sources = targets(by_bucket.groupBy("_mix_src").agg(F.sum("w").alias("source_size")).withColumn("source", F.when(~F.col("_mix_src.n"), F.col("_mix_src.s"))), percent, most_epochs)
    sources = sources.withColumn("_mix_src", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    sources = sources.withColumn("_mix_words", F.least(F.round("target").cast("long"), F.col("source_size") * most_epochs))
    sources = sources.withColumn("_mix_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_mix_words") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("_mix_rest", F.col("_mix_words") - F.col("_mix_epochs") * F.col("source_size"))
    running = Window.partitionBy("_mix_src").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = by_bucket.withColumn("_mix_before", F.coalesce(F.sum("w").over(running), F.lit(0)).cast("long")).join(sources, "_mix_src").where("_mix_before <= _mix_rest and _mix_rest < _mix_before + w")
    edge = edge.groupBy("_mix_src").agg(F.min("_mix_bucket").alias("_mix_edge"), F.min_by("_mix_before", "_mix_bucket").alias("_mix_before"))
    sources = stored(sources.select("_mix_src", *[F.col(c).alias("_mix_" + c.removeprefix("_mix_")) for c in ("source_size", "target", "_mix_epochs", "_mix_rest")]).join(edge, "_mix_src", "left"), "mix-sources")

    rows = keyed.withColumn("_mix_bucket", bucket).join(sources, "_mix_src")
    here = F.col("_mix_bucket") == F.col("_mix_edge")  # no edge: the rest is 0
    inside = Window.partitionBy("_mix_src").orderBy("_mix_key", "_mix_id", "_mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where(here).withColumn("_mix_done", F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("_mix_part", F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_rest") - F.col("_mix_done"))))
    other = rows.where(F.coalesce(~here, F.lit(True))).withColumn("_mix_part", F.when(F.col("_mix_bucket") < F.col("_mix_edge"), F.col("_mix_size")).otherwise(0))
    out = at_edge.drop("_mix_done").unionByName(other)
    return out.select(*[F.col(f"_keep_{n}").alias(c) for n, c in enumerate(keep)], *[F.col("_mix_" + c).alias(prefix + c) for c in ("size", "source_size", "target")], (F.col("_mix_epochs") * F.col("_mix_size") + F.col("_mix_part")).cast("long").alias(prefix + "taken"))
