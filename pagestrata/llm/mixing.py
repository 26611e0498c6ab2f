"""Mixing sources to target weights (problem 9).

Method: capped water-filling. Every source offers its tokens times its greatest number of repetitions.
The wanted total is shared out by the targets; sources that cannot give their part are clamped at
their offer, and what is missing goes to the others in proportion to their targets, until nothing
changes. The amount of a source over its tokens gives its repetitions: whole copies of every document,
and for the fraction a seeded sample of documents.

The fraction is drawn by hash: documents fall into 2**16 buckets by a seeded hash of their id; buckets
are taken in order while their tokens fit. Tokens are summed by (source, bucket) before anything meets,
so a source with a third of all rows costs no more than its buckets. Sizes are tokens of a public
tokenizer (:mod:`encode`).

Cases: null and empty texts have no tokens; a source named in the targets without documents gets 0; a
source without target gets share and repetitions 0; a null source is a source like any other; targets
may be given for null too; shares that do not sum to 1 are scaled; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.llm.encode import DEFAULT_PATH, token_lengths
from pagestrata.session import stored

BUCKETS = 1 << 16


def water_fill(available: dict, share: dict, repeats: dict, total: float | None = None) -> dict:
    """Tokens to take from each source: at most available x repeats, else in proportion to the shares.

    ``total`` is the wanted sum, by default all available tokens of the named sources; where even the
    caps together fall short of it, every source gives its cap.
    """
    offer = {s: float(available.get(s, 0)) * max(0, repeats.get(s) or 0) for s in share}
    want = float(sum(available.get(s, 0) for s in share)) if total is None else float(total)
    want = min(want, sum(offer.values()))
    taken = {s: 0.0 for s in share}
    open_ = {s for s in share if offer[s] > 0 and share[s] and share[s] > 0}
    left = want
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= offer[s]}
        if not full:
            taken |= {s: left * share[s] / weight for s in open_}
            break
        taken |= {s: offer[s] for s in full}
        left -= sum(offer[s] for s in full)
        open_ -= full
    return taken


def sized(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, written once."""
    return stored(token_lengths(docs, ["doc_id", "source"], "text", path), "mix-sizes")


def _bucket(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS))


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """(source, named, documents, available, target_share, max_repeats, repeats, whole, cut, sampled_tokens): the plan of each source."""
    buckets = sizes.withColumn("bucket", _bucket(seed)).groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"))
    buckets = stored(buckets, "mix-buckets")
    offers = buckets.groupBy("source").agg(F.sum("t").alias("available"), F.sum("d").alias("documents"))
    goal = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    table = goal.alias("g").join(offers.alias("o"), F.expr("g.source <=> o.source"), "full").select(F.coalesce("g.source", "o.source").alias("source"), "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"))
    named = [r for r in table.filter("target_share IS NOT NULL").collect()]  # as many rows as there are targets
    sum_share = sum(max(0.0, r["target_share"]) for r in named) or 1.0
    taken = water_fill({r["source"]: r["available"] for r in named}, {r["source"]: max(0.0, r["target_share"]) / sum_share for r in named}, {r["source"]: r["max_repeats"] for r in named}, total)
    amounts = sizes.sparkSession.createDataFrame([(s, float(x)) for s, x in taken.items()], "source string, amount double")
    plan = table.alias("t").join(F.broadcast(amounts).alias("a"), F.expr("t.source <=> a.source"), "left").select("t.*", F.coalesce("amount", F.lit(0.0)).alias("amount"))
    repeats = F.when(F.col("available") > 0, F.col("amount") / F.col("available")).otherwise(0.0)
    plan = plan.withColumn("named", F.col("target_share").isNotNull()).withColumn("repeats", repeats).withColumn("whole", F.floor(F.col("repeats") + 1e-12)).withColumn("rest", F.col("amount") - F.col("whole") * F.col("available"))
    run = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    drawn = buckets.withColumn("run", run).alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).filter(F.expr("b.run <= p.rest + 0.5")).groupBy("p.source").agg(F.max("bucket").alias("cut"), F.max("run").alias("extra"))
    out = plan.alias("p").join(drawn.alias("d"), F.expr("p.source <=> d.source"), "left")
    return out.select("p.source", "named", "documents", "available", "target_share", "max_repeats", "repeats", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), (F.col("whole") * F.col("available") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("sampled_tokens"))


def report_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """Per source: documents and tokens available, target share, cap, repetitions, tokens sampled and actual share."""
    plan = plan_mix(sizes, targets, total, seed)
    whole = F.sum("sampled_tokens").over(Window.partitionBy())
    share = F.when(whole > 0, F.col("sampled_tokens") / whole).otherwise(0.0)
    return plan.select("source", "documents", F.col("available").alias("tokens_available"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "repeats", "sampled_tokens", share.alias("actual_share"))


def sample_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies): every document that the mixture takes, with its number of copies."""
    plan = plan_mix(sizes, targets, total, seed).filter("named").select("source", "whole", "cut")
    got = sizes.withColumn("bucket", _bucket(seed)).alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source"))
    copies = F.col("whole") + (F.col("bucket") <= F.col("cut")).cast("int")
    return got.select("doc_id", "s.source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")
