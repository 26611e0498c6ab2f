"""Lines repeated over the pages of one site (problem 4).

Method: for every (site, line) the urls of the site with and without the line stand against the urls of all
other sites with and without the same line; the log-likelihood ratio of this table is large where the
line belongs to the site. A prompt that most sites share is as frequent outside as inside, and a corpus of
one site has no outside; hence a second null: the line is on no more urls of its site than an ordinary
line, whose number of urls is the lower quartile over all (site, line) of the corpus. Excess against either null
counts, at twice the smaller p-value. Benjamini-Hochberg controls the false-discovery rate over all
(site, line), also those too rare to be reported. Significant excess lines on at least ``min_urls`` urls
are removed by an anti-join, and what is left is put together by position.

Plan: the table is read once; narrow hashed keys go to the shared folder and everything else works on
them. One shuffle of distinct (site, line, url) with map-side combine gives the counts; only lines on
``min_urls`` urls or more are tested (the others count in the family, so the control is conservative);
blocks meet the excess lines in one semi-join of narrow rows, where AQE splits hot lines.

Cases: a null text has no line; null domain falls back to the host of ``url``, both null give site
null, which is a site of its own; blocks on a null url count for no url; a repeated delivery counts
once (pages are counted by distinct url, results by distinct block); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.session import stored

_BINS = 1600
_SEED = "\u0001"


def site_of(domain: Column, url: Column) -> Column:
    """Lower-case host without leading ``www.`` and port: the domain, or the host of the url where it is null."""
    host = F.coalesce(domain, F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), r":[0-9]*$", "")


def line_of(text: Column) -> Column:
    """The words of a line, lower-cased, digit runs as one ``0``, joined by blanks."""
    folded = F.regexp_replace(F.lower(text), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def is_line(line: Column) -> Column:
    """At least three words, two of them with a letter."""
    return line.rlike(r"^[^ ]+ [^ ]+ [^ ]") & (F.regexp_count(line, F.lit(r"\p{L}[^ ]*")) >= 2)


def keyed(blocks: DataFrame) -> DataFrame:
    """Blocks with hashes of their site (``s``), of their url (``u``) and two of their line (null where it is no case)."""
    with_line = blocks.withColumn("s", F.xxhash64(site_of(F.col("wayback_domain"), F.col("url")))).withColumn("_line", line_of(F.col("text"))).withColumn("_line", F.when(is_line(F.col("_line")), F.col("_line")))
    with_line = with_line.withColumn("u", F.when(F.col("url").isNotNull(), F.xxhash64("url")))
    return with_line.withColumns({"h1": F.when(F.col("_line").isNotNull(), F.xxhash64("_line")), "h2": F.when(F.col("_line").isNotNull(), F.xxhash64(F.lit(_SEED), "_line"))}).drop("_line")


def _part(k: Column, share: Column) -> Column:
    """k log(share), 0 where k is 0."""
    return F.when(k > 0, k * F.log(share)).otherwise(F.lit(0.0))


def llr_outside(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio of k1 in n1 inside against k2 in n2 outside; 0 where the inside has no excess."""
    one = lambda k, n, p: _part(k, p) + _part(n - k, 1 - p)
    p1, p2, p = k1 / n1, k2 / F.greatest(n2, F.lit(1)), (k1 + k2) / (n1 + n2)
    return F.when((n2 > 0) & (p1 > p2), 2 * (one(k1, n1, p1) + one(k2, n2, p2) - one(k1, n1, p) - one(k2, n2, p))).otherwise(F.lit(0.0))


def llr_ordinary(k: Column, ordinary: Column) -> Column:
    """Log-likelihood ratio of k urls against the urls of an ordinary line (Poisson); 0 where there is no excess."""
    return F.when(k > ordinary, 2 * (k * F.log(k / ordinary) - (k - ordinary))).otherwise(F.lit(0.0))


def p_value(llr: Column) -> Column:
    """Upper bound of the tail of the chi-square distribution of one degree."""
    x = F.greatest(llr, F.lit(1e-9))
    return F.least(F.lit(1.0), F.exp(-x / 2) * F.sqrt(F.lit(2 / 3.141592653589793) / x))


def excess_lines(keys: DataFrame, min_urls: int = 10, fdr: float = 0.01) -> DataFrame:
    """(s, h1, h2, urls, site_urls, llr) of the significant excess lines; ``keys`` needs s, h1, h2 and u."""
    seen = keys.filter("h1 IS NOT NULL AND u IS NOT NULL").select("s", "h1", "h2", "u").distinct()
    lines = stored(seen.groupBy("s", "h1", "h2").agg(F.count("*").alias("urls")), "site-line-counts")
    sites = stored(keys.filter("u IS NOT NULL").select("s", "u").distinct().groupBy("s").agg(F.count("*").alias("site_urls")), "site-urls")
    # The family, its lower quartile and all urls: three numbers.
    by_count = lines.groupBy("urls").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("urls"))  # as many rows as there are different counts
    whole = by_count.select("urls", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("tests"))
    ordinary, tests = whole.filter("4 * upto >= tests").agg(F.min("urls"), F.max("tests")).first()
    everywhere = sites.agg(F.sum("site_urls")).first()[0] or 0
    can = lines.filter(F.col("urls") >= min_urls)
    outside = lines.join(can.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("urls").alias("all_urls"))
    tested = can.join(outside, ["h1", "h2"]).join(sites, "s")
    k1, n1 = F.col("urls"), F.col("site_urls")
    best = F.greatest(llr_outside(k1, n1, F.col("all_urls") - k1, F.lit(everywhere) - n1), llr_ordinary(k1, F.lit(float(ordinary or 1))))
    # A bin holds ratios up to its upper end; its p-value is that of its lower end.
    tested = stored(tested.select("s", "h1", "h2", "urls", "site_urls", best.alias("llr"), F.least(F.floor(best * 8), F.lit(_BINS)).alias("bin")), "site-line-tests")
    bins = tested.groupBy("bin").agg(F.count("*").alias("n"))
    rank = F.sum("n").over(Window.orderBy(F.desc("bin")))  # at most _BINS + 1 rows
    cut = bins.withColumn("rank", rank).filter(2 * p_value(F.col("bin") / 8) <= F.lit(fdr) * F.col("rank") / F.lit(max(1, tests or 1))).agg(F.min("bin")).first()[0]
    return tested.filter(F.col("bin") >= F.lit(cut if cut is not None else _BINS + 1)).drop("bin")


_SAME = "k.h1 = x.h1 AND k.h2 = x.h2 AND k.s = x.s"


def find_site_lines(blocks: DataFrame, min_urls: int = 10, fdr: float = 0.01) -> DataFrame:
    """(block_id) of the blocks whose line is a significant excess line of their site, once each."""
    keys = stored(keyed(blocks.select("block_id", "text", "url", "wayback_domain")).select("block_id", "s", "h1", "h2", "u"), "site-line-keys")
    hit = keys.filter("h1 IS NOT NULL").alias("k").join(excess_lines(keys, min_urls, fdr).alias("x"), F.expr(_SAME), "left_semi")
    return hit.select("block_id").distinct()


def without_site_lines(blocks: DataFrame, min_urls: int = 10, fdr: float = 0.01, segment: int = 2000) -> DataFrame:
    """(url, wayback_timestamp, segment, part, text, blocks): every capture of a page without its excess lines, put together by position.

    A capture is cut into segments of ``segment`` positions; where more than twice as many blocks share one (repeated
    or null positions), it is cut further into parts of ``segment`` ids, so no group is unbounded. Blocks without
    a url belong to no page and stand alone.
    """
    keys = keyed(blocks.select("block_id", "text", "url", "wayback_domain", "wayback_timestamp", "position"))
    lines = excess_lines(stored(keys.select("s", "h1", "h2", "u"), "site-line-keys"), min_urls, fdr)
    kept = keys.filter("text IS NOT NULL").alias("k").join(lines.alias("x"), F.expr(_SAME), "left_anti").dropDuplicates(["block_id"])
    place = F.floor(F.coalesce(F.col("position"), F.lit(0)) / segment)
    kept = stored(kept.select("url", "wayback_timestamp", place.alias("segment"), F.coalesce("position", F.lit(0)).alias("position"), "block_id", "text"), "site-line-rest")
    group = ["url", "wayback_timestamp", "segment"]
    crowded = kept.filter("url IS NOT NULL").groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * segment)
    match = F.expr("k.url = c.url AND k.wayback_timestamp <=> c.wayback_timestamp AND k.segment = c.segment")
    part = F.when(F.col("k.url").isNull(), F.col("k.block_id")).when(F.col("c.n").isNotNull(), F.floor(F.col("k.block_id") / segment)).otherwise(F.lit(0)).cast("bigint")
    placed = kept.alias("k").join(crowded.alias("c"), match, "left").select("k.*", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "block_id", "text")))
    return placed.groupBy(*group, "part").agg(ordered.alias("b")).select(*group, "part", F.expr("array_join(transform(b, x -> x.text), '\\n')").alias("text"), F.size("b").alias("blocks"))
