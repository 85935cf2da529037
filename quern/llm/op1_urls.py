"""URL filters: host and path rules, then the likelihood ratio of two character models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query, by which the models also learn what is accepted and rejected.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
#: Characters of context; share (1 in) of labelled URLs kept for calibration; chance of a character never seen.
ORDER, HELD, FLOOR = 4, 10, 1 / 256
#: Grams that are broadcast: no more than this many can each have its share of all places.
HEAVY = 50_000
BINS = 400


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: of its host or a subdomain, its path a prefix. Ties go by text."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column, order: int) -> Column:
    """For each character of the lower-cased URL and its end, the character after its context; the start is padded."""
    padded = F.concat(F.lit("\x02" * order), lower_ascii(url), F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def likelihoods(counts: DataFrame, order: int) -> DataFrame:
    """(gram, difference): log chance of each gram's last character after the others, accepted less rejected.

    counts: (gram, a, b), b the rejected. Witten-Bell smoothing: a context's chances are mixed with those of
    the context without its first character, by how many different characters have followed it, down to FLOOR.
    """
    p = None
    for k in range(order + 1):
        own = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("s")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        own = own.withColumn("ctx", F.left("s", F.lit(k)))
        seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
        after = own.groupBy("ctx").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), seen("a").alias("ta"), seen("b").alias("tb"))
        level = own.join(after, "ctx")
        if p is None:
            level = level.withColumns({"la": F.lit(FLOOR), "lb": F.lit(FLOOR)})
        else:
            level = level.withColumn("lower", F.right("s", F.lit(k))).join(p.select(F.col("s").alias("lower"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "lower")
        mix = lambda c, n, t, low: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(low)) / (F.col(n) + F.col(t))).otherwise(F.col(low))
        p = level.select("s", mix("a", "na", "ta", "la").alias("pa"), mix("b", "nb", "tb", "lb").alias("pb"))
    return p.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pb")).alias("difference"))


def calibrated(scores: DataFrame) -> float:
    """The score that tells held-back accepted URLs (label 1) from rejected (0) with the best mean of both rates; 0 without both."""
    at = F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(1.999), "score")) * (BINS // 4)).alias("bin")
    table = scores.groupBy(at).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum((1 - F.col("label")) * F.col("n")).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in table), sum(r["bad"] for r in table)
    if not good or not bad:
        return 0.0
    best, where, low_good, low_bad = 1.0, 0.0, 0, 0
    for r in table:
        low_good, low_bad = low_good + r["good"], low_bad + r["bad"]
        rate = (good - low_good) / good + low_bad / bad
        if rate > best + 1e-12:
            best, where = rate, (r["bin"] + 1) / (BINS // 4)
    return float(where)


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages (page_id, url).

    The longest fitting rule decides. URLs that no rule fits are judged by models of character contexts learnt
    from all URLs that rules allow and block: the difference of the two log likelihoods, divided by the URL's
    length, against a threshold calibrated on a tenth of those URLs (chosen by hash) that the counts leave out.

    Gram counts cover every URL and stay distributed. Equal URLs are scored once. A null URL, or one without
    `://`, has empty host and path and is scored by its text (null: as empty); repeated rows and null ids get a
    row each; without rules that both allow and block some page, the models are equal and all else is allowed.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    fit = matched(host_of(F.col("url")), path_of(F.col("url")), rules)
    urls = cut(
        rows.groupBy("url").agg(F.count("*").alias("n")).select(
            F.monotonically_increasing_id().alias("id"), "url", "n", F.when(fit["verdict"] == "allow", 1).when(fit["verdict"] == "block", 0).alias("label"), (F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0).alias("held"))
    )
    # URLs are short rows that become many; they are dealt out before that.
    urls = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = urls.select("id", "n", F.when(~F.col("held"), F.col("label")).alias("train"), F.explode(grams(F.col("url"), order)).alias("gram"))
    weight = lambda v: F.sum(F.when(F.col("train") == v, F.col("n")).otherwise(0))
    counts = cut(places.groupBy("gram").agg(weight(1).alias("a"), weight(0).alias("b"), F.count("*").alias("uses")))
    model = cut(likelihoods(counts, order).join(counts.select("gram", "uses"), "gram"))
    size, total = model.agg(F.count("*"), F.sum("uses")).first()
    spots = places.select("id", "gram")
    if size <= HEAVY:
        told = spots.join(F.broadcast(model), "gram")
    else:  # at most HEAVY grams can have a HEAVY-th of all places each; without them no gram is frequent
        heavy = F.col("uses") * HEAVY >= total
        often = F.broadcast(model.where(heavy).select("gram", F.col("difference").alias("often")))
        split = spots.join(often, "gram", "left")
        told = split.where("often is not null").select("id", F.col("often").alias("difference")).unionByName(
            split.where("often is null").select("id", "gram").join(model.where(~heavy), "gram").select("id", "difference"))
    scores = cut(told.groupBy("id").agg(F.round(F.avg("difference"), 9).alias("score")).join(urls, "id").select("url", "n", "label", "held", "score"))
    threshold = calibrated(scores.where("held and label is not null"))
    found = rows.join(scores.select("url", "score"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    by = matched(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(by["verdict"], F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", by["rule"].alias("rule"), verdict.alias("verdict"), "score")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages", "page_id", "url"))
