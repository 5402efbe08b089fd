"""URL filtering by host and path rules and by two character language models.

Main path: DataFrame functions only. The URLs that the rules judge train two smoothed
variable-order Markov models over characters, one of rejected and one of accepted URLs.
A character's probability mixes its count after the longest context with the
probability after the next shorter one, down to the uniform one. Counts are kept for each
gram itself, in a table that grows with the URLs; the distinct grams of the URLs are
joined to it once, and the URLs to those. A URL is blocked when its
log-likelihood difference, divided by its length, exceeds a threshold calibrated on
accepted URLs that the models leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.minhash import BROADCAST_ROWS
from lodestone.llm.storage import persist_table

#: Characters in the longest gram (a context and the next character).
ORDER = 5
#: Parts that each gram is dealt to where the grams are too many to be sent to all tasks.
SALTS = 16
#: Weight of the shorter context's estimate, in counts.
PRIOR = 2.0
#: Share of left-out accepted URLs that the threshold lets pass.
PASS = 0.99

#: (verdict, host, path): fixed rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _padded(url: Column) -> Column:
    """What the models read: the URL after its scheme, between marks."""
    body = F.lower(F.regexp_replace(url, "(?s)^.*?://", ""))
    return F.concat(F.lit("\x02" * (ORDER - 1)), body, F.lit("\x03"))


def _held() -> Column:
    """Whether the models leave a URL out."""
    return F.pmod(F.xxhash64("padded"), F.lit(5)) == 0


def _grams(padded: Column) -> Column:
    """The longest gram that ends at each character."""
    return F.transform(F.sequence(F.lit(ORDER), F.length(padded)), lambda i: F.substring(padded, i - ORDER + 1, F.lit(ORDER)))


def _differences(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """For each distinct gram of ``wanted``, how much likelier its last character is under the
    blocked model: log-likelihood under it less that under the allowed one.

    A shorter gram's count, and a context's, is the sum over the counted grams that hold it,
    so that the counts after a context add up to the context's.
    """
    out = wanted
    p = {"b": F.lit(1 / 256), "a": F.lit(1 / 256)}
    for k in range(1, ORDER + 1):
        for name, size in ((f"g{k}", k), (f"c{k}", k - 1)):
            part = F.substring("gram", ORDER - k + 1, size) if size else F.lit("")
            sums = counts.groupBy(part.alias(name)).agg(F.sum("b").alias(f"{name}b"), F.sum("a").alias(f"{name}a"))
            out = out.withColumn(name, part).join(F.broadcast(sums) if size < 3 else sums, name, "left")
        for side in "ba":
            p[side] = (F.coalesce(f"g{k}{side}", F.lit(0)) + PRIOR * p[side]) / (F.coalesce(f"c{k}{side}", F.lit(0)) + PRIOR)
    return out.select("gram", (F.ln(p["b"]) - F.ln(p["a"])).alias("delta"))


def _scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, score): the mean difference by character, for each row that has any."""
    grams = rows.select("id", F.explode(_grams(F.col("padded"))).alias("gram"))
    deltas = persist_table(_differences(grams.select("gram").distinct(), counts), "url-deltas")
    if deltas.count() <= BROADCAST_ROWS:
        found = grams.join(F.broadcast(deltas), "gram")
    else:  # common grams are dealt to many tasks
        salted = deltas.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = grams.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return found.groupBy("id").agg(F.round(F.avg("delta"), 9).alias("score"))


def judge_urls(pages: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of each URL; one row for each row.

    Null URLs and those without ``://`` have an empty host and path and fit no rule. A null
    or empty URL, and every URL while no rule has judged URLs of both kinds, has no score
    and is allowed. Null keys and repeated rows each give their row; an empty table gives
    none; other columns are not read. Returns key, host, path, rule, verdict, score (null
    where the rule decides).
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _padded(F.col("url")).alias("padded"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    rows = persist_table(rows.withColumn("id", F.monotonically_increasing_id()), "url-rows")
    judged = rows.filter("by is not null").select(F.col("by.verdict").alias("verdict"), "padded", _held().alias("held"))
    train = judged.filter("not held").select("verdict", F.explode(_grams(F.col("padded"))).alias("gram"))
    counts = train.groupBy("gram").agg(F.count_if(F.col("verdict") == "block").alias("b"), F.count_if(F.col("verdict") == "allow").alias("a"))
    counts = persist_table(counts, "url-grams")
    both = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).select(F.coalesce((F.col("b") > 0) & (F.col("a") > 0), F.lit(False))).first()[0]
    held = F.coalesce((F.col("by.verdict") == "allow") & _held(), F.lit(False))
    able = (F.col("by").isNull() | held) & (F.length("padded") > ORDER) & F.lit(both)
    scored = persist_table(_scores(rows.filter(able), counts), "url-scores")
    rows = rows.join(scored, "id", "left")
    limit = rows.filter(held).agg(F.coalesce(F.greatest(F.percentile_approx("score", PASS, 10_000), F.lit(0.0)), F.lit(0.0))).scalar()
    out = rows.withColumn("score", F.when(F.col("by").isNull(), F.col("score"))).withColumn("limit", limit)
    other = F.when(F.col("score") > F.col("limit"), "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", other).alias("verdict"), "score")
