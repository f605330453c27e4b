"""URL filter: allow and block rules, then a character language-model ratio; native expressions only.

A rule is a host and a start of the path; it fits its host with all subdomains, and of the
rules that fit the longest wins. URLs that a rule decides are the accepted and the rejected
ones on which two character models are trained, each URL with an end mark: Markov models of
variable order up to `ORDER`, where each context's estimate is smoothed into the one of its
shorter context (Witten-Bell: a context with n characters seen, d of them different, keeps
n / (n + d) of the mass). A URL that no rule decides gets the difference of its two mean
log-likelihoods a character, and is allowed at or above the threshold. The threshold is
calibrated on the trained URLs: the value that misjudges the fewest, in equal weights of both
classes, over a grid of hundredths.

The models read the whole url in lower case without its scheme. Every distinct n-gram is
looked up once by joins on the shorter context, and each URL sums over its n-grams.

Defined cases: a null url and one without `://` have an empty host and path, fit no rule and
are judged by the model on what text there is; an empty text has the ratio 0; without
trained URLs of both classes the ratio is 0 and the threshold 0, so all are allowed; equal
urls are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.storage import materialize

ORDER = 4  # characters of context, at most
END = "\n"
#: Host suffix, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """`page_id, url, host, path`, the longest rule that fits and its verdict (null: none)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest is asked first, so it is put outermost.
    for suffix, start, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == suffix) | F.endswith("host", F.lit(f".{suffix}"))) & F.startswith("path", F.lit(start))
        rule = F.when(fits, suffix + start).otherwise(rule)
        verdict = F.when(fits, say).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _text(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each character and the end: the context of up to `ORDER` characters, and the character."""
    whole = F.concat("text", F.lit(END))
    at = rows.where("text <> ''").select(*keep, whole.alias("chars"), F.explode(F.sequence(F.lit(1), F.length(whole))).alias("at"))
    begin = F.greatest(F.col("at") - ORDER, F.lit(1))
    return at.select(
        *keep, F.substring(F.col("chars"), begin, F.col("at") - begin).alias("context"), F.substring(F.col("chars"), F.col("at"), F.lit(1)).alias("next"))


def train(ruled: DataFrame) -> DataFrame:
    """`(context, next, allow, block)`: smoothed probabilities of every n-gram seen, at every order."""
    grams = _grams(ruled.groupBy("text", "ruled").agg(F.count("*").alias("k")), "ruled", "k")
    full = grams.groupBy("ruled", "context", "next").agg(F.sum("k").alias("k"))
    counts = full.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.length("context")), lambda n: F.substring("context", F.length("context") - n + 1, n))).alias("context"),
        "next", "ruled", "k")
    both = [F.sum(F.when(F.col("ruled") == c, F.col("k")).otherwise(0)).alias(f"n_{c}") for c in ("allow", "block")]
    return materialize(counts.groupBy("context", "next").agg(*both), "url-counts")


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """`(context, next, allow, block)` log probabilities of the distinct n-grams `asked(context, next)`."""
    mass = counts.groupBy("context").agg(*[
        f for c in ("allow", "block") for f in (F.sum(f"n_{c}").alias(f"all_{c}"), F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"kinds_{c}"))])
    mass = materialize(mass, "url-contexts")
    # Both models fall back to the same share for a character that neither has seen.
    current = asked.withColumns({"allow": F.lit(1 / 256), "block": F.lit(1 / 256)})
    for order in range(ORDER + 1):
        short = F.expr(f"if(length(context) >= {order}, right(context, {order}), null)")
        seen = counts.where(F.length("context") == order).select(F.col("context").alias("short"), F.col("next"), "n_allow", "n_block")
        known = mass.where(F.length("context") == order).withColumnRenamed("context", "short")
        current = current.withColumn("short", short).join(known, "short", "left").join(seen, ["short", "next"], "left")
        new = {
            c: F.when(F.coalesce(f"all_{c}", F.lit(0)) == 0, F.col(c)).otherwise(
                (F.coalesce(f"n_{c}", F.lit(0)) + F.col(f"kinds_{c}") * F.col(c)) / (F.col(f"all_{c}") + F.col(f"kinds_{c}")))
            for c in ("allow", "block")}
        current = current.withColumns(new).select("context", "next", "allow", "block")
    return current.select("context", "next", F.log("allow").alias("allow"), F.log("block").alias("block"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """`(page_id, host, path, rule, verdict, ratio)` of every page."""
    rows = materialize(with_rule(pages, rules).withColumn("text", _text(F.col("url"))), "url-rows")
    counts = train(rows.where("ruled IS NOT NULL"))
    # Each distinct text is scored once, however many pages have it.
    distinct = rows.select("text").distinct()
    grams = materialize(_grams(distinct, "text").groupBy("text", "context", "next").agg(F.count("*").alias("k")), "url-grams")
    logs = materialize(probabilities(counts, grams.select("context", "next").distinct()), "url-model")
    trained = counts.where("context = ''").agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).first()
    usable = bool(trained.a) and bool(trained.b)
    ratio = F.sum(F.col("k") * (F.col("allow") - F.col("block"))) / F.sum("k") if usable else F.sum(F.lit(0.0))
    scores = materialize(grams.join(logs, ["context", "next"]).groupBy("text").agg(F.round(ratio, 9).alias("ratio")), "url-scores")
    scored = rows.join(scores, "text", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    least = threshold(scored) if usable else 0.0
    verdict = F.coalesce("ruled", F.when(F.col("ratio") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")


def threshold(scored: DataFrame) -> float:
    """The ratio, in hundredths, that misjudges the smallest share of ruled URLs of both classes."""
    bins = scored.where("ruled IS NOT NULL").groupBy(F.floor(100 * F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "ratio"))).alias("bin")).agg(
        *[F.sum((F.col("ruled") == c).cast("long")).alias(c) for c in ("allow", "block")]).collect()  # 4,001 rows at most
    allow, block = (sum(b[c] for b in bins) for c in ("allow", "block"))

    def wrong(cut: int) -> float:
        return sum(b.allow for b in bins if b.bin < cut) / allow + sum(b.block for b in bins if b.bin >= cut) / block

    return min(sorted({0, *(b.bin for b in bins)}, key=abs), key=wrong) / 100
