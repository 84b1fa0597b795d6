"""URL verdicts from host and path rules, with DataFrame functions only.

Each distinct URL is expanded into its host suffixes. These meet the hosts of the rules in an
equi-join on a short hash prefix, which tells what lengths of path rules of such a host
have; only those path prefixes are expanded. The expressions (host suffix, path prefix) meet the rules in
an equi-join on the first eight hex digits of their SHA-256; the full digests are compared after
it, and of the rules that are confirmed the longest wins. Nothing about the rules
is gathered on the driver but their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast; beyond it the joins shuffle both sides.
BROADCAST_RULES = 20_000
#: Hex digits of a digest that the joins meet on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds __kl_host and __kl_path; both are empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"__kl_host": host, "__kl_path": path})


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; the zero byte cannot stand in a host."""
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def short(of: Column) -> Column:
    return F.substring(of, 1, SHORT)


def known_rules(rules: DataFrame) -> DataFrame:
    """r_host, r_path, r_verdict, r_digest of each rule without a null; of one given twice, `block`."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block sorts after allow
    return rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path")))


def expressions(urls: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """__kl_url, __kl_digest: of each url (__kl_url, __kl_host, __kl_path) the expressions that a rule could name.

    The array of a host's path lengths holds each length once, so at most as many as the longest path has characters.
    """
    hosts = rules.groupBy(short(F.sha2("r_host", 256)).alias("h_short")).agg(F.collect_set(F.length("r_path")).alias("h_lengths"))
    hosts = F.broadcast(hosts) if few else hosts
    labels = F.split("__kl_host", r"\.")
    suffixes = urls.where("__kl_host != ''").withColumn("__kl_labels", labels).select("__kl_url", "__kl_path", "__kl_labels", F.explode(F.sequence(F.lit(1), F.size("__kl_labels"))).alias("__kl_n"))
    suffixes = suffixes.select("__kl_url", "__kl_path", F.array_join(F.slice("__kl_labels", -F.col("__kl_n"), F.col("__kl_n")), ".").alias("__kl_suffix"))
    met = suffixes.withColumn("__kl_h", short(F.sha2("__kl_suffix", 256))).join(hosts, F.col("__kl_h") == F.col("h_short"))
    fitting = F.filter("h_lengths", lambda n: n <= F.length("__kl_path"))
    return met.select("__kl_url", F.explode(F.transform(fitting, lambda n: digest(F.col("__kl_suffix"), F.substring(F.col("__kl_path"), F.lit(1), n)))).alias("__kl_digest"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to pages; columns of those names are replaced.

    rules: host, path (starting with `/`, or empty for any), verdict; any number of them. A rule fits its
    host and all subdomains if the url's path starts with the rule's path. The longest
    rule (host and path together) wins, then the longest host; of one rule given twice,
    `block`. Rules with a null are left out. Null urls, urls without `://` and urls that
    no rule fits get the default verdict and a null rule; every row of pages is kept, repeated ones too.
    An empty table gives none.
    """
    rules = known_rules(rules)
    few = rules.limit(broadcast + 1).count() <= broadcast

    urls = split_url(pages.select(F.col(url).alias("__kl_url")).distinct(), "__kl_url")
    each = expressions(urls, rules, few).withColumn("__kl_short", short(F.col("__kl_digest")))
    side = rules.withColumn("r_short", short(F.col("r_digest")))
    met = each.join(F.broadcast(side) if few else side, F.col("__kl_short") == F.col("r_short"))
    # the short prefixes brought them together; what counts is that the full digests agree
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("all"), F.length("r_host").alias("of_host"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    confirmed = F.when(F.col("__kl_digest") == F.col("r_digest"), order)
    best = met.groupBy("__kl_url").agg(F.max(confirmed).alias("__kl_best")).select(F.col("__kl_url").alias("__kl_key"), "__kl_best")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = split_url(pages.withColumn("__kl_of", F.col(url)).join(best, F.col("__kl_of") == F.col("__kl_key"), "left"), "__kl_of")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__kl_host").alias("host"), F.col("__kl_path").alias("path"), F.col("__kl_best")["rule"].alias("rule"), F.coalesce(F.col("__kl_best")["verdict"], F.lit(default)).alias("verdict"))
