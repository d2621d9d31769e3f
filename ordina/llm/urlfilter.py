"""URL filters: host and path rules, and association rules for what they leave open.  DataFrame functions only.

Rules of hosts and paths come first: a rule fits its host and all subdomains if the path starts with the rule's,
and the longest that fits wins.  The distinct urls they decide are the labels: pattern growth mines combinations of url
tokens that go with a verdict, and rules of enough support and confidence judge the other urls.  The labels and segments
that the rules themselves test are no tokens, so that the mined rules say something of their own.

Mining takes all items of all labelled urls, and no set is cut.  It is pattern growth over projected tables: a level holds,
for each set of items, the labelled urls that have it, with their items that come later (the rarest come first), equal ones
as one row.  What is left out can't change a verdict: tokens too rare for the support; of tokens that the same labelled
urls have all but one (a url with any of them has the item); sets that no url to be judged has; and whatever holds a part that
settles it: one of a single verdict, one of the same labelled urls, or one too rare to beat the sure rules that the url
fits.  The work follows the number of the other sets, which may grow as 2**items where mixed items are independent and many
urls to be judged have all of them.  A mined rule stands in an inverted index under its rarest item, so a url meets only
the rules one of its own items leads to.

Defined results: a null url, or one without ``://``, has an empty host and path, and gets the default verdict unless
a rule or a token says otherwise; equal urls get equal verdicts; an empty table gives no rows; without labelled urls
nothing is mined and the default verdict holds; other columns of the input are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, read

Rule = tuple[str, str, str]  #: verdict, host, path

RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null; found by the host's suffixes."""
    if not rules:
        return F.lit(None).cast("struct<length:int,path:string,rule:string,verdict:string>")
    by_host: dict[str, list[Column]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("length"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array().cast("array<struct<length:int,path:string,rule:string,verdict:string>>"))))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, segments of the path with digits as one sign, query and fragment keys with values."""
    kind = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    url = F.coalesce(url, F.lit(""))
    segments = F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/")
    query = F.split(F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), r"[0-9]+", "#"), "&")
    return F.array_distinct(
        F.concat(kind("s:", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), kind("h:", F.split(host, r"\.")), kind("p:", segments), kind("q:", query), kind("f:", F.array(F.regexp_extract(url, "(?s)#(.*)", 1))))
    )


def rule_tokens(rules: tuple[Rule, ...]) -> list[str]:
    """The tokens that hosts and paths of the rules consist of."""
    out = [f"h:{x}" for _, h, _ in rules for x in h.split(".")] + [f"p:{re.sub('[0-9]+', '#', x)}" for _, _, p in rules for x in p.split("/") if x]
    return sorted(set(out))


def items(labelled: DataFrame, least_support: float) -> DataFrame:
    """token, item, n: the tokens in enough of the labelled urls (url, tokens, verdict); those of the same urls share an item."""
    every = labelled.agg(F.count("*").alias("n")).scalar()
    held = labelled.select("url", F.explode("tokens").alias("token"))
    cover = lambda seed: F.sum(F.xxhash64(F.lit(seed), "url").cast("decimal(38,0)"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"), cover(1).alias("c1"), cover(2).alias("c2")).where(F.col("n") >= F.lit(least_support) * every)
    classes = counts.groupBy("n", "c1", "c2").agg(F.min("token").alias("item"))
    return counts.join(classes, ["n", "c1", "c2"]).select("token", "item", "n")


def sets_of(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """keys, items: the distinct items of the tokens of each row; rows without a known token have none."""
    return rows.select(*keys, F.explode_outer("tokens").alias("token")).join(known.select("token", "item"), "token", "left").groupBy(*keys).agg(F.collect_set("item").alias("items"))


def mine(labelled: DataFrame, least_support: float, least_confidence: float, asked: DataFrame | None = None) -> DataFrame:
    """items, verdict, confidence, support from items, verdict: all rules of enough of both, without rules that a shorter one of no less confidence makes needless.

    With ``asked`` (items of the urls to be judged) only those that can be the best for one of them.
    """
    scratch, every = Scratch(labelled.sparkSession, "rules"), labelled.count()
    least = math.ceil(least_support * every)
    data = scratch.table(labelled.groupBy(F.array_distinct("items").alias("items"), "verdict").agg(F.count("*").alias("c")))
    ranks = scratch.table(data.select(F.explode("items").alias("item"), "c").groupBy("item").agg(F.sum("c").alias("n")))

    def start(rows: DataFrame, *keys: str) -> DataFrame:
        """No items as the set yet, all of the row, the rarest first, as the rest."""
        held = rows.withColumn("row", F.monotonically_increasing_id())
        held = scratch.table(held).select("row", *keys, F.explode("items").alias("item")).join(ranks, "item")
        rest = F.transform(F.array_sort(F.collect_set(F.struct("n", "item"))), lambda x: x["item"]).alias("rest")
        return held.groupBy("row", *keys).agg(rest).select(F.array().cast("array<string>").alias("own"), "rest", *keys)

    ask = data.select("items").distinct() if asked is None else asked.select(F.array_distinct("items").alias("items")).distinct()
    # top: urls of the commonest sure rule known to fit; without ``asked`` all rules count, so there is none
    ask = scratch.table(start(ask).distinct().withColumn("top", F.lit(0).cast("long")))
    data = scratch.table(start(data, "verdict", "c").groupBy("own", "rest", "verdict").agg(F.sum("c").alias("c")).withColumn("of", F.lit(every).cast("long")))
    found = []
    while True:
        wanted = ask.select("own", F.explode("rest").alias("item")).distinct()
        counts = data.select("own", "of", "verdict", "c", F.explode("rest").alias("item")).groupBy("own", "of", "item", "verdict").agg(F.sum("c").alias("c"))
        counts = counts.groupBy("own", "of", "item").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.collect_list(F.struct("verdict", "c")).alias("by"))
        # an item that all urls of the set have adds nothing to it; alone it is a rule
        counts = counts.join(wanted, ["own", "item"], "left_semi").where((F.col("most") >= least) & ((F.size("own") == 0) | (F.col("n") < F.col("of"))))
        counts = scratch.table(counts)
        told = counts.select(F.array_sort(F.array_append("own", F.col("item"))).alias("items"), "n", F.inline("by")).withColumn("confidence", F.col("c") / F.col("n"))
        found.append(scratch.table(told.where((F.col("c") >= least) & (F.col("confidence") >= least_confidence)).select("items", "verdict", "confidence", (F.col("c") / F.lit(every)).alias("support"))))
        sure = F.col("most") == F.col("n")
        entries = lambda where, value: F.map_from_entries(F.collect_list(F.when(where, F.struct("item", value))))
        info = counts.groupBy("own").agg(entries(sure, F.col("most")).alias("sure"), entries(~sure & (F.col("n") < F.col("of")), F.struct("n", "most")).alias("open"))
        info = scratch.table(info.where(F.size("open") > 1))  # one open item has none to go with
        later = lambda x: F.slice(x, F.col("at") + 2, F.size(x))
        grown = [F.array_append("own", F.col("item")).alias("own"), later(F.col("rest")).alias("rest")]
        ask = ask.join(info, "own")
        if asked is not None:
            ask = ask.withColumn("top", F.greatest("top", F.array_max(F.transform("rest", lambda x: F.element_at("sure", x)))))
        ask = ask.withColumn("rest", F.filter("rest", lambda x: F.element_at("open", x)["most"] >= F.col("top")))
        ask = ask.select("own", "rest", "top", F.posexplode("rest").alias("at", "item")).select(*grown, "top").where(F.size("rest") > 0)
        ask = scratch.table(ask.groupBy("own", "rest").agg(F.min("top").alias("top")))
        if ask.isEmpty():
            break
        data = data.join(info.select("own", "open"), "own").withColumn("rest", F.filter("rest", lambda x: F.map_contains_key("open", x)))
        data = data.select("own", "rest", "open", "verdict", "c", F.posexplode("rest").alias("at", "item"))
        data = data.select(*grown, "verdict", "c", F.element_at("open", F.col("item"))["n"].alias("of")).where(F.size("rest") > 0)
        data = data.join(ask.select("own").distinct(), "own", "left_semi")
        data = scratch.table(data.groupBy("own", "rest", "verdict", "of").agg(F.sum("c").alias("c")))
    rules = found[0]
    for more in found[1:]:
        rules = rules.unionByName(more)
    rules = scratch.table(rules)
    # where a rule fits, its part fits too, with no less support: of no less confidence, the part wins
    part = rules.select(F.col("items").alias("part"), F.col("items")[0].alias("token"), "verdict", F.col("confidence").alias("of_part"))
    met = rules.withColumn("token", F.explode("items")).join(part, ["token", "verdict"]).where((F.size("part") < F.size("items")) & (F.col("of_part") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    return rules.join(met.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support")


def match(urls: DataFrame, mined: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """url, verdict, confidence of the best mined rule whose items a url (url, tokens) has; urls without one are left out."""
    own = urls.select("url", F.explode("tokens").alias("token")).join(known.select("token", "item"), "token").select("url", "item").distinct()
    own = scratch.table(own)
    counts = own.groupBy("item").agg(F.count("*").alias("urls"))
    held = mined.withColumn("rule_id", F.xxhash64("items", "verdict")).select("*", F.explode("items").alias("item")).join(counts, "item")
    # a rule with an item that no url has fits none; the others stand under their rarest item
    index = held.groupBy("rule_id", "verdict", "confidence", "support", "items").agg(F.min(F.struct("urls", "item")).alias("rare"), F.count("*").alias("n")).where("n = size(items)")
    index = index.select(F.col("rare.item").alias("item"), "items", "verdict", "confidence", "support")
    sets = own.groupBy("url").agg(F.collect_set("item").alias("all_items"))
    met = sets.select("url", "all_items", F.explode("all_items").alias("item")).join(scratch.table(index), "item").where(F.size(F.array_except("items", "all_items")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", "support", "verdict")).alias("m")).select("url", "m.verdict", "m.confidence")


def judge(
    pages: DataFrame, url: str = "url", page_id: str = "page_id", rules: tuple[Rule, ...] = RULES, default: str = "allow",
    least_support: float = 0.01, least_confidence: float = 0.8,
) -> DataFrame:
    """page_id, host, path, rule, verdict, by ('rule', 'mined' or 'default') and confidence: one row for each page."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = scratch.table(rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)))
    taken = F.array(*[F.lit(t) for t in rule_tokens(rules)]) if rules else F.array().cast("array<string>")
    found = F.array_except(tokens(F.col("url"), F.col("host"), F.col("path")), taken).alias("tokens")
    decided = rows.where("best is not null").select("url", found, F.col("best.verdict").alias("verdict")).dropDuplicates(["url"])
    left = rows.where("best is null and url is not null").select("url", found).dropDuplicates(["url"])
    columns = ["page_id", "host", "path", F.col("best.rule").alias("rule")]
    decided = scratch.table(decided)
    if decided.isEmpty():
        return rows.select(*columns, F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.when(F.col("best").isNotNull(), "rule").otherwise("default").alias("by"), F.lit(None).cast("double").alias("confidence"))
    known = scratch.table(items(decided, least_support))
    labelled, left = scratch.table(sets_of(decided, known, "url", "verdict")), scratch.table(left)
    mined = scratch.table(mine(labelled, least_support, least_confidence, sets_of(left, known, "url")))
    judged = scratch.table(match(left, mined, known, scratch).select(F.col("url").alias("u"), F.col("verdict").alias("mined"), "confidence"))
    found = rows.join(judged, rows["url"] == judged["u"], "left")
    by = F.when(F.col("best").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return found.select(*columns, F.coalesce("best.verdict", "mined", F.lit(default)).alias("verdict"), by.alias("by"), F.when(F.col("best").isNull(), F.col("confidence")).alias("confidence"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(read(spark, sf_dir, "pages"), rules=RULES).select("page_id", "host", "path", "rule", "verdict")
