import itertools
import random
import re

from pyspark.sql import functions as F

from ordina.llm import quotes, urlfilter
from ordina.llm.storage import Scratch

RULES = urlfilter.RULES


def rule_of(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, None))


def test_rules_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "no scheme.net/"), (-4, "http://EXAMPLE.Net/en/x"), (-5, "http://net"), (-6, "http://xnet/"), (-7, "https://a.org/fr/?q#f"), (-8, "ftp://a.net/b://c.org/fr/"), (-9, "http://a.example.com/de/\n://x"), (-1, None)]
    got = urlfilter.judge(pages.union(spark.createDataFrame(odd, pages.schema))).collect()
    rows = {(r.page_id): r for r in got}
    assert len(got) == pages.count() + len(odd)
    for i, url in [(r.page_id, r.url) for r in pages.collect()] + odd:
        host, path, rule, verdict = rule_of(url)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://s{i % 7}.casino.example.com/win/{i}") for i in range(40)] + [(100 + i, f"http://t{i}.news.example.com/read/{i}") for i in range(40)] + [(200, "http://other.casino.test/win/9"), (201, "http://other.news.test/read/9"), (202, "http://unknown.test/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "casino.example.com", "/"), ("allow", "news.example.com", "/"))
    got = {r.page_id: (r.verdict, r.by) for r in urlfilter.judge(pages, rules=rules, default="keep").collect()}
    assert got[200] == ("block", "mined") and got[201] == ("allow", "mined") and got[202] == ("keep", "default")


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Shall we meet?\nAt noon, at the gate."),
        (1, 1, "b", "I can't.\n\nTomorrow then."),
        (1, 2, "a", "On Monday b wrote:\n> I can't.\n> \n> Tomorrow then.\nFine."),
        (1, 3, "c", "> shall we  MEET?\n> At noon, at the gate.\n\nI'll come."),
        (1, 4, "b", ">> I can't.\n> Fine.\nGood."),
        (1, 5, "b", "> never said\nWhat?"),
        (2, 0, "a", None), (2, 1, "a", ""), (None, 0, "a", "> Fine."), (2, None, "a", "> x"), (2, 2, "b", "> self\nself"), (2, 2, "b", "> self\nself"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [one[t].reply_to for t in range(6)] == [None, None, 1, 0, 2, None]
    assert [(one[t].thread, one[t].depth, one[t].behind) for t in range(6)] == [(0, 0, 1), (1, 0, 2), (1, 1, 1), (0, 1, 0), (1, 2, 0), (5, 0, 0)]
    assert [one[t].text for t in (2, 3, 4, 5)] == ["Fine.", "I'll come.", "Good.", "What?"] and one[4].quoted_levels == 2
    assert [r.turn for r in sorted(one.values(), key=lambda r: (r.thread, -r.behind))] == [0, 3, 1, 2, 4, 5]
    assert {(r.text, r.reply_to) for r in got if r.conv_id == 2 and r.turn == 2} == {("self", None)}
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_native_and_deep(spark):
    rows = [(1, i, "u", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(40)]
    got = {r.turn: (r.thread, r.depth, r.behind) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i, 39 - i) for i in range(40)}


def test_reply_order_against_brute_force(spark):
    """Random threads, one of a hub with many replies, and a very long text; clashing names stay out."""
    rng, rows, want = random.Random(3), [], {}
    for conv in range(4):
        up, said = {}, {}
        for i in range(60):
            own = f"Words of message {i} in {conv}, say {i * i}." + (" long" * 300_000 if (conv, i) == (1, 5) else "")
            up[i] = None if i == 0 or rng.random() < 0.1 else 0 if conv == 2 and rng.random() < 0.8 else rng.randrange(i)
            said[i] = own
            rows.append((conv, i, "u", (f"> {said[up[i]]}\n" if up[i] is not None else "") + own, "x", 1))
        below = {}
        for i in range(60):
            below.setdefault(up[i], []).append(i)

        def visit(i, depth, order):
            order.append((i, depth))
            for j in below.get(i, []):
                visit(j, depth + 1, order)

        for root in below[None]:
            order = []
            visit(root, 0, order)
            for place, (i, depth) in enumerate(order):
                want[conv, i] = (up[i], root, depth, len(order) - 1 - place, said[i])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string, side int")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.behind, r.text) for r in quotes.link(df).collect()}
    assert got == want


def test_quotes_of_deeper_levels(spark):
    rows = [
        (1, 0, "a", "The first one."), (1, 1, "b", "Quite another, and longer."), (1, 2, "c", ">> The first one.\nOnly deeper."), (1, 3, "c", "> never said\n>> never said either\n>>> quite another, and longer.\nUnknown above."),
        (1, 4, "c", ">> Quite another, and longer.\n> The first one.\nThe shallowest wins."),
    ]
    got = {r.turn: (r.reply_to, r.thread, r.quoted_levels) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (None, 1, 0), 2: (0, 0, 2), 3: (1, 1, 3), 4: (0, 0, 2)}


def test_rules_of_four_tokens_and_needless_ones(spark):
    """Every three of a, b, c, d are half allowed; only the four together are blocked."""
    rows = [(["a", "b", "c", "d"], "block")] * 10 + [([x for x in "abcd" if x != out], "allow") for out in "abcd" for _ in range(10)] + [(["e", "f"], "block")] * 10
    mined = {(tuple(r.items_), r.verdict) for r in urlfilter.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.01, 0.8).withColumnRenamed("items", "items_").collect()}
    assert (("a", "b", "c", "d"), "block") in mined
    assert {(("e",), "block"), (("f",), "block")} <= mined and (("e", "f"), "block") not in mined


def test_matching_against_brute_force(spark):
    """Every url gets the best of all rules it fits, whichever item the rule stands under."""
    rng = random.Random(8)
    names = [f"t{i}" for i in range(12)]
    known = {t: f"t{i // 2 * 2}" for i, t in enumerate(names)}  # two tokens each are one item
    rules = [(sorted(rng.sample([f"t{i}" for i in range(0, 12, 2)], rng.randint(1, 4))), rng.choice(["block", "allow"]), round(rng.uniform(0.8, 1), 3), round(rng.random(), 3)) for _ in range(40)]
    urls = [(f"u{i}", rng.sample(names, rng.randint(0, 9))) for i in range(200)]
    got = urlfilter.match(
        spark.createDataFrame(urls, "url string, tokens array<string>"), spark.createDataFrame(rules, "items array<string>, verdict string, confidence double, support double"),
        spark.createDataFrame(list(known.items()), "token string, item string"), Scratch(spark, "t"),
    )
    want = {}
    for url, own in urls:
        have = {known[t] for t in own}
        fits = [(c, s, v) for i, v, c, s in rules if set(i) <= have]
        if fits:
            want[url] = (max(fits)[2], max(fits)[0])
    assert {r.url: (r.verdict, r.confidence) for r in got.collect()} == want


def test_long_urls_are_mined_in_bounds(spark):
    tail = F.concat_ws("/", *[F.concat(F.lit(f"seg{i}x"), F.when(F.hash("page_id", F.lit(i)) % 20 == 0, "q").otherwise("r")) for i in range(40)])
    df = spark.range(400).withColumnRenamed("id", "page_id").withColumn("url", F.concat(F.when(F.col("page_id") % 2 == 0, "http://spam.a.net/").otherwise("http://good.b.org/fr/"), tail)).withColumn("rule", F.lit("clash")).withColumn("verdict", F.lit(1))
    one = spark.createDataFrame([(1000, "http://spam.else.xyz/"), (1001, "http://x.y/" + "a/" * 50_000)], "page_id long, url string").withColumn("rule", F.lit("")).withColumn("verdict", F.lit(0))
    got = {r.page_id: (r.verdict, r.by) for r in urlfilter.judge(df.unionByName(one)).collect()}
    assert len(got) == 402 and got[0] == ("block", "rule") and got[1] == ("allow", "rule") and got[1000] == ("block", "mined") and got[1001][1] == "default"


def test_rule_hosts_are_no_tokens():
    assert {"h:net", "h:example", "h:com", "h:org", "p:en", "p:de", "p:fr"} == set(urlfilter.rule_tokens(RULES))


def test_mining_takes_all_items_of_a_url(spark):
    """Two items that tell nothing alone and all together, behind nine that each tell a little."""
    rng, rows = random.Random(4), []
    for i in range(160):
        x, y = i % 2, i // 2 % 2
        bad = x != y
        often = ["/".join(f"w{k}" for k in "abcdefghi" if (i // 4 + ord(k)) % 10 < (7 if bad else 5))]
        rows.append((i, f"http://{'bad' if bad else 'good'}.test/x{'no'[x]}/y{'no'[y]}/{often[0]}"))
    rng.shuffle(rows)
    everything = "/".join(f"w{k}" for k in "abcdefghi")
    asked = [(1000 + 2 * x + y, f"http://open.else/x{'no'[x]}/y{'no'[y]}/") for x in (0, 1) for y in (0, 1)] + [(2000, f"http://open.else/{everything}/xo/yn")]
    pages = spark.createDataFrame(rows + asked, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.by, r.confidence) for r in urlfilter.judge(pages, rules=(("block", "bad.test", "/"), ("allow", "good.test", "/")), default="keep").collect()}
    assert [got[1000 + k] for k in range(4)] == [("allow", "mined", 1.0), ("block", "mined", 1.0), ("block", "mined", 1.0), ("allow", "mined", 1.0)]
    assert got[2000][:2] == ("block", "mined")


def test_mining_against_brute_force(spark):
    """For each url the best of all rules over all sets of its items."""
    rng, names = random.Random(6), "abcdefghijk"
    labelled = [(sorted(x for x in names if rng.random() < 0.6), rng.choice(["allow", "block", "block"])) for _ in range(60)]
    asked = [sorted(x for x in names if rng.random() < 0.6) for _ in range(25)] + [list(names), []]
    rules = urlfilter.mine(spark.createDataFrame(labelled, "items array<string>, verdict string"), 0.1, 0.7, spark.createDataFrame([(x,) for x in asked], "items array<string>"))
    rules = [(r.confidence, r.support, r.verdict, set(r[0])) for r in rules.collect()]
    sets = [(set(x), v) for x, v in labelled]
    for own in asked:
        best = None
        for k in range(1, len(own) + 1):
            for part in itertools.combinations(own, k):
                fits = [v for x, v in sets if x.issuperset(part)]
                for v in set(fits):
                    c = fits.count(v)
                    if c >= 6 and c / len(fits) >= 0.7:
                        best = max(best or (0,), (c / len(fits), c / 60, v))
        assert max([(c, s, v) for c, s, v, part in rules if part <= set(own)], default=None) == best, own
