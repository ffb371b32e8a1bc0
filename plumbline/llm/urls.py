"""URL filters: lists of rules first, then a tree of path templates for each host.

Segments that look like numbers, dates, hashes and the like become wildcards by their shape.  Then the tree is built
from the top: below each node, rare segments among many become one wildcard, unless their
labels surely differ from those of the others, and the segments left, in the order of their
share of good labels, are merged with those before them unless a test tells them apart from all of these or from the first; what
follows merged segments is
counted together.  A path's template is its way through the tree, and it is rejected if the share of good labels among
the labelled URLs of the template, smoothed by that of its host and of all, is below a limit.

Segments that all paths of a node share are passed at once, so rounds follow the branchings of the tree.  From the round
ONE_BY_ONE on a branch is two segments long, then four, and so on: rounds grow with the logarithm of the deepest path.

DataFrame functions only.  URLs are first counted by host and shape, the rounds work on these counts; a node has at most
RARE_SHARE + MANY + SHARES entries to order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 6
MANY = 20
RARE_SHARE = 100
SHARES = 64
ONE_BY_ONE = 12
APART = 6.63  # chi-squared, one degree of freedom, one in a hundred
SURE = 100.0  # one chance in so many that any of a node's rare children is set apart by accident
WEIGHT = 10.0
LEAST_PURITY = 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Shapes of variable segments, tried in this order.
SHAPES = (
    ("num", r"^[0-9]+$"),
    ("date", r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"),
    ("uuid", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    ("hex", r"^(?=.*[0-9])[0-9A-Fa-f]{8,}$"),
    ("long", r"^.{41,}$"),
    ("mixed", r"^(?=.*[0-9]{3}).+$"),
)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path.  The host stands after the first :// up to /, ?, # or the end, A-Z lower-cased; the path from there
    up to ?, # or the end.  Both are empty for null and where :// is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null for none.

    A rule, a host and the begin of a path, fits that host and its subdomains.  Of rules of one length that with the
    longer host wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        domain, begin = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int | None = DEPTH) -> Column:
    """The path's segments, variable ones as {shape} with their extension; {rest} stands for all below the depth, if any."""

    def shaped(s: Column) -> Column:
        stem, extension = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.lower(F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2))
        out = F.lit(None).cast("string")
        for name, pattern in reversed(SHAPES):
            out = F.when(stem.rlike(pattern), F.lit(f"{{{name}}}")).otherwise(out)
        literal = F.translate(s, "{}|", "()!")  # so that no literal looks like a wildcard
        return F.when(out.isNotNull(), F.concat(out, extension)).otherwise(literal)

    found = F.filter(F.split(path, "/"), lambda s: s != "")
    if depth is None:
        return F.transform(found, shaped)
    kept = F.transform(F.slice(found, 1, depth), shaped)
    return F.when(F.size(found) > depth, F.concat(kept, F.array(F.lit("{rest}")))).otherwise(kept)


def _differs(overall: float) -> Column:
    """Whether a child's labels are surely not drawn as those of its siblings: a bound of the binomial's tail, right for few labels too."""
    good, bad = F.col("good").cast("double"), F.col("bad").cast("double")
    n = good + bad
    of_rest = (F.col("all_good") - good + WEIGHT * overall) / (F.col("all_good") + F.col("all_bad") - n + WEIGHT)
    one = F.when(good > 0, good * F.log(good / n / of_rest)).otherwise(0.0)
    two = F.when(bad > 0, bad * F.log(bad / n / (1 - of_rest))).otherwise(0.0)
    return one + two > F.log(SURE * F.col("kinds"))


def _groups(entries: Column, overall: float) -> Column:
    """Entries of a node, by rising share, numbered so that alike ones agree: an entry stays with those before it unless it surely differs
    from all of them together, or from the first of them, so that no chain of small steps leads from one end to the other."""

    def apart(x: Column, g: Column, b: Column) -> Column:
        # (g1 / n1 - g2 / n2)^2 / (p q (1 / n1 + 1 / n2)), free of divisions by zero
        n1, n2 = (x["good"] + x["bad"]).cast("double"), (g + b).cast("double")
        gap = (x["good"] * n2 - g * n1) * (x["good"] * n2 - g * n1) * (n1 + n2)
        return gap > F.lit(APART) * n1 * n2 * (x["good"] + g) * (x["bad"] + b)

    none = F.lit(0).cast("long")
    start = F.struct(F.array().cast("array<int>").alias("numbers"), F.lit(0).alias("number"), *[none.alias(c) for c in ("g", "b", "first_g", "first_b")])

    def step(s: Column, x: Column) -> Column:
        new = apart(x, s["g"], s["b"]) | apart(x, s["first_g"], s["first_b"])
        number = s["number"] + new.cast("int")
        sums = [F.when(new, x[c]).otherwise(s[k] + x[c]).alias(k) for k, c in (("g", "good"), ("b", "bad"))]
        # The first that has labels stands for the begin of the group.
        unknown = new | (s["first_g"] + s["first_b"] == 0)
        firsts = [F.when(unknown, x[c]).otherwise(s[k]).alias(k) for k, c in (("first_g", "good"), ("first_b", "bad"))]
        return F.struct(F.concat(s["numbers"], F.array(number)).alias("numbers"), number.alias("number"), *sums, *firsts)

    return F.aggregate(entries, start, step)["numbers"]


def _round(state: DataFrame, width: int, overall: float) -> DataFrame:
    """The rows that are not at their path's end, further on: over all segments that their node's rows share, and a branch of width segments."""
    node = ["host", "template"]
    rest = F.expr("slice(segments, at + 1, size(segments))")
    ends = state.filter(F.size("segments") > F.col("at")).groupBy(*node).agg(F.min(rest).alias("a"), F.max(rest).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = written(ends.select(F.col("host").alias("of"), F.col("template").alias("so_far"), F.when(F.array_position(same, F.lit(False)) == 0, F.size("a")).otherwise(F.array_position(same, F.lit(False)) - 1).cast("int").alias("shared")), "url-shared")
    met = state.filter(F.size("segments") > F.col("at")).join(shared, (F.col("host") == F.col("of")) & (F.col("template") == F.col("so_far")))
    on = F.expr("array_join(transform(slice(segments, at + 1, shared), s -> concat('/', s)), '')")
    moved = met.select("host", "segments", "n", "good", "bad", F.concat("template", on).alias("template"), (F.col("at") + F.col("shared")).alias("at"))
    moved = written(moved.withColumn("segment", F.when(F.size("segments") > F.col("at"), F.expr(f"array_join(slice(segments, at + 1, {width}), '/')"))), "url-moved")
    here = moved.filter("segment IS NOT NULL")
    children = written(here.groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-children")
    totals = written(children.groupBy(*node).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")), "url-totals")
    known = children.join(totals, node)
    wild = F.col("segment").startswith("{") & (F.lit(width) == 1)
    few = (F.col("kinds") > MANY) & (F.col("n") * RARE_SHARE < F.col("total"))
    known = known.withColumn("token", F.when(wild, F.col("segment")).when(few & ~_differs(overall), F.lit("{*}")))
    share = (F.col("good") + WEIGHT * overall) / (F.col("good") + F.col("bad") + WEIGHT)
    # Rare children that are set apart by their labels are taken together by share first, so a node has a bounded number of entries.
    entry = F.when(few, F.concat(F.lit("/"), F.floor(share * SHARES).cast("string"))).otherwise(F.col("segment"))
    literal = known.filter("token IS NULL").withColumn("entry", entry)
    entries = literal.groupBy(*node, "entry").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("segment").alias("name"), F.count("*").alias("names"))
    each = F.struct(share.alias("share"), "entry", "good", "bad", "name", "names")
    nodes = entries.groupBy(*node).agg(F.sort_array(F.collect_list(each)).alias("entries"))
    numbered = nodes.select(*node, "entries", _groups(F.col("entries"), overall).alias("numbers")).select(*node, F.explode(F.arrays_zip("entries", "numbers")).alias("e"))
    numbered = numbered.select(*node, "e.entries.entry", F.col("e.numbers").alias("number"), F.concat(F.col("e.entries.name"), F.when(F.col("e.entries.names") > 1, F.concat(F.lit("+"), (F.col("e.entries.names") - 1).cast("string"))).otherwise(F.lit(""))).alias("name"))
    alike = numbered.groupBy(*node, "number").agg(F.sort_array(F.collect_list("name")).alias("names"), F.collect_list("entry").alias("in"))
    called = F.when(F.size("names") > 1, F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))).otherwise(F.col("names")[0])
    merged = literal.select(*node, "segment", "entry").join(alike.select(*node, F.explode("in").alias("entry"), called.alias("token")), [*node, "entry"])
    tokens = written(known.filter("token IS NOT NULL").select(*node, "segment", "token").unionByName(merged.select(*node, "segment", "token")), "url-tokens")
    longer = here.join(tokens, [*node, "segment"]).withColumn("template", F.concat("template", F.lit("/"), "token"))
    longer = longer.withColumn("at", F.least(F.col("at") + width, F.size("segments")))
    ended = moved.filter("segment IS NULL")
    return written(longer.select(*state.columns).unionByName(ended.select(*state.columns)), "url-level")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, segments, template, labelled, purity) from (host, segments, n, good, bad), distinct in the first two."""
    state = written(shapes.select("*", F.lit("").alias("template"), F.lit(0).alias("at")), "url-level")
    all_good, all_bad = state.agg(F.sum("good"), F.sum("bad")).first()
    overall = ((all_good or 0) + 1.0) / ((all_good or 0) + (all_bad or 0) + 2.0)
    done, turn = [], 0
    while state.agg(F.count_if(F.size("segments") > F.col("at"))).first()[0]:
        done.append(state.filter(F.size("segments") <= F.col("at")))
        state = _round(state, 1 << max(0, turn - ONE_BY_ONE + 1), overall)
        turn += 1
    state = functools.reduce(DataFrame.unionByName, [*done, state])
    hosts = state.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    stats = state.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"))
    of_host = (F.col("hg") + WEIGHT * overall) / (F.col("hg") + F.col("hb") + WEIGHT)
    purity = (F.col("tg") + WEIGHT * of_host) / (F.col("tg") + F.col("tb") + WEIGHT)
    stats = stats.join(hosts, "host").select("host", "template", (F.col("tg") + F.col("tb")).alias("labelled"), purity.alias("purity"))
    return state.select("host", "template", "segments").join(stats, ["host", "template"]).select("host", "segments", "template", "labelled", "purity")


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, least: float = LEAST_PURITY, depth: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, labelled, purity) for each row of pages.

    labels holds (page_id, good) with good true or false; rows that are null in either have no say, and neither have
    ids that pages lacks.  The verdict is that of the longest rule that fits, else block if the template's purity is
    below least, else allow.  A null URL, or one without ://, has an empty host and path.  Repeated rows are judged each;
    a label counts once for each row of its page id.  Rows with a null id are judged, without labels.  Other columns
    are not read.  Empty in, empty out.
    """
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", segments(F.col("path"), depth))
    votes = labels.select(F.col("page_id").alias("of"), F.col("good").cast("int").alias("good")).filter("of IS NOT NULL AND good IS NOT NULL")
    votes = votes.groupBy("of").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    labelled = rows.join(votes, F.col("page_id") == F.col("of"), "left")
    counts = labelled.groupBy("host", "segments").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = templates(counts)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, ["host", "segments"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "labelled", "purity")


def query(spark, folder: str) -> DataFrame:
    """Pages carry the id of their document as the first number of the path; its labels say whether a page is good."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    number = F.regexp_extract(parsed(F.col("url"))[1], r"([0-9]{1,18})", 1)
    named = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    good = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge(pages, named.join(good, "doc_id").select("page_id", "good"))
