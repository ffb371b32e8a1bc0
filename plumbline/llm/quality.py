"""Quality rules as weak supervision.

Every rule votes good, votes bad or abstains on a document.  Expectation-maximisation on the table of vote patterns
estimates how far each rule can be trusted on good and on bad documents, and a document is judged by the posterior
probability that it is good, instead of having to pass every rule.

Only DataFrame functions are used.  Counts are taken row by row inside generated code, the vote patterns (at most
3 to the number of rules, whatever the corpus) are grouped with map-side sums, and every round of the estimation is one
aggregate over that table, written once to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, WORD, written

ROUNDS = 25
# Weight of the belief that a rule is right, in documents: on good ones, on bad ones, and for the share of good ones.
RIGHT_ON_GOOD, WRONG_ON_GOOD = 99.0, 1.0
RIGHT_ON_BAD, WRONG_ON_BAD = 1.0, 1.0
GOOD_DOCS, BAD_DOCS = 9.0, 1.0
FIRST_GUESS = 0.9


@dataclass(frozen=True)
class Rule:
    """Conditions over the counts, as SQL that Spark and others read alike; neither met: the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "word_chars >= 2 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeats", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 45 * n_words"),
    Rule("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "5 * n_capitals <= n_letters", "2 * n_capitals > n_letters"),
    Rule("stops", "100 * n_stops >= n_words AND 4 * n_stops <= n_words", "2 * n_stops > n_words"),
    Rule("letters", "10 * n_letters >= 8 * word_chars", "10 * n_letters < 6 * word_chars"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_capitals", "n_letters", "n_stops"]


def _matches(text: Column, pattern: str) -> Column:
    """How many characters of the text are in a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash another window of the text has too; windows are (hash, position), sorted."""
    twice = F.filter(
        windows,
        lambda w, i: (w["h"] == F.get(windows, i - 1)["h"]) | (w["h"] == F.get(windows, i + 1)["h"]),
    )
    return F.sort_array(F.transform(twice, lambda w: w["p"]))


def counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep and COUNTS of every whole text; a null text counts as empty.

    Three-word windows are compared by 64-bit hash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept")] if keep else [F.struct(F.lit(1).alias("_")).alias("_kept")]
    base = docs.select(*kept, t.alias("t"))
    # Arrays that lambdas refer to must be columns of their own, else they are built again for every element.
    lists = base.select(
        "_kept",
        "t",
        F.filter(F.split(F.regexp_replace("t", f"[{SPACES}]+", " "), " "), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
    )
    n = F.size("words")
    windows = lists.select(
        "*",
        F.sort_array(
            F.transform(
                F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(
                    F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")
                ),
            )
        ).alias("windows"),
    )
    places = windows.select("*", _repeat_words(F.col("windows")).alias("places"))
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
    )["n"]
    found = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": _matches(F.col("t"), "[#*$%&|<>]"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_lines": F.size("lines"),
        "n_repeat_words": covered,
        "n_capitals": _matches(F.col("t"), r"\p{Lu}"),
        "n_letters": _matches(F.col("t"), r"\p{L}"),
        "n_stops": F.regexp_count(F.col("t"), F.lit(f"[.!?][{SPACES}]")),
    }
    return places.select("_kept", *[c.cast("long").alias(k) for k, c in found.items()]).select(*([f"_kept.`{c}`" for c in keep] if keep else []), *COUNTS)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as slots: 0 stands for the document itself, 2i+1 for a good vote of rule i, 2i+2 for a bad one.

    Of both conditions the bad one wins; a rule that abstains adds nothing.
    """
    cast = [F.expr(f"CASE WHEN {r.bad} THEN {2 * i + 2} WHEN {r.good} THEN {2 * i + 1} END") for i, r in enumerate(rules)]
    return F.array_compact(F.array(F.lit(0), *cast))


@dataclass(frozen=True)
class Trust:
    """What the estimation found: the share of good documents, and how often each rule is right on good and bad ones."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def posterior(self, slots: Column) -> Column:
        """The probability that a document with these votes is good."""
        weights = [math.log(self.good / (1 - self.good))]
        for a, b in zip(self.right_on_good, self.right_on_bad, strict=True):
            weights += [math.log(a / (1 - b)), math.log((1 - a) / b)]
        table = F.array(*map(F.lit, weights))
        return 1 / (1 + F.exp(-F.aggregate(slots, F.lit(0.0), lambda s, j: s + F.get(table, j))))


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Trust:
    """Expectation-maximisation over (votes, n) patterns; a round brings two sums for each slot to the driver.

    The first guess holds documents without a bad vote for good.  A rule never does worse than chance on both kinds
    together, so a good vote never speaks against a document.  An empty table gives the prior beliefs.
    """
    bad = F.exists("votes", lambda j: (j > 0) & (j % 2 == 0))
    p, trust = F.when(bad, 1 - FIRST_GUESS).otherwise(FIRST_GUESS), None
    for _ in range(rounds):
        weighed = patterns.select("n", p.alias("p"), F.explode("votes").alias("slot"))
        sums = weighed.groupBy("slot").agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p"))))
        found = {r[0]: (float(r[1]), float(r[2])) for r in sums.collect()}
        none = (0.0, 0.0)
        on_good, on_bad = [], []
        for i in range(len(rules)):
            (gg, bg), (gb, bb) = found.get(2 * i + 1, none), found.get(2 * i + 2, none)
            a = (gg + RIGHT_ON_GOOD) / (gg + gb + RIGHT_ON_GOOD + WRONG_ON_GOOD)
            on_good.append(a)
            on_bad.append(max((bb + RIGHT_ON_BAD) / (bg + bb + RIGHT_ON_BAD + WRONG_ON_BAD), 1 - a))
        good, bad_docs = found.get(0, none)
        trust = Trust((good + GOOD_DOCS) / (good + bad_docs + GOOD_DOCS + BAD_DOCS), tuple(on_good), tuple(on_bad))
        p = trust.posterior(F.col("votes"))
    return trust


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Trust:
    """Trust in the rules from all documents; documents that fail the base have no say, they are rejected anyway."""
    patterns = counted.filter(f"NOT ({BASE_FAILED})").groupBy(votes(rules).alias("votes")).agg(F.count("*").alias("n"))
    return estimate(written(patterns.repartition(1), "vote-patterns"), rules, rounds)


def judged(counted: DataFrame, trust: Trust, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Adds base_failed, posterior and kept to the rows of counts()."""
    out = counted.select("*", F.expr(BASE_FAILED).alias("base_failed"), votes(rules).alias("votes"))
    out = out.select("*", trust.posterior(F.col("votes")).alias("posterior"))
    return out.select("*", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """A row per document: its id, COUNTS, the votes, base_failed, posterior and kept.

    A null or empty text has no words and fails the base.  Repeated rows and null ids are judged row by row; equal
    counts get equal verdicts.  Other columns of docs are not read.  An empty table gives an empty result.
    """
    counted = written(counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]), "quality-counts")
    return judged(counted, fit(counted, rules), rules, least)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The documents that are kept, all their columns unchanged; judged as by quality()."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    counted = written(counts(packed, keep=["row"]), "counted-documents")
    return judged(counted, fit(counted, rules), rules, least).filter("kept").select("row.*")


def query(spark, folder: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL for DuckDB; every round of the estimation is a table of one row."""
    k = range(len(RULES))
    any_bad = " OR ".join(f"coalesce(v_{r.name} = 0, false)" for r in RULES)
    steps = [f"e0 AS (SELECT p.*, CASE WHEN {any_bad} THEN {1 - FIRST_GUESS!r} ELSE {FIRST_GUESS} END::DOUBLE AS p FROM pat p)"]
    odds = "ln(t.good / (1 - t.good)) + " + " + ".join(
        f"CASE v_{r.name} WHEN 1 THEN ln(t.a{i} / (1 - t.b{i})) WHEN 0 THEN ln((1 - t.a{i}) / t.b{i}) ELSE 0 END" for i, r in enumerate(RULES)
    )
    for step in range(ROUNDS):
        sums = ", ".join(
            f"coalesce(sum(CASE WHEN v_{r.name} = {v} THEN n * {w} END), 0)::DOUBLE AS {x}{i}"
            for i, r in enumerate(RULES)
            for x, v, w in (("gg", 1, "p"), ("gb", 0, "p"), ("bg", 1, "(1 - p)"), ("bb", 0, "(1 - p)"))
        )
        rates = ", ".join(
            f"(gg{i} + {RIGHT_ON_GOOD}) / (gg{i} + gb{i} + {RIGHT_ON_GOOD + WRONG_ON_GOOD}) AS a{i}, "
            f"greatest((bb{i} + {RIGHT_ON_BAD}) / (bg{i} + bb{i} + {RIGHT_ON_BAD + WRONG_ON_BAD}), "
            f"1 - (gg{i} + {RIGHT_ON_GOOD}) / (gg{i} + gb{i} + {RIGHT_ON_GOOD + WRONG_ON_GOOD})) AS b{i}"
            for i in k
        )
        steps.append(f"s{step} AS MATERIALIZED (SELECT coalesce(sum(n * p), 0)::DOUBLE AS g, coalesce(sum(n), 0)::DOUBLE AS m, {sums} FROM e{step})")
        steps.append(f"t{step} AS MATERIALIZED (SELECT (g + {GOOD_DOCS}) / (m + {GOOD_DOCS + BAD_DOCS}) AS good, {rates} FROM s{step})")
        steps.append(f"e{step + 1} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds}))) AS p FROM pat p, t{step} t)")
    vote = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END AS v_{r.name}" for r in RULES)
    names = ", ".join(f"v_{r.name}" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM l)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS x FROM twice) GROUP BY r),
f AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
  (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters,
  len(regexp_extract_all(t, '[.!?][{SPACES}]'))::BIGINT AS n_stops
  FROM l LEFT JOIN rep USING (r)),
v AS MATERIALIZED (SELECT *, {BASE_FAILED} AS base_failed, {vote} FROM f),
pat AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, t{ROUNDS - 1} t"""


ORACLE_SQL = _oracle()
