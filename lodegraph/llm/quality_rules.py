"""Weak supervision over quality rules, in DataFrame expressions only.

Rules look at a document's measures and vote bad or good, or abstain.
Expectation-maximisation over the counts of vote patterns (at most 2**7 rows,
whatever the number of documents) estimates how often each rule votes on good and on
bad documents, which is its accuracy, and the share of good documents; the posterior
probability of being good, given who voted and who abstained, decides.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; repeated rows give repeated results; an empty table gives no rows;
only doc_id and text are read. A posterior of exactly one half keeps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
BITS = 30  # no text that Spark holds has more words than this many bits count
ROUNDS = 25
#: How often a rule that votes bad, or good, is thought to vote on good and on bad documents before any is seen; the
#: share of good documents; and for how many documents these guesses count.
BAD_RULE, GOOD_RULE, EVEN, WEIGHT = (0.05, 0.3), (0.7, 0.1), 0.5, 10.0
#: (rule, what it votes, when); where the condition doesn't hold the rule abstains. Healthy
#: signs are one rule, not six: they go together on every clean text, and six voters who
#: copy each other would outvote any single sign of junk.
RULES = [
    ("symbols", -1, "5 * n_symbols > n_words"),
    ("capitals", -1, "10 * n_upper > 4 * word_chars"),
    ("exclaims", -1, "10 * n_bangs > 3 * n_words"),
    ("lines", -1, "2 * n_dup_lines > n_lines"),
    ("repeats", -1, "100 * n_repeat_words > 40 * n_words"),
    ("length", -1, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("clean", 1, "20 * n_symbols < n_words AND 10 * n_upper < 2 * word_chars AND 20 * n_bangs < n_words AND 2 * n_dup_lines <= n_lines AND 100 * n_repeat_words <= 40 * n_words AND word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
]
VOTES = [f"v_{name}" for name, _, _ in RULES]
#: The share of good documents is like one more rule, which votes on every document.
PRIORS = [BAD_RULE if vote < 0 else GOOD_RULE for _, vote, _ in RULES] + [(EVEN, 1 - EVEN)]
Rates = list[tuple[float, float]]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text. Each array is named before it is used twice, so that it is made once."""

    def near(xs: Column, key, k: Column) -> Column:
        x = key(F.get(xs, k))
        return F.coalesce(x == key(F.get(xs, k - 1)), F.lit(False)) | F.coalesce(x == key(F.get(xs, k + 1)), F.lit(False))

    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("w", F.array_remove(F.split("text", SPACE), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    w, low = F.col("w"), F.lit((1 << BITS) - 1).cast("long")
    # three-word windows by a hash with their place below it: sorting longs is cheap, and what it finds is checked by the words
    d = d.withColumn("p", F.sort_array(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), BITS).bitwiseOR(i.cast("long")))))
    p = F.col("p")
    d = d.withColumn("c", F.filter(p, lambda x, k: near(p, lambda y: F.shiftright(y, BITS), k)))
    d = d.withColumn("t", F.sort_array(F.transform("c", lambda x: F.struct(F.concat_ws(" ", F.get(w, x.bitwiseAND(low).cast("int")), F.get(w, x.bitwiseAND(low).cast("int") + 1), F.get(w, x.bitwiseAND(low).cast("int") + 2)).alias("s"), x.bitwiseAND(low).cast("int").alias("i")))))
    t = F.col("t")
    d = d.withColumn("s", F.sort_array(F.transform(F.filter(t, lambda x, k: near(t, lambda y: y["s"], k)), lambda x: x["i"])))
    s = F.col("s")
    return d.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
    )


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"v_{name}": F.expr(f"CASE WHEN {when} THEN {vote} ELSE 0 END") for name, vote, when in RULES})


def log_odds(votes, rates: Rates) -> float:
    """Of being good, for votes (0 for abstaining) of the rules, by how often each votes on good and on bad documents."""
    return sum(math.log(g / b) if v else math.log((1 - g) / (1 - b)) for v, (g, b) in zip((*votes, 1), rates, strict=True))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Rates:
    """How often each rule votes on good and on bad documents, and the share of either, by expectation-maximisation over pattern counts."""
    rates = list(PRIORS)
    for _ in range(rounds):
        good = [n / (1 + math.exp(-log_odds(votes, rates))) for votes, n in patterns]
        bad = [n - x for (_, n), x in zip(patterns, good, strict=True)]
        voted = lambda r, of: sum(x for (votes, _), x in zip(patterns, of, strict=True) if votes[r])
        g, b = sum(good), sum(bad)
        rates = [((voted(r, good) + WEIGHT * p) / (g + WEIGHT), (voted(r, bad) + WEIGHT * q) / (b + WEIGHT)) for r, (p, q) in enumerate(PRIORS[:-1])]
        rates.append(((g + WEIGHT * EVEN) / (g + b + WEIGHT), (b + WEIGHT * (1 - EVEN)) / (g + b + WEIGHT)))
    return rates


def accuracies(rates: Rates) -> dict[str, float]:
    """How often each rule is right where it votes."""
    share, rest = rates[-1]
    return {name: (share * g if vote > 0 else rest * b) / (share * g + rest * b) for (name, vote, _), (g, b) in zip(RULES, rates, strict=False)}


def judge(docs: DataFrame) -> DataFrame:
    """The measures, votes, base_failed, p_good and kept of every row."""
    rows = common.stored(with_votes(measures(docs)), "quality")
    patterns = [(tuple(r[v] for v in VOTES), r["n"]) for r in rows.groupBy(*VOTES).agg(F.count("*").alias("n")).orderBy(*VOTES).collect()]
    rates = fit(patterns)
    odds = F.lit(math.log(rates[-1][0] / rates[-1][1]))
    for v, (g, b) in zip(VOTES, rates, strict=False):
        odds = odds + F.when(F.col(v) != 0, math.log(g / b)).otherwise(math.log((1 - g) / (1 - b)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (odds >= 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *cols, "base_failed", "kept", F.round("p_good", 4).alias("p_good"), *VOTES)


def _oracle() -> str:
    votes = ", ".join(f"CASE WHEN {when} THEN {vote} ELSE 0 END AS v_{name}" for name, vote, when in RULES)
    long = " UNION ALL ".join(f"SELECT pid, n, {i} AS rule, {v} AS vote FROM pat" for i, v in enumerate([*VOTES, "1"]))
    priors = ", ".join(f"({i}, {g}::DOUBLE, {b}::DOUBLE)" for i, (g, b) in enumerate(PRIORS))
    gain = "CASE WHEN {vote} <> 0 THEN ln({g} / {b}) ELSE ln((1 - {g}) / (1 - {b})) END"
    last, guess = len(RULES), f"{WEIGHT} * any_value"
    same = " AND ".join(f"v.{v} = q.{v}" for v in VOTES)
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS lines FROM base),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM ws WHERE len(w) >= 3),
txt AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM tri),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM txt) WHERE c > 1),
cover AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT ws.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs FROM ws LEFT JOIN cover USING (rid)),
v AS (SELECT *, {votes} FROM m),
pat AS (SELECT row_number() OVER () AS pid, * FROM (SELECT {', '.join(VOTES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL)),
long AS ({long}),
priors(rule, pg, pb) AS (VALUES {priors}),
em(it, rule, g, b) AS (
  SELECT 0, rule, pg, pb FROM priors
  UNION ALL
  SELECT it + 1, rule, CASE WHEN rule = {last} THEN (sum(n * q) + {guess}(pg)) / (sum(n) + {WEIGHT}) ELSE (sum(CASE WHEN vote <> 0 THEN n * q ELSE 0 END) + {guess}(pg)) / (sum(n * q) + {WEIGHT}) END,
    CASE WHEN rule = {last} THEN (sum(n * (1 - q)) + {guess}(pb)) / (sum(n) + {WEIGHT}) ELSE (sum(CASE WHEN vote <> 0 THEN n * (1 - q) ELSE 0 END) + {guess}(pb)) / (sum(n * (1 - q)) + {WEIGHT}) END FROM (
    SELECT em.it, l.n, l.rule, l.vote, pg, pb, 1 / (1 + exp(-sum({gain.format(vote='l.vote', g='em.g', b='em.b')}) OVER (PARTITION BY l.pid))) AS q
    FROM long l JOIN em USING (rule) JOIN priors USING (rule) WHERE em.it < {ROUNDS}) GROUP BY it, rule),
q AS (SELECT pid, sum({gain.format(vote='vote', g='em.g', b='em.b')}) AS odds FROM long JOIN em USING (rule) WHERE it = {ROUNDS} GROUP BY pid),
verdict AS (SELECT {', '.join(VOTES)}, odds >= 0 AS good, round(1 / (1 + exp(-odds)), 4) AS p_good FROM pat JOIN q USING (pid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)) AND q.good AS kept, q.p_good, {', '.join('v.' + x for x in VOTES)}
FROM v JOIN verdict q ON {same}
"""


ORACLE = _oracle()
