"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes for good (1) or bad (0) or abstains (null). Expectation-maximisation on the counts of vote patterns, of which
there are at most 3 ** rules, estimates how often each rule is right about good and about bad documents; a document's
posterior probability of being good combines its votes by these accuracies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import stored

SPACE = r"\x20\x09-\x0D"
#: votes as (good if, bad if) over the measures; the texts are valid in Spark and in other SQL engines alike
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 100", "n_words < 50"),
    "symbols": ("n_symbols = 0", "10 * n_symbols > n_words"),
    "repeats": ("20 * n_repeat_words <= n_words", "3 * n_repeat_words > n_words"),
    "lines": ("n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    "word_length": ("word_chars >= 3 * n_words and word_chars <= 9 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    "capitals": ("10 * n_capitals <= word_chars", "3 * n_capitals > word_chars"),
    "stops": ("40 * n_stops >= n_words", "n_words >= 100 and 200 * n_stops < n_words"),
    "bars": ("n_bars = 0", "10 * n_bars > n_words"),
}
ITERATIONS, KEEP = 25, 0.5
START, PRIOR = 0.8, 0.8
LOW, HIGH = 0.51, 0.999


def measured(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_stops, n_bars)` per row.

    Null and blank texts have no words. Repeats are found by sorting the hashes of a text's 3-word windows with their
    places, so the work for a text of n words is of the order n log n, whatever it repeats.
    """
    blank = " \t\n\x0b\f\r"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(blank))
    rows = rows.withColumn("words", F.when(trimmed != "", F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>")))
    many = F.size("words") - 2
    rows = rows.withColumn(
        "windows", F.when(many > 1, F.transform(
            F.sequence(F.lit(0), many - 1), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])
        )).otherwise(F.array().cast("array<bigint>")),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn(
        "ordered", F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    at = F.col("ordered")
    same = F.filter(at, lambda e, k: F.coalesce((k > 0) & (F.get(at, k - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce(F.get(at, k + 1)["h"] == e["h"], F.lit(False)))
    places = F.sort_array(F.transform(same, lambda e: e["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    rows = rows.withColumn("lines", lines)

    def count(pattern: str):
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", blank, "")).cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(repeated, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), count("[A-Z]").alias("n_capitals"), count("[.!?]").alias("n_stops"), count(r"\|").alias("n_bars"),
    )


def vote(good: str, bad: str) -> str:
    return f"CASE WHEN n_words = 0 THEN NULL WHEN {good} THEN 1 WHEN {bad} THEN 0 END"


def log_odds(right: Mapping[str, tuple], prior) -> str:
    """Log odds of good for votes `v_<rule>`; `right` has for each rule how often it is right about good and about bad."""
    parts = [f"ln({prior} / (1 - {prior}))"]
    for name, (good, bad) in right.items():
        parts.append(f"CASE v_{name} WHEN 1 THEN ln({good} / (1 - {bad})) WHEN 0 THEN ln((1 - {good}) / {bad}) ELSE 0 END")
    return " + ".join(parts)


def accuracies(votes: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, iterations: int = ITERATIONS) -> tuple[dict[str, tuple[float, float]], float]:
    """Accuracies of the rules and the share of good documents, estimated from columns `v_<rule>` over all rows.

    Each round is one aggregate over the patterns; the driver keeps two numbers a rule. Accuracies stay above one half,
    which fixes what good means, and under one. Without rows the starting values are returned.
    """
    names = list(rules)
    patterns = stored(votes.groupBy(*(f"v_{n}" for n in names)).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    right, prior = {n: (START, START) for n in names}, PRIOR
    for _ in range(iterations):
        posterior = f"1 / (1 + exp(-({log_odds(right, prior)})))"
        sums = patterns.withColumn("p", F.expr(posterior)).agg(
            F.sum("n").alias("all"), F.sum(F.col("n") * F.col("p")).alias("good"),
            *(F.sum(F.expr(f"CASE WHEN v_{n} = 1 THEN n * p ELSE 0 END")).alias(f"gg_{n}") for n in names),
            *(F.sum(F.expr(f"CASE WHEN v_{n} IS NOT NULL THEN n * p ELSE 0 END")).alias(f"g_{n}") for n in names),
            *(F.sum(F.expr(f"CASE WHEN v_{n} = 0 THEN n * (1 - p) ELSE 0 END")).alias(f"bb_{n}") for n in names),
            *(F.sum(F.expr(f"CASE WHEN v_{n} IS NOT NULL THEN n * (1 - p) ELSE 0 END")).alias(f"b_{n}") for n in names),
        ).first()
        if not sums["all"]:
            break

        def bounded(part: float, whole: float) -> float:
            return min(HIGH, max(LOW, (part + 1) / (whole + 2)))

        right = {n: (bounded(sums[f"gg_{n}"], sums[f"g_{n}"]), bounded(sums[f"bb_{n}"], sums[f"b_{n}"])) for n in names}
        prior = min(HIGH, max(1 - HIGH, (sums["good"] + 1) / (sums["all"] + 2)))
    return right, prior


def judged(docs: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, keep: float = KEEP) -> DataFrame:
    """Measures, votes, `base_failed`, `posterior` and `kept` per row of `docs(doc_id, text)`.

    `base_failed`: fewer than 50 words, or more than half of them in repeated windows. `kept` is false then, else whether
    the posterior reaches `keep`. Texts without words get no votes. Rows keep their number, repeated or with null ids; other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = measured(docs).withColumns({f"v_{n}": F.expr(vote(*texts)) for n, texts in rules.items()})
    rows = stored(rows, "votes")
    right, prior = accuracies(rows, rules)
    rows = rows.withColumn("posterior", F.expr(f"1 / (1 + exp(-({log_odds(right, prior)})))"))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep))
