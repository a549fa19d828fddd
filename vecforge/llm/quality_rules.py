"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), votes bad (-1) or abstains (0). The votes of all
documents are counted by vote pattern, at most 3 ** len(RULES) rows; expectation
maximisation over that table estimates how each rule votes on good and on bad
documents and how many documents are good. A document's score is
its posterior probability of being good; no single rule can reject it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
#: Rules over the statistics: SQL of "votes bad", SQL of "votes good"; what is neither abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "n_words >= 40"),
    "repetition": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words and n_words >= 10"),
    "symbols": ("100 * n_symbols > 6 * word_chars", "false"),
    "symbol_runs": ("100 * n_symbol_runs > 25 * n_words", "false"),
    "lines": ("100 * n_dup_lines > 50 * n_lines", "false"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words or n_words = 0", "word_chars between 4 * n_words and 9 * n_words and n_words > 0"),
    "capitals": ("100 * n_capitals > 30 * word_chars", "false"),
    "shouting": ("100 * n_shouts > 25 * n_words", "false"),
    "variety": ("100 * n_distinct < 15 * n_words", "100 * n_distinct >= 35 * n_words and n_words >= 10"),
}


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each whole text; a null text has no words and counts of 0.

    n_repeat_words counts the words in 5-word windows that the text has twice
    or more: windows are hashed, sorted with their places, and equal neighbours
    mark their words; texts whose windows are all different skip that.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD)))
    hashed = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5)))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("t", F.lit("[!?]+")).cast("long").alias("n_shouts"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(F.size("w") >= 5, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    rows = rows.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    placed = F.array_sort(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(1), F.size("h")).alias("i")))
    rows = rows.withColumn("s", F.when(F.col("repeats"), placed))
    pair = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    places = F.sort_array(F.array_distinct(F.flatten(pair)))
    rows = rows.withColumn("p", F.when(F.col("repeats"), places))
    # Sorted window starts cover min(5, distance to the next start) words each, the last one 5.
    covered = F.aggregate(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(5))), F.lit(5), lambda n, x: n + x)
    return rows.select(*rows.columns[:10], F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"))


@dataclass
class Fitted:
    """Share of good documents; by rule the chances of the votes (-1, 0, 1) on good and on bad documents."""

    good: float
    on_good: dict[str, list[float]]
    on_bad: dict[str, list[float]]

    def posterior(self):
        """Column of the posterior probability of good, from the columns vote_<rule>."""
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for r, chances in self.on_good.items():
            weight = [math.log(g / b) for g, b in zip(chances, self.on_bad[r], strict=True)]
            vote = F.col(f"vote_{r}")
            logit = logit + F.when(vote == -1, weight[0]).when(vote == 1, weight[2]).otherwise(weight[1])
        return 1 / (1 + F.exp(-logit))


#: Pseudo-counts of the votes (-1, 0, 1) on good and on bad documents.
PRIOR = ((0.2, 4.4, 5.4), (3.0, 4.0, 3.0))
#: A rule votes bad on a good document at most this often.
FALSE_ALARM = 0.02


def votes(stats: DataFrame) -> DataFrame:
    cases = [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"vote_{r}") for r, (bad, good) in RULES.items()]
    return stats.select("*", *cases)


def fit(voted: DataFrame, rounds: int = 40) -> Fitted:
    """Expectation maximisation over the counted patterns.

    It starts from "a document with a bad vote is bad" (held at 0.95), which
    all-must-pass filtering would take for final. Chances are smoothed by
    PRIOR, a rule's false alarms stay under FALSE_ALARM, so a rule that seldom
    agrees with others keeps its meaning, and the good share stays in 0.05 to
    0.95. An empty table gives the priors.
    """
    names = list(RULES)
    counted = voted.groupBy(*[f"vote_{r}" for r in names]).count().collect()  # 3 ** len(RULES) rows at most
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted)
    chances = [[[x / sum(PRIOR[y]) for x in PRIOR[y]] for _ in names] for y in (0, 1)]
    good, first = 0.8, True
    for _ in range(rounds if patterns else 0):
        mass = [0.0, 0.0]
        seen = [[list(PRIOR[y]) for _ in names] for y in (0, 1)]
        for pattern, n in patterns:
            logit = math.log(good / (1 - good)) + sum(math.log(chances[0][j][v + 1] / chances[1][j][v + 1]) for j, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-min(500.0, max(-500.0, logit))))
            if first:
                p = 0.05 if -1 in pattern else 0.95
            for y, w in ((0, n * p), (1, n * (1 - p))):
                mass[y] += w
                for j, v in enumerate(pattern):
                    seen[y][j][v + 1] += w
        first = False
        good = min(0.95, max(0.05, mass[0] / sum(mass)))
        chances = [[[x / sum(row) for x in row] for row in seen[y]] for y in (0, 1)]
        for j, (alarm, rest, agree) in enumerate(chances[0]):
            if alarm > FALSE_ALARM:
                k = (1 - FALSE_ALARM) / (rest + agree)
                chances[0][j] = [FALSE_ALARM, rest * k, agree * k]
    return Fitted(good, *(dict(zip(names, chances[y], strict=True)) for y in (0, 1)))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: statistics, votes, `quality` (posterior), base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated
    windows. Null and empty texts have no words and fail it. Null ids and
    repeated rows are judged like others; an empty table gives no rows.
    """
    voted = written(votes(statistics(docs, doc_id, text)), "votes")
    model = fit(voted)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    out = voted.withColumn("quality", model.posterior()).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
