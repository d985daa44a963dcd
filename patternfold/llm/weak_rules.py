"""Quality by weak supervision: rules vote good (1), bad (-1) or abstain (0), expectation-maximisation learns how
often each rule is right about good and about bad documents, and the posterior probability of good decides.

DataFrame and SQL functions only. Counts are exact over whole texts: what repeats within a text is found in the
row itself, by sorting hashes of its five-word windows, so no word is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import shared

SPACE = r"[\\x20\\x09-\\x0D]"
#: Common short words of the languages in hand, as written inside sentences.
COMMON = (
    "the of and to in is that it for was on are as with be by at this from or an have not "
    "le la les de des et un une est que dans pour par sur avec au du qui ne "
    "der die das und von zu den mit ist ein eine für auf dem nicht im als auch "
    "el los las y en del se por con para su una es al lo como"
).split()

#: Each rule: name, when it votes bad, when it votes good; else it abstains.
RULES = [
    ("length", "n_words < 10", "n_words >= 30"),
    ("word_size", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("common", "100 * n_common < 2 * n_words", "100 * n_common >= 5 * n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars", "100 * n_capitals <= 15 * word_chars"),
]
ITERATIONS, SETTLED = 60, 1e-3  # steps at most; they end when no parameter's logit moves farther
#: Bounds that keep the two classes what their names say: least and most chance of a bad vote.
BAD_IF_GOOD, BAD_IF_BAD = (0.0005, 0.05), (0.2, 0.995)


def _hashes() -> str:
    return "transform(words, w -> xxhash64(w))"


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, of every text (null: no word): n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_common, n_capitals, all long.
    """
    common = ", ".join(f"'{w}'" for w in COMMON)
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.selectExpr(*keep, "_t", f"filter(split(_t, '{SPACE}+'), w -> w != '') AS words", f"filter(split(_t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines")
    t = t.selectExpr(
        *keep,
        "cast(size(words) AS bigint) AS n_words",
        "cast(length(array_join(words, '')) AS bigint) AS word_chars",
        "cast(size(split(_t, '[#*$%&|<>]')) - 1 AS bigint) AS n_symbols",
        "cast(size(lines) AS bigint) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        f"cast(size(filter(words, w -> w in ({common}))) AS bigint) AS n_common",
        "cast(size(split(_t, '[A-Z]')) - 1 AS bigint) AS n_capitals",
        f"{_hashes()} AS _w",
    )
    t = t.selectExpr("*", "CASE WHEN n_words < 5 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) END AS _h").drop("_w")
    t = t.selectExpr("*", "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END AS _s").drop("_h")
    t = t.selectExpr("*", "CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(_s) - 1), k -> get(_s, k - 1).h <=> _s[k].h OR get(_s, k + 1).h <=> _s[k].h), k -> _s[k].i)) END AS _p").drop("_s")
    # each repeated window covers five words, less what the next one covers too
    return t.selectExpr("*", "CASE WHEN _p IS NULL THEN 0L ELSE 5L + aggregate(sequence(0, size(_p) - 2), 0L, (a, k) -> a + least(5, _p[k + 1] - _p[k])) END AS n_repeat_words").drop("_p")


def vote(counts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``counts`` with a column vote_<rule> of -1, 0 or 1 for each rule."""
    return counts.selectExpr("*", *(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{name}" for name, bad, good in rules))


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> dict:
    """Prior of good, and for each rule the chance that it votes bad (if it votes) on good and on bad documents.

    Steps go on until none of them moves by more than SETTLED (as a logit), at most ``iterations`` times.
    Works on the counts of distinct vote patterns, at most 3 to the number of rules, written once; each
    iteration is one aggregate of them, and one row comes back.
    """
    columns = [f"vote_{n}" for n in names]
    patterns = shared.written(votes.groupBy(*columns).count().coalesce(1), "votes")
    model = {"prior": 0.85, "rules": {n: (0.02, 0.5) for n in names}}
    for _ in range(iterations):
        p = patterns.withColumn("p", posterior(model, names))
        sums = [F.sum(F.col("count") * F.col("p")).alias("good"), F.sum("count").alias("all")]
        for n in names:
            v = F.col(f"vote_{n}")
            for label, on in (("bad", v == -1), ("any", v != 0)):
                sums += [F.sum(F.when(on, F.col("count") * F.col("p")).otherwise(0.0)).alias(f"{n}_{label}_g"), F.sum(F.when(on, F.col("count") * (1 - F.col("p"))).otherwise(0.0)).alias(f"{n}_{label}_b")]
        row = p.agg(*sums).first()
        if not row["all"]:
            break
        within = lambda x, bounds: min(max(x, bounds[0]), bounds[1])
        before, model = model, {
            "prior": within((row["good"] + 1) / (row["all"] + 2), (0.05, 0.98)),
            "rules": {n: (within((row[f"{n}_bad_g"] + 0.1) / (row[f"{n}_any_g"] + 5), BAD_IF_GOOD), within((row[f"{n}_bad_b"] + 2) / (row[f"{n}_any_b"] + 4), BAD_IF_BAD)) for n in names},
        }
        if max(abs(a - b) for a, b in zip(_logits(before), _logits(model))) < SETTLED:
            break
    return model


def _logits(model: dict) -> list[float]:
    return [math.log(p / (1 - p)) for p in (model["prior"], *(x for pair in model["rules"].values() for x in pair))]


def posterior(model: dict, names: list[str]):
    """Probability of good given the votes; abstentions say nothing."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for n in names:
        good, bad = model["rules"][n]
        v = F.col(f"vote_{n}")
        odds = odds + F.when(v == -1, math.log(good / bad)).when(v == 1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the counts, votes, quality (posterior of good), base_failed and kept, for each row of ``docs``.

    Null and empty texts have no word, so they fail the base; repeated rows are judged alike; other columns don't
    matter. Counts and votes are computed once and written; an empty table gives an empty result.
    """
    names = [n for n, _, _ in RULES]
    staged = shared.written(vote(text_counts(docs, text, keep)), "quality")
    model = fit(staged, names)
    out = staged.withColumn("quality", posterior(model, names)).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op2_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base and verdict of every document (null texts have no word and fail the base; repeated rows alike)."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
