"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good (+1), bad (-1) or abstains (0) on a document's measures. Expectation-maximisation then
estimates, for each rule and for either true class, how often it gives each vote, and with that how far a
document's votes can be trusted; the posterior probability of the good class replaces the rule that every
test must pass. The fit runs over the histogram of vote patterns (at most 3 to the number of rules, whatever
the corpus holds), as one SQL expression, and counts all documents.

Cases: a null text counts as an empty one; documents that fail the base limits are never kept; a repeated row
counts and is judged each time; an empty table gives no rows. Texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import GAP_CLASS, WORD_CLASS, cut, let, read

WINDOW = 5
RULES = ("length", "symbols", "lines", "repeats", "word_length", "case", "shouting", "variety", "sentences", "marks", "plain_words")
STEPS = 25
#: Weight of the prior, as a share of all documents: a rule is taken to fault few good documents (the first row,
#: by vote -1, 0, 1) and many bad ones (the second), until the votes say otherwise.
PRIOR_WEIGHT = 0.03
PRIOR_GOOD, PRIOR_BAD = (0.02, 0.49, 0.49), (0.34, 0.33, 0.33)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{GAP_CLASS}+"), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Where none repeats, that is all; else the starts of repeated windows
    are put in order and the words they cover counted, so that the cost is that of a sort.
    """
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(g: Column) -> Column:
        paired = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        count = lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(width), x - F.get(p, k - 1)), F.lit(width))), F.lit(0), lambda a, x: a + x)
        return let(paired, lambda s: let(starts(s), count))

    return let(words, lambda w: F.when(F.size(w) < width, 0).otherwise(let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))))


def measures(documents: DataFrame) -> DataFrame:
    """doc_id and the measures that rules vote on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
    )
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return documents.select(
        "doc_id", let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"), count("[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"), count("!").alias("n_shouts"), count(r"[.!?](?=\s|$)").alias("n_sentences"),
        count(r"[^\p{L}\s]").alias("n_marks"), count(r"(?<!\S)[^\p{L}\s]+(?!\S)|([^\p{L}\p{N}\s])\1\1").alias("n_odd_words"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_shouts", "n_sentences", "n_marks", "n_odd_words")


def votes() -> list[Column]:
    """The rules, in the order of RULES."""
    c = F.col
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    veto = lambda bad: F.when(bad, -1).otherwise(0)  # noqa: E731  says nothing of documents that it does not fault
    mean = chars / words
    return [
        vote(c("n_words") < 10, c("n_words") >= 40),
        veto(c("n_symbols") / chars > 0.05),
        veto(c("n_dup_lines") / lines > 0.3),
        veto(c("n_repeat_words") / words > 0.2),
        veto((mean < 2.5) | (mean > 12)),
        veto(c("n_upper") / chars > 0.4),
        veto(c("n_shouts") / words > 0.1),
        vote((c("n_words") >= 20) & (c("n_distinct_words") / words < 0.2), (c("n_words") >= 20) & (c("n_distinct_words") / words > 0.4)),
        vote((c("n_words") >= 40) & (c("n_sentences") / words < 0.01), (c("n_sentences") / words >= 0.02) & (c("n_sentences") / words <= 0.34)),
        veto(c("n_marks") / chars > 0.12),
        veto((c("n_words") >= 10) & (c("n_odd_words") / words > 0.15)),
    ]


def fit(voted: DataFrame, rules: int, steps: int = STEPS) -> list[float]:
    """From ``voted(votes)``: the share of good documents, then for each rule, class (bad, good) and vote (-1, 0, 1) its probability."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"), F.sum("n").alias("total"))

    def expectation(p: Column, s: Column) -> Column:
        log_of = lambda v, good: F.aggregate(F.transform(v, lambda x, j: F.ln(F.get(s, 1 + j * 6 + (3 if good else 0) + x + 1))), F.lit(0.0), lambda a, b: a + b)
        odds = lambda v: F.ln(F.get(s, F.lit(0))) - F.ln(1 - F.get(s, F.lit(0))) + log_of(v, True) - log_of(v, False)
        return F.transform(p, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (1 / (1 + F.exp(-odds(x["votes"])))).alias("r")))

    def maximisation(e: Column) -> Column:
        mass = lambda good: F.aggregate(e, F.lit(0.0), lambda a, x: a + x["n"] * (x["r"] if good else 1 - x["r"]))
        total = lambda g, b: F.array((g + 1) / (g + b + 2))

        def cell(k: Column, g: Column, b: Column) -> Column:
            rule, good, vote = F.floor(k / 6).cast("int"), F.pmod(F.floor(k / 3).cast("int"), F.lit(2)) == 1, F.pmod(k, F.lit(3)) - 1
            hit = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.when(F.get(x["votes"], rule) == vote, x["n"] * F.when(good, x["r"]).otherwise(1 - x["r"])).otherwise(0.0))
            prior = F.get(F.array(*[F.lit(v) for v in (*PRIOR_BAD, *PRIOR_GOOD)]), F.pmod(k, F.lit(6)))
            return (hit + PRIOR_WEIGHT * (g + b) * prior) / (F.when(good, g).otherwise(b) + PRIOR_WEIGHT * (g + b))

        return let(mass(True), lambda g: let(mass(False), lambda b: F.concat(total(g, b), F.transform(F.sequence(F.lit(0), F.lit(rules * 6 - 1)), lambda k: cell(k, g, b)))))

    # Before the first step, a document leans to bad with each bad vote and to good with each good one.
    lean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x < 0, -3.0).when(x > 0, 0.5).otherwise(0.0))
    start = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (1 / (1 + F.exp(-lean(x["votes"])))).alias("r")))
    state = let(start, maximisation)
    fitted = row.where("total > 0").select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: let(expectation(F.col("p"), s), maximisation)).alias("s"))
    got = fitted.first()  # a fixed count of numbers
    return list(got["s"]) if got else [0.5] + [1 / 3] * (rules * 6)


def accuracies(state: list[float]) -> dict[str, float]:
    """How often each rule is right when it does not abstain."""
    out = {}
    for j, name in enumerate(RULES):
        bad, good = state[1 + j * 6 : 4 + j * 6], state[4 + j * 6 : 7 + j * 6]
        right = (1 - state[0]) * bad[0] + state[0] * good[2]
        out[name] = right / (right + (1 - state[0]) * bad[2] + state[0] * good[0])
    return out


def posterior(state: list[float], rules: int) -> Column:
    """The probability that a document with these ``votes`` is good."""
    import math

    odds = F.lit(math.log(state[0]) - math.log(1 - state[0]))
    for j in range(rules):
        vote, gain = F.get("votes", F.lit(j)), [math.log(state[4 + j * 6 + v] / state[1 + j * 6 + v]) for v in range(3)]
        odds = odds + F.when(vote < 0, gain[0]).when(vote > 0, gain[2]).otherwise(gain[1])
    return 1 / (1 + F.exp(-odds))


def judge(documents: DataFrame) -> DataFrame:
    """Measures, base limits, votes, posterior and verdict per document."""
    voted = cut(measures(documents).withColumn("votes", F.array(*votes())))
    state = fit(voted, len(RULES))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.withColumn("posterior", posterior(state, len(RULES)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
