"""Quality rules (operator 7): base counts and a learned decision list, in DataFrame functions only.

Sequential covering learns rules for rejecting: a rule grows, threshold by threshold, on two thirds
of the labelled rows by information gain, is pruned on the last third, and is taken if it stays
precise there; the rows it covers leave and the next rule begins. The list becomes one ordered
conditional expression. Counts for each step come from one grouped aggregation over binned
statistics; only those counts (features x bins x 4) reach the driver.

Null and empty texts have no words: all counts are 0, base_failed holds and kept is false. Labels
that are null, or of unknown documents, teach nothing; without labels the list is empty and only
the base decides. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, table, written

SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def neighbours(sorted_values: Column, join: Callable[[Column, Column], Column]) -> Column:
    n = F.size(sorted_values)
    return F.zip_with(F.slice(sorted_values, 1, n - 1), F.slice(sorted_values, 2, n - 1), join)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that come twice or more; windows by 64-bit hashes within a text."""

    def spread(positions: Column) -> Column:
        """Words covered by windows at these ascending positions."""
        return F.when(F.size(positions) == 0, F.lit(0)).otherwise(F.aggregate(neighbours(positions, lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda s, x: s + x))

    def few(windows: Column, twice: Column) -> Column:
        return spread(F.filter(F.transform(windows, lambda w, i: F.when(F.array_contains(twice, w), i)), lambda i: i.isNotNull()))

    def many(windows: Column) -> Column:
        """For texts with many repeated windows: sort (window, position) pairs."""
        return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), lambda s: spread(F.sort_array(F.array_distinct(F.flatten(neighbours(s, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))))

    def count(windows: Column) -> Column:
        return let(
            F.array_distinct(F.filter(let(F.sort_array(windows), lambda s: neighbours(s, lambda a, b: F.when(a == b, a))), lambda x: x.isNotNull())),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 64, few(windows, twice)).otherwise(many(windows)),
        )

    hashed = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), count)))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed and the statistics that rules may use, in a struct `_m`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    words = docs.withColumn("_words", F.filter(F.split(text, SPACES), lambda w: w != ""))
    n = F.size("_words").cast("long")
    counts = words.withColumn(
        "_m",
        F.struct(
            n.alias("n_words"),
            without(text, SPACE_CHARS).cast("long").alias("word_chars"),
            (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
            (F.length(text) - without(text, CAPITALS)).alias("capitals"),
            (F.length(text) - without(text, "0123456789")).alias("digits"),
            (F.length(text) - without(text, "!?")).alias("marks"),
            (F.length(text) - without(text, ".,;:")).alias("points"),
            (F.length(text) - without(text, "|<>")).alias("bars"),
            F.size(lines).alias("lines"),
            F.size(F.array_distinct("_words")).alias("distinct"),
        ),
    ).drop("_words")
    return counts


def statistics() -> dict[str, Column]:
    m = F.col("_m")
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    return {
        "words": m["n_words"].cast("double"),
        "word_length": chars / words,
        "symbols_per_word": m["n_symbols"] / words,
        "bars_per_word": m["bars"] / words,
        "dup_line_share": m["n_dup_lines"] / F.greatest(m["lines"], F.lit(1)),
        "repeat_share": m["n_repeat_words"] / words,
        "capital_share": m["capitals"] / chars,
        "digit_share": m["digits"] / chars,
        "marks_per_word": m["marks"] / words,
        "points_per_word": m["points"] / words,
        "words_per_line": words / F.greatest(m["lines"], F.lit(1)),
        "distinct_share": m["distinct"] / words,
    }


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


# ---------------------------------------------------------------- learning


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Statistics of at most `sample` labelled documents, chosen by the hash of their id."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    found = measured(joined).select(base_failed().alias("failed"), (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), *(c.alias(k) for k, c in statistics().items()))
    return written(found).where("not failed").drop("failed")  # a filter before would be measured on every document, below the join


Rule = list[tuple[str, str, float]]


def holds(rule: Rule, at: Callable[[str], Column] = F.col) -> Column:
    out = F.lit(True)
    for name, op, x in rule:
        out &= (at(name) >= x) if op == ">=" else (at(name) < x)
    return out


def counted(rows: DataFrame, edges: dict[str, list[float]]) -> dict:
    """(feature, bin) to rows [good grow, bad grow, good held, bad held]; one aggregation."""
    bins = F.array(*(F.struct(F.lit(name).alias("name"), sum((F.when(F.col(name) >= x, 1).otherwise(0) for x in at), F.lit(0)).alias("bin")) for name, at in edges.items()))
    out: dict = {}
    for r in rows.select(F.explode(bins).alias("b"), "bad", "held").groupBy("b.name", "b.bin", "bad", "held").count().collect():
        out.setdefault((r["name"], r["bin"]), [0, 0, 0, 0])[2 * r["held"] + r["bad"]] = r["count"]
    return out


def literals(counts: dict, edges: dict[str, list[float]]) -> dict:
    """Every threshold test with the rows that pass it."""
    out = {}
    for name, at in edges.items():
        for j, x in enumerate(at):
            above = [sum(counts.get((name, b), [0] * 4)[i] for b in range(j + 1, len(at) + 1)) for i in range(4)]
            below = [sum(counts.get((name, b), [0] * 4)[i] for b in range(j + 1)) for i in range(4)]
            out[name, ">=", x], out[name, "<", x] = above, below
    return out


def gain(before: list[int], after: list[int]) -> float:
    """How much a test tells about the bad rows it keeps."""
    good, bad = after[0], after[1]
    return bad * (log2((bad + 1) / (bad + good + 2)) - log2((before[1] + 1) / (before[0] + before[1] + 2))) if bad else 0.0


def learn(rows: DataFrame, bins: int = 24, max_rules: int = 8, max_tests: int = 3, precision: float = 0.95, least: int = 8) -> list[Rule]:
    """An ordered list of conjunctions that reject.

    bins: quantile thresholds of a statistic. precision: share of bad rows among those a rule covers
    in the held third, after adding one good row. least: bad rows that a rule must cover to grow.
    """
    names = [c for c in rows.columns if c not in ("bad", "held")]
    probs = [i / bins for i in range(1, bins)] + [0.97, 0.98, 0.99, 0.995]
    found = rows.select(*(F.percentile_approx(c, probs).alias(c) for c in names)).first()
    edges = {c: sorted(set(found[c])) for c in names if found[c]}
    rules: list[Rule] = []
    left = F.lit(True)
    while edges and len(rules) < max_rules:
        rule: Rule = []
        passed: list[list[int]] = []
        while len(rule) < max_tests:
            tests = literals(counted(rows.where(left & holds(rule)), edges), edges)
            whole = [sum(x) for x in zip(*(tests[t] for t in ((names[0], ">=", edges[names[0]][0]), (names[0], "<", edges[names[0]][0]))))] if names[0] in edges else [0] * 4
            if not passed:
                passed.append(whole)
            best = max(sorted(tests), key=lambda t: gain(whole, tests[t]))
            if gain(whole, tests[best]) <= 0 or tests[best][1] < least:
                break
            rule.append(best)
            passed.append(tests[best])
            if not tests[best][0]:
                break
        score = lambda p: p[3] / (p[2] + p[3] + 1)
        while len(rule) > 1 and score(passed[len(rule) - 1]) >= score(passed[len(rule)]):  # prune the last test
            rule.pop()
        if not rule or score(passed[len(rule)]) < precision:
            break
        rules.append(rule)
        left &= ~holds(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds rejects, a text that none rejects is kept."""
    stats = statistics()
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(holds(rule, stats.__getitem__), False)
    return out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of docs, with `_m` (a struct of counts) and `_kept`."""
    return measured(docs).withColumn("_kept", verdict(rules))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that the list keeps, all columns as they are, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return judged(packed, rules).where("_kept").select("row.*")


def learned_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    return learn(labelled_rows(docs, labels, sample))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", *(F.col("_m")[c].alias(c) for c in BASE), base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
