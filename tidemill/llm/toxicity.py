"""Toxicity (operator 8): weak supervision by a generative label model, then a linear classifier.

Voters are lexicons and text patterns. The lexicons are learned as words far likelier in toxic than in
other labelled training texts, and dealt among `lexicons` voters; no label reaches the label model. It
explains the votes on all training rows by a hidden class: each voter has a vote probability in each
class and stratum of text length (its accuracy; longer texts give every voter more to vote on) and may
depend on one other voter, chosen as the tree with most information within the classes (the
correlations); expectation maximisation fits it to the counts of the distinct vote patterns. Its
posteriors, not the labels, then train a logistic regression over words and patterns, which scores
every text. The words it sees are chosen by the posteriors too.

At most `sample` labelled rows teach the lexicons and lend their texts to the classifier, chosen by
hash of the id. Null and empty texts have no features and get the intercept's score. Without labels of
both kinds, or without a telling word, every score is the share of toxic labels, or 0. Null labels
teach nothing. Texts of the labelled sample with the same three least hashes of long words count once
for the lexicons (that of the smallest id): copies of one text would make its chance words look telling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import digest_bucket, table, text_chunks, with_text, written

LETTERS = re.compile(r"[^\W\d_]+").findall
PATTERNS = ("shouts", "marks", "addressed", "repeats", "signs", "digits")
STRATA = 6


def patterns(text: str, words: list[str]) -> list[int]:
    """Votes on the form of a text: capitals, exclamation marks, second person, one word over and over,
    signs among the letters, many digits."""
    letters = sum(map(len, words))
    return [
        int(letters > 0 and sum(map(str.isupper, text)) * 3 > letters),
        int(text.count("!") * 20 > len(words)),
        int(words.count("you") * 100 > 2 * len(words)),
        int(len(words) > 20 and len(set(words)) * 3 < len(words)),
        int(sum(map(text.count, "*#$%&@")) * 5 > len(words)),
        int(sum(map(str.isdigit, text)) * 10 > letters),
    ]


def stratum(n_words: int) -> int:
    """0 for under 32 words, then one more for each doubling, STRATA - 1 from 512 on."""
    return min(max(n_words.bit_length() - 5, 0), STRATA - 1)


def facts(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """The rows with `words`, the distinct words of a text (of the vocabulary, if any), `form`, the votes of
    the patterns, and `stratum` of its length."""
    kept = None if vocabulary is None else frozenset(vocabulary)
    columns = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = []
            for t in batch.column("text").to_pylist():
                own = LETTERS(t.lower()) if t else []
                distinct = set(own) if kept is None else kept.intersection(own)
                found.append((sorted(distinct), patterns(t or "", own), stratum(len(own))))
            made = {"words": pa.list_(pa.string()), "form": pa.list_(pa.int64()), "stratum": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {c: pa.array([x[i] for x in found], kind) for i, (c, kind) in enumerate(made.items())})

    fields = ", ".join(f"{c} {t}" for c, t in docs.select(columns).dtypes)
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, fields + ", words array<string>, form array<long>, stratum long")


def telling_words(rows: DataFrame, weight: str, most: int, surely: float, least: int = 5) -> list[str]:
    """Words whose log-odds between rows of `weight` 1 and 0, less two standard errors, exceed `surely`."""
    total = rows.agg(F.sum(weight).alias("t"), F.count("*").alias("n")).first()
    toxic, other = (total.t or 0), total.n - (total.t or 0)
    if not toxic or not other:
        return []
    seen = rows.select(F.explode("words").alias("word"), F.col(weight).alias("t")).groupBy("word").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    rest = F.col("n") - F.col("t") + 0.5
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log(rest / (other + 1))
    low = odds - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / rest)
    return [r.word for r in seen.where(F.col("t") >= least).withColumn("low", F.round(low, 9)).where(F.col("low") > surely).orderBy(F.desc("low"), "word").limit(most).collect()]


def once(rows: DataFrame) -> DataFrame:
    """One row of those with the same sketch, that of the smallest id."""
    long = F.slice(F.sort_array(F.transform(F.filter("words", lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))), 1, 3)
    sketch = F.when(F.size(long) == 3, long).otherwise(F.array(F.xxhash64("words")))
    return rows.groupBy(sketch.alias("sketch")).agg(F.min(F.struct("doc_id", "toxic", "words")).alias("r")).select("r.*")


class LabelModel:
    """Hidden class with voters in a tree, by strata; fitted to counts of distinct vote patterns.

    votes: a row of 0 and 1 for each pattern. strata: its stratum. weight: how many texts have it.
    prior: share of the class at the start. speaking: the first so many voters speak for the class; that
    they seldom do so outside of it is known beforehand, as `trust` times the texts there are in which
    they would do so at the rate `slips`. Without it a text with a single vote is taken for a slip."""

    def __init__(self, votes: np.ndarray, strata: np.ndarray, weight: np.ndarray, prior: float, speaking: int, rounds: int = 40, trust: float = 3.0, slips: float = 5e-4):
        votes = np.asarray(votes, float)
        self.m, self.speaking, self.trust, self.slips = votes.shape[1], np.arange(votes.shape[1]) < speaking, trust, slips
        self.parent = np.full(self.m, -1)
        self.prior = min(max(prior, 1e-4), 0.5)
        post = np.where(votes[:, :speaking].sum(1) > 0, 0.9, 0.02)  # a lexicon speaks for toxic until the fit says otherwise
        for r in range(rounds):
            if r == rounds // 2:
                self.parent = self.tree(votes, weight, post)
            self.maximise(votes, strata, weight, post)
            post = self.posterior(votes, strata)

    def tree(self, votes, weight, post) -> np.ndarray:
        """Maximum spanning tree of the information between voters within the classes."""
        gain = np.zeros((self.m, self.m))
        for w in (weight * post, weight * (1 - post)):
            both = (votes * w[:, None]).T @ votes + 1e-3
            one, total = np.diag(both), w.sum() + 4e-3
            cells = ((both, one[:, None], one), (one[:, None] - both, one[:, None], total - one), (one - both, total - one[:, None], one), (total - one[:, None] - one + both, total - one[:, None], total - one))
            for joint, a, b in cells:
                p = np.maximum(joint, 1e-9) / total
                gain += total * p * np.log(p * total * total / np.maximum(a * b, 1e-9))
        gain /= weight.sum()
        parent, inside = np.full(self.m, -1), [0]
        for _ in range(self.m - 1):
            i, j = max(((i, j) for i in range(self.m) if i not in inside for j in inside), key=lambda x: gain[x])
            parent[i] = j if gain[i, j] > 1e-4 else -1
            inside.append(i)
        return parent

    def above(self, votes: np.ndarray) -> np.ndarray:
        """The vote of each voter's parent, 0 without one."""
        return np.where(self.parent >= 0, votes[:, self.parent], 0).astype(np.int64)

    def maximise(self, votes, strata, weight, post) -> None:
        self.prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.5))
        self.table = np.empty((2, STRATA, 2, self.m))  # class, stratum, parent's vote, voter: probability of a vote
        above = self.above(votes)
        for y, w in ((0, weight * (1 - post)), (1, weight * post)):
            for s in range(STRATA):
                own = np.where(strata == s, w, 0.0)
                known = self.speaking * self.trust * own.sum() * (1 - y)
                mean = ((own @ votes) + 0.1 + known * self.slips) / (own.sum() + 0.2 + known)
                for a in (0, 1):
                    given = own[:, None] * (above == a)
                    self.table[y, s, a] = ((given * votes).sum(0) + (2 + known) * mean) / (given.sum(0) + 2 + known)

    def posterior(self, votes: np.ndarray, strata: np.ndarray) -> np.ndarray:
        """Probability of the class for each row of votes."""
        votes = np.asarray(votes, float)
        above, log = self.above(votes), []
        for y, share in ((0, 1 - self.prior), (1, self.prior)):
            p = self.table[y][strata[:, None], above, np.arange(self.m)]
            log.append(np.log(share) + np.log(np.where(votes == 1, p, 1 - p)).sum(1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def vote_bits(lexicons: list[list[str]]) -> F.Column:
    """All votes of a row as one number: a bit for each lexicon, then one for each pattern."""
    heard = [F.arrays_overlap("words", F.array(*map(F.lit, own))) for own in lexicons] + [F.get("form", i) == 1 for i in range(len(PATTERNS))]
    return sum((F.when(v, F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(heard)), F.lit(0)).cast("long")


def unpacked(bits, n: int) -> np.ndarray:
    return (np.asarray(bits, np.int64)[:, None] >> np.arange(n)) & 1


Classifier = tuple[float, dict[str, float], np.ndarray]


def fitted(rows: DataFrame, labels: DataFrame, sample: int = 20_000, words: int = 96, lexicons: int = 12, features: int = 2048) -> Classifier:
    """Intercept, word weights and pattern weights of the classifier. rows, labels: training rows alone.

    words: most lexicon words. features: most words that the classifier sees."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    base = rows.select("doc_id", "text")
    known = written(facts(base.join(F.broadcast(chosen), "doc_id"), None))  # at most `sample` ids
    telling = telling_words(once(known), "toxic", words, 1.5)
    share = known.agg(F.avg("toxic")).first()[0]
    if not telling:
        return float(np.log((share or 1e-9) / (1 - (share or 1e-9)))) if (share or 0) < 1 else 30.0, {}, np.zeros(len(PATTERNS))
    dealt = [x for x in (telling[i::lexicons] for i in range(lexicons)) if x]
    n = len(dealt) + len(PATTERNS)
    cast = facts(base, telling).select(vote_bits(dealt).alias("bits"), "stratum")
    seen = cast.groupBy("bits", "stratum").count().orderBy("bits", "stratum").toPandas()  # under STRATA * 2 ** voters rows
    model = LabelModel(unpacked(seen["bits"], n), seen["stratum"].to_numpy(), seen["count"].to_numpy(float), float(share), len(dealt))
    return classifier(known.withColumn("bits", vote_bits(dealt)), n, telling, model, features)


def classifier(rows: DataFrame, voters: int, telling: list[str], model: LabelModel, features: int) -> Classifier:
    """Logistic regression on soft labels: each row counts for both classes by its posterior."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    kinds = rows.select("bits", "stratum").distinct().toPandas()  # of the bounded sample
    kinds["p"] = model.posterior(unpacked(kinds["bits"], voters), kinds["stratum"].to_numpy())
    soft = written(rows.join(F.broadcast(spark.createDataFrame(kinds)), ["bits", "stratum"]).select("words", "form", F.round("p", 9).alias("p")))
    vocabulary = list(dict.fromkeys(telling + telling_words(soft, "p", features, 0.5)))[:features]
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    train = soft.select("words", array_to_vector(F.transform("form", lambda v: v.cast("double"))).alias("shape"), both.alias("y")).select("words", "shape", "y.*")
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="has", minTF=1.0)
    counted.setBinary(True)
    ready = VectorAssembler(inputCols=["has", "shape"], outputCol="features").transform(counted.transform(train))
    found = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(ready)
    weights = found.coefficients.toArray()
    return float(found.intercept), dict(zip(vocabulary, weights.tolist())), weights[len(vocabulary) :]


def scored(docs: DataFrame, intercept: float, weights: dict[str, float], form: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    kept = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out = []
            for t in batch.column("text").to_pylist():
                own = LETTERS(t.lower()) if t else []
                z = intercept + sum(weights[w] for w in sorted(kept.intersection(own))) + float(np.dot(form, patterns(t or "", own)))
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(out, pa.float64())})

    return with_text(docs).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = digest_bucket("doc_id", 5) == 0
    model = fitted(docs.where(~held_out), labels.where(~held_out))
    return scored(docs, *model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
