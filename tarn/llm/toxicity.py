"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier.

Method. Voters are lexicons and patterns. Some are written down: insults by language, counted, and patterns such as an
insult after "you are". The others are families of words, all words with a common start (or one word), that lean to toxic
or clean texts over all labelled training rows, and further than chance would make any of so many families lean; a family
inside another that leans as much is left out. A voter says its side where it occurs and abstains elsewhere. The given label is one more voter.
A latent-class model of the votes is fitted by expectation maximisation: how often each voter speaks in either class,
how accurate the label itself is, and how far pairs of voters agree beyond what the classes explain; voters that agree so
are weighed down. A logistic regression on the votes learns the posterior labels of a bounded sample of training rows and
scores every text, by its votes alone.

The votes of at most SAMPLE training rows reach the driver, and a name for each voter. No number of voters is set: how
many families there are is decided by the bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

#: Lengths of word starts that are features, besides whole words.
STARTS = range(3, 9)
#: Training rows that label model and classifier are fitted to.
SAMPLE = 20_000
#: A family of words votes if its log odds between the classes exceed LEAN and are so far from chance that, of all families
#: there are, FALSE at most would be as far if none told anything (by the Chernoff bound of its texts' classes).
LEAN, FALSE = 0.7, 10.0
#: Score from which a text counts as toxic.
TOXIC = 0.7
#: Rounds of the label model, steps and ridge of the classifier.
ROUNDS, STEPS, RIDGE = 30, 1000, 3e-5
#: What the label model believes of the given labels before it sees any: their accuracy, and as how many rows that counts.
LABEL_PRIOR, LABEL_ROWS = 0.95, 20.0
#: Features that a Python worker counts before it hands them on.
COUNTED = 150_000

#: Words of abuse by language, in lower case.
LEXICONS = {
    "en": "ass asshole bastard bitch clown coward creep crap damn disgusting dumb dumbass fool freak garbage idiot imbecile jerk liar loser moron parasite pathetic pig scum shit stupid trash ugly vermin worthless".split(),
    "de": "abschaum arsch arschloch blöd depp dreck dumm dummkopf ekelhaft erbärmlich feigling hurensohn idiot lügner missgeburt mistkerl schlampe schwein scheiße trottel versager vollidiot wertlos widerlich".split(),
    "fr": "abruti bouffon connard con crétin débile dégoûtant idiot imbécile lâche menteur merde minable nul ordure pathétique pourriture raclure salaud salope stupide vermine".split(),
    "es": "asqueroso basura bastardo cabrón cerdo cobarde escoria estúpido gilipollas idiota imbécil inútil maldito mentiroso mierda patético payaso perdedor puta tonto".split(),
}
_ABUSE = "|".join(sorted({w for words in LEXICONS.values() for w in words}))
#: Patterns over the text in lower case.
PATTERNS = {
    "you are": re.compile(rf"\b(?:you(?:'re| are)|du bist|ihr seid|tu es|vous êtes|eres|sois)\s(?:\w+\s){{0,3}}(?:{_ABUSE})\b"),
    "such": re.compile(rf"\b(?:such an?|what an?|so ein|quel|qué)\s(?:\w+\s)?(?:{_ABUSE})\b"),
    "masked": re.compile(r"\b(?:f[*@#$]{1,3}k|s[*@#$]{1,2}t|b[*@#$]{1,3}h|a[*@#$]{2}(?:hole)?)"),
    "shut up": re.compile(r"\b(?:shut up|go to hell|drop dead|kill yourself|halt die fresse|ta gueule|cállate)\b"),
}
#: What a text must have before a pattern is looked for.
_MAYBE_MASKED = re.compile(r"[fsba][*@#$]")
_PHRASES = ("shut up", "go to hell", "drop dead", "kill yourself", "halt die fresse", "ta gueule", "cállate")
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """The distinct words of a text, lower-cased, marked =, and the starts of longer words, marked ^."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add("=" + w)
        for k in STARTS:
            if len(w) < k:
                break
            out.add("^" + w[:k])
    return out


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean, toxic): texts with each feature by class, summed up over a task as far as memory goes."""
    C.serving("toxicity")
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "clean", "toxic"])

    for batch in batches:
        for t, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for f in features(text):
                counts.setdefault(f, [0, 0])[1 if t else 0] += 1
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


class Voters:
    """The voters by number: families of words first, then lexicons (a word, two words or more, no word at all), then patterns."""

    MOST_WORDS = 150_000

    def __init__(self, families: list[str]):
        self.families = families
        self.names = [*families, *(f"{n} {k}" for k in LEXICONS for n in ("one of", "two of")), "none of any", *PATTERNS]
        self._place = {n: i for i, n in enumerate(families)}
        self._lexicon: dict[str, list[int]] = {}
        for at, words in enumerate(LEXICONS.values()):
            for w in words:
                self._lexicon.setdefault(w, []).append(at)
        self._seen: dict[str, tuple[tuple[int, ...], list[int]]] = {}

    def _of(self, w: str) -> tuple[tuple[int, ...], list[int]]:
        """The families and the lexicons of a word; those of words seen are remembered."""
        if len(self._seen) > self.MOST_WORDS:
            self._seen.clear()
        place = self._place
        found = [place["=" + w]] if "=" + w in place else []
        found += [place["^" + w[:k]] for k in STARTS if len(w) >= k and "^" + w[:k] in place]
        self._seen[w] = out = (tuple(found), self._lexicon.get(w, []))
        return out

    def votes(self, text: str | None) -> list[int]:
        """The voters that say something of a text, in order."""
        low = (text or "").lower()
        out: set[int] = set()
        hits = [0] * len(LEXICONS)
        seen = self._seen
        for w in set(_WORD.findall(low)):
            known = seen.get(w) or self._of(w)
            if known[0]:
                out.update(known[0])
            for k in known[1]:
                hits[k] += 1
        base = len(self.families)
        out.update(base + 2 * k + j for k, n in enumerate(hits) for j in (0, 1) if n > j)
        base += 2 * len(hits)
        if not any(hits):
            out.add(base)
        for i, (name, pattern) in enumerate(PATTERNS.items()):
            if name == "masked":
                able = _MAYBE_MASKED.search(low)
            elif name == "shut up":
                able = any(p in low for p in _PHRASES)
            else:
                able = any(hits)  # the others need a word of abuse
            if able and pattern.search(low):
                out.add(base + 1 + i)
        return sorted(out)


def _found(batches: Iterator[pa.RecordBatch], families: list[str]) -> Iterator[pa.RecordBatch]:
    C.serving("toxicity")
    voters = Voters(families)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([voters.votes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["toxic", "found"])


# --- label model -----------------------------------------------------------------------------


class Votes:
    """Which voters speak in which row, by row and voter of each vote."""

    def __init__(self, found: pa.ListArray, n_voters: int):
        self.shape = len(found), n_voters
        self.row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
        self.voter = found.flatten().to_numpy().astype(np.int64)

    def by_row(self, weight: np.ndarray) -> np.ndarray:
        """For each row the sum of its voters' weights."""
        return np.bincount(self.row, weight[self.voter], self.shape[0])

    def by_voter(self, weight: np.ndarray) -> np.ndarray:
        """For each voter the sum of its rows' weights."""
        return np.bincount(self.voter, weight[self.row], self.shape[1])

    def together(self) -> np.ndarray:
        """In how many rows each pair of voters speaks, 2000 rows at a time."""
        out = np.zeros((self.shape[1],) * 2, np.float32)
        for at in range(0, self.shape[0], 2000):
            some = slice(*np.searchsorted(self.row, [at, at + 2000]))
            x = np.zeros((min(2000, self.shape[0] - at), self.shape[1]), np.float32)
            x[self.row[some] - at, self.voter[some]] = 1
            out += x.T @ x
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def posteriors(votes: Votes, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """(posterior of toxic, the share of each voter's votes that go to toxic rows, voter weights, accuracy of the labels
    by class) from the votes and the given labels (0 or 1).

    The label is a voter with an error rate of its own in either class; the rounds start from what LABEL_PRIOR makes of
    the labels alone. Given the class, a voter speaks with a rate of its own. The correlation of two voters is that of
    their votes after the class means are taken away; a voter's weight is one over the sum of its squared correlations,
    so that a group that always speaks together counts about once.
    """
    n = votes.shape[0]
    together = votes.together()
    spoken = np.maximum(np.diag(together).astype(np.float64), 1e-9)
    right = (LABEL_PRIOR, LABEL_PRIOR)  # of clean, of toxic
    p = np.where(labels > 0, LABEL_PRIOR, 1 - LABEL_PRIOR)
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        mass = np.array([(1 - p).sum(), p.sum()]) + 1e-9
        sums = np.stack([votes.by_voter(1 - p), votes.by_voter(p)])
        rates = (sums + 0.5) / (mass[:, None] + 1)
        hit = np.array([((1 - p) * (labels == 0)).sum(), (p * (labels > 0)).sum()])
        right = tuple(((hit + LABEL_PRIOR * LABEL_ROWS) / (mass + LABEL_ROWS)).tolist())
        # X'X less the class means: E = X - PR, E'E = X'X - S'R - R'S + R'(P'P)R, some columns at a time
        both = np.array([[((1 - p) ** 2).sum(), ((1 - p) * p).sum()], [((1 - p) * p).sum(), (p**2).sum()]])
        sd = np.sqrt(np.maximum(spoken - 2 * (sums * rates).sum(0) + ((both @ rates) * rates).sum(0), 1e-9 * n))
        for k in range(0, len(weight), 500):
            some = slice(k, k + 500)
            rest = together[:, some] - sums.T @ rates[:, some] - rates.T @ (sums[:, some] - both @ rates[:, some])
            weight[some] = 1 / np.maximum(((rest / sd[:, None] / sd[some]) ** 2).sum(0), 1)
        said, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        by_label = np.where(labels > 0, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        new = _logistic(np.log(mass[1] / mass[0]) + by_label + (weight * silent).sum() + votes.by_row(weight * (said - silent)))
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p, votes.by_voter(p) / spoken, weight, right


def logistic(votes: Votes, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the last for the bias, of a logistic regression of y (0 to 1) on the votes, by accelerated gradient steps."""
    n, k = votes.shape
    at = np.ones(k + 1)
    norm = 1.0
    for _ in range(30):  # the largest eigenvalue of X'X / n
        z = votes.by_row(at[:-1]) + at[-1]
        at = np.append(votes.by_voter(z), z.sum()) / n
        norm = max(float(np.linalg.norm(at)), 1e-9)
        at /= norm
    scale = norm * 1.05 / 4 + ridge
    w = before = np.zeros(k + 1)
    penalty = np.append(np.full(k, ridge), 0.0)
    for i in range(steps):
        at = w + (i / (i + 3)) * (w - before)
        miss = _logistic(votes.by_row(at[:-1]) + at[-1]) - y
        grad = np.append(votes.by_voter(miss), miss.sum()) / n + penalty * at
        before, w = w, at - grad / scale
    return w


class Model:
    """The families that vote, the weights of all voters, the bias, and what the label model found."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: float, accuracy: np.ndarray, voter_weight: np.ndarray, label_accuracy: tuple[float, float]):
        self.families, self.weights, self.bias = families, weights, bias
        self.accuracy, self.voter_weight, self.label_accuracy = accuracy, voter_weight, label_accuracy


def leaning(rows: DataFrame, n_clean: int, n_toxic: int) -> DataFrame:
    """(feature) of the families of words that lean to either class; see LEAN and FALSE."""
    counts = rows.mapInArrow(_training_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = C.stored(counts.where(F.col("clean") + F.col("toxic") > 1))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    both, rate = F.col("clean") + F.col("toxic"), n_toxic / (n_clean + n_toxic)
    part = lambda n, r: F.when(n > 0, n * F.log(n / (both * r))).otherwise(0.0)
    bound = part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)
    least = math.log(max(counts.count(), 1) / FALSE)
    some = C.checkpointed(counts.select("feature", F.signum(odds).alias("side"), F.abs(odds).alias("lean"), bound.alias("bound")).where((F.col("bound") > least) & (F.col("lean") > LEAN)))
    C.dropped(counts)
    # the starts of a family's words, and the start itself of a single word
    starts = F.transform(F.sequence(F.lit(min(STARTS)), F.lit(max(STARTS))), lambda k: F.when((k < F.length("feature") - 1) | ((k == F.length("feature") - 1) & F.col("feature").startswith("=")), F.concat(F.lit("^"), F.expr("substring(feature, 2)").substr(F.lit(1), k))))
    inner = some.select("feature", "side", "lean", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("outer"))
    outer = some.select(F.col("feature").alias("outer"), F.col("side").alias("outer_side"), F.col("lean").alias("outer_lean"))
    covered = inner.join(outer, "outer").where("side = outer_side and outer_lean >= 0.9 * lean").select("feature").distinct()
    return some.select("feature").join(covered, "feature", "left_anti")


def fit(rows: DataFrame) -> Model:
    """Fit to labelled rows (id, text, toxic). Without rows of both kinds every score is the rate of toxic rows."""
    n_clean, n_toxic = (rows.where(F.col("toxic") == k).count() for k in (0, 1))
    prior = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
    if not n_clean or not n_toxic:
        nothing = np.zeros(len(Voters([]).names))
        return Model([], nothing, float(np.log(prior / (1 - prior))), nothing, nothing, (1.0, 1.0))
    families = sorted(r[0] for r in leaning(rows, n_clean, n_toxic).collect())
    chosen = C.checkpointed(rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).distinct())
    sample = C.join_ids(rows, chosen, "id").dropDuplicates(["id"]).mapInArrow(lambda it: _found(it, families), "toxic int, found array<int>").toArrow()
    votes = Votes(sample.column("found").combine_chunks(), len(Voters(families).names))
    posterior, accuracy, weight, right = posteriors(votes, sample.column("toxic").to_numpy())
    w = logistic(votes, posterior)
    return Model(families, w[:-1], float(w[-1]), accuracy, weight, right)


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    C.serving("toxicity")
    m = model.value
    voters = Voters(m.families)
    for batch in batches:
        z = [m.bias + float(m.weights[voters.votes(t)].sum()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_logistic(np.array(z)), pa.float64())], names=["id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, learnt from the labels (doc_id, toxic) of rows not held out.

    A row is held out if crc32 of its id as text, modulo 3, is 1; with a null id it is not held out (null), and learnt from
    never. Nothing but its text goes into a score; null and empty texts get the score of a text in which only the voter for
    "no word of abuse" speaks. Labels that are null or of unknown ids are left out; of labels of an id that contradict each
    other the toxic one counts. Repeated rows each have a row. Without labels of both kinds all scores are equal. An empty
    table gives an empty result. Other columns of either table aren't read, whatever their names.
    """
    C.arrow_rows(docs.sparkSession)
    docs = C.inputs(docs, id=id_col, text=text_col)
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic")).where("toxic is not null and id is not null").where(C.crc32_mod3(F.col("id")) != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = C.stored(C.join_ids(docs, C.checkpointed(known), "id").select("id", "text", "toxic").repartition("id"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    C.dropped(rows)
    scored = docs.mapInArrow(lambda it: _scored(it, model), "id long, score double")
    return scored.select("id", (C.crc32_mod3(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
