"""Toxicity by weak supervision.

Many voters fire or abstain on a text: word lists, patterns, and evidence words. Evidence words are words and word
stems that a log-likelihood ratio finds in toxic training documents too often for chance; they fall in three grades.
A strong one votes by itself, weaker ones vote where a text has more of them than its length explains (a bound on the
Poisson tail, at three levels), so that a long text does not fire them by chance.

A generative label model with a latent class, a base rate and, for each voter, its firing rate given the class and
given the one voter it depends on most, is fitted by EM to the counts of vote patterns of all documents. It yields the
voters' accuracies and their correlations, and a posterior label for every pattern. No given label is in that fit.
A linear classifier over hashed words, stems and the votes is trained on the posteriors of a bounded sample, and its
scale is set by the given labels. It scores every whole text.

A given label is used for three things: to find evidence words and their chance rates, to have enough rows of either
class in the sample, and for the final scale. It is no target of the classifier.

Bounds: `voters()` are 19, so that at most 2**19 patterns of 12 bytes come to the driver. The labelled sample holds at
most `per_class` rows of either class, the unlabelled one about `unlabelled` distinct texts (those of least hash),
both outside the held-out fold; of their features only those seen in `mined_docs` rows, and of the rows only the at
most `features` chosen ones, come to the driver. Everything else is computed over all documents.

Nulls and odd rows: a null text counts as empty; an empty text fires no voter and scores the bias; long texts
are scored whole; equal texts score alike; a null id is in fold crc32('') of the labels; an empty table or an
empty label table gives an untrained constant score of the label rate; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, class_rates, fold, labelled_sample, materialise, small_batches

WORD = re.compile(r"[^\W\d_]+")
FOLDS, HELD_OUT = 4, 2
FLOOR = -0.2  # of a weight: a word hardly makes up for an insult

LEXICONS = {
    "insults": "idiot idiots moron morons imbecile imbeciles clown clowns loser losers fool fools dunce cretin jerk jerks dimwit halfwit twit buffoon",
    "contempt": "pathetic worthless disgusting stupid dumb useless repulsive despicable vile hideous revolting contemptible brainless spineless",
    "dehumanising": "scum trash garbage filth vermin parasite parasites rat rats pig pigs cockroach cockroaches maggot maggots subhuman savage savages",
    "profanity": "damn bastard bastards bitch bitches crap bullshit asshole assholes shit shitty fuck fucking fucker arse piss",
    "hostility": "hate hates hatred despise loathe kill die destroy exterminate hang burn rot perish",
}
LISTS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
LIST_OF = {word: k for k, words in enumerate(LISTS.values()) for word in words}
INSULTING = frozenset().union(*(LISTS[k] for k in ("insults", "contempt", "dehumanising")))
ADDRESS = re.compile(r"\b(?:you|they|he|she|these|those)\b[^.\n]{0,24}?\b(?:" + "|".join(sorted(INSULTING)) + r")\b")
COMMANDS = ("shut up", "go away", "get lost", "drop dead", "go to hell", "nobody likes you", "kill yourself")
COMMAND = re.compile(r"\b(?:" + "|".join(COMMANDS) + r")\b")
CENSORED = re.compile(r"\b[a-z]{1,3}[*@#]{2,}[a-z]{1,3}\b")
SIGNS = [a + b for a in "*@#" for b in "*@#"]
PATTERNS = ("address", "command", "censored")
STEMS = (4, 5, 6, 7)  # letters
WIDTH = 2 + len(STEMS)  # features of a word: itself, its stems, its word list
GRADES = ("weak", "medium", "strong")
COUNTED = ("weak", "medium", "any")  # evidence that votes by its number
LEVELS = (-1.0, -2.5, -5.0)  # powers of ten of the chance that a text of this length has so many


def voters() -> list[str]:
    return [*LISTS, *PATTERNS, "strong", "strong twice", *[f"{c} {level}" for c in COUNTED for level in LEVELS]]


FIRST_PATTERN, FIRST_EVIDENCE = len(LISTS), len(LISTS) + len(PATTERNS)
FIRST_COUNTED = FIRST_EVIDENCE + 2


@dataclass(frozen=True)
class ToxicParams:
    per_class: int = 3000
    unlabelled: int = 6000
    bits: int = 22
    features: int = 6000
    mined_docs: int = 3
    grades: tuple[float, float, float] = (7.0, 11.0, 25.0)  # least log-likelihood ratio of a weak, medium and strong evidence word
    purity: tuple[float, float, float] = (0.6, 0.6, 0.95)  # least share of its documents that are toxic
    l2: float = 1e-4
    steps: int = 150
    threshold: float = 0.3


# Features ---------------------------------------------------------------------------------------------------------

def token_features(token: str, bits: int) -> list[int]:
    """WIDTH hashed ids: the word, its stems and the word list it is on; -1 for none."""
    mask, raw = (1 << bits) - 1, token.encode()
    plain = len(raw) == len(token)
    stems = [crc32(raw[:n] if plain else token[:n].encode(), n) & mask if len(token) > n else -1 for n in STEMS]
    return [crc32(raw) & mask, *stems, crc32(b"list %d" % LIST_OF[token]) & mask if token in LIST_OF else -1]


def words_of(text: str | None) -> tuple[str, set]:
    """The text in lower case and its distinct words."""
    lower = (text or "").lower()
    return lower, set(WORD.findall(lower))


def fired_patterns(lower: str, tokens: set) -> list[int]:
    """Places in PATTERNS of those found in a text; none is searched for where its word, phrase or signs are not in the text."""
    out = []
    if not INSULTING.isdisjoint(tokens) and ADDRESS.search(lower):
        out.append(0)
    if any(x in lower for x in COMMANDS) and COMMAND.search(lower):
        out.append(1)
    if any(x in lower for x in SIGNS) and CENSORED.search(lower):
        out.append(2)
    return out


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of features found in so many toxic and clean rows against the toxic share of all words; 0 below it."""
    n = np.maximum(toxic + clean, 1e-9)
    rate = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    ratio = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return np.where(rate > share, ratio, 0.0)


def chance(found: int, expected: float) -> float:
    """Power of ten of a bound (Chernoff's) on the chance of so many or more, where `expected` are expected."""
    return 0.0 if found <= expected else (found - expected - found * math.log(found / expected)) / math.log(10)


@dataclass
class Voters:
    """Votes of a text. grade: hashed id to grade of an evidence word; rates: a word's chance to be counted as COUNTED."""

    grade: dict[int, int]
    rates: tuple[float, ...]
    bits: int

    def graded(self, ids) -> int:
        """Grade of a word by its features; -1 for none."""
        return max(self.grade.get(x, -1) for x in ids)

    def code(self, token: str) -> int:
        """1 + grade of a word, 0 for none, and its word list in higher bits. Words of insulting lists are strong, of other lists weak."""
        grade = self.graded(token_features(token, self.bits)[:-1])
        if token in LIST_OF:
            grade = max(grade, 2 if token in INSULTING else 0)
            return grade + 1 | (LIST_OF[token] + 1) << 2
        return grade + 1

    def votes(self, codes, n_words: int, fired) -> int:
        """The pattern of votes of a text with so many distinct words, given the codes of those that are not 0."""
        out, hits = 0, [0, 0, 0]
        for code in codes:
            if code >> 2:
                out |= 1 << (code >> 2) - 1
            hits[(code & 3) - 1] += 1
        for k in fired:
            out |= 1 << FIRST_PATTERN + k
        if hits[2]:
            out |= 1 << FIRST_EVIDENCE
            out |= (hits[2] > 1) << FIRST_EVIDENCE + 1
        if codes:
            for c, found in enumerate((hits[0], hits[1], sum(hits))):
                if found:
                    power = chance(found, self.rates[c] * n_words)
                    for k, level in enumerate(LEVELS):
                        out |= (power <= level) << FIRST_COUNTED + c * len(LEVELS) + k
        return out

    def pattern(self, lower: str, tokens: set, cache: Cache) -> int:
        return self.votes(list(filter(None, map(cache.__getitem__, tokens))), max(1, len(tokens)), fired_patterns(lower, tokens))


def bits_of(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns, dtype=np.int64)[:, None] >> np.arange(len(voters()))) & 1


# Label model ------------------------------------------------------------------------------------------------------

@dataclass
class LabelModel:
    """Firing rates of voters given the class and the voter each depends on."""

    base: float
    parent: list[int]
    rate: np.ndarray  # voter, class, parent's vote
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlation: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([1 - self.base, self.base]))[None, :].repeat(len(votes), 0)
        for i, up in enumerate(self.parent):
            given = votes[:, up] if up >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = self.rate[i, y, given]
                logs[:, y] += np.where(votes[:, i] == 1, np.log(p), np.log1p(-p))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def _tree(votes: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Each voter's parent in the spanning tree of largest conditional correlation; and the correlations.

    weight: rows by class.
    """
    corr = np.zeros((votes.shape[1],) * 2)
    for y in (0, 1):
        w = weight[:, y] / max(weight[:, y].sum(), 1e-12)
        mean = w @ votes
        cov = (votes * w[:, None]).T @ votes - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr += np.abs(cov / np.outer(sd, sd)) * weight[:, y].sum() / max(weight.sum(), 1e-12)
    np.fill_diagonal(corr, 0)
    corr = np.round(corr, 9)  # ties fall alike however the rows are grouped
    parent, joined = [-1] * len(corr), {0}
    while len(joined) < len(corr):
        strength, i, up = max((corr[i, j], -i, -j) for i in range(len(corr)) if i not in joined for j in joined)
        joined.add(-i)
        if strength > 0.05:
            parent[-i] = -up
    return parent, corr


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """EM over distinct vote patterns and their counts. It begins from the number of voters that fire."""
    fired = votes.sum(1)
    post = np.where(fired >= 4, 0.95, np.where(fired >= 2, 0.3, 0.005)).astype(float)
    model = LabelModel(0.1, [-1] * votes.shape[1], np.full((votes.shape[1], 2, 2), 0.1))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post], 1)
        parent, corr = _tree(votes, weight)
        rate = np.zeros((votes.shape[1], 2, 2))
        for i, up in enumerate(parent):
            for y in (0, 1):
                for v in (0, 1):
                    w = weight[:, y] * (votes[:, up] == v if up >= 0 else 1)
                    rate[i, y, v] = (w @ votes[:, i] + 0.5 * (0.3 if y else 0.01)) / (w.sum() + 0.5)
        base = (weight[:, 1].sum() + 0.5) / (weight.sum() + 1)
        model = LabelModel(float(base), parent, np.clip(rate, 1e-5, 1 - 1e-5), {}, corr)
        fresh = model.posterior(votes)
        if np.abs(fresh - post).max() < 1e-6:
            break
        post = fresh
    weight = np.stack([counts * (1 - post), counts * post], 1)
    rates = (weight.T @ votes) / np.maximum(weight.sum(0), 1e-12)[:, None]
    model.accuracy = {name: (float(rates[0, i]), float(rates[1, i])) for i, name in enumerate(voters())}
    return model


# Samples ----------------------------------------------------------------------------------------------------------

def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label): about `rows` distinct texts of all documents without a label, outside the held-out fold; label is -1.

    Texts of least hash are taken, so that each has the same chance and copies, however many, are one row.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id")
    share = min(1.0, rows / max(1, docs.count()) * FOLDS / (FOLDS - 1))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))
    text = text.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & (F.pmod("order", F.lit(1_000_000_007)) < int(share * 1_000_000_007)))
    return text.join(known, "doc_id", "left_anti").groupBy("order").agg(F.min("text").alias("text")).select("text", F.lit(-1).alias("label"))


SAMPLED = "label int, fired int, ids array<int>"  # ids: WIDTH for each distinct word


def featured(sample: DataFrame, bits: int) -> DataFrame:
    """Label, patterns that fire and features of each sampled row."""
    def features(batches):
        cache = Cache(lambda token: token_features(token, bits), 50_000)
        for pdf in batches:
            fired, ids = [], []
            for text in pdf["text"]:
                lower, tokens = words_of(text)
                fired.append(sum(1 << k for k in fired_patterns(lower, tokens)))
                ids.append(np.array([x for t in tokens for x in cache[t]], dtype=np.int32))
            yield pd.DataFrame({"label": pdf["label"], "fired": fired, "ids": ids})
    return sample.mapInPandas(features, SAMPLED)


def _list_ids(bits: int) -> dict[int, int]:
    return {crc32(b"list %d" % k) & ((1 << bits) - 1): k for k in range(len(LISTS))}


def sampled_codes(ids: np.ndarray, voter: Voters, insulting: frozenset) -> list[int]:
    """`Voters.code` of each word of a sampled row that has one, from its features; insulting: hashed ids of such words."""
    lists, out = _list_ids(voter.bits), []
    for word in np.asarray(ids).reshape(-1, WIDTH).tolist():
        grade, on = voter.graded(word[:-1]), word[-1]
        if on >= 0:
            grade = max(grade, 2 if word[0] in insulting else 0)
            out.append(grade + 1 | (lists[on] + 1) << 2)
        elif grade >= 0:
            out.append(grade + 1)
    return out


def insulting_ids(bits: int) -> frozenset:
    return frozenset(token_features(w, bits)[0] for w in INSULTING)


def mined(sample: DataFrame, p: ToxicParams) -> dict[int, int]:
    """Hashed id to grade of the evidence words and stems of the labelled sample."""
    ids = F.filter("ids", lambda x: x >= 0)
    known = sample.where(F.col("label") >= 0)
    mass = {r["label"]: float(r["n"]) for r in known.groupBy("label").agg(F.sum(F.size("ids") / WIDTH).alias("n")).collect()}
    share = (mass.get(1, 0.0) + 0.5) / (sum(mass.values()) + 1)
    seen = known.select("label", F.explode(F.array_distinct(ids)).alias("id")).groupBy("id").agg(
        F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    got = seen.where((F.col("a") >= p.mined_docs) & (F.col("a") >= min(p.purity) * (F.col("a") + F.col("b")))).toPandas()
    ratio = likelihood_ratio(got["a"].to_numpy(float), got["b"].to_numpy(float), share)
    pure = (got["a"] / np.maximum(got["a"] + got["b"], 1)).to_numpy(float)
    grade = np.full(len(got), -1)
    for k, (least, purity) in enumerate(zip(p.grades, p.purity, strict=True)):
        grade[(ratio >= least) & (pure >= purity)] = k
    return {int(i): int(g) for i, g in zip(got["id"], grade, strict=True) if g >= 0}


def chance_rates(sample: DataFrame, grade: dict[int, int], bits: int) -> tuple[float, ...]:
    """Chance that a word of a clean labelled row counts as each of COUNTED."""
    voter = Voters(grade, (), bits)

    def hits(batches):
        insulting = insulting_ids(bits)
        for pdf in batches:
            rows = [[(c & 3) - 1 for c in sampled_codes(x, voter, insulting)] for x in pdf["ids"]]
            yield pd.DataFrame({"weak": [r.count(0) for r in rows], "medium": [r.count(1) for r in rows], "any": [len(r) for r in rows], "n": [len(x) // WIDTH for x in pdf["ids"]]})

    got = sample.where("label = 0").mapInPandas(hits, "weak long, medium long, any long, n long").agg(*[F.sum(c).alias(c) for c in (*COUNTED, "n")]).first()
    return tuple(((got[c] or 0) + 0.5) / ((got["n"] or 0) + 1) for c in COUNTED)


# Classifier -------------------------------------------------------------------------------------------------------

def fit_linear(index: np.ndarray, start: np.ndarray, target: np.ndarray, weight: np.ndarray, size: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on counted features, weights not below FLOOR, by accelerated projected gradient steps.

    index: feature ids, row by row from start.
    """
    row = np.repeat(np.arange(len(target)), np.diff(np.append(start, len(index))))
    w, v, bias, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    total = weight.sum()
    scale = 1.0 / (0.25 * max(1.0, np.percentile(np.diff(np.append(start, len(index))), 90)) + l2)
    for step in range(steps):
        m = step / (step + 3)
        look, lookb = w + m * v, bias + m * vb
        z = np.bincount(row, weights=look[index], minlength=len(target)) + lookb
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight / total
        grad = np.bincount(index, weights=err[row], minlength=size) + l2 * look
        fresh, freshb = np.maximum(look - 8 * scale * grad, FLOOR), lookb - 8 * scale * err.sum()
        v, vb, w, bias = fresh - w, freshb - bias, fresh, freshb
    return w, float(bias)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of y on z, lightly held to slope 1."""
    a, b = 1.0, 0.0
    w = weight / weight.sum() * len(z)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([(w * (p - y) * z).sum() + 0.1 * (a - 1), (w * (p - y)).sum()])
        r = w * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


@dataclass
class ToxicModel:
    weights: dict[int, float]  # of hashed words and stems
    vote_weights: list[float]
    bias: float
    slope: float
    shift: float
    bits: int
    voters: Voters | None = None
    label_model: LabelModel | None = None

    def scorer(self):
        weights, bits, voter, votes = self.weights, self.bits, self.voters, self.vote_weights

        def effect(token: str):
            code = voter.code(token) if voter else 0
            weight = sum(weights.get(x, 0.0) for x in token_features(token, bits) if x >= 0)
            return (weight, code) if weight or code else None
        cache = Cache(effect)

        def score(text: str | None) -> float:
            lower, tokens = words_of(text)
            found = sorted(filter(None, map(cache.__getitem__, tokens)))
            z = sum(w for w, _ in found) + self.bias
            if voter:
                pattern = voter.votes([c for _, c in found if c], max(1, len(tokens)), fired_patterns(lower, tokens))
                z += sum(w for k, w in enumerate(votes) if pattern >> k & 1)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * z + self.shift))))
        return score

    def column(self, text):
        """Score as a column expression."""
        model = ToxicModel(self.weights, self.vote_weights, self.bias, self.slope, self.shift, self.bits, self.voters)

        @F.pandas_udf("double")
        def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = model.scorer()
            for texts in batches:
                yield pd.Series([score(t) for t in texts], dtype="float64")
        return toxic_score(text)


def vote_counts(docs: DataFrame, voter: Voters) -> pd.DataFrame:
    """Number of documents of each vote pattern, over all documents."""
    @F.pandas_udf("long")
    def pattern(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Cache(voter.code)
        for texts in batches:
            yield pd.Series([voter.pattern(*words_of(t), cache) for t in texts], dtype="int64")

    return docs.select(pattern("text").alias("pattern")).groupBy("pattern").count().toPandas().sort_values("pattern", ignore_index=True)


def training_rows(sample: DataFrame, voter: Voters, posterior: dict[int, float], p: ToxicParams) -> tuple[pd.DataFrame, np.ndarray]:
    """(label, pattern, kept places of chosen features) of each sampled row, and the chosen features' ids."""
    def vote(batches):
        insulting = insulting_ids(p.bits)
        for pdf in batches:
            pattern = [voter.votes(sampled_codes(x, voter, insulting), max(1, len(x) // WIDTH), [k for k in range(len(PATTERNS)) if f >> k & 1]) for x, f in zip(pdf["ids"], pdf["fired"], strict=True)]
            yield pd.DataFrame({"label": pdf["label"], "pattern": pattern, "soft": [posterior[x] for x in pattern], "ids": pdf["ids"]})

    voted = materialise(sample.mapInPandas(vote, "label int, pattern long, soft double, ids array<int>"), "toxic-voted")
    ids = F.filter("ids", lambda x: x >= 0)
    mass = voted.agg(F.sum(F.col("soft") * F.size("ids")).alias("a"), F.sum(F.size("ids")).alias("n")).first()
    seen = voted.select("soft", F.explode(F.array_distinct(ids)).alias("id")).groupBy("id").agg(F.sum("soft").alias("a"), F.count(F.lit(1)).alias("n"))
    got = seen.where((F.col("n") >= p.mined_docs) & (F.col("a") * float(mass["n"]) > F.col("n") * float(mass["a"]))).toPandas()
    ratio = likelihood_ratio(got["a"].to_numpy(float), (got["n"] - got["a"]).to_numpy(float), float(np.clip(mass["a"] / max(1, mass["n"]), 1e-6, 1 - 1e-6)))
    order = np.lexsort((got["id"], -np.round(ratio, 6)))[: p.features]
    chosen = np.sort(got["id"].to_numpy()[order[ratio[order] > 6]].astype(np.int64))

    def keep(batches):
        for pdf in batches:
            out = []
            for x in pdf["ids"]:
                x = np.asarray(x, dtype=np.int64)
                at = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1) if len(chosen) else np.zeros(len(x), int)
                out.append(np.sort(at[chosen[at] == x]).astype(np.int32) if len(chosen) else np.zeros(0, np.int32))
            yield pd.DataFrame({"label": pdf["label"], "pattern": pdf["pattern"], "soft": pdf["soft"], "kept": out})

    rows = voted.mapInPandas(keep, "label int, pattern long, soft double, kept array<int>").toPandas()
    rows["kept"] = [np.asarray(k, dtype=">u4").tobytes() for k in rows["kept"]]
    return rows.sort_values(["label", "pattern", "kept"], ignore_index=True), chosen  # one order, whatever the partitions


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams | None = None) -> ToxicModel:
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, params or ToxicParams())


def _fit(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> ToxicModel:
    n0, n1 = class_rates(labels, "toxic", FOLDS, HELD_OUT)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    known = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, p.per_class).select("text", "label")
    sample = materialise(featured(known.unionAll(unlabelled_sample(docs, labels, "toxic", p.unlabelled)), p.bits), "toxic-sample")
    if sample.where("label >= 0").select("label").distinct().count() < 2:
        return ToxicModel({}, [], float(np.log(prior / (1 - prior))), 1.0, 0.0, p.bits)
    grade = mined(sample, p)
    voter = Voters(grade, chance_rates(sample, grade, p.bits), p.bits)
    counts = vote_counts(docs, voter)
    model = fit_label_model(bits_of(counts["pattern"]), counts["count"].to_numpy(float))
    posterior = dict(zip(counts["pattern"].tolist(), model.posterior(bits_of(counts["pattern"])).tolist(), strict=True))

    rows, chosen = training_rows(sample, voter, posterior, p)
    votes = bits_of(rows["pattern"])
    index = [np.concatenate([np.frombuffer(k, dtype=">u4").astype(np.int32), len(chosen) + np.flatnonzero(v).astype(np.int32)]) for k, v in zip(rows["kept"], votes, strict=True)]
    start = np.cumsum([0, *[len(k) for k in index[:-1]]])
    w, bias = fit_linear(np.concatenate(index), start, rows["soft"].to_numpy(float), np.ones(len(rows)), len(chosen) + votes.shape[1], p.l2 + 0.3 / len(rows), p.steps)
    given = np.flatnonzero(rows["label"] >= 0)
    y = rows["label"].to_numpy()[given]
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    slope, shift = platt(np.array([w[index[i]].sum() for i in given]) + bias, y.astype(float), weight)
    weights = {int(i): float(v) for i, v in zip(chosen, w, strict=False) if abs(v) > 1e-4}
    return ToxicModel(weights, w[len(chosen) :].tolist(), bias, slope, shift, p.bits, voter, model)


def score_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    p = params or ToxicParams()
    model = fit_toxicity(docs, labels, p)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), model.column(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicParams | None = None) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    p = params or ToxicParams()
    model = fit_toxicity(docs, labels, p)
    return docs.where(model.column(F.col("text")) < p.threshold)
