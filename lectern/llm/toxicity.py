"""Toxicity by a logistic classifier that is regularised with counterfactual pairs."""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.llm.langid import held_out
from lectern.storage import broadcast_within, cut, texts

WORD = re.compile(r"[^\W\d_]+")
#: Letters of the word beginnings that count as features beside whole words.
BEGINNINGS = (5, 7)
#: What ends a sentence.
STOP = re.compile(r"[.!?\u2026\u0964\n\r]+")
#: Identity terms in English, German, French and Spanish; a term is swapped for the others of its line. Pronouns
#: that mark a person's gender are among them; articles are not, which follow grammar and no person.
IDENTITY = (
    ("he", "she"), ("him", "her"), ("himself", "herself"), ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("boys", "girls"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("disabled", "blind", "deaf"), ("elderly", "youthful"),
    ("er", "sie"), ("ihm", "ihr"), ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("ausländer", "einheimische", "flüchtlinge"), ("schwarze", "weiße"), ("behinderte", "blinde", "gehörlose"),
    ("il", "elle"), ("ils", "elles"), ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("étrangers", "citoyens", "réfugiés"), ("noirs", "blancs", "arabes", "asiatiques"), ("handicapés", "aveugles", "sourds"),
    ("él", "ella"), ("ellos", "ellas"), ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("extranjeros", "ciudadanos", "refugiados"), ("negros", "blancos", "árabes", "asiáticos"), ("discapacitados", "ciegos", "sordos"),
)


def words(text: str | None) -> set[str]:
    """The distinct words of a text, lower-cased: runs of letters."""
    return set(WORD.findall(text.lower())) if text else set()


def features(found) -> set[str]:
    """Words and the beginnings of longer words, marked with a star."""
    return {*found, *(f"{w[:n]}*" for w in found for n in BEGINNINGS if len(w) > n)}


def swaps(found: set[str], identity=IDENTITY) -> list[tuple[str, str]]:
    """(term, other) for each identity term of a sentence and each other term of its line."""
    return [(t, o) for line in identity for t in line if t in found for o in line if o != t]


def changes(found: set[str], identity=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """(features that go, features that come) for each swap of an identity term in a sentence of these words."""
    out = []
    for term, other in swaps(found, identity):
        rest = features(found - {term})
        out.append((features({term}) - rest, features({other}) - rest))
    return out


def text_changes(text: str | None, identity=IDENTITY) -> Counter:
    """How often each change ((features that go), (features that come)) comes from a swap in one of a text's sentences. Each
    sentence is a pair with its swapped form, so what another sentence says takes nothing from it."""
    terms = {t for line in identity for t in line}
    out: Counter = Counter()
    for sentence in STOP.split(text.lower()) if text else ():
        if not terms.isdisjoint(found := set(WORD.findall(sentence))):
            out.update((tuple(sorted(gone)), tuple(sorted(come))) for gone, come in changes(found, identity))
    return out


class Model:
    """Weights of features and an intercept; ``swapped`` is how many counterfactual pairs of sentences the fit held
    together."""

    def __init__(self, weights: dict[str, float], bias: float, swapped: int = 0):
        self.weights, self.bias, self.swapped = weights, bias, swapped

    def margin(self, found: set[str]) -> float:
        return self.bias + sum(map(self.weights.__getitem__, features(found) & self.weights.keys()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(words(text)), -40, 40))))


def solve(rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int], int]], size: int, counterfactual: float = 1.0, sparse: float = 2e-4, ridge: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Proximal gradient descent on mean log loss + ridge/2 |w|^2 + counterfactual/2 * mean over pairs of (z - z')^2 + sparse |w|_1.

    z is the linear score of a sentence of a labelled text and z' that of the sentence with one identity term swapped for
    another of its line; they differ by what the features that come weigh, less those that go. Equal pairs (gone, come, times)
    count as often as they occur. The penalty holds both scores together, which takes
    from a group's name what only its company in the labelled texts gave it.
    """
    y = np.array(labels, float)
    flat = lambda lists: (np.array([c for r in lists for c in r], np.int64), np.repeat(np.arange(len(lists)), [len(r) for r in lists]))
    col, row = flat(rows)
    gone, gone_of = flat([g for g, _, _ in pairs])
    come, come_of = flat([c for _, c, _ in pairs])
    times = np.array([n for _, _, n in pairs], float)
    times /= max(times.sum(), 1)
    w, bias = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    grown, momentum = np.zeros(size), 0.0
    for _ in range(rounds):  # AdaGrad steps, then soft thresholds
        z = bias + np.bincount(row, w[col], len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(col, off[row], size) / len(rows) + ridge * w
        if pairs and counterfactual:
            d = (np.bincount(come_of, w[come], len(pairs)) - np.bincount(gone_of, w[gone], len(pairs))) * counterfactual * times
            g += np.bincount(come, d[come_of], size) - np.bincount(gone, d[gone_of], size)
        grown += g * g
        speed = 0.3 / (np.sqrt(grown) + 1e-8)
        w = w - speed * g
        w = np.sign(w) * np.maximum(np.abs(w) - speed * sparse, 0)
        momentum += off.mean() ** 2
        bias -= 0.3 * off.mean() / (np.sqrt(momentum) + 1e-8)
    return w, bias


def trained(rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int], int]], names: list[str], prior: float | None = None, **options) -> Model:
    """The model of encoded texts; ``prior`` is the share of label 1 among the rows that the texts were drawn from. With one
    label alone, or none, the score is constant."""
    share = sum(labels) / max(1, len(labels))
    if share in (0, 1):
        return Model({}, 0.0 if not labels else 16.0 * share - 8)
    if not pairs:
        warnings.warn("no labelled text holds an identity term, so no counterfactual pair regularises the classifier", stacklevel=2)
    w, bias = solve(rows, labels, pairs, len(names), **options)
    if prior is not None and 0 < prior < 1:
        bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model({k: float(v) for k, v in zip(names, w) if v}, float(bias), sum(n for _, _, n in pairs))


def known(names, at: dict[str, int]) -> list[int]:
    """The numbers of the features that have one."""
    return sorted(at[f] for f in names if f in at)


def fit(said: list[str | None], labels: list[int], prior: float | None = None, identity=IDENTITY, support: int = 3, **options) -> Model:
    """A model of texts held here. Features are those of at least ``support`` texts, and those of the identity terms."""
    docs = [features(words(t)) for t in said]
    seen = Counter(f for d in docs for f in d)
    names = sorted({f for f, n in seen.items() if n >= support} | features({t for line in identity for t in line}))
    at = {f: i for i, f in enumerate(names)}
    swapped = sum((text_changes(t, identity) for t in said), Counter())
    return trained([known(d, at) for d in docs], list(labels), [(known(g, at), known(c, at), n) for (g, c), n in sorted(swapped.items())], names, prior, **options)


STRINGS = T.ArrayType(T.StringType())


SWAPPED = T.ArrayType(T.StructType().add("gone", STRINGS).add("come", STRINGS).add("times", T.LongType()))


@pandas_udf(STRINGS)
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([sorted(features(words(t))) for t in text], dtype=object)


def _swapped(identity):
    @pandas_udf(SWAPPED)
    def swapped(text: pd.Series) -> pd.Series:
        return pd.Series([[(list(g), list(c), n) for (g, c), n in sorted(text_changes(t, identity).items())] for t in text], dtype=object)

    return swapped


def learn(docs: DataFrame, labels: DataFrame, most: int = 3_000, identity=IDENTITY, support: int = 3, **options) -> Model:
    """A model of label ``toxic`` from the labelled rows: at most about ``most`` of each label, chosen by hash of doc_id,
    are fitted on, a bounded sample; the intercept is set back to the labels' true shares.

    Only ids meet the labels; the chosen ids, about 2 * ``most``, are broadcast to the texts, so no text but theirs is
    shuffled. Texts become sets of features, and sentences pairs with their swapped forms, in the tasks; both are counted there,
    and the driver gets numbers of known features, and each different pair of these once.
    Of rows with the same doc_id the smallest text is read; null doc_ids, labels and texts teach nothing.
    """
    told = labels.where("toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).distinct()
    taught = docs.where("text is not null").select("doc_id").distinct().join(told, F.col("doc_id") == F.col("_id")).select("_id", F.col("_toxic").alias("toxic"))
    counts = dict(taught.groupBy("toxic").count().collect())
    if not counts:
        return Model({}, 0.0)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, most / n))).otherwise(share)
    chosen = cut(taught.where(F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 30)) < share * (1 << 30)))
    rows = texts(docs).where("text is not null").select("doc_id", "text").join(broadcast_within(chosen), F.col("doc_id") == F.col("_id"))
    few = rows.groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    sample = cut(few.select("_id", (F.col("toxic") == 1).cast("int").alias("toxic"), _features("text").alias("features"), _swapped(identity)("text").alias("pairs")))
    often = sample.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    names = sorted({r.f for r in often.select("f").collect()} | features({t for line in identity for t in line}))
    numbers = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @pandas_udf("array<int>")
    def number(found: pd.Series) -> pd.Series:
        return pd.Series([known(f, numbers.value) for f in found], dtype=object)

    got = sorted(sample.select("_id", "toxic", number("features").alias("row")).collect(), key=lambda r: (r._id, r.toxic))
    each = sample.select(F.explode("pairs").alias("p")).groupBy("p.gone", "p.come").agg(F.sum("p.times").alias("times"))
    pairs = sorted((tuple(r.gone), tuple(r.come), r.times) for r in each.collect())  # terms and their beginnings: as many as the lists allow
    pairs = [(known(g, numbers.value), known(c, numbers.value), n) for g, c, n in pairs]
    return trained([r.row for r in got], [r.toxic for r in got], pairs, names, counts.get(1, 0) / sum(counts.values()), **options)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    Null and empty texts get the score of a text without known words. Repeated rows get equal scores; other columns are
    kept, but for columns of these two names, which are replaced; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    @pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in column], dtype="float64")

    scored = texts(docs).select(*[docs[c] for c in names], score(docs[text]).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document, learned from the labelled rows not held out.

    Rows with null doc_id are scored and teach nothing; repeated rows get equal scores; without usable labels every score
    is 0.5; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    out = docs.select("doc_id", held_out().alias("held_out"), "text")
    model = learn(out.where("not held_out"), labels, **options)
    return predict(out, model).select("doc_id", "held_out", "score", "predicted")
