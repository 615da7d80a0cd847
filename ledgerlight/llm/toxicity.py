"""Toxicity by a classifier chain.

The labels have one toxic flag; as a proxy, the chain's categories are toxic text in each of the corpus's languages, then
toxic text of any kind. Each category is a logistic regression over the words of a text (the words themselves, their first
4, 5 and 6 letters, hashed to 32 bits) and over the probabilities of the categories before it. Those probabilities come, for training,
from models that have not seen the row (out-of-fold), so that later models learn how far to trust earlier ones.

The models are fitted on a bounded sample of labelled rows, SAMPLE of each class by smallest hash of doc_id, in one task
that gets the sample's word hashes; only the models reach the driver. Features are chosen by their log odds in the training rows. Every document is
scored over its whole text.

Null text: no words, the prior. A doc_id labelled more than once counts as toxic if any label says so; null labels and
labels without a document are passed over. Without labels of both kinds nothing is rejected (probability 0). Rows that
repeat are scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release

LANGUAGES = ("en", "de", "fr", "es")
CATEGORIES = (*(f"toxic_{x}" for x in LANGUAGES), "toxic")
SAMPLE = 4000  # labelled rows of each class at most
FEATURES = 3000  # of a category
FOLDS = 3
PREFIXES = (4, 5, 6)
LEAST = 4  # toxic rows that must hold a feature
KEPT = 1 << 18  # words whose features a task remembers

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    return [zlib.crc32(b"w" + word.encode()), *(zlib.crc32(b"p" + word[:n].encode()) for n in PREFIXES if len(word) > n)]


def text_features(text: str | None) -> np.ndarray:
    """The sorted distinct feature hashes of a text."""
    return np.unique(np.array([h for w in set(_WORD.findall((text or "").lower())) for h in word_features(w)], np.uint32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Linear:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    chain: np.ndarray  # weights of the probabilities of earlier categories
    bias: float


def _fit(rows: np.ndarray, codes: np.ndarray, kinds: np.ndarray, n: int, y: np.ndarray, earlier: np.ndarray, steps: int = 150) -> tuple[Linear, np.ndarray]:
    """L2-regularised logistic regression on the features that tell the classes apart, by gradient steps with Adam.

    rows, codes: which of n texts holds which of kinds. Also gives the places of the model's features among kinds."""
    pos = int(y.sum())
    if not pos or pos == n:
        return Linear(np.zeros(0, np.uint32), np.zeros(0), np.zeros(earlier.shape[1]), 8.0 if pos else -8.0), np.zeros(0, np.int64)
    with_y = np.bincount(codes[y[rows] > 0], minlength=len(kinds))
    without = np.bincount(codes, minlength=len(kinds)) - with_y
    odds = np.log((with_y + 0.5) / (pos + 1)) - np.log((without + 0.5) / (n - pos + 1))
    strength = np.abs(odds) * np.sqrt(np.maximum(with_y, without * pos / n))
    strength[(with_y < LEAST) & (odds > 0)] = 0
    pick = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    pick = pick[strength[pick] > 2.0]
    column = np.full(len(kinds), -1, np.int32)
    column[pick] = np.arange(len(pick))
    hit = np.flatnonzero(column[codes] >= 0)
    r, c = rows[hit], column[codes[hit]]
    k, m = len(pick), earlier.shape[1]
    w, first, second = (np.zeros(k + m + 1) for _ in range(3))
    w[-1] = np.log(pos / (n - pos))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos))
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], n) + earlier @ w[k : k + m] + w[-1] if k else earlier @ w[k : k + m] + w[-1]
        d = weight * (_sigmoid(z) - y)
        g = np.concatenate([np.bincount(c, d[r], k) if k else np.zeros(0), earlier.T @ d, [d.sum()]]) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return Linear(kinds[pick], w[:k], w[k : k + m], float(w[-1])), pick


def _score_rows(model: Linear, places: np.ndarray, rows: np.ndarray, codes: np.ndarray, kinds: int, n: int, earlier: np.ndarray) -> np.ndarray:
    """The model's probabilities of n texts."""
    weight = np.zeros(kinds)
    weight[places] = model.weights
    hit = np.flatnonzero(weight[codes])
    return _sigmoid(np.bincount(rows[hit], weight[codes[hit]], n) + model.bias + earlier @ model.chain)


def fit_chain(texts: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> list[Linear]:
    """A model for each column of labels (rows x categories), each fed the out-of-fold probabilities of those before."""
    n = len(texts)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    kinds, codes = np.unique(np.concatenate(texts) if n else np.zeros(0, np.uint32), return_inverse=True)
    codes = codes.astype(np.int32)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    earlier = np.zeros((n, 0))
    chain = []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        chain.append(_fit(rows, codes, kinds, n, y, earlier)[0])
        out = np.zeros(n)
        for f in range(FOLDS if j + 1 < labels.shape[1] else 0):
            train, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            place = np.full(n, -1, np.int32)
            place[train] = np.arange(len(train))
            use = place[rows] >= 0
            part, places = _fit(place[rows[use]], codes[use], kinds, len(train), y[train], earlier[train])
            out[rest] = _score_rows(part, places, rows, codes, len(kinds), n, earlier)[rest]
        earlier = np.hstack([earlier, out[:, None]])
    return chain


class Scorer:
    """The chain's probabilities of texts. A word's features are looked up once."""

    def __init__(self, chain: list[Linear]):
        self.chain = chain
        self.known = np.unique(np.concatenate([m.features for m in chain])) if chain else np.zeros(0, np.uint32)
        self.table = np.zeros((len(self.known), len(chain)))
        for j, m in enumerate(chain):
            self.table[np.searchsorted(self.known, m.features), j] = m.weights
        self.place = {h: i for i, h in enumerate(self.known.tolist())}
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> list[float]:
        words, place, found = self.words, self.place, set()
        if len(words) > KEPT:
            words.clear()
        for w in set(_WORD.findall((text or "").lower())):
            got = words.get(w)
            if got is None:
                got = words[w] = tuple(place[h] for h in word_features(w) if h in place)
            if got:
                found.update(got)
        own = self.table[sorted(found)].sum(0) if found else np.zeros(len(self.chain))
        earlier: list[float] = []
        for j, m in enumerate(self.chain):
            earlier.append(float(_sigmoid(own[j] + m.bias + (np.array(earlier) @ m.chain if j else 0.0))))
        return earlier


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain, from at most sample labelled rows of each class."""
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    pick = None
    for y in (0, 1):
        some = truth.where(F.col("toxic") == y).orderBy(*order).limit(sample)
        pick = some if pick is None else pick.union(some)
    pick = pick.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit("")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").join(F.broadcast(pick), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "toxic": b["toxic"], "f": [text_features(t).tobytes() for t in b["text"]]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        got = list(batches)
        if not got:
            return
        got = pd.concat(got, ignore_index=True)
        got = got.assign(size=got["f"].map(len)).sort_values(["doc_id", "size", "f"]).drop_duplicates("doc_id")
        toxic = got["toxic"].to_numpy(int)
        if len(got) and toxic.min() < toxic.max():
            y = np.stack([*(toxic * (got["lang"] == x).to_numpy(int) for x in LANGUAGES), toxic], 1)
            yield pd.DataFrame({"chain": [pickle.dumps(fit_chain([np.frombuffer(f, np.uint32) for f in got["f"]], y))]})
        del got
        release()

    held = rows.mapInPandas(features, "doc_id long, lang string, toxic int, f binary")
    found = held.repartition(1).mapInPandas(fit, "chain binary").first()  # the sample meets in one task, its model comes back
    return pickle.loads(found["chain"]) if found else []


def score(documents: DataFrame, chain: list[Linear]) -> DataFrame:
    """documents, all columns, with toxicity (array of the categories' probabilities in the order of CATEGORIES)."""
    sent = documents.sparkSession.sparkContext.broadcast(chain)
    state: dict = {}

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        if "scorer" not in state:
            release()
            state["scorer"] = Scorer(sent.value)
        return pd.Series([state["scorer"].score(t) for t in texts])

    return documents.withColumn("toxicity", probabilities(F.col("text")) if chain else F.array(*[F.lit(0.0)] * len(CATEGORIES)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, a probability for each category, rejected."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels, sample))
    columns = [F.round(F.get("toxicity", F.lit(i)), 6).alias(c) for i, c in enumerate(CATEGORIES)]
    return scored.select("doc_id", *columns, (F.get("toxicity", F.lit(len(CATEGORIES) - 1)) >= threshold).alias("rejected"))


def filtered(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "text", *["lang"] * ("lang" in documents.columns))
    scored = score(named, train(documents, labels))
    kept = scored.where(F.get("toxicity", F.lit(len(CATEGORIES) - 1)) < threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
