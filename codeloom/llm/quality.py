"""Quality classifier trained on weak labels.

1. Overlapping heuristic labellers vote good, bad or abstain on every document. The
   documents are counted by vote pattern, at most 3**len(LABELLERS) rows whatever the
   input, so expectation-maximisation over all documents runs on that small table and
   estimates each labeller's accuracies and the share of good documents.
2. A linear scorer over hashed features (byte trigrams and the labellers' measurements
   in buckets) is fitted to the posterior labels of TRAIN_ROWS documents at most, those
   with the smallest hashed ids; that bound is a parameter.
3. All documents are scored over their whole texts; one with a probability below
   THRESHOLD is rejected.

Defined results: null and empty texts are rejected, with probability 0; a null id is
scored like others; repeated rows get equal scores; an empty table gives no rows; if
all votes agree, or there are too few documents, the scorer falls back on the
posterior of a document's own votes; other columns are passed through by `filtered`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

GOOD, BAD, ABSTAIN = 1, 0, 2
TRAIN_ROWS = 4000
TRAIN_BYTES = 64 << 20  # of the sample's texts together; a sixteenth of it for one
MIN_TRAIN_ROWS = 50
FEATURES = 1 << 14
THRESHOLD = 0.5
#: Bytes by class.
_UPPER, _LOWER, _SPACE, _PLAIN = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True  # ! " ' ( ) , - . : ; ?
_PLAIN[48:58] = True

#: Heuristic labellers. Each looks for one thing, so its silence says nothing: it votes
#: in one direction or abstains. Measurement, bound, vote when the measurement exceeds it.
LABELLERS = (
    ("symbols", 0.08, BAD),
    ("capitals", 0.5, BAD),
    ("repeats", 0.3, BAD),
    ("few_pairs", 0.6, BAD),
    ("wordless", 0.2, BAD),
    ("shouting", 0.3, BAD),
    ("marked_words", 0.7, BAD),
    ("copied_lines", 0.6, BAD),
    ("prose", 0.5, GOOD),
    ("variety", 0.92, GOOD),
)
#: Words from which the labellers of shares of words vote.
MIN_WORDS = 12


def measure(text: bytes) -> np.ndarray:
    """The labellers' measurements of a text, each between 0 and 1."""
    b = np.frombuffer(text, np.uint8)
    words = text.split()
    n = max(1, len(words))
    inner = max(1, int(np.count_nonzero(~_SPACE[b])))
    upper, lower = int(np.count_nonzero(_UPPER[b])), int(np.count_nonzero(_LOWER[b]))
    high = int(np.count_nonzero(b >= 128))
    symbols = (inner - upper - lower - high - int(np.count_nonzero(_PLAIN[b]))) / inner
    capitals = upper / max(1, upper + lower)
    bare = sum(not (w.isalnum() or any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 or 48 <= c <= 57 for c in w)) for w in words) / n
    shouting = min(1.0, int(np.count_nonzero(b == 33)) / n)
    again = few = marked = 0.0
    if len(words) >= MIN_WORDS:
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        few = 1 - len(set(zip(words, words[1:]))) / (n - 1)
        marked = sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / n
    lines = [x for x in text.split(b"\n") if x.strip()] if text.count(b"\n") > 3 else []
    copied = 1 - len(set(lines)) / len(lines) if lines else 0.0
    letters = (upper + lower + high + int(np.count_nonzero((b >= 48) & (b <= 57)))) / inner
    variety = min(1 - few, letters) if len(words) >= MIN_WORDS else 0.0
    plain = symbols < 0.04 and bare < 0.06 and shouting < 0.1 and again < 0.08 and (capitals < 0.25 or len(words) < MIN_WORDS)
    return np.array([symbols, capitals, again, few, bare, shouting, marked, copied, float(plain), variety])


def votes(m: np.ndarray) -> str:
    return "".join(str(vote if x > bound else ABSTAIN) for x, (_, bound, vote) in zip(m, LABELLERS, strict=True))


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Share of good documents and each labeller's accuracy when it votes, by expectation-maximisation.

    Starts from seven good documents in ten and labellers right four times in five, and smooths by ten
    votes, so the classes keep their meaning and a silent labeller keeps its start.
    """
    names = sorted(patterns)
    count = np.array([patterns[p] for p in names], float)
    vote = np.array([[int(c) for c in p] for p in names]).reshape(len(names), len(LABELLERS))
    accuracy, prior = np.full(len(LABELLERS), 0.8), 0.7
    for _ in range(rounds):
        p = posterior(vote, prior, accuracy)
        right = np.where(vote == GOOD, p[:, None], 1 - p[:, None]) * (vote != ABSTAIN)
        accuracy = (count @ right + 8) / (count @ (vote != ABSTAIN) + 10)
        accuracy = np.clip(accuracy, 0.55, 0.99)
        prior = float(np.clip((count @ p + 5) / (count.sum() + 10), 0.1, 0.9))
    return prior, accuracy


def posterior(vote: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """Probability of good quality given votes; abstaining says nothing."""
    weight = np.log(accuracy / (1 - accuracy))
    z = np.where(vote == GOOD, weight, np.where(vote == BAD, -weight, 0.0)).sum(axis=1) + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features(text: bytes, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: slots and weights. Trigrams share a weight of one, so length does not count."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    gram = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    slots, times = np.unique(gram, return_counts=True)
    bucket = np.minimum((m * 20).astype(int), 20)
    return np.concatenate([slots, (1 << 13) + np.arange(len(m)) * 32 + bucket]), np.concatenate([times / len(gram), np.full(len(m), 1.0)])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 100, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on posterior labels by AdaGrad over all rows; the last weight is the intercept."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    w, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    for _ in range(rounds):
        z = np.bincount(at, w[slot] * value, len(rows)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(slot, off[at] * value, FEATURES), off.sum()) / len(rows) + 1e-5 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: dict[str, int] = {}
        for text in batch.column("text").to_pylist():
            if text and text.strip():
                p = votes(measure(text))
                got[p] = got.get(p, 0) + 1
        yield pa.RecordBatch.from_pydict({"pattern": list(got), "n": list(got.values())}, schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))


class Model:
    """What scoring needs: EM's estimates and the scorer's weights (None: posterior of the votes only)."""

    def __init__(self, prior: float, accuracy: np.ndarray, weights: np.ndarray | None):
        self.prior, self.accuracy, self.weights = prior, accuracy, weights

    def score(self, text: bytes | None) -> tuple[float, float]:
        """Probability of good quality by the scorer, and by the votes."""
        if not text or not text.strip():
            return 0.0, 0.0
        m = measure(text)
        p = float(posterior(np.array([[int(c) for c in votes(m)]]), self.prior, self.accuracy)[0])
        if self.weights is None:
            return p, p
        slot, value = features(text, m)
        z = float(self.weights[slot] @ value + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50)))), p


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    text = F.col(text_col).cast("binary").alias("text")
    counted = docs.select(text).mapInArrow(_vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r["pattern"]: r["n"] for r in counted.collect()}  # at most 3**len(LABELLERS) rows
    prior, accuracy = estimate(patterns) if patterns else estimate({str(ABSTAIN) * len(LABELLERS): 0})
    # The sample: the smallest hashes, of texts that are not too long, up to a number of rows and bytes.
    order = F.xxhash64(id_col)
    short = docs.filter(F.octet_length(text_col) <= TRAIN_BYTES // 16).select(order.alias("h"), F.octet_length(text_col).alias("n"), text)
    first = short.select("h", "n").orderBy("h", "n").limit(train_rows).collect()
    total, bound = 0, None
    for r in first:
        total += r["n"]
        if total > TRAIN_BYTES:
            break
        bound = r["h"]
    sample = short.filter(F.col("h") <= (bound if bound is not None else 0)).select("h", "text").orderBy("h", "text").limit(len(first) if bound is not None else 0)
    texts = [r["text"] for r in sample.collect() if r["text"] and r["text"].strip()]
    measured = [measure(t) for t in texts]
    target = posterior(np.array([[int(c) for c in votes(m)] for m in measured]).reshape(-1, len(LABELLERS)), prior, accuracy)
    if len(texts) < MIN_TRAIN_ROWS or (target > 0.5).all() or (target < 0.5).all():
        return Model(prior, accuracy, None)
    return Model(prior, accuracy, fit([features(t, m) for t, m in zip(texts, measured, strict=True)], target))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, weak_score and kept; only texts go to the workers, with the model of about 130 kB."""
    shared = docs.sparkSession.sparkContext.broadcast((model.prior, model.accuracy, model.weights))

    @F.pandas_udf("score double, weak_score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([own.score(t) for t in texts], columns=["score", "weak_score"])

    out = docs.withColumn("__codeloom_scores", score(F.col(text_col).cast("binary")))
    new = {"score": F.col("__codeloom_scores.score"), "weak_score": F.col("__codeloom_scores.weak_score"), "kept": F.col("__codeloom_scores.score") >= THRESHOLD}
    return out.withColumns(new).drop("__codeloom_scores")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects."""
    model = train(docs, id_col, text_col)
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    found = scored(packed, model, f"row.{text_col}")
    return found.filter("kept").select("row.*")
