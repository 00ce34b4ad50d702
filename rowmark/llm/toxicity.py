"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The gap-weighted subsequence kernel counts the letter triples that two strings share in order,
each gap costing a factor, so an insult still matches with letters inserted or left apart.

1. From a bounded sample of labelled texts, words and word beginnings that mark toxic texts are
   chosen as landmarks, most telling first, unlike each other.
2. A text is described by its best match with each landmark over all its words, mapped by the
   inverse root of the landmarks' kernel matrix (Nyström).
3. A linear machine with squared hinge loss is trained on the sample and calibrated.
4. Every whole text is scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmark.llm._repeats import row_keys

#: At most so many labelled rows are learnt from: those with the smallest hash of their doc_id.
SAMPLE_ROWS = 12_000
LANDMARKS, CANDIDATES = 64, 600
#: Letters in a subsequence, the factor per letter spanned, and the power of the similarity.
LENGTH, DECAY, POWER = 3, 0.5, 4
#: A word is compared with a landmark if it has at least this share of its letters.
SHARED_LETTERS = 0.75
#: Letters of a word compared at a time; longer words are compared in overlapping stretches.
STRETCH, LONGEST_LANDMARK = 24, 12
#: Pairs of words and landmarks compared at a time.
PAIRS = 8192
THRESHOLD = 0.3
_REMEMBERED = 300_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPELT_OUT = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words by white space; letters set apart one by one count as a word too."""
    text = text.lower()
    words = set(text.split())
    for run in _SPELT_OUT.findall(text):
        words.add("".join(run.split()))
    return words


def letters_of(word: str) -> str:
    return word if word.isalpha() else _NOT_LETTERS.sub("", word)


def _codes(strings: list[str], width: int) -> np.ndarray:
    padded = "".join([s.ljust(width, "\0") for s in strings])
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted count of common subsequences of each row pair of two code arrays (0 is padding)."""
    used, m = (int((x != 0).sum(1).max(initial=0)) for x in (s, t))
    s, t = np.ascontiguousarray(s[:, :used].T), np.ascontiguousarray(t[:, :m].T)
    pairs, square, decay = s.shape[1], np.float32(decay * decay), np.float32(decay)
    # By letter, then by pair: each step runs over all pairs at once.
    prefix = [np.ones((m + 1, pairs), np.float32)] + [np.zeros((m + 1, pairs), np.float32) for _ in range(length - 1)]
    total, some = np.zeros(pairs, np.float32), t != 0
    for j in range(used):
        match = ((s[j] == t) & some).astype(np.float32) * square
        total += (match * prefix[length - 1][:m]).sum(0)
        for i in range(length - 1, 0, -1):
            step = match * prefix[i - 1][:m]
            for k in range(1, m):
                step[k] += step[k - 1] * decay
            prefix[i] *= decay
            prefix[i][1:] += step
    return total


@dataclass
class Landmarks:
    """Landmark strings, and the similarities of words to them."""

    strings: list[str]
    codes: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.codes = _codes(self.strings, LONGEST_LANDMARK)
        self.own = subsequence_kernel(self.codes, self.codes) if self.strings else np.zeros(0, np.float32)

    def matrix(self) -> np.ndarray:
        """The landmarks' kernel matrix, normalised."""
        n = len(self.strings)
        a, b = np.divmod(np.arange(n * n), n)
        values = subsequence_kernel(self.codes[a], self.codes[b]).reshape(n, n).astype(float)
        return (values / np.sqrt(np.outer(self.own, self.own))) ** POWER

    def similar(self, words: list[str]) -> dict[str, np.ndarray]:
        """For the words that resemble a landmark: the similarities to all landmarks, 0 to 1."""
        owners, stretches = [], []
        for i, word in enumerate(words):
            letters = letters_of(word)
            for low in range(0, max(1, len(letters) - STRETCH // 2), STRETCH // 2):
                if len(letters) - low >= LENGTH:
                    owners.append(i)
                    stretches.append(letters[low : low + STRETCH])
        out: dict[str, np.ndarray] = {}
        if not owners or not self.strings:
            return out
        codes = _codes(stretches, STRETCH)
        alphabet = np.unique(self.codes[self.codes != 0])
        has = np.stack([(codes == a).any(1) for a in alphabet], 1)
        needs = np.stack([(self.codes == a).sum(1) for a in alphabet], 1)
        least = np.ceil(SHARED_LETTERS * (self.codes != 0).sum(1))
        row, mark = np.nonzero(has.astype(np.float32) @ needs.T.astype(np.float32) >= least)
        # Pairs of like lengths together, in arrays that are no wider than they need be.
        order = np.lexsort(((codes != 0).sum(1)[row], (self.codes != 0).sum(1)[mark]))
        row, mark = row[order], mark[order]
        for low in range(0, len(row), PAIRS):
            r, m = row[low : low + PAIRS], mark[low : low + PAIRS]
            values = np.minimum(1, subsequence_kernel(codes[r], self.codes[m]) / self.own[m]) ** POWER
            close = np.flatnonzero(values > 0.05)
            for i, k, v in zip(r[close].tolist(), m[close].tolist(), values[close].tolist(), strict=True):
                vector = out.setdefault(words[owners[i]], np.zeros(len(self.strings), np.float32))
                vector[k] = max(vector[k], v)
        return out


class Describer:
    """Texts as best matches with the landmarks; remembers the words it has compared."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.known, self.hot = landmarks, set(), {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.landmarks.strings)), np.float32)
        for low in range(0, len(texts), 500):
            words = [words_of(t or "") for t in texts[low : low + 500]]
            if len(self.known) > _REMEMBERED:
                self.known, self.hot = set(), {}
            new = sorted(set().union(*words) - self.known)
            self.known.update(new)
            self.hot |= self.landmarks.similar(new)
            for i, found in enumerate(words, low):
                for word in found & self.hot.keys():
                    np.maximum(out[i], self.hot[word], out=out[i])
        return out


@dataclass
class Machine:
    """Landmarks, Nyström map, weights and calibration."""

    landmarks: Landmarks
    transform: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, described: np.ndarray) -> np.ndarray:
        margin = described @ self.transform @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def train_machine(landmarks: Landmarks, described: np.ndarray, toxic: np.ndarray, penalty: float = 1e-3) -> Machine:
    """Squared-hinge linear machine by Newton steps on the Nyström features, then a logistic fit."""
    values, vectors = np.linalg.eigh(landmarks.matrix())
    transform = vectors * (1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = np.c_[described.astype(float) @ transform, np.ones(len(described))]
    y = np.where(toxic, 1.0, -1.0)
    cost = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-6])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active] + 1e-12 * np.eye(len(w)), xa.T @ y[active])
        done = np.allclose(new, w, atol=1e-7)
        w = new
        if done:
            break
    margin = x @ w
    slope, offset = _logistic(margin, toxic)
    return Machine(landmarks, transform, w, slope, offset)


def _logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (targets smoothed by the class sizes)."""
    pos, neg = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, ab = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        gradient = z.T @ (p - target) + 1e-6 * ab
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        ab = ab - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def held_out(doc_id: Column | str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per word and word beginning, toxic and not, per batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = set()
            for word in words_of(text or ""):
                letters = letters_of(word)
                found.update(letters[:n] for n in (4, 5, 6, len(letters)) if LENGTH < n <= min(len(letters), LONGEST_LANDMARK))
            counts[bool(toxic)].update(found)
        strings = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"string": strings, "toxic": [counts[1][s] for s in strings], "clean": [counts[0][s] for s in strings]},
            schema=pa.schema([("string", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
        )


def choose_landmarks(sample: DataFrame, toxic: int, clean: int, count: int = LANDMARKS) -> Landmarks:
    """The strings whose share of toxic texts exceeds that of clean ones most surely."""
    rate_t, rate_c = F.col("toxic") / toxic, F.col("clean") / clean
    spread = F.sqrt((F.col("toxic") + 1) / F.lit(toxic) ** 2 + (F.col("clean") + 1) / F.lit(clean) ** 2)
    found = (
        sample.mapInArrow(_beginnings, "string string, toxic long, clean long")
        .groupBy("string")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 2")
        .select("string", ((rate_t - rate_c) / spread).alias("weight"))
        .where("weight > 1")
        .orderBy(F.desc("weight"), "string")
        .limit(CANDIDATES)
    )
    candidates = Landmarks([row["string"] for row in found.collect()])
    if not candidates.strings:
        return candidates
    like, chosen = candidates.matrix(), []
    for i in range(len(candidates.strings)):
        if len(chosen) < count and all(like[i, j] < 0.4 for j in chosen):
            chosen.append(i)
    return Landmarks([candidates.strings[i] for i in chosen])


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
)


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | float:
    """A machine, or the share of toxic rows if the labels show only one class or nothing telling."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id")).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    sample = documents.select("doc_id", F.col("text").cast("string")).join(picked, "doc_id").select("text", "toxic")
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    share = (toxic + 0.5) / (toxic + clean + 1)
    if not toxic or not clean:
        return share
    landmarks = choose_landmarks(sample, toxic, clean)
    if not landmarks.strings:
        return share
    handle = documents.sparkSession.sparkContext.broadcast(landmarks)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(handle.value)
        for batch in batches:
            rows = describer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("toxic")], names=["x", "toxic"]
            )

    rows = sample.mapInArrow(describe, "x binary, toxic boolean").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, len(landmarks.strings))
    order = np.lexsort(x.T)  # the same sums whatever the order of rows
    return train_machine(landmarks, x[order], rows.column("toxic").to_numpy().astype(bool)[order])


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, scored by its text alone.

    Null and empty texts score as texts without any match. Rows with null labels or ids are not
    learnt from; a document with several labels is learnt from with each. Without labels of both
    classes every score is the share of toxic rows (0.5 without labels). Repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    return scored(documents, labels, threshold, sample_rows).drop("text_key")


def scored(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The same with text_key, the hash of the text that was scored."""
    machine = learn(documents, labels, sample_rows)
    rows = documents.select(
        F.col("doc_id").cast("long"), row_keys()[1].alias("text_key"), held_out("doc_id").alias("held_out"), F.col("text").cast("string")
    )
    handle = documents.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        describer = Describer(fitted.landmarks) if isinstance(fitted, Machine) else None
        for batch in batches:
            if describer is None:
                scores = np.full(batch.num_rows, fitted)
            else:
                scores = fitted.score(describer(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], schema=_SCORED,
            )

    return rows.mapInArrow(score, "doc_id long, text_key long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
