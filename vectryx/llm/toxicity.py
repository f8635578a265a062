"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

The lexicon holds words and word beginnings that mark toxic documents among the labelled ones; a small list of common
insults is in it from the start. Features of a training document come from a lexicon learned without its half of the
sample, and the calibration from trees grown without its fold, so that neither sees what it is judged on.

Training is on the driver, on a bounded sample; the model (hundreds of words, some trees) goes to the workers, and scoring
is a map without shuffle in batches of bounded text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, sliced, texts
from .langid import remainder
from .quality import CONT, DIGIT, LOWER, PUNCT, SPACE, STOP, SYMBOL, UPPER, WIDE, class_counts

INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "ugly", "filth", "crap", "hate", "imbecile", "vermin", "garbage")
SECOND_PERSON = frozenset("you your yours yourself youre ya u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo vos usted ustedes vosotros".split())
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
NEAR = 5
FEATURES = ("hits", "density", "weight", "strongest", "different", "obfuscated_hits", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "punctuation", "symbols", "digits", "obfuscated_words", "wide", "mean_word", "log_words")


def letters(word: str) -> str:
    """A word's core in lower case: what isn't a letter or digit goes from both ends."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def plain(word: str) -> str:
    """A core with look-alikes undone and what parts its letters left out."""
    return "".join(c for c in word.translate(_PLAIN) if c.isalpha())


def keys(core: str, least: int = 4, most: int = 8) -> list[str]:
    """The word, and its beginnings with a star."""
    return [core, *(core[:n] + "*" for n in range(least, min(most, len(core)) + 1))]


@dataclass
class Lexicon:
    weights: dict[str, float]

    def weight(self, core: str) -> float:
        w = self.weights
        return max([w.get(k, 0.0) for k in keys(core)], default=0.0) if core else 0.0


def learn_lexicon(own: list[bytes], toxic: np.ndarray, least_documents: int = 5, least_log_odds: float = 3.0, most: int = 500) -> Lexicon:
    """By document counts: log odds with half a document added on either side; the `most` strongest of them by support."""
    yes, no = Counter(), Counter()
    for t, label in zip(own, toxic):
        cores = {letters(w) for w in set(t.decode().split())}
        (yes if label else no).update({k for c in cores if c for k in keys(c)})
    n_yes, n_no = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = {}
    for k, n in yes.items():
        if n >= least_documents:
            odds = float(np.log((n + 0.5) / (n_yes + 1)) - np.log((no[k] + 0.5) / (n_no + 1)))
            if odds >= least_log_odds:
                found[k] = odds
    strongest = sorted(found, key=lambda k: (-found[k] * np.sqrt(yes[k]), k))[:most]
    weights = {w: least_log_odds for w in INSULTS}
    weights.update({k: found[k] for k in strongest})
    return Lexicon(weights)


class _Codes(dict):
    """Of a word: weight in thousandths, and flags for second person, capitals, hidden spelling. Words beyond `longest` bytes aren't kept."""

    most, longest = 300_000, 128

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core = letters(word)
        inner = bool(core) and not core.isalpha() and any(c.isalpha() for c in core) and not core.replace("-", "").replace("'", "").replace("’", "").isalpha()
        w, hidden = self.lexicon.weight(core), 0
        if not w and (inner or word[:1] in "@$!"):
            w = max(self.lexicon.weight(plain(core)), self.lexicon.weight(plain(word.lower().rstrip(".,;:!?"))))
            hidden = int(w > 0)
        code = int(round(w * 1000)) << 4 | (core in SECOND_PERSON) | (word.isupper() and len(core) > 1) << 1 | inner << 2 | hidden << 3
        if len(raw) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[raw] = code
        return code


def featured(text: bytes, codes: _Codes) -> list[float]:
    words = text.split()
    n = len(words)
    c = class_counts(text)
    chars = max(1, int(c.sum() - c[CONT] - c[SPACE]))
    alpha = max(1, int(c[UPPER] + c[LOWER] + c[WIDE]))
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    weight = (code >> 4) / 1000
    hit, second = np.flatnonzero(weight > 0), np.flatnonzero(code & 1)
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        gap = np.minimum(np.abs(hit - second[np.maximum(at - 1, 0)]), np.abs(second[np.minimum(at, len(second) - 1)] - hit))
        near = int((gap <= NEAR).sum())
    m = max(1, n)
    return [
        len(hit), len(hit) / m, float(weight.sum()), float(weight.max()) if n else 0.0, len({words[i] for i in hit}), int((code >> 3 & 1).sum()), len(second) / m, near,
        int(c[UPPER]) / alpha, int((code >> 1 & 1).sum()) / m, text.count(b"!") / m, int(c[PUNCT] + c[STOP]) / chars, int(c[SYMBOL]) / chars, int(c[DIGIT]) / chars, int((code >> 2 & 1).sum()) / m, int(c[WIDE]) / chars, chars / m, float(np.log1p(n)),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth for the log odds: splits as (feature, threshold) by level order, leaves by path."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaves[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Trees:
    """Newton steps on the logistic loss over quantile bins; ties between splits go to the first feature and bin."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            own = node - first
            best = np.full(n, 1e-9)
            for j, e in enumerate(edges):
                width = len(e) + 1
                key = own * width + binned[j]
                sums = [np.bincount(key, v, n * width).reshape(n, width).cumsum(1) for v in (g, h, np.ones(len(y)))]
                left = [s[:, :-1] for s in sums]
                total = [s[:, -1:] for s in sums]
                if not left[0].size:
                    continue
                gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                gain[(left[2] < least) | (total[2] - left[2] < least)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(n), at] > best
                best[better] = gain[np.arange(n), at][better]
                feature[first:][:n][better] = j
                threshold[first:][:n][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        leaves = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        raw += leaves[leaf]
        model.trees.append((feature, threshold, leaves))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw, share of 1) of the best non-decreasing fit, by pooling adjacent violators; equal raws are one."""
    values, at = np.unique(raw, return_inverse=True)
    sums, counts = np.bincount(at, y), np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for v, s, n in zip(values, sums, counts):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, hi = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    x = [v for b in blocks for v in (b[2], b[3])]
    p = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(x), np.array(p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.knots) if len(x) else np.zeros(0)


def train(own: list[bytes], toxic: np.ndarray, folds: int = 5) -> Model | None:
    """From texts and labels in an order that has nothing to do with them; None without labels of both kinds."""
    toxic = np.asarray(toxic, float)
    if not len(own) or toxic.min() == toxic.max():
        return None
    half = np.arange(len(own)) % 2
    x = np.zeros((len(own), len(FEATURES)))
    for k in (0, 1):
        other = half != k
        codes = _Codes(learn_lexicon([t for t, o in zip(own, other) if o], toxic[other]))
        for i in np.flatnonzero(half == k):
            x[i] = featured(own[i], codes)
    fold = np.arange(len(own)) // 2 % folds
    raw = np.zeros(len(own))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = boost(x[fold != k], toxic[fold != k]).raw(x[fold == k])
    return Model(learn_lexicon(own, toxic), boost(x, toxic), isotonic(raw, toxic))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_chars: int = 20_000, skip: tuple[int, int] | None = (3, 1)) -> Model | None:
    """From a bounded sample of the labelled rows: the most_rows ids of the lowest hash, texts of up to most_chars characters.

    An id with several labels counts as toxic if one of them says so; of its texts the one of the least hash is taken. Null ids, labels and
    texts are left out, and so are ids with the remainder skip[1] by skip[0].
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if skip:
        rows = rows.where(remainder(F.col("doc_id"), skip[0]) != skip[1])
    chosen = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    labeled = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    first = labeled.groupBy("doc_id", "toxic").agg(F.min_by("text", "h").alias("text"))
    found = first.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toArrow()
    return train(texts(found.column("text")), np.asarray(found.column("toxic").to_pylist(), float) > 0)


def score(docs: DataFrame, model: Model | None, held: tuple[int, int] = (3, 1), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Null text is scored like empty. Null id: not held out. Without a model (no labels of both kinds) scores are 0. Equal
    texts get equal scores; other columns are not looked at; no rows, no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        m = shared.value
        codes = _Codes(m.lexicon) if m else None
        for batch in sliced(batches):
            own = texts(batch.column("text"))
            s = m.score(np.array([featured(t, codes) for t in own])) if m else np.zeros(len(own))
            ids = batch.column("doc_id").to_pylist()
            held_out = [d is not None and zlib.crc32(str(d).encode()) % held[0] == held[1] for d in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array(held_out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    plain_docs = docs.select("doc_id", "text")
    return plain_docs.mapInArrow(run, f"doc_id {plain_docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
