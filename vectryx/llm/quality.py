"""Quality rules: base counts, then the divergence of a document from its language.

A document's histograms of character classes and of its language's common words are compared with those of all
documents of that language by Jensen-Shannon distance (square root of the divergence to base 2, so 0 to 1).

Scale: two narrow passes. References come from counts that are summed in each task before the shuffle, so a hot
language or word is one row a task; what reaches the driver is `common` words and the classes of each language. The
second pass is a map without shuffle. Batches of bounded text keep a worker's memory the same for any text length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, claim_memory, if_small, shingle_hashes, sliced, texts, word_hashes

SPACE, LOWER, UPPER, DIGIT, STOP, PUNCT, SYMBOL, WIDE, CONT, CONTROL = range(10)
#: Classes that take part in the distance; white space and the inner bytes of a character don't.
CLASSES = (LOWER, UPPER, DIGIT, STOP, PUNCT, SYMBOL, WIDE, CONTROL)


def _class_table() -> np.ndarray:
    t = np.full(256, CONTROL, np.uint8)
    for chars, kind in ((b" \t\n\x0b\x0c\r", SPACE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT), (b".,;:", STOP), (b"!\"'()+-/=?@[\\]^_`{}~", PUNCT), (b"#*$%&|<>", SYMBOL)):
        t[list(chars)] = kind
    t[0x80:0xC0], t[0xC0:] = CONT, WIDE
    return t


TOTAL = b" words"
_TABLE = _class_table()
#: For common words: lower case, and everything in ASCII but letters and digits parts words.
_FOLD = bytes(c if 97 <= c < 123 or 48 <= c < 58 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the base; the distances apply from the guards on."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common: int = 100
    class_distance: float = 0.33
    word_distance: float = 0.38
    guard_chars: int = 200
    guard_words: int = 150
    reference_words: int = 2000


@dataclass
class References:
    """Of each language: shares of the character classes, its common words, their shares and, last, that of all others."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, list[bytes]] = field(default_factory=dict)
    shares: dict[str, np.ndarray] = field(default_factory=dict)


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=10)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(), np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def counts(text: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the class counts."""
    words, by_class = text.split(), class_counts(text)
    word_chars = len(text) - int(by_class[SPACE]) - int(by_class[CONT])
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > 3:
        h = shingle_hashes(word_hashes(words), 3)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            twice = np.zeros(len(words), bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for i in range(3):
                twice[at + i] = True
            repeat = int(twice.sum())
    return len(words), word_chars, int(by_class[SYMBOL]), len(lines) - len(set(lines)), repeat, by_class


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def flush(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in words.items():
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)
        words.clear()

    claim_memory("words")
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}
    totals: Counter = Counter()
    for batch in sliced(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            own = text.translate(_FOLD).split()
            words.setdefault(lang, Counter()).update(own)
            totals[lang] += len(own)
            classes[lang] = classes.get(lang, 0) + class_counts(text)
        if sum(map(len, words.values())) > 400_000:
            yield from flush(words)
    yield from flush(words)
    for lang, c in classes.items():  # classes and the total are told from words by the blank in front
        yield from flush({lang: Counter({b" %d" % k: int(c[k]) for k in CLASSES} | {TOTAL: totals[lang]})})


def references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """From all rows with a language; one of fewer than reference_words words has none, every other one has its own.

    Of each the common words and classes are collected, and sent to the workers. Ties among words go to the smaller bytes.
    """
    found = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count_languages, "lang string, word binary, n long")
    summed = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    top = summed.withColumn("kind", F.col("word") < F.lit(b"!")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max(rules.common, len(CLASSES) + 1))
    top = checkpointed(top.select("lang", "word", "n"))
    langs = top.where((F.col("word") == F.lit(TOTAL)) & (F.col("n") >= rules.reference_words)).select("lang")
    by: dict[str, list] = {}
    for r in top.join(if_small(langs), "lang").select("lang", "word", "n").collect():
        by.setdefault(r.lang, []).append((bytes(r.word), r.n))
    out = References()
    for lang, pairs in by.items():
        total = dict(pairs)[TOTAL]
        c = {int(w): n for w, n in pairs if w[:1] == b" " and w != TOTAL}
        share = np.array([c.get(k, 0) for k in CLASSES], float)
        words = sorted(((w, n) for w, n in pairs if w[:1] != b" "), key=lambda x: (-x[1], x[0]))[: rules.common]
        out.classes[lang] = share / share.sum()
        out.words[lang] = [w for w, _ in words]
        out.shares[lang] = np.array([*(n for _, n in words), total - sum(n for _, n in words)], float) / total
    return out


def distances(text: bytes, by_class: np.ndarray, lang: str | None, refs: References, rules: Rules) -> tuple[float, float]:
    """Class and word distance from the language's reference, or from the nearest if there is none for it; 0 under the guards."""
    langs = [lang] if lang in refs.classes else list(refs.classes)
    if not langs:
        return 0.0, 0.0
    c = by_class[list(CLASSES)].astype(float)
    of_class = min(distance(c / c.sum(), refs.classes[x]) for x in langs) if c.sum() >= rules.guard_chars else 0.0
    words = text.translate(_FOLD).split()
    of_words = 0.0
    if len(words) >= rules.guard_words:
        n = Counter(words)
        each = []
        for x in langs:
            h = np.array([n[w] for w in refs.words[x]] + [0], float)
            h[-1] = len(words) - h.sum()
            each.append(distance(h / len(words), refs.shares[x]))
        of_words = min(each)
    return of_class, of_words


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _judged(batch: pa.RecordBatch, refs: References, rules: Rules) -> list[tuple]:
    rows = []
    for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
        n, chars, symbols, lines, repeat, by_class = counts(text)
        failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
        a, b = distances(text, by_class, lang, refs, rules)
        rows.append((n, chars, symbols, lines, repeat, failed, not failed and a <= rules.class_distance and b <= rules.word_distance, a, b))
    return rows


def judge(docs: DataFrame, refs: References | None = None, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, base_failed, kept and both distances for each row of docs (doc_id, text, lang).

    Null or empty text: counts of 0, base_failed. Null language, or one too rare for a reference: the nearest
    reference. Equal rows give equal rows; columns besides the three are not looked at; no rows give no rows.
    """
    refs = refs or references(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in sliced(batches):
            columns = list(zip(*_judged(batch, refs, rules)))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *(x.split()[0] for x in OUT.split(", "))])

    plain = docs.select("doc_id", "text", "lang")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {OUT}")


def keep(docs: DataFrame, refs: References | None = None, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns whatever those are called.

    Where a row's language is too rare for a reference, the base rules alone decide: another language's words say nothing
    about it. (judge() gives the distance from the nearest then, as its SQL does.)
    """
    refs = refs or references(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in sliced(batches):
            rare = [lang is not None and lang not in refs.classes for lang in batch.column("lang").to_pylist()]
            yield batch.filter(pa.array([not r[5] if x else r[6] for r, x in zip(_judged(batch, refs, rules), rare)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
