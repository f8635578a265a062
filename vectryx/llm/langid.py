"""Language identification by partial matching: the language whose frozen byte model gives a text the fewest bits.

Each language has a tree of contexts of up to three bytes with the counts of what followed. A byte seen after its
longest known context costs -log2(n / (N + q)) (N bytes followed, q of them different); one not seen costs the escape,
-log2(q / (N + q)), and then what it costs after the context shorter by a byte, down to a uniform code. As the counts are
frozen, what every byte costs after every context is worked out once, for all languages side by side; scoring is then
two table look-ups a byte.

The models are fitted on the driver on a bounded sample; their size is bounded by its, and they are sent to the
workers. Scoring is a map without shuffle in batches of bounded text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, if_small, sliced

ORDER = 3
#: Letters and, as \w takes them too, signs like a superscript two, which str.isalpha() tells apart.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class Models:
    """costs[row * symbols + symbol] has the bits in each language; row_of[context] the row of its longest known suffix."""

    def __init__(self, samples: dict[str, list[bytes]], least_context: int = 2, most_bytes: int = 256 << 20):
        """least_context: how often a context must be in the samples; doubled for each length of which the table would pass most_bytes."""
        self.langs = sorted(samples)
        if not self.langs:
            self.symbols, self.symbol, self.row_of, self.costs = 1, np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32)
            return
        seen = np.zeros(256, bool)
        for own in samples.values():
            for t in own:
                seen[np.frombuffer(t, np.uint8)] = True
        self.symbol = np.zeros(256, np.uint8 if seen.sum() < 256 else np.uint16)
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.symbols = int(seen.sum()) + 1
        n_langs = len(self.langs)
        streams = [np.concatenate([np.concatenate([np.zeros(ORDER, np.int64), self.symbol[np.frombuffer(t, np.uint8)].astype(np.int64)]) for t in samples[lang]] or [np.zeros(ORDER, np.int64)]) for lang in self.langs]
        rows = [np.full((1, a, n_langs), np.log2(a), np.float32)]  # the uniform code
        count, last = 1, np.zeros(1, np.int64)
        for k in range(ORDER + 1):
            grams = []
            for s in streams:
                g = np.zeros(max(0, len(s) - ORDER), np.int64)
                for i in range(k, -1, -1):  # the byte itself last
                    g = g * a + s[ORDER - i : len(s) - i]
                g = g[s[ORDER:] > 0] if len(g) else g  # what pads a text is no symbol
                grams.append(np.unique(g, return_counts=True))
            contexts, per = np.unique(np.concatenate([g // a for g, _ in grams]), return_inverse=True)
            total = np.bincount(per, np.concatenate([n for _, n in grams]), len(contexts)) if len(contexts) else np.zeros(0)
            least, width = least_context, 4 * a * n_langs
            while k and len(total) and least <= total.max() and (count + np.count_nonzero(total >= least)) * width > most_bytes:
                least *= 2
            contexts = contexts[total >= least] if k else contexts
            if not len(contexts):
                contexts = np.zeros(1, np.int64) if not k else contexts
            parent = last[contexts % (a ** (k - 1)) if k > 1 else np.zeros(len(contexts), np.int64)] if k else np.zeros(len(contexts), np.int64)
            table = np.concatenate(rows)[parent]
            for j, (g, n) in enumerate(grams):
                at = np.searchsorted(contexts, g // a)
                known = at < len(contexts)
                known[known] &= contexts[at[known]] == (g // a)[known]
                at, sym, n = at[known], (g % a)[known], n[known].astype(float)
                followed, different = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                there = followed > 0
                table[there, :, j] += -np.log2(different[there] / (followed + different)[there]).astype(np.float32)[:, None]
                table[at, sym, j] = -np.log2(n / (followed + different)[at])
            row = np.zeros(a**k, np.int64)
            if k:
                row[:] = np.tile(last, a) if k > 1 else last[0]
            row[contexts] = count + np.arange(len(contexts))
            rows.append(table)
            count, last = count + len(contexts), row
        self.row_of = last.astype(np.int32)
        self.costs = np.concatenate(rows).reshape(-1, n_langs)

    def bits(self, own: list[bytes]) -> np.ndarray:
        """Code lengths, text by language."""
        if not own or not self.langs:
            return np.zeros((len(own), len(self.langs)))
        s = self.symbol[np.frombuffer(b"".join(own), np.uint8)].astype(np.int32)
        lengths = np.array([len(t) for t in own])
        starts = np.cumsum(lengths) - lengths
        a = self.symbols
        context = np.zeros(len(s), np.int32)
        for k in range(ORDER, 0, -1):
            before = np.zeros(len(s), np.int32)
            before[k:] = s[:-k] if k < len(s) else s[:0]
            for i in range(k):  # nothing comes before a text
                at = starts + i
                before[at[i < lengths]] = 0
            context = context * a + before
        costs = self.costs[self.row_of[context] * a + s]
        out = np.zeros((len(own), len(self.langs)))
        full = lengths > 0
        if full.any():
            out[full] = np.add.reduceat(costs, starts[full], axis=0, dtype=np.float64)
        return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _remainder(doc_id: object, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def fit(docs: DataFrame, per_language: int = 300, most_chars: int = 20_000, total_chars: int = 30_000_000, skip: tuple[int, int] | None = (4, 2)) -> Models:
    """Models from a bounded sample of the labelled rows of docs (doc_id, text, lang), of every language that has one.

    Of each language the per_language rows of the lowest hash among those of up to most_chars characters, as far as its
    equal share of total_chars goes (the first text is cut to it): so many characters at most reach the driver. Only rows
    below a hash that some 4 * per_language rows of their language are below take part in the ranking, so it sees as many
    rows for any input. Rows whose id has the remainder skip[1] by skip[0] are held out.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text").between(1, most_chars)))
    if skip:
        rows = rows.where(remainder(F.col("doc_id"), skip[0]) != skip[1])
    counted = checkpointed(rows.groupBy("lang").count())
    share = max(1, total_chars // max(1, counted.count()))
    part = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count"))
    # of the hashes, which are signed: all up to this one
    langs = if_small(counted.select(F.col("lang").alias("own"), (F.lit(-(2.0**63)) + part * F.lit(2.0**64)).alias("below")))
    h = F.xxhash64("doc_id", "text")
    few = rows.select("lang", "text", h.alias("h")).join(langs, F.col("lang") == F.col("own")).where(F.col("h").cast("double") <= F.col("below"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    ranked = few.select("lang", "h", F.left("text", F.lit(share)).alias("text")).withColumns({"rank": F.row_number().over(order), "upto": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    chosen = ranked.where((F.col("rank") <= per_language) & (F.col("upto") <= share))
    found = chosen.orderBy("lang", "h", "text").select("lang", "text").toArrow()
    samples: dict[str, list[bytes]] = {}
    for lang, text in zip(found.column("lang").to_pylist(), found.column("text").to_pylist()):
        samples.setdefault(lang, []).append(text.lower().encode())
    return Models(samples)


def predict(docs: DataFrame, models: Models, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text).

    score: the share of the best language when 2**-bits are summed over the languages. Null text, one without a letter, or
    no language to choose from: `und`, score 0. Null id: not held out. Ties go to the first language by code point.
    Equal texts, equal values; other columns are not looked at; no rows, no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, most_bytes=1 << 20):
            own = batch.column("text").to_pylist()
            bits = m.bits([(t or "").lower().encode() for t in own])
            pred, score = [], []
            for t, b in zip(own, bits):
                if not t or not len(b) or not has_letter(t):
                    pred.append("und"), score.append(0.0)
                    continue
                best = int(b.argmin())
                pred.append(m.langs[best]), score.append(float(1 / np.exp2(np.clip(b[best] - b, -1000, 0)).sum()))
            held_out = [_remainder(d, held[0]) == held[1] for d in batch.column("doc_id").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(held_out, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
