"""Substring dedup: passages of a document that occur, perhaps with changes, in a document before it.

Candidates: of every document the minimizers of its five-word hashes (the least of each `window` in a row, so that any
run of window + 4 equal words shares one). A minimizer's documents are all held against the first of them alone, so
there is one candidate for each document and minimizer at most, however many documents share it; a pair needs two, or
one twice. Beside them there are seeds of `least_fragment` words, thinned so that each least_words equal words have one;
of these one is enough.

Alignment: a pair's equal k-mers are joined to runs, the runs chained in order with a cost for gaps through a Fenwick
tree of prefix maxima, and the gaps of a chain aligned word by word. What stays at the threshold's identity is a
fragment; a document's fragments, from whichever documents, are merged, and `least_words` of them make a passage.

The first holder of a seed may have a part of a passage only, while a later one has all of it. So the equal run around
each long seed is followed in both documents to where they part. Documents that part from the same first holder at the
same place may agree beyond it: where one of them isn't covered there by its fragments, the words next to that place,
least_fragment in a row, of all of them are looked up among each other. Long seeds leave no more than that between
them, so an equal run of least_words is covered whole, whoever else has pieces of it.

Scale: hashes are counted before the shuffle, joins on a frequent one are split by AQE, and the alignment streams rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, claim_memory, if_small, keyed, mixed, shingle_hashes, sliced, stored, texts, word_hashes


@dataclass(frozen=True)
class Rules:
    """k words a seed, so many seeds a window; shares of equal words; lengths in words. gap_cost: of a word in a gap."""

    k: int = 5
    window: int = 12
    identity: float = 0.8
    least_fragment: int = 20
    least_words: int = 50
    gap_cost: float = 0.25
    join_gap: int = 5

    @property
    def long_window(self) -> int:
        """So many seeds of least_fragment words are in least_words."""
        return max(1, self.least_words - self.least_fragment + 1)


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """The distinct least values of all windows; of fewer hashes, the least of all."""
    if len(h) <= window:
        return h.min(keepdims=True) if len(h) else h
    span, least = 1, h
    while span * 2 <= window:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    return np.unique(least[np.r_[True, least[1:] != least[:-1]]])


def again(least: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Those of the sorted distinct hashes that are in h twice or more."""
    at = np.minimum(np.searchsorted(least, h), len(least) - 1)
    return least[np.bincount(at[least[at] == h], minlength=len(least)) > 1]


def _nth(h: np.ndarray) -> np.ndarray:
    """How many equal hashes come before each of the sorted ones."""
    at = np.arange(len(h))
    return at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0))


def runs(a: np.ndarray, b: np.ndarray, at: np.ndarray | None = None, order_b: np.ndarray | None = None) -> np.ndarray:
    """Rows (start in a, start in b, seeds): maximal runs of equal hashes on one diagonal. at: the places of a's hashes, if not all.

    The n-th occurrence of a hash in a is matched with the n-th in b, so repetitive texts give no more matches than words.
    With at, those that a has more of go through b's again. order_b sorts b, if it is known.
    """
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable") if order_b is None else order_b
    sa, sb = a[oa], b[ob]
    lo, hi = np.searchsorted(sb, sa, "left"), np.searchsorted(sb, sa, "right")
    nth = _nth(sa)
    there = nth < hi - lo if at is None else hi > lo
    nth = nth[there] if at is None else nth[there] % (hi - lo)[there]
    pa_, pb = oa[there], ob[lo[there] + nth]
    if at is not None:
        pa_ = at[pa_]
    order = np.argsort(pa_, kind="stable")
    pa_, pb = pa_[order], pb[order]
    if not len(pa_):
        return np.empty((0, 3), np.int64)
    start = np.flatnonzero(np.r_[True, (np.diff(pa_) != 1) | (np.diff(pb) != 1)])
    return np.column_stack([pa_[start], pb[start], np.diff(np.r_[start, len(pa_)])])


class Fenwick:
    """Prefix maxima of (value, item) over places 0..n-1."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at <= self.n:
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """The best of places before at."""
        found = (-1e18, -1)
        while at > 0:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def chains(found: np.ndarray, rules: Rules) -> list[list[tuple[int, int, int]]]:
    """Chains of (start in a, start in b, words), each run in one at most, best first.

    score(j) = words(j) + max(0, max over i that end before j starts, in both, of score(i) - gap_cost * gaps(i, j)); the
    gaps are linear in the ends of i and the starts of j, so the maximum is one over a prefix of the ends in b.
    """
    rows = [(int(a), int(b), int(n) + rules.k - 1) for a, b, n in found]
    if len(rows) == 1:
        return [rows]
    ends = sorted({b + n for _, b, n in rows})
    place = {e: i for i, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    waiting = sorted(range(len(rows)), key=lambda i: rows[i][0] + rows[i][2])
    score, before, w = [0.0] * len(rows), [-1] * len(rows), 0
    starts = np.searchsorted(ends, [b for _, b, _ in rows], "right").tolist()
    for j in sorted(range(len(rows)), key=lambda i: rows[i][:2]):
        a, b, n = rows[j]
        while w < len(waiting) and rows[i := waiting[w]][0] + rows[i][2] <= a:
            end_a, end_b = rows[i][0] + rows[i][2], rows[i][1] + rows[i][2]
            tree.put(place[end_b], score[i] + rules.gap_cost * (end_a + end_b), i)
            w += 1
        best, i = tree.upto(starts[j])
        best -= rules.gap_cost * (a + b)
        score[j], before[j] = (n + best, i) if best > 0 else (n, -1)
    used, out = [False] * len(rows), []
    for j in sorted(range(len(rows)), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(rows[j])
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two gaps: a row of the table is the bits of a number, 0 where it rises."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a.tolist():
        if met := row & places.get(x, 0):
            row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


def align(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, rules: Rules) -> list[tuple[int, int, int, int, int]]:
    """Fragments (start in a, words, start in b, words, equal words) of a chain that reach the identity.

    Where a chain as a whole doesn't, it is cut at its widest gap.
    """
    gaps = []
    for (x, y, n), (x2, y2, _) in zip(chain, chain[1:]):
        ga, gb = x2 - x - n, y2 - y - n
        gaps.append((max(ga, gb), common_words(a[x + n : x2], b[y + n : y2]) if ga and gb else 0))
    out, todo = [], [(0, len(chain))]
    while todo:
        i, j = todo.pop()
        x, y = chain[i][:2]
        na, nb = chain[j - 1][0] + chain[j - 1][2] - x, chain[j - 1][1] + chain[j - 1][2] - y
        equal = sum(c[2] for c in chain[i:j]) + sum(g[1] for g in gaps[i : j - 1])
        if equal >= rules.identity * max(na, nb):
            if na >= rules.least_fragment:
                out.append((x, na, y, nb, equal))
        elif j - i > 1:
            cut = max(range(i, j - 1), key=lambda g: gaps[g][0]) + 1
            todo += [(i, cut), (cut, j)]
    return out


def long_hashes(h: np.ndarray, rules: Rules) -> np.ndarray:
    """Of all least_fragment words in a row, from the hashes of k words."""
    last = rules.least_fragment - rules.k
    count, total = max(0, len(h) - last), np.uint64(1)
    for i in [*range(0, last, rules.k), last]:
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + count]
    return mixed(total) if count else h[:0]


class Words:
    """The word hashes of a text with its seeds, each worked out when it is asked for."""

    def __init__(self, words: np.ndarray, rules: Rules):
        self.words, self.rules = words, rules

    @cached_property
    def seeds(self) -> np.ndarray:
        return shingle_hashes(self.words, self.rules.k)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.seeds, kind="stable")

    @cached_property
    def long(self) -> np.ndarray:
        return long_hashes(self.seeds, self.rules)

    @cached_property
    def long_order(self) -> np.ndarray:
        return np.argsort(self.long, kind="stable")

    def first(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the long hashes h are here, and the first places of those."""
        own = self.long[self.long_order]
        if not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        there = np.flatnonzero(own[at] == h)
        return there, self.long_order[at[there]]


def equal_spans(a: Words, b: Words) -> list[tuple[int, int, int, int, int]]:
    """What of a is in equal runs of least_fragment words or more, wherever and however often they are in a and b."""
    found, there = b.first(a.long)
    if not len(found):
        return []
    least = a.rules.least_fragment
    new = np.flatnonzero(np.r_[True, np.diff(found) > least])
    ends = np.r_[found[new[1:] - 1], found[-1]] + least
    return [(int(x), int(y - x), int(z), int(y - x), int(y - x)) for x, y, z in zip(found[new], ends, there[new])]


def fragments(a: np.ndarray | Words, b: np.ndarray | Words, rules: Rules) -> list[tuple[int, int, int, int, int]]:
    """All fragments of the word hashes a that are in b.

    Where a holds something more often than b, what was left over meets b again, until no seed is left or nothing new comes.
    Equal runs are found whatever the seeds in them were matched with.
    """
    own, other = (x if isinstance(x, Words) else Words(x, rules) for x in (a, b))
    a, b, sa, sb = own.words, other.words, own.seeds, other.seeds
    if len(a) == len(b) and np.array_equal(a, b):
        return [(0, len(a), 0, len(b), len(a))] if len(a) >= rules.least_fragment else []
    found = runs(sa, sb, order_b=other.order)
    if not len(found):
        return []
    out, covered, left = [], np.zeros(len(a), bool), None
    while len(found):
        new = [f for c in chains(found, rules) for f in align(c, a, b, rules)]
        new = [f for f in new if not covered[f[0] : f[0] + f[1]].all()]
        for x, n, *_ in new:
            covered[x : x + n] = True
        if out and not new:
            break
        out += new
        if left is None:
            ordered = sb[other.order]
            left = ordered[np.minimum(np.searchsorted(ordered, sa), len(sb) - 1)] == sa
        for x, _, n in found.tolist():
            left[x : x + n] = False
        at = np.flatnonzero(left)
        at = at[~covered[at] | ~covered[at + rules.k - 1]]
        found = runs(sa[at], sb, at, other.order) if len(at) else []
    for f in equal_spans(own, other):
        if not covered[f[0] : f[0] + f[1]].all():
            out.append(f)
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the start are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        to = min(n, at + step)
        if len(differ := np.flatnonzero(a[at:to] != b[at:to])):
            return at + int(differ[0])
        at, step = to, step * 2
    return n


RIGHT, LEFT = 1, 2


def run_ends(a: np.ndarray | Words, b: np.ndarray | Words, rules: Rules) -> list[tuple[int, int, int, int]]:
    """(side, place in a, how far a passage may go on from there, place in b): the ends of the equal runs around a's long seeds.

    Of a seed that b has more than once, the first counts. An end that is a's own isn't one.
    """
    own, other = (x if isinstance(x, Words) else Words(x, rules) for x in (a, b))
    a, b = own.words, other.words
    if not len(own.long):
        return []
    least = minimizers(own.long, rules.long_window)
    shared = least[other.first(least)[0]]
    if not len(shared):
        return []
    at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, own.long), len(shared) - 1)] == own.long)
    out, reach = [], {}
    for x, y in zip(at.tolist(), other.first(own.long[at])[1].tolist()):
        if x < reach.get(x - y, 0):
            continue
        left, right = _agreeing(a[:x][::-1], b[:y][::-1]), _agreeing(a[x:], b[y:])
        start, end = x - left, x + right
        reach[x - y] = end
        if end < len(a):
            out.append((RIGHT, end, min(len(a), end + rules.long_window - 1), y + right))
        if start:
            out.append((LEFT, start, max(0, start - rules.long_window + 1), y - left))
    return out


def seeds(docs: DataFrame, rules: Rules) -> DataFrame:
    """(h, d): the minimizers of each document; odd ones are long seeds. One that a document has twice comes as another hash beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in sliced(batches):
            ids, hashes = [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                own = Words(word_hashes(t.split()), rules)
                h = minimizers(own.seeds, rules.window)
                if len(h):
                    h = np.concatenate([h, mixed(again(h, own.seeds))]) & ~np.uint64(1)
                h = np.concatenate([h, minimizers(own.long, rules.long_window) | np.uint64(1)])
                ids.append(np.full(len(h), d, np.int64))
                hashes.append(h.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes))], names=["d", "h"])

    return docs.mapInArrow(run, "d long, h long")


def candidates(own: DataFrame) -> DataFrame:
    """(d, r, long) of seeds() once: documents with two minimizers whose first document is r, r < d, or with one long seed that r has first.

    A minimizer counts twice if both have it twice: a passage of one short line again and again has no second one.
    """
    first = own.groupBy("h").agg(F.min("d").alias("r"), F.max("d").alias("top")).where(F.col("r") < F.col("top")).select("h", "r")
    met = own.join(first, "h").where(F.col("d") != F.col("r")).groupBy("d", "r").agg(F.count("*").alias("n"), F.max(F.col("h").bitwiseAND(1)).alias("long"))
    return met.where((F.col("n") > 1) | (F.col("long") > 0)).select("d", "r", (F.col("long") > 0).alias("long"))


ALIGNED = ("d", "r", "text_hash", "kind", "start", "words", "at")


def aligned(pairs: DataFrame, own: DataFrame, rules: Rules) -> DataFrame:
    """Fragments (kind 0: start, words) of d in r, and ends of equal runs (kind RIGHT or LEFT: start, how far in words, place in r in at)."""
    left = pairs.hint("shuffle_hash").join(own.select(F.col("doc_id").alias("d"), F.col("text").alias("td")), "d")
    joined = left.join(own.select(F.col("doc_id").alias("r"), F.col("text").alias("tr")), "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        last: tuple[int | None, bytes, Words | None] = (None, b"", None)
        for batch in sliced(sliced(batches, "td"), "tr"):
            rows = []
            for d, r, long, h, td, tr in zip(*(batch.column(c).to_pylist() for c in ("d", "r", "long", "text_hash")), texts(batch.column("td")), texts(batch.column("tr"))):
                if last[0] != r or last[1] != tr:  # rows of one r come together
                    last = (r, tr, Words(word_hashes(tr.split()), rules))
                own_words = Words(word_hashes(td.split()), rules)
                rows += [(d, r, h, 0, f[0], f[1], None) for f in fragments(own_words, last[2], rules)]
                if long and td != tr:
                    rows += [(d, r, h, *e) for e in run_ends(own_words, last[2], rules)]
            columns = list(zip(*rows)) or [[]] * len(ALIGNED)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=ALIGNED)

    return joined.select("d", "r", "long", F.xxhash64("td").alias("text_hash"), "td", "tr").mapInArrow(run, ", ".join(f"{c} long" for c in ALIGNED))


def open_ends(found: DataFrame) -> DataFrame:
    """(d, text_hash, kind, start) of aligned() ends at places where documents part from another together, one of them uncovered there.

    A window holds what was found of one document, no more than its words.
    """
    own = Window.partitionBy("d", "text_hash")
    by = own.orderBy("start", "kind", "to", "r")
    spans = found.withColumn("to", F.when(F.col("kind") == 0, F.col("start") + F.col("words")).otherwise(F.col("start")))
    reach = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("reach", reach).withColumn("island", F.sum((F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).cast("int")).over(by))
    whole = Window.partitionBy("d", "text_hash", "island")
    ends = islands.withColumns({"last": F.max("to").over(whole), "first": F.min("start").over(whole)}).where(F.col("kind") > 0)
    bare = F.when(F.col("kind") == RIGHT, F.col("last") < F.col("words")).otherwise(F.col("first") > F.col("words"))
    ends = checkpointed(ends.select("d", "text_hash", "kind", "start", "r", "at", bare.alias("bare")))
    places = ends.groupBy("r", "at", "kind").agg(F.min("d").alias("lo"), F.max(F.when(F.col("bare"), F.col("d"))).alias("hi")).where(F.col("lo") < F.col("hi"))
    return ends.join(places.select("r", "at", "kind"), ["r", "at", "kind"]).select("d", "text_hash", "kind", "start")


def beside(ends: DataFrame, own: DataFrame, rules: Rules) -> DataFrame:
    """Fragments, as aligned() has them, of least_fragment words that go over the open ends and that a document before has over one of its own."""
    reach = rules.long_window - 1
    low = F.when(F.col("kind") == RIGHT, F.col("start") - rules.least_fragment + 1).otherwise(F.col("start") - reach)
    wanted = ends.groupBy("d", "text_hash").agg(F.collect_set(low).alias("low"))
    keyed_texts = own.select(F.col("doc_id").alias("x"), F.xxhash64("text").alias("xh"), "text")
    joined = keyed_texts.join(if_small(checkpointed(wanted)), (F.col("x") == F.col("d")) & (F.col("xh") == F.col("text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in sliced(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for d, th, low, t in zip(batch.column("d").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("low"), texts(batch.column("text"))):
                every = long_hashes(shingle_hashes(word_hashes(t.split()), rules.k), rules)
                at = np.unique((np.asarray(low.values)[:, None] + np.arange(reach)[None, :]).reshape(-1))
                at = at[(at >= 0) & (at < len(every))]
                for c, x in zip(columns, (every[at].view(np.int64), np.full(len(at), d, np.int64), np.full(len(at), th, np.int64), at.astype(np.int64))):
                    c.append(x)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=["h", "d", "text_hash", "start"])

    grams = checkpointed(joined.select("d", "text_hash", "low", "text").mapInArrow(run, "h long, d long, text_hash long, start long"))
    first = grams.groupBy("h").agg(F.min("d").alias("r"), F.max("d").alias("top")).where(F.col("r") < F.col("top")).select("h", "r")
    met = grams.join(first, "h").where(F.col("d") != F.col("r"))
    # neighbours of one r make one fragment
    by = Window.partitionBy("d", "text_hash", "r").orderBy("start")
    row = met.select("d", "text_hash", "r", "start").distinct().withColumn("run", F.col("start") - F.row_number().over(by))
    spans = row.groupBy("d", "text_hash", "r", "run").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + rules.least_fragment).alias("words"))
    return spans.select("d", "r", "text_hash", F.lit(0).cast("long").alias("kind"), "start", "words", F.lit(None).cast("long").alias("at"))


def passages(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, text_hash, start_word, n_words, source_ids: passages of documents that occur in documents of a lower id.

    source_ids: documents that they were found in, sorted, without those that have nothing beyond what others have. Null or short text: no passage. Rows without id are not looked
    at. Rows of one id are not compared with one another; where an id has several texts, text_hash (xxhash64) tells whose
    passage it is, and equal rows count once. Other columns are not looked at; no rows, no rows.
    """
    plain = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = if_small(checkpointed(plain.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("x"))))
    own = plain.join(repeated, F.col("doc_id") == F.col("x"), "left_anti").union(plain.join(repeated, F.col("doc_id") == F.col("x"), "left_semi").distinct())
    with stored(seeds(plain, rules)) as known:
        pairs = checkpointed(candidates(known))
    found = checkpointed(aligned(pairs, own, rules))
    more = beside(open_ends(found), own, rules)
    return merged(found.where(F.col("kind") == 0).unionByName(more), rules)


def merged(found: DataFrame, rules: Rules) -> DataFrame:
    """Fragments of a document to passages. A window holds one document's fragments, no more than its words."""
    by = Window.partitionBy("d", "text_hash").orderBy("start", F.desc("words"), "r")
    reach = F.max(F.col("start") + F.col("words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | (F.col("start") > F.col("reach") + rules.join_gap)).cast("int"))
    grouped = parted.withColumn("nth", F.sum("new").over(by)).withColumn("adds", F.greatest(F.col("start") + F.col("words") - F.greatest(F.col("start"), F.coalesce("reach", F.lit(0))), F.lit(0)))
    out = grouped.groupBy("d", "text_hash", "nth").agg(F.min("start").alias("start_word"), F.max(F.col("start") + F.col("words")).alias("end"), F.sum("adds").alias("covered"), F.array_sort(F.collect_set(F.when(F.col("adds") > 0, F.col("r")))).alias("source_ids"))
    out = out.where((F.col("covered") >= rules.least_words) & (F.col("covered") >= rules.identity * (F.col("end") - F.col("start_word"))))
    return out.select(F.col("d").alias("doc_id"), "text_hash", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "source_ids")


_WORDS = re.compile(WORD.encode())


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans (start, words) and the white space inside them."""
    at = [m.span() for m in _WORDS.finditer(text)]
    out, last = [], 0
    for start, n in sorted(spans):
        out.append(text[last : at[start][0]])
        last = at[start + n - 1][1]
    return b"".join([*out, text[last:]])


def cut(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the passages cut out that occur in documents of a lower id; a document left without a word goes.

    All columns stay as they are but text and, where it is there, n_chars. Rows without passages stay untouched, those
    without id, text or words included.
    """
    spans = passages(docs, rules).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "_spans")
    rows = keyed(docs, _id=F.col("doc_id"), _text=F.xxhash64("text"))
    joined = rows.join(spans, (F.col("_id") == F.col("_d")) & (F.col("_text") == F.col("_h")), "left").select("_row", "_spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("_row"))
            spans = batch.column("_spans").to_pylist()
            if not any(spans):
                yield rows
                continue
            new, keep = rows.column("text").to_pylist(), []
            for i, s in enumerate(spans):
                if s:
                    new[i] = without(new[i].encode(), [(x["start_word"], x["n_words"]) for x in s]).decode()
                keep.append(not s or bool(new[i].encode().strip()))
            columns = []
            for name in names:
                c = rows.column(name)
                if name == "text":
                    c = pa.array(new, c.type)
                elif name == "n_chars":
                    c = pa.array([len(t) if s else n for t, s, n in zip(new, spans, c.to_pylist())], c.type)
                columns.append(c)
            yield pa.record_batch(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
