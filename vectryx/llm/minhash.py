"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles' hashes; its sketch is the k least of them. Documents of equal sets are one
class, and only classes are compared. Inverted lists of the retained values give the candidates: a pair of classes at the
threshold shares `least_shared` of k values but for a chance of 1e-6, so it meets in a list of one of its k - least + 1
rarest values, and all others are dropped. Text that many documents merely share sits in the frequent values and makes
no candidates.

Within a list no pairs are enumerated at first: all members are held against one pivot, the most central one. Links that
hold make components; the estimate from the union's sketch drops pairs far below the threshold, and what is left is
decided on the full sets. Members of one list that are in different components after that are gathered in blocks by their
pivot, and a block's full sets are counted against each other at once: no row is made for a pair.

Scale: texts are read once for the sketches and shuffled once, for the exact check; everything else moves sketches or
narrow rows. Counts are aggregated before the shuffle; joins on a hot value are split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, claim_memory, if_small, keyed, mixed, shingle_hashes, sliced, texts, word_hashes
from .components import components

K = 64
#: A block of members holds two tiles of so many rows and values of their sets (but for one set that is larger), which bounds a worker's memory.
BLOCK_ROWS, BLOCK_VALUES = 2048, 2_000_000
#: So many ids of documents in lists are broadcast, some 16 bytes each.
MOST_OWNERS = 2_500_000


def least_shared(k: int, percent: int, miss: float = 1e-6) -> int:
    """The number of k values that a pair at the threshold shares, but for a chance of `miss`."""
    p, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail > miss:
            return max(1, c)
    return k


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes; of fewer words, the one of their whole sequence; none without words."""
    own = word_hashes(text.lower().split())
    if not len(own):
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(own, words)) if len(own) >= words else mixed(shingle_hashes(own, len(own)) + np.uint64(len(own)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, text_hash, n (size of the set), set_hash (of the whole set), sketch (its k least values, as signed longs, ascending unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in sliced(batches):
            n, whole, least = [], [], []
            for t in texts(batch.column("text")):
                s = shingle_set(t, words)
                n.append(len(s))
                whole.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                least.append(s[:k].view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "set_hash", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, set_hash string, sketch array<long>")


def prefix_lists(classes: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(v, id, n, score): each class's rarest values that others have too, as many as it takes to meet all its partners.

    score sums how many classes have each of its values: the most central member of a list has the highest.
    """
    posts = classes.select("id", "n", F.explode("sketch").alias("v"))
    shared = posts.groupBy("v").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    met = posts.join(shared, "v")
    fraction = F.array(*(F.lit(min(least_shared(k, percent) * i // k, i)) for i in range(k + 1)))
    size = F.least(F.col("n"), F.lit(k)).cast("int")
    length = size - F.greatest(F.get(fraction, size), F.lit(1)) + 1
    own = Window.partitionBy("id")
    ranked = met.select("*", F.row_number().over(own.orderBy("df", "v")).alias("rank"), F.count("*").over(own).alias("m"), F.sum("df").over(own).alias("score"))
    return ranked.where(F.col("rank") + size - F.col("m") <= length).select("v", "id", "n", "score")


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) once: each member of a list with the list's most central one."""
    best = lists.groupBy("v").agg(F.max(F.struct("score", (-F.col("id")).alias("least"), "n")).alias("best"), F.count("*").alias("c")).where(F.col("c") > 1)
    joined = lists.join(best.select("v", (-F.col("best.least")).alias("b"), F.col("best.n").alias("nb")), "v")
    return joined.where((F.col("id") != F.col("b")) & _sizes_fit("n", "nb", percent)).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def apart_blocks(lists: DataFrame, labels: DataFrame, rows: int = BLOCK_ROWS, values: int = BLOCK_VALUES) -> DataFrame:
    """(p, i, j, second, id, label): the members of lists that are in different components, in blocks to be held against each other.

    The lists of one pivot p make one group, without p, which all of them have been held against. A group of more than
    `rows` members or `values` values is cut into tiles, and each two tiles i <= j make a block; `second` tells those of j.
    """
    labeled = lists.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    best = labeled.groupBy("v").agg(F.max(F.struct("score", (-F.col("id")).alias("least"))).alias("best"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    best = best.where(F.col("lo") < F.col("hi")).select("v", (-F.col("best.least")).alias("p"))
    members = checkpointed(labeled.join(best, "v").where(F.col("id") != F.col("p")).select("p", "id", "label", "n").distinct())
    tiles = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / values)).cast("int")
    groups = members.groupBy("p").agg(tiles.alias("tiles"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") < F.col("hi"))
    placed = members.join(groups.select("p", "tiles"), "p").withColumn("own", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return placed.select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "label")


def linked_labels(sets: list[np.ndarray], labels: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """The pairs of different labels that sets link, one row each: a set of the second tile with one of the first, or, if all are of one tile, any two.

    Counted are all values of the sets but those that one label alone has, which no intersection asked for can hold; a set
    that is left with less than `percent` of its values links with nothing here. The counts are a product of 0/1 matrices.
    """
    sizes, tags = np.array([len(s) for s in sets], np.int64), np.unique(labels, return_inverse=True)[1]
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    before = 2 * len(row)
    while len(row) and len(row) < 0.9 * before:
        before = len(row)
        first = np.r_[True, flat[1:] != flat[:-1]]
        starts, tag = np.flatnonzero(first), tags[row]
        mixed_values = np.minimum.reduceat(tag, starts) < np.maximum.reduceat(tag, starts)
        keep = mixed_values[np.cumsum(first) - 1]
        keep &= (100 * np.bincount(row[keep], minlength=len(sets)) >= percent * sizes)[row]
        flat, row = flat[keep], row[keep]
    if not len(row):
        return np.empty((0, 2), np.int64)
    alive, row = np.unique(row, return_inverse=True)
    column = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    tags, sizes, labels, second = tags[alive], sizes[alive], labels[alive], second[alive]
    main = tags == np.bincount(tags).argmax()  # its members aren't held against each other
    if second.any() and not second.all():
        sides = [(~second & ~main, second), (~second & main, second & ~main)]
    else:
        sides = [(~main, np.ones(len(alive), bool))]
    sides = [(np.flatnonzero(x), np.flatnonzero(y)) for x, y in sides]
    counts = [np.zeros((len(x), len(y))) for x, y in sides]
    for at in range(0, int(column[-1]) + 1, 1024):
        lo, hi = np.searchsorted(column, (at, at + 1024))
        has = np.zeros((len(alive), 1024), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        for total, (x, y) in zip(counts, sides):
            total += has[x] @ has[y].T
    found = [np.empty((0, 2), np.int64)]
    for total, (x, y) in zip(counts, sides):
        for at in range(0, len(x), 256):
            both, some = total[at : at + 256], x[at : at + 256]
            hit = (both > 0) & ((100 + percent) * both >= percent * (sizes[some, None] + sizes[y])) & (tags[some, None] != tags[y])
            r, c = np.nonzero(hit)
            found.append(np.unique(np.sort(np.stack([labels[some[r]], labels[y[c]]], axis=1), axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def apart_links(blocks: DataFrame, own_texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the labels that full sets within a block link; own_texts (id, text)."""
    rows = blocks.join(own_texts, "id").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        own: tuple | None = None
        sets: list[np.ndarray] = []
        labels: list[int] = []
        second: list[bool] = []

        def ended() -> pa.RecordBatch:
            found = linked_labels(sets, np.array(labels, np.int64), np.array(second, bool), percent)
            for x in (sets, labels, second):
                x.clear()
            return pa.record_batch([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in sliced(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in ("p", "i", "j", "second", "label")))
            for (*key, side, label), t in zip(keys, texts(batch.column("text"))):
                if own != key and sets:
                    yield ended()
                own = key
                sets.append(shingle_set(t, words))
                labels.append(label)
                second.append(side)
        if sets:
            yield ended()

    return rows.select("p", "i", "j", "second", "label", "text").mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, k: int = K, margin: float = 5.5) -> DataFrame:
    """The pairs whose estimate from the union's sketch is not `margin` standard errors below the threshold.

    Sets no larger than k are whole in their sketches; for those the estimate is exact.
    """
    p = percent / 100
    least = p - margin * (p * (1 - p) / k) ** 0.5
    own = classes.select("id", "sketch")
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.asarray(z.values, np.int64).view(np.uint64) for z in (x, y))
                union = np.union1d(x, y)[:k]
                both = np.intersect1d(x, y, assume_unique=True)
                keep.append(len(both) > 0 and np.count_nonzero(both <= union[-1]) >= least * len(union))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, own_texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets link; own_texts (id, text)."""
    joined = pairs.join(own_texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(own_texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("words")
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in sliced(sliced(batches, "ta"), "tb"):
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), texts(batch.column("ta")), texts(batch.column("tb"))):
                if last[0] != a:  # rows of one a come together
                    last = (a, shingle_set(ta, words))
                keep.append(linked(last[1], shingle_set(tb, words), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Linked are documents whose shingle sets A and B have 100 |A and B| >= percent |A or B|; component_id is the least id
    that links reach. Null or wordless text: 0 shingles, linked with nothing. Null id: component null, kept. Where one id
    has several texts, that of the least hash stands for it and all its rows share a component. Equal rows give equal
    rows; other columns are not looked at; no rows, no rows. No lists, links or components are collected.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = checkpointed(sketches(docs, words))
    real = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    several = real.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where(F.col("lo") < F.col("hi"))
    several = if_small(checkpointed(several.select(F.col("doc_id").alias("r"), "lo")))
    one = real.join(several, F.col("doc_id") == F.col("r"), "left").where(F.col("r").isNull() | (F.col("text_hash") == F.col("lo")))
    least = one.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x"))
    classes = checkpointed(least.select(F.col("x.doc_id").alias("id"), F.col("x.n").alias("n"), F.col("x.sketch").alias("sketch"), "set_hash"))
    lists = checkpointed(prefix_lists(classes, percent))
    first = checkpointed(likely(pivot_pairs(lists, percent), classes, percent))
    owners = if_small(checkpointed(lists.select("id").distinct()), MOST_OWNERS)  # else all texts are shuffled to find theirs
    own_texts = docs.where(F.col("text").rlike(WORD)).join(owners, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own_texts = checkpointed(own_texts.withColumnRenamed("doc_id", "id"))
    links = checkpointed(confirmed(first, own_texts, words, percent))
    labels = components(links)
    final = components(links.union(apart_links(apart_blocks(lists, labels), own_texts, words, percent)))
    rows = known.select("doc_id", "n", "set_hash").join(several, F.col("doc_id") == F.col("r"), "left")
    chosen = one.select(F.col("doc_id").alias("one_id"), F.col("set_hash").alias("one_hash")).join(several, F.col("one_id") == F.col("r"), "left_semi").distinct()
    rows = rows.join(if_small(checkpointed(chosen)), F.col("doc_id") == F.col("one_id"), "left").withColumn("set_hash", F.when(F.col("n") > 0, F.coalesce("one_hash", "set_hash")))
    placed = checkpointed(classes.select(F.col("set_hash").alias("h"), "id").join(final, "id", "left").select("h", F.coalesce("component", "id").alias("component")))
    out = rows.join(placed, F.col("set_hash") == F.col("h"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document near_duplicates() keeps, with all their columns; of an id's rows one.

    Which of them: the one whose columns, written as JSON, are least. Rows without id stay.
    """
    found = near_duplicates(docs, words, percent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("g")).distinct()
    again = if_small(checkpointed(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("r"))))
    left = keyed(docs, _id=F.col("doc_id")).join(gone, F.col("_id") == F.col("g"), "left_anti")
    once = left.join(again, F.col("_id") == F.col("r"), "left_anti")
    repeated = left.join(again, F.col("_id") == F.col("r"), "left_semi")
    first = repeated.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy(F.to_json("_row")))).where(F.col("_nth") == 1).drop("_nth")
    return once.unionByName(first).select("_row.*")
