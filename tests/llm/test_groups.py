"""Operators that compare or weigh documents: mixing, near duplicates, passages, components; and chats."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from sqlcheck import SMALL, compare
from hypothesis import given, settings
from hypothesis import strategies as st

from vectryx.llm import chat, common, minhash, mixing, substring
from vectryx.llm.components import components


def words(n, start=0):
    return " ".join(f"w{start + i}x" for i in range(n))


# mixing


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_quality_rules", "op7_near_duplicates", "op10_chat"])
def test_equals_sql(spark, name):
    ours, theirs = compare(spark, name)
    assert ours == theirs


def clamped(sizes, weights, share, most):
    """By rounds: give by weight, clamp what is above, and share again."""
    total, targets, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(most * sizes[i] for i in over)
        free -= over
    return targets


def test_water_filling_by_rounds(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 100, 1000, 7]) for _ in range(9)]
        weights = [rng.choice([1, 2, 3, 10]) for _ in range(9)]
        rows = spark.createDataFrame([(f"s{i}", s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
        found = {r.source: r.target for r in mixing.water_fill(rows, 1.5, 2.0).collect()}
        want = clamped(sizes, weights, 1.5, 2.0)
        assert [found[f"s{i}"] for i in range(9)] == pytest.approx(want)


def test_mix_meets_targets_and_repeats(spark, messy, make):
    docs = make([(i, words(1 + i * 7 % 50), "en", None if i % 11 == 0 else f"s{i % 5}") for i in range(1500)])
    a, b = mixing.mix(docs), mixing.mix(docs.repartition(7))
    rows = a.collect()
    assert Counter(rows) == Counter(b.collect())
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        assert r.taken == r["size"] * r.repeats and r.taken <= 2 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert len(by) == 6 and all(abs(t - want) <= 26 for t, want in by.values())
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.repeats if r["size"] else 0
    out = mixing.repeated(docs)
    assert out.schema == docs.schema and Counter(r.doc_id for r in out.collect()) == +taken
    whole = mixing.mix(messy)
    assert whole.count() == messy.count()
    assert sum(r.repeats for r in whole.collect() if r["size"]) == mixing.repeated(messy).count()
    assert mixing.mix(messy.where("false")).count() == 0 and mixing.repeated(messy.where("false")).count() == 0
    nothing = make([(1, None), (2, " ")])
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0] and mixing.repeated(nothing).count() == 0


# components


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_by_union_find(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    links = spark.createDataFrame(pairs, "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_a_chain(spark):
    links = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    assert {r.component for r in components(links).collect()} == {0}


# near duplicates


def jaccard_groups(docs, n, percent):
    """Brute force over all pairs; docs: {id: text}."""
    sets = {}
    for i, t in docs.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in docs}


def variants(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(make, n, percent):
    rng = random.Random(percent)
    texts = [words(rng.randint(1, 9), rng.randrange(50)) for _ in range(60)]
    for size in (20, 60, 200):  # groups around the threshold, without and with their origin among them
        origin = words(size, rng.randrange(10**6))
        texts += variants(rng, origin, 40, max(2, size // 12))
    shared = words(70, 10**7)  # a passage that many documents share
    texts += [f"{words(60, 10**8 + i * 100)} {shared} {words(30, 10**9 + i * 100)}" for i in range(80)]
    texts += [None, "", " \n", "A b C", "a B c", "a b c", words(300)] + [words(300)] * 30
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(list(docs.items())), n, percent).collect()}
    assert found == jaccard_groups(docs, n, percent)


def test_near_duplicate_edges(make, messy):
    rows = minhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].component_id == 6 and not by[7].kept and by[1].n_shingles == 0 and by[1].kept and by[4].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(messy.where("false")).count() == 0
    kept = minhash.keep_one(messy)
    assert kept.schema == messy.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in by if by[i].kept] + [None, None])
    # one id with two texts is one document; its rows share a component
    twice = make([(1, words(40)), (2, words(40)), (2, words(40, 900)), (3, words(40, 900)), (4, words(40, 5000)), (4, words(40, 5000))])
    found = minhash.near_duplicates(twice).collect()
    assert len({r.component_id for r in found if r.doc_id == 2}) == 1
    assert Counter(r.doc_id for r in minhash.keep_one(twice).collect())[4] == 1


def test_near_duplicates_with_a_void_row_of_the_same_id(make):
    rows = [x for i in range(8) for x in ((10 * i, words(100, 1000 * i)), (10 * i + 1, words(99, 1000 * i)), (10 * i + 1, None), (10 * i + 1, "  "))]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows)).where("n_shingles > 0").collect()}
    assert found == {10 * i + j: 10 * i for i in range(8) for j in (0, 1)}


@pytest.mark.parametrize("tiles", [False, True])
def test_linked_labels_by_brute_force(tiles):
    rng = np.random.default_rng(7)
    for _ in range(60):
        bases = [rng.integers(0, 1 << 60, 40).astype(np.uint64) for _ in range(2)]
        sets = []
        for _ in range(30):
            s = bases[rng.integers(0, 2)].copy()
            s[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(0, 30)
            sets.append(np.unique(s))
        labels, second = rng.integers(0, 12, 30), (rng.integers(0, 2, 30) == 1) & tiles
        want = set()
        for i in range(30):
            for j in range(i):
                if labels[i] != labels[j] and (second[i] != second[j] or not second.any()) and minhash.linked(sets[i], sets[j], 80):
                    want.add((min(labels[i], labels[j]), max(labels[i], labels[j])))
        assert {tuple(x) for x in minhash.linked_labels(sets, labels, second, 80)} == want


def test_a_group_below_the_threshold_makes_no_pairs(spark, make):
    """Texts from one template, each with its own changes: none links, and what is moved grows with the texts, not with their pairs."""
    rng = random.Random(3)

    def changed(doc, share):
        return " ".join(f"c{doc}x{i}" if rng.random() < share else f"w{i}x" for i in range(150))

    docs = [(i, changed(i, 0.04)) for i in range(120)]
    docs += [(1000, docs[5][1] + " more"), (1001, docs[117][1] + " more")]
    sets = {d: minhash.shingle_set(t.encode(), 3) for d, t in docs}
    pairs = [(d, e) for d in sets for e in sets if d < e and minhash.linked(sets[d], sets[e], 85)]
    assert (5, 1000) in pairs and (117, 1001) in pairs and len(pairs) < len(docs)
    want = {d: d for d in sets}
    for _ in docs:
        for d, e in pairs:
            want[d] = want[e] = min(want[d], want[e])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(make(docs), 3, 85).collect()} == want
    known = minhash.sketches(make(docs), 3)
    lists = minhash.prefix_lists(known.select(known.doc_id.alias("id"), "n", "sketch"), 85).cache()
    none = spark.createDataFrame([], "id long, component long")
    blocks = minhash.apart_blocks(lists, none)
    members = blocks.select("p", "id").distinct().count()
    assert blocks.count() == members < 10 * len(docs)
    cut = minhash.apart_blocks(lists, none, rows=16)
    assert cut.groupBy("p", "i", "j").count().where("count > 64").count() == 0
    texts = make(docs).selectExpr("doc_id id", "text")
    linked = {frozenset(r) for r in minhash.apart_links(blocks, texts, 3, 85).collect()}
    assert linked == {frozenset(r) for r in minhash.apart_links(cut, texts, 3, 85).collect()}


def test_near_duplicates_with_many_owners(make, monkeypatch):
    """Few ids of documents in lists are broadcast, so that no other texts are shuffled; many are joined, with the same result."""
    docs = make([(i, words(60, 1000 * (i % 7)) + f" end{i}") for i in range(20)])
    want = sorted((i, i % 7) for i in range(20))
    for most in (minhash.MOST_OWNERS, 1):
        monkeypatch.setattr(minhash, "MOST_OWNERS", most)
        assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()) == want


def test_least_shared_is_safe():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        c = minhash.least_shared(64, percent)
        assert 0.4 * 64 < c < percent * 0.64 and (rng.binomial(64, percent / 100, 200_000) >= c).all()


# passages


def test_minimizers_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 12, 13, 40, 200):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        want = {min(h[i : i + 12]) for i in range(max(1, n - 11))} if n else set()
        assert set(substring.minimizers(h, 12)) == want


def test_runs_chains_and_gaps_by_brute_force():
    rng, rules = random.Random(6), substring.Rules()
    for _ in range(60):
        found = np.array(sorted({(rng.randrange(60), rng.randrange(60), rng.randint(1, 4)) for _ in range(rng.randint(1, 14))}))
        rows = [(a, b, n + rules.k - 1) for a, b, n in found.tolist()]
        score = {}
        for j in sorted(range(len(rows)), key=lambda i: rows[i][:2]):
            a, b, n = rows[j]
            score[j] = n + max([0.0] + [score[i] - rules.gap_cost * (a - x - m + b - y - m) for i, (x, y, m) in enumerate(rows) if i in score and x + m <= a and y + m <= b])
        got = substring.chains(found, rules)
        best = got[0]
        value = sum(n for _, _, n in best) - rules.gap_cost * sum(c[0] - p[0] - p[2] + c[1] - p[1] - p[2] for p, c in zip(best, best[1:]))
        assert value == pytest.approx(max(score.values())) and sorted(r for c in got for r in c) == sorted(rows)
    for _ in range(50):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(0, 9))]) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert substring.common_words(a, b) == table[-1, -1]
    a, b = np.array([1, 2, 3, 9, 2, 3, 4], np.uint64), np.array([5, 2, 3, 4, 1, 2, 3], np.uint64)
    assert sorted(map(tuple, substring.runs(a, b))) == sorted({(0, 4, 1), (1, 1, 2), (4, 5, 2), (6, 3, 1)})


def exact_runs(texts):
    """{id: longest run of equal words with a text of a lower id}, by brute force."""
    out = {}
    for d, t in texts.items():
        a, best = t.split(), 0
        for r, u in texts.items():
            if r < d:
                where = defaultdict(list)
                for j, w in enumerate(u.split()):
                    where[w].append(j)
                last = {}
                for w in a:
                    now = {j: last.get(j - 1, 0) + 1 for j in where.get(w, ())}
                    best = max(best, *now.values()) if now else best
                    last = now
        out[d] = best
    return out


def test_passages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    longest = exact_runs(texts)
    found = {r.doc_id for r in substring.passages(docs).collect()}
    assert {d for d, n in longest.items() if n > 50} <= found
    assert all(longest[d] >= 5 for d in found)


def test_planted_passages(make, messy):
    rng = random.Random(8)
    passage = words(60, 10**6)
    edited = passage.split()
    for i in (10, 25, 41):
        edited[i] = "changed"
    rows = [(i, f"{words(100, i * 1000)} {passage} {words(20, i * 1000 + 500)}") for i in range(40)]
    rows += [(100, f"{words(30, 77000)} {' '.join(edited)} {words(30, 78000)}"), (101, words(200, 90000)), (102, " ".join(passage.split()[:40]) + " " + words(40, 95000)), (103, passage), (104, words(200, 90000)), (105, " ".join(rng.choice(passage.split()) for _ in range(80)))]
    found = {r.doc_id: r for r in substring.passages(make(rows)).collect()}
    assert set(found) == set(range(1, 40)) | {100, 103, 104}
    assert all((found[i].start_word, found[i].n_words, found[i].source_ids) == (100, 60, [0]) for i in range(1, 40))
    assert (found[100].start_word, found[100].n_words) == (30, 60) and found[104].source_ids == [101]
    out = {r.doc_id: r for r in substring.cut(make(rows)).collect()}
    assert set(out) == {i for i, _ in rows} - {103, 104}
    assert out[5].text == f"{words(100, 5000)}  {words(20, 5500)}" and out[5].n_chars == len(out[5].text) and out[0].text == rows[0][1]
    assert all(out[i].text == t for i, t in rows if i in (101, 102, 105))
    assert substring.passages(messy.where("false")).count() == 0 and substring.cut(messy.where("false")).schema == messy.schema
    whole = substring.cut(messy)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in messy.where("doc_id IS NULL OR doc_id <> 7").collect())


def test_periodic_passages(make):
    line = words(9, 5 * 10**6)
    rows = [(1, f"{words(40, 100)} {' '.join(['same'] * 70)} {words(40, 200)}"), (2, f"{words(50, 300)} {' '.join(['same'] * 60)} {words(40, 400)}"), (3, f"{words(40, 500)} {' '.join([line] * 8)}"), (4, f"{' '.join([line] * 7)} {words(40, 600)}")]
    found = {r.doc_id: (r.start_word, r.n_words, r.source_ids) for r in substring.passages(make(rows)).collect()}
    assert found == {2: (50, 60, [1]), 4: (0, 63, [3])}


def test_passages_more_often_than_in_the_source():
    rules, rng = substring.Rules(), np.random.default_rng(2)

    def new(n):
        return rng.integers(0, 2**63, n).astype(np.uint64)

    def covered(a, b):
        out = np.zeros(len(a), bool)
        for x, n, *_ in substring.fragments(a, b, rules):
            out[x : x + n] = True
        return out

    p = new(60)
    edited = p.copy()
    edited[[9, 18, 27, 36, 45]] = new(5)
    for copy in (p, edited):
        gaps = [new(25) for _ in range(51)]
        a = np.concatenate([x for g in gaps[:50] for x in (g, copy)] + gaps[50:])
        want = np.concatenate([x for _ in range(50) for x in (np.zeros(25, bool), np.ones(60, bool))] + [np.zeros(25, bool)])
        assert (covered(a, np.concatenate([new(30), p, new(30)])) == want).all()
    shuffled = np.concatenate([p[45:], new(3), p[30:45], new(3), p[15:30], new(3), p[:15]])
    got = covered(np.concatenate([shuffled, new(30), p]), np.concatenate([new(30), p]))
    assert got[-60:].all() and not got[69:99].any()
    assert covered(p, np.concatenate([shuffled, new(9), p])).all() and not covered(new(90), p).any()


def test_passages_whose_pieces_others_have_first(make):
    rows, want = [], set()
    for i in range(40):
        n, each = ((5, 12), (4, 15), (3, 19), (4, 13))[i % 4]
        p = words(n * each, 10**6 + 1000 * i).split()
        pieces = [p[j : j + each] for j in range(0, n * each, each)]
        spread = " ".join(" ".join(x) + " " + words(3, 2 * 10**6 + 1000 * i + 10 * j) for j, x in enumerate(pieces[::-1]))
        rows += [(1000 + i, spread), (2000 + i, f"{words(30, 3 * 10**6 + 1000 * i)} {' '.join(p)}"), (3000 + i, f"{' '.join(p)} {words(30, 4 * 10**6 + 1000 * i)}")]
        want.add(3000 + i)
    cut = words(51, 9 * 10**6).split()  # each 25 words of it have a holder before, but not the middle
    rows += [(10, " ".join(cut[:25])), (11, " ".join(cut[26:])), (12, " ".join(cut) + " " + words(30, 5 * 10**6)), (13, words(30, 6 * 10**6) + " " + " ".join(cut))]
    found = {r.doc_id: r.n_words for r in substring.passages(make(rows)).collect()}
    assert want <= set(found) and found[13] == 51 and all(found[d] >= 52 for d in want)


def covered_words(found, doc):
    return {w for r in found if r.doc_id == doc for w in range(r.start_word, r.start_word + r.n_words)}


def test_equal_runs_are_found_whatever_came_before(make):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, want = [], {}
    for trial in range(60):
        n, first = rng.randint(50, 75), 10_000 * (trial + 1)
        p = [rng.choice(vocabulary) + f"t{trial}" for _ in range(n)]
        ids = iter(range(first, first + 100))
        for _ in range(rng.randint(0, 12)):  # pieces of it in documents before, some of them altered
            a = rng.randrange(n - 8)
            piece = p[a : a + rng.choice([8, 8, 15, 22, 40])]
            rows.append((next(ids), f"{words(rng.randint(0, 9), first * 1000 + 50 * next(ids))} {' '.join(piece)} {words(30, first * 1000 + 50 * next(ids) + 10)}"))
        for k in range(rng.randint(2, 3)):
            before = rng.randint(0, 30)
            d = next(ids)
            rows.append((d, " ".join([*words(before, first * 2000 + 100 * d).split(), *p, *words(rng.randint(0, 30), first * 3000 + 100 * d).split()])))
            if k:
                want[d] = set(range(before, before + n))
    found = substring.passages(make(rows)).collect()
    assert all(w <= covered_words(found, d) for d, w in want.items())


def test_run_ends_and_common_words_by_brute_force():
    rng, rules = np.random.default_rng(4), substring.Rules()
    for _ in range(40):
        p, n = rng.integers(0, 2**60, 70).astype(np.uint64), rng.integers(0, 2**60, (4, 9)).astype(np.uint64)
        x, y = int(rng.integers(0, 3)), int(rng.integers(0, 3))
        a = np.concatenate([n[0][:x], p[: int(rng.integers(50, 70))], n[1]])
        b = np.concatenate([n[2][:y], p, n[3]])
        size = len(a) - x - 9
        want = {(substring.RIGHT, x + size, min(len(a), x + size + 30), y + size)} | ({(substring.LEFT, x, 0, y)} if x else set())
        assert set(substring.run_ends(a, b, rules)) == want
    assert substring.run_ends(p, p[:10], rules) == [] and substring.run_ends(p, p, rules) == []
    big = np.random.default_rng(5).integers(0, 50, (2, 600))
    table = np.zeros((601, 601), int)
    for i in range(600):
        for j in range(600):
            table[i + 1, j + 1] = table[i, j] + 1 if big[0, i] == big[1, j] else max(table[i, j + 1], table[i + 1, j])
    assert substring.common_words(big[0], big[1]) == table[-1, -1]


# chats


def test_chat_round_trip_and_edges(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "a\\", "###", "</turn>\n### User: x", "\\\\</turn>", "line\nline", "é中"]
    rows, want = [], {}
    for c in range(40):
        rng = random.Random(c)
        turns = [(c, t, rng.choice(["system", "user", "assistant", "tool:x", None, "=odd\\", ""]), rng.choice(texts)) for t in range(rng.randint(1, 6))]
        rows += turns
        want[c] = turns
    rows += [(None, 1, "user", "hi"), (50, None, "user", "first"), (50, 1, "assistant", "second"), (51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, state string").repartition(5)
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(found) == set(range(40)) | {None, 50, 51}
    for c, turns in want.items():
        own = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        loss = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(own.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        state, roles = "start", [t[2] or "" for t in turns]
        for role in roles:
            state = chat.TURN_ORDER.get((state, role), "broken")
        assert r.valid == (state == "answered")
    assert found[50].valid and found[51].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0
    segments = chat.format_turns(df.where("conv_id = 50")).collect()
    assert "".join(s.text for s in segments) == "### User: first</turn>\n### Assistant: second</turn>\n"
    assert [s.text for s in segments if s.loss] == ["second"]


# shared parts


def test_words_are_cut_at_six_bytes_alone():
    assert "a\x1cb\x85c\xa0d e".encode().split() == ["a\x1cb\x85c\xa0d".encode(), b"e"]
    h = common.word_hashes([b"a", b"b", b"a"])
    assert h[0] == h[2] != h[1] and len(common.shingle_hashes(h, 4)) == 0


def test_checkpoint_folder_is_the_sessions(spark):
    common.checkpointed(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize(("master", "named", "fails"), [("yarn", None, True), ("local-cluster[2,1,1024]", None, True), ("yarn", "/shared/", False), ("local[4]", None, False)])
def test_no_folder_of_one_machine_on_a_cluster(master, named, fails):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named or other), sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="share"):
            common.shared_folder(session, "x-")
    else:
        assert common.shared_folder(session, "x-").startswith("/shared" if named else "/")
