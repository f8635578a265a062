"""Operators that look at one document at a time: quality, licences, toxicity, pieces, images, languages."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import plain_webp
import pytest
from sqlcheck import SMALL, compare

from vectryx.llm import common, langid, licenses, pieces, quality, queries, toxicity, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# quality


def base(text):
    own = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(zip(own, own[1:], own[2:]))
    covered = set()
    for i, w in enumerate(zip(own, own[1:], own[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base_counts(messy, spark):
    for df in (messy, spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = Counter((r.doc_id, base(r.text or "")) for r in df.collect())
        judged = quality.judge(df).collect()
        found = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in judged)
        assert found == texts
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged)
        assert not any(r.kept and r.base_failed for r in judged)


def plain_distance(p, q):
    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b) if x)

    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))


def test_quality_distances_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = quality.Rules(guard_words=60)
    rows = docs.collect()
    classes = {quality.LOWER: "a-z", quality.UPPER: "A-Z", quality.DIGIT: "0-9", quality.STOP: ".,;:", quality.PUNCT: "!\"'()+\\-/=?@\\[\\\\\\]^_`{}~", quality.SYMBOL: "#*$%&|<>", quality.WIDE: "\x80-\U0010ffff", quality.CONTROL: "\x00-\x08\x0e-\x1f\x7f"}

    def of_class(text):
        return [len(re.findall(f"[{classes[k]}]", text)) for k in quality.CLASSES]

    def folded(text):
        return re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))

    langs = {r.lang for r in rows}
    total = {lang: np.sum([of_class(r.text) for r in rows if r.lang == lang], axis=0) for lang in langs}
    counted = {lang: Counter(w for r in rows if r.lang == lang for w in folded(r.text)) for lang in langs}
    judged = {r.doc_id: r for r in quality.judge(docs, rules=rules).collect()}
    checked = 0
    for r in rows:
        n = sum(counted[r.lang].values())
        top = sorted(counted[r.lang].items(), key=lambda x: (-x[1], x[0].encode()))[: rules.common]
        if n < rules.reference_words:
            continue
        own, words = of_class(r.text), folded(r.text)
        want_class = plain_distance([x / sum(own) for x in own], [x / sum(total[r.lang]) for x in total[r.lang]]) if sum(own) >= rules.guard_chars else 0
        here = Counter(words)
        mine = [here[w] for w, _ in top]
        ref = [c / n for _, c in top]
        want_words = plain_distance([x / len(words) for x in [*mine, len(words) - sum(mine)]], [*ref, 1 - sum(ref)]) if len(words) >= rules.guard_words else 0
        got = judged[r.doc_id]
        assert got.class_distance == pytest.approx(want_class, abs=1e-9) and got.word_distance == pytest.approx(want_words, abs=1e-7)
        assert got.kept == (not got.base_failed and got.class_distance <= rules.class_distance and got.word_distance <= rules.word_distance)
        checked += 1
    assert checked > 100


def test_quality_rejects_junk_and_keeps_good(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and not kept[r.doc_id].base_failed]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_quality_of_many_and_of_rare_languages(make):
    def text(lang, n):
        rng = random.Random(f"{lang} {n}")
        return " ".join(f"{lang}{chr(97 + int(rng.paretovariate(0.7)) % 26)}{rng.randrange(9)}" for _ in range(n))

    rows = [(1000 * i + j, text(f"l{i}q", 1000), f"l{i}q") for i in range(260) for j in range(3)] + [(10**6, text("rare", 400), "rare")]
    docs = make(rows)
    refs = quality.references(docs)
    assert set(refs.classes) == {f"l{i}q" for i in range(260)}
    assert all(r.word_distance < 0.38 for r in quality.judge(docs, refs).where("doc_id < 1000000").collect())
    assert {r.doc_id for r in quality.keep(docs, refs).collect()} == {r[0] for r in rows}


def test_quality_edges(spark, make, messy):
    assert quality.judge(messy.where("false")).count() == 0
    assert quality.keep(messy.where("false")).columns == messy.columns
    kept = quality.keep(messy)
    verdicts = Counter(r.doc_id for r in quality.judge(messy).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == verdicts and kept.schema == messy.schema
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and quality.distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


# licences


def test_licenses_equal_sql(spark):
    ours, theirs = compare(spark, "op3_licenses")
    assert ours == theirs


def test_licenses(make, messy):
    lines = {v: k for k, v in licenses.SENTENCES.items()}
    mit = ". ".join(lines[i].upper() for i in ("mit-grant", "mit-notice", "mit-warranty")) + "."
    wrapped = "Some words.\nLicensed under the\nApache License, Version 2.0."
    rows = [(1, mit), (2, "Intro line without a stop\nReleased under the MIT License.\nMore"), (3, wrapped), (4, lines["mit-grant"] + "."), (5, "All rights reserved. All rights reserved."), (6, "the software is good"), (7, lines["bsd-grant"] + ". " + lines["bsd-source"] + ". " + lines["bsd-binary"] + "!"), (8, lines["gpl3-later"].replace(" ", "\n") + ".")]
    found = {r.doc_id: r for r in licenses.scan(make(rows)).collect()}
    assert [found[i].licenses for i in range(1, 9)] == ["MIT", "MIT", "Apache-2.0", "", "Proprietary", "", "BSD-2-Clause", "GPL-3.0-or-later"]
    more = {20: ("Zlib", ["zlib-basis", "zlib-liable", "zlib-grant"]), 21: ("AGPL-3.0-or-later", ["agpl3-later", "gnu-warranty", "agpl-see"]), 22: ("EPL-2.0", ["epl2-grant"]), 23: ("CC0-1.0", ["cc0-deed"]), 24: ("LGPL-3.0-or-later", ["lgpl3-later"]), 25: ("BSL-1.0", ["bsl1-short"])}
    told = {r.doc_id: r for r in licenses.scan(make([(i, ". ".join(lines[x].capitalize() for x in own) + ".") for i, (_, own) in more.items()])).collect()}
    assert {i: (r.licenses, r.unmatched) for i, r in told.items()} == {i: (name, 0) for i, (name, _) in more.items()}
    assert found[4].unmatched == 1 and found[5].n_sentences == 2 and found[5].unmatched == 0 and found[1].sentence_ids == "<mit-grant><mit-notice><mit-warranty>"
    assert licenses.scan(messy).count() == messy.count() and licenses.scan(messy.where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.check_rules({"Not normal": "x"}, ())


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(found[r.doc_id], r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(p.held_out and 0 <= p.score <= 1 and p.predicted == (p.score >= 0.7) for p, _ in held)
    hits = sum(p.predicted for p, y in held if y)
    assert hits >= 0.85 * sum(y for _, y in held) and hits >= 0.9 * sum(p.predicted for p, _ in held)


def test_toxicity_edges(spark, make, messy):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(0)] + [(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(messy, labels, skip=None) is None
    rows = toxicity.score(messy, None).collect()
    assert len(rows) == messy.count() and all(r.score == 0 for r in rows)
    docs = make([(i, f"you are an {'idiot' if i % 2 else 'author'} number{i} indeed") for i in range(200)] + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(3, 1, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, skip=None)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert found[1].predicted == 1 and found[2].predicted == 0 and found[900].score == found[901].score
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_isotonic_by_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        x = np.array([rng.randint(0, 6) for _ in range(12)], float)
        y = np.array([rng.randint(0, 1) for _ in range(12)], float)
        knots, p = toxicity.isotonic(x, y)
        fit = np.interp(np.unique(x), knots, p)
        values = np.unique(x)
        means = [(y[x == v].sum(), (x == v).sum()) for v in values]
        for i in range(len(values)):  # the min-max formula
            want = max(min(sum(m[0] for m in means[a : b + 1]) / sum(m[1] for m in means[a : b + 1]) for b in range(i, len(values))) for a in range(i + 1))
            assert fit[i] == pytest.approx(want)


def test_features():
    codes = toxicity._Codes(toxicity.Lexicon({"idiot": 3.0}))
    x = dict(zip(toxicity.FEATURES, toxicity.featured(b"YOU total !d10t, Idiot!! fine well-known", codes)))
    assert x["hits"] == 2 and x["obfuscated_hits"] >= 0 and x["near_second_person"] == 2 and x["capital_words"] == pytest.approx(1 / 6)
    assert toxicity.letters("(Wörter)!") == "wörter" and toxicity.plain("1d10t") == "idiot"


def plain_boost(x, y, rounds, depth, rate, bins, ridge, least):
    """Every split of every node tried by itself; a tree is nested (feature, threshold, left, right) or a leaf's value."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    raw = [math.log(share / (1 - share))] * len(y)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]

    def grow(rows, level, g, h):
        def weight(own):
            return sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + ridge)

        if level == depth:
            return -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
        best = (1e-9, 0, math.inf)
        for j, e in enumerate(edges):
            for t in e:
                low, high = [i for i in rows if x[i, j] <= t], [i for i in rows if x[i, j] > t]
                if len(low) >= least and len(high) >= least and (gain := weight(low) + weight(high) - weight(rows)) > best[0] + 1e-9:
                    best = (gain, j, t)
        _, j, t = best
        return j, t, grow([i for i in rows if x[i, j] <= t], level + 1, g, h), grow([i for i in rows if x[i, j] > t], level + 1, g, h)

    def value(tree, row):
        while isinstance(tree, tuple):
            j, t, low, high = tree
            tree = low if row[j] <= t else high
        return tree

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        tree = grow(list(range(len(y))), 0, [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p])
        raw = [r + value(tree, row) for r, row in zip(raw, x)]
    return raw


def test_boosting_by_brute_force():
    rng = np.random.default_rng(7)
    for depth in (1, 2, 3):
        x = np.column_stack([rng.normal(size=70), rng.integers(0, 4, 70), rng.random(70)])
        y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=70) * 0.5) > 0.8).astype(float)
        model = toxicity.boost(x, y, rounds=6, depth=depth, rate=0.3, bins=8, ridge=1.0, least=5)
        assert model.raw(x) == pytest.approx(plain_boost(x, y, 6, depth, 0.3, 8, 1.0, 5))


def plain_features(text, lexicon):
    """The features again, a word at a time."""
    raw = WORD.findall(text)
    cores = []
    for w in raw:
        low = w.lower()
        while low and not low[0].isalnum():
            low = low[1:]
        while low and not low[-1].isalnum():
            low = low[:-1]
        cores.append(low)

    def weight(core):
        return max([0.0, *(v for k, v in lexicon.items() if core and (k == core or k[-1:] == "*" and len(k) in range(5, 10) and core.startswith(k[:-1])))])

    def undone(word):
        return "".join(c for c in word.translate(str.maketrans("013457@$!", "oieastasi")) if c.isalpha())

    inner = [any(c.isalpha() for c in c_) and not c_.replace("-", "").replace("'", "").replace("\u2019", "").isalpha() for c_ in cores]
    weights, hidden = [], []
    for w, c, mixed in zip(raw, cores, inner):
        own = weight(c)
        other = max(weight(undone(c)), weight(undone(w.lower().rstrip(".,;:!?")))) if not own and (mixed or w[0] in "@$!") else 0.0
        weights.append(own or other)
        hidden.append(other > 0)
    hits = [i for i, w in enumerate(weights) if w > 0]
    second = [i for i, c in enumerate(cores) if c in toxicity.SECOND_PERSON]
    m, chars = max(1, len(raw)), max(1, sum(map(len, raw)))
    wide = sum(ord(c) >= 128 for c in text)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    alpha = max(1, upper + lower + wide)
    return dict(zip(toxicity.FEATURES, [
        len(hits), len(hits) / m, sum(weights), max(weights, default=0.0), len({raw[i] for i in hits}), sum(hidden), len(second) / m, sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits),
        upper / alpha, sum(w.isupper() and len(c) > 1 for w, c in zip(raw, cores)) / m, text.count("!") / m, sum(c in ".,;:!\"'()+-/=?@[\\]^_`{}~" for c in text) / chars, sum(c in "#*$%&|<>" for c in text) / chars, sum("0" <= c <= "9" for c in text) / chars, sum(inner) / m, wide / chars, chars / m, math.log1p(len(raw)),
    ], strict=True))


def test_features_by_brute_force(messy, spark):
    lexicon = {"idiot": 3.0, "stup*": 2.5, "trash": 4.0, "w50*": 1.0, "the": 0.25, "pa\u00dfe*": 2.0}
    codes = toxicity._Codes(toxicity.Lexicon(lexicon))
    own = ["YOU total !d10t, Idiot!! fine well-known 1d1ot", "@stupidly $tupid STUPID? u'r tr4sh ... ---", "", "\u00dcBER Pa\u00dfend du 3 a 1 !!", "x" * 300 + " you " + "trash" * 60]
    for t in own + [r.text or "" for r in messy.collect()] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]:
        got = dict(zip(toxicity.FEATURES, toxicity.featured(t.encode(), codes)))
        assert got == pytest.approx(plain_features(t, lexicon), abs=1e-9), t[:80]


def test_toxicity_query_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels, skip=(3, 1))
    learned = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts]
    again = toxicity.fit(docs.where("doc_id IN (%s)" % ",".join(str(r.doc_id) for r in learned)), labels, skip=None)
    assert again.lexicon == model.lexicon and np.array_equal(again.knots[0], model.knots[0])  # nothing else was learned from
    found = {r.doc_id: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    assert set(found) == set(texts)
    for d, t in texts.items():
        f = plain_features(t, model.lexicon.weights)
        raw = model.trees.base
        for feature, threshold, leaves in model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (f[toxicity.FEATURES[feature[node]]] > threshold[node] + 1e-12)
            raw += leaves[node - len(feature)]
        want = float(np.interp(raw, *model.knots))
        assert found[d].score == pytest.approx(want, abs=1e-6) and found[d].predicted == int(found[d].score >= 0.7) and found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


# pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.model_path())


def test_pieces_equal_the_library(codec, messy):
    rng, alphabet = random.Random(2), " \n\t▁aébc.,!ﬁ①퟿中文AB  \x00​1290</s>²ṩ́"
    texts = [r.text or "" for r in messy.collect()] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == codec.library.encode(t)
        assert codec.decode(ids) == codec.library.decode(ids)
    codec.end_batch()
    for _ in range(500):
        ids = [rng.randint(0, 400) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == codec.library.decode(ids)


def test_piece_queries(spark, codec, messy):
    for df in (messy, spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = Counter()
        for r in df.collect():
            ids = codec.library.encode(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(map(tuple, pieces.digests(df).collect())) == want
        assert Counter((r.doc_id, len(r.ids)) for r in pieces.encode(df).collect()) == Counter((k[0], k[1]) for k in want.elements())
    assert pieces.digests(messy.where("false")).count() == 0


def test_long_parts_and_words_are_not_remembered():
    own = pieces.Codec(pieces.model_path())
    texts = [chr(0x4E00 + i) * 3000 for i in range(50)] + ["x" * 5000, "word another word"]
    for t in texts:
        assert own.encode(t) == own.library.encode(t)
    own.end_batch()
    assert max(map(len, own.known)) <= 64
    common.word_hashes([b"y" * 10**6, b"short"])
    assert b"short" in common._hashes and max(map(len, common._hashes)) <= 128


def test_check_catches_a_wrong_merge(codec):
    broken = pieces.Codec(pieces.model_path())
    broken.cost = {k: -v for k, v in broken.cost.items()}
    broken.encode("the international organisation")
    with pytest.raises(ValueError, match="the library"):
        broken.end_batch()


# images


class Stream(plain_webp.Writer):
    """Writes any lossless stream, code by code, for the reader to read."""

    def lengths(self, own):
        self.put(0, 1).put(15, 4)
        for s in plain_webp._ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in own:
            self.put(int(format(n, "04b")[::-1], 2), 4)
        code, last, out = 0, 0, {}
        for n, s in sorted((n, s) for s, n in enumerate(own) if n):
            code <<= n - last
            out[s], last = (int(format(code, f"0{n}b")[::-1], 2), n), n
            code += 1
        return out

    def image(self, symbols, top, cache_bits=0, groups=1, tile=None):
        """symbols: (argb,) literals, ("back", length, distance code), ("cache", index). groups > 1: every code is written so often."""
        self.put(1, 1).put(cache_bits, 4) if cache_bits else self.put(0, 1)
        if top:
            if tile:
                bits, of = tile
                self.put(1, 1).put(bits - 2, 3)
                self.image([(g << 8,) for g in of], False)
            else:
                self.put(0, 1)
        green = [9] * 256 + ([6] * 24 + [6] * 8 if cache_bits == 3 else [6] * 16 + [5] * 8)
        for _ in range(groups):
            g, eight, d = self.lengths(green), None, None
            r, b, a = (self.lengths([8] * 256) for _ in range(3))
            d = self.lengths([6] * 16 + [5] * 24)
        for s in symbols:
            if s[0] == "back":
                for book, value, start in ((g, s[1], 256), (d, s[2], 0)):
                    symbol, extra, n = self.split(value)
                    self.put(*book[start + symbol]).put(extra, n)
            elif s[0] == "cache":
                self.put(*g[280 + s[1]])
            else:
                v = s[0]
                self.put(*g[v >> 8 & 255]).put(*r[v >> 16 & 255]).put(*b[v & 255]).put(*a[v >> 24])
        return self

    @staticmethod
    def split(value):
        value -= 1
        if value < 4:
            return value, 0, 0
        n = value.bit_length() - 2
        return 2 * n + 2 + (value >> n & 1), value & ((1 << n) - 1), n

    def start(self, w, h):
        return self.put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(1, 1).put(0, 3)

    def data(self):
        return self.value.to_bytes((self.n + 7) // 8 + 8, "little")


def read(data):
    """By both readers."""
    found = webp.decode_streams([data])[0]
    assert np.array_equal(found, plain_webp.decode_stream(data))
    return found


def literals(x):
    return [(int(v),) for v in np.asarray(x).reshape(-1)]


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, (h, w), dtype=np.uint32)


def test_plain_pixels_back_references_and_cache():
    x = noise(4, 5)
    s = Stream().start(5, 4).put(0, 1).image(literals(x), True)
    assert np.array_equal(read(s.data()), x)
    # a row, then copies of it from one row up (distance code 1), then the pixel to the left (code 2), and an absolute distance
    row = noise(1, 8, 1)[0]
    s = Stream().start(8, 4).put(0, 1).image([*literals(row), ("back", 8, 1), ("back", 5, 2), ("back", 3, 120 + 8), ("back", 8, 120 + 24)], True)
    want = [*row, *row, *[row[7]] * 5, *row[5:8], *row]
    assert read(s.data()).reshape(-1).tolist() == want
    slot = (int(row[2]) * 0x1E35A7BD & 0xFFFFFFFF) >> 29
    last = max(i for i, v in enumerate(row) if (int(v) * 0x1E35A7BD & 0xFFFFFFFF) >> 29 == slot)
    s = Stream().start(10, 1).put(0, 1).image([*literals(row), ("cache", slot), ("back", 1, 120 + 9)], True, cache_bits=3)
    assert read(s.data()).reshape(-1).tolist() == [*row, row[last], row[0]]


def test_entropy_image():
    x = noise(6, 6, 2)
    s = Stream().start(6, 6).put(0, 1).image(literals(x), True, groups=3, tile=(2, [2, 0, 1, 2]))
    assert np.array_equal(read(s.data()), x)


def test_subtract_green_and_cross_colour():
    x = noise(5, 7, 3)
    c = webp._channels(x).reshape(5, 7, 4).copy()
    c[..., 0] -= c[..., 1]
    c[..., 2] -= c[..., 1]
    s = Stream().start(7, 5).put(1, 1).put(2, 2).put(0, 1).image(literals(c.view("<u4")), True)
    assert np.array_equal(read(s.data()), x)
    tiles = noise(2, 2, 4)

    def signed(v):
        return v - 256 if v > 127 else v

    y = np.zeros_like(x)
    for i in range(5):
        for j in range(7):
            t, v = int(tiles[i >> 2, j >> 2]), int(x[i, j])
            to_red, to_blue, red_blue = signed(t & 255), signed(t >> 8 & 255), signed(t >> 16 & 255)
            a, r, g, b = v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255
            nr = (r - (to_red * signed(g) >> 5)) & 255
            nb = (b - (to_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5)) & 255
            y[i, j] = a << 24 | nr << 16 | g << 8 | nb
    s = Stream().start(7, 5).put(1, 1).put(1, 2).put(0, 3).image(literals(tiles), False).put(0, 1).image(literals(y), True)
    assert np.array_equal(read(s.data()), x)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = noise(5, 6, 10 + mode)

    def parts(v):
        return [int(v) >> s & 255 for s in (24, 16, 8, 0)]

    def avg(a, b):
        return [(p + q) // 2 for p, q in zip(a, b)]

    y = np.zeros_like(x)
    for i in range(5):
        for j in range(6):
            if not i and not j:
                p = [255, 0, 0, 0]
            elif not i:
                p = parts(x[i, j - 1])
            elif not j:
                p = parts(x[i - 1, j])
            else:
                left, top, corner = parts(x[i, j - 1]), parts(x[i - 1, j]), parts(x[i - 1, j - 1])
                right = parts(x[i - 1, j + 1]) if j < 5 else parts(x[i, 0])
                distance = sum(abs(t - c) for t, c in zip(top, corner)), sum(abs(m - c) for m, c in zip(left, corner))
                mean = avg(left, top)
                p = [
                    [255, 0, 0, 0], left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right)),
                    left if distance[0] < distance[1] else top,
                    [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, corner)],
                    [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean, corner)],
                ][mode]
            r = [(a - b) & 255 for a, b in zip(parts(x[i, j]), p)]
            y[i, j] = r[0] << 24 | r[1] << 16 | r[2] << 8 | r[3]
    s = Stream().start(6, 5).put(1, 1).put(0, 2).put(1, 3).image([(mode << 8,)], False).put(0, 1).image(literals(y), True)
    assert np.array_equal(read(s.data()), x)


def test_streams_side_by_side():
    many = []
    for k in range(12):
        x = noise(3 + k, 4 + k % 3, k)
        s = Stream().start(x.shape[1], x.shape[0])
        if k % 3 == 1:
            s.put(0, 1).image(literals(x), True, groups=2, tile=(2, [k % 2, 1] * 9 if k == 99 else [(i + k) % 2 for i in range(webp._div(x.shape[1], 2) * webp._div(x.shape[0], 2))]))
        else:
            s.put(0, 1).image([*literals(x[:2]), ("back", (x.shape[0] - 2) * x.shape[1], 120 + 1 + k % 4)], True)
        many.append(s.data())
    for data, found in zip(many, webp.decode_streams(many)):
        assert np.array_equal(found, plain_webp.decode_stream(data))
    with pytest.raises(ValueError):
        webp.decode_streams([many[0], many[1][:20]])
    assert webp.decode_streams([]) == [] and webp.encode_all([]) == [] and webp.decode_all([]) == []


def payloads():
    """What each of the writer's choices is right for."""
    rng, g = random.Random(3), np.random.default_rng(9)
    for k in (1, 2, 3, 4, 5, 16, 17, 64, 129, 256):
        alphabet = bytes(rng.sample(range(256), k))
        yield webp.padded(bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 2000))))
    yield webp.padded(bytes(rng.randrange(97, 120) for _ in range(192 * 70 + 5)))
    yield g.integers(0, 256, 192 * 32, np.uint8).tobytes()
    grey = g.integers(0, 256, (32, 64, 1), np.uint8)
    yield (grey + g.integers(0, 2, (32, 64, 3), np.uint8)).astype(np.uint8).tobytes()
    rows = np.repeat(g.integers(0, 256, (2, 64, 3), np.uint8), 16, 0)
    yield rows.tobytes()
    rows[:, 40:] = grey[:, 40:]
    yield rows.tobytes()
    yield webp.padded((" ".join(f"word{i % 37} thing{i % 11}" for i in range(900)) + "\n" + "-" * 700).encode())
    yield webp.padded("\n".join("the same line again" if i % 2 else f"line {i * i}" for i in range(300)).encode())


def test_payloads_round_trip():
    every, seen = list(payloads()), Counter()
    media = webp.encode_all(every)
    for p, m, images in zip(every, media, webp.decode_all(media)):
        assert webp.samples(images).tobytes() == p and m == webp.encode(p)  # whatever it is written beside
        assert all(np.array_equal(x, plain_webp.decode_stream(c)) for x, c in zip(images, webp._chunks(m)))
        seen += webp.traits(m)
    assert set(seen) == {"predictor", "cross-colour", "subtract green", "palette", "cache", "prefix codes", "literals", "copied", "cached"}
    assert len(webp.decode(media[10])) == 3
    for bad in (b"", b"x"):
        with pytest.raises(ValueError):
            webp.encode(bad)
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxJUNK")


def test_many_small_and_one_long(monkeypatch):
    rng = random.Random(6)
    tiny = [webp.padded(bytes(rng.choices(range(33, 120), k=rng.randint(0, 190)))) for _ in range(3000)]
    long = webp.padded(" ".join(f"w{rng.randrange(5000)}" for _ in range(60_000)).encode())
    every = [*tiny[:1500], long, *tiny[1500:]]
    media = webp.encode_all(every)
    assert all(webp.samples(x).tobytes() == p for p, x in zip(every, webp.decode_all(media)))
    monkeypatch.setattr(webp, "GROUP", 50_000)
    assert webp.encode_all(every) == media and all(webp.samples(x).tobytes() == p for p, x in zip(every, webp.decode_all(media)))


def test_transforms_are_undone():
    for seed in range(6):
        g = np.random.default_rng(seed)
        x = np.uint32(0xFF000000) | noise(int(g.integers(1, 33)), 64, seed) & np.uint32(0xFFFFFF if seed % 2 else 0x0F0F0F)
        x[1::3] = x[0]
        x[:, 9:30] = x[:, 8:9]
        res, modes, cross = webp._spatial(x)
        back = webp._uncross(res, cross, webp.TILE)
        assert np.array_equal(webp._unpredict([back], [(0, modes, webp.TILE, 64)])[0], x)
        assert np.array_equal(webp._add_green(webp._add_green(x, -1), 1), x)


def test_code_lengths_are_the_best():
    rng = np.random.default_rng(2)
    counts = np.where(rng.random((40, 60)) < 0.5, 0, rng.integers(1, 500, (40, 60)))
    counts[0], counts[1, 1:], counts[1, 0] = 0, 0, 7
    counts[2, :16] = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]
    counts[2, 16:] = 0
    for row, lengths in zip(counts, webp.code_lengths(counts, 30)):
        heap = [int(c) for c in row if c]
        total = 0
        while len(heap) > 1:
            heap.sort()
            heap[:2] = [heap[0] + heap[1]]
            total += heap[0]
        assert (row * lengths).sum() == (total or row.sum()) and ((lengths > 0) == (row > 0)).all()
    short = webp.code_lengths(counts, 7)
    assert short.max() == 7 and (np.where(short > 0, 2.0 ** -short.astype(float), 0).sum(1)[2:] == 1).all()


def test_documents_are_written_with_the_formats_means(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    media, seen = webp.store(docs).collect(), Counter()
    for r in media:
        seen += webp.traits(r.media)
    assert {"palette", "cache", "prefix codes", "literals", "copied", "cached"} <= set(seen)
    assert seen["cached"] > 100_000 and seen["copied"] > 30_000 and seen["prefix codes"] >= 3 * len(media)
    found = {r.doc_id: r for r in webp.features(webp.store(docs)).collect()}
    for r in docs.where("doc_id < 60").collect():
        payload, m = webp.padded((r.text or "").encode()), next(x.media for x in media if x.doc_id == r.doc_id)
        again = b"".join(webp.samples([plain_webp.decode_stream(c)]).tobytes() for c in webp._chunks(m))
        assert again == payload and found[r.doc_id].payload_sha256 == hashlib.sha256(again).hexdigest()


def test_media_query(messy):
    found = webp.features(webp.store(messy)).collect()
    assert len(found) == messy.count()
    texts = {r.doc_id: (r.text or "").encode() for r in messy.collect() if r.doc_id is not None}
    for r in found:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        payload = t + b" " * (-len(t) % 192 or (0 if t else 192))
        m = webp.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and r.feature.startswith(f"{len(payload) // 192}x192 ")
    assert webp.features(webp.store(messy.where("false"))).count() == 0


# languages


def test_code_lengths_by_brute_force():
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": [b"der hund und die katze", "grün".encode()]}
    m = langid.Models(samples)
    total, counts = Counter(), {lang: {} for lang in samples}
    for lang, own in samples.items():
        for t in own:
            s = [0] * 3 + [int(m.symbol[c]) for c in t]
            for i in range(3, len(s)):
                for k in range(4):
                    context = tuple(s[i - k : i])
                    total[context] += 1
                    counts[lang].setdefault(context, Counter())[s[i]] += 1

    def bits(t, lang):
        s, out = [0] * 3 + [int(m.symbol[c]) for c in t], 0.0
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0):
                context = tuple(s[i - k : i])
                n = counts[lang].get(context)
                if (k and total[context] < 2) or not n:
                    continue
                whole, kinds = sum(n.values()), len(n)
                if s[i] in n:
                    out -= math.log2(n[s[i]] / (whole + kinds))
                    break
                out -= math.log2(kinds / (whole + kinds))
            else:
                out += math.log2(m.symbols)
        return out

    texts = [b"the hat", b"", b"und die maus", b"x", "grün zz".encode(), b"t"]
    assert m.bits(texts) == pytest.approx(np.array([[bits(t, lang) for lang in m.langs] for t in texts]), abs=1e-3)


def test_languages_beyond_any_cap(make):
    rng = random.Random(5)
    alphabets = {f"l{i:03d}": rng.sample("abcdefghijklmnopqrstuvwxyz", 7) for i in range(300)}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))

    docs = make([(10 * i + j, text(lang), lang) for i, lang in enumerate(alphabets) for j in range(3)])
    models = langid.fit(docs, total_chars=200_000, skip=None)
    assert models.langs == sorted(alphabets) and models.costs.nbytes <= 260 << 20
    asked = make([(i, text(lang), lang) for i, lang in enumerate(alphabets)])
    langs = dict(enumerate(alphabets))
    assert sum(r.lang_pred == langs[r.doc_id] for r in langid.predict(asked, models).collect()) >= 0.95 * 300
    small = langid.Models({lang: [text(lang).encode()] for lang in alphabets}, most_bytes=1 << 20)
    assert small.costs.nbytes <= 1 << 20 and np.isfinite(small.bits([b"abc"])).all()


@pytest.mark.parametrize("text", ["\u00b2", "\u00bd", "\u2167", "\u2460", "_1 2", "\u00b2 \u2460 9"])
def test_signs_that_are_no_letters(make, text):
    models = langid.Models({"a": [b"some text"]})
    assert [r.lang_pred for r in langid.predict(make([(1, text), (2, text + "\u00e9")]), models).orderBy("doc_id").collect()] == ["und", "a"]


def test_language_accuracy_and_edges(spark, messy):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op9_language(spark, sf).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    models = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r.doc_id: r for r in langid.predict(messy, models).collect() if r.doc_id}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {1, 2, 3, 13} and all(0 <= r.score <= 1 for r in rows.values())
    empty = langid.fit(messy.where("false"))
    assert {r.lang_pred for r in langid.predict(messy, empty).collect()} == {"und"}
    assert langid.predict(messy.where("false"), models).count() == 0


def test_extra_bits_of_lengths_and_distances():
    """The reader's tables by symbol give back what the writer splits, with as many bits."""
    values = np.unique(np.r_[np.arange(1, 5000), 2 ** np.arange(1, 20), 2 ** np.arange(1, 20) + 1, 2**20])
    symbol, extra, bits = webp._split(values)
    assert (webp._EXTRA_BITS[symbol] == bits).all() and (extra <= webp._EXTRA_MASK[symbol]).all()
    assert (webp._LEAST_VALUE[symbol] + extra == values).all()


def random_lengths(rng, size):
    used = rng.sample(range(size), rng.choice((1, 1, 2, 2, 3, 9, min(size, 30), size)))
    counts = np.zeros((1, size), np.int64)
    counts[0, used] = [rng.choice((1, 2, 5, 60, 900)) for _ in used]
    return webp.code_lengths(counts, 12)


def put_code(s, lengths, rng):
    """As the writer puts a code, or with four bits a length, as many as are stated."""
    own = lengths[0].tolist()
    if rng.random() < 0.7 or sum(map(bool, own)) < 2:
        for value, n in zip(*(x.tolist() for x in webp._codes_written(lengths, np.array([len(own)]))[1:])):
            s.put(value, n)
        return
    last = max(i for i, n in enumerate(own) if n) + 1
    s.put(0, 1).put(15, 4)
    for symbol in plain_webp._ORDER:
        s.put(4 if symbol < 16 else 0, 3)
    s.put(1, 1).put(4, 3).put(last - 2, 10)
    for n in own[:last]:
        s.put(int(format(n, "04b")[::-1], 2), 4)


def test_prefix_codes_side_by_side():
    rng, streams, want = random.Random(8), [], []
    for k in range(120):
        cache = rng.choice((0, 0, 3, 8))
        s = Stream().start(1 + k % 5, 1 + k % 3).put(0, 1)
        s.put(1, 1).put(cache, 4) if cache else s.put(0, 1)
        s.put(0, 1)
        begin, codes = s.n, [random_lengths(rng, n) for n in webp._sizes_of_codes(cache)]
        for c in codes:
            put_code(s, c, rng)
        streams.append(s.data())
        want.append((s.n, [c[0].tobytes() for c in codes]))
        one = webp.Bits(s.data(), begin)
        assert [bytes(webp._read_code(one, c.size)) for c in codes] == want[-1][1] and one.at == s.n
    assert [(m.bits.at, *m.groups) for m in webp.read_heads(streams)] == want
    table, starts, entries = webp.code_tables(want[5][1], np.zeros(5, np.int64))
    assert starts.tolist() == [0, *np.cumsum(entries).tolist()[:-1]] and len(table) == entries.sum()
    alone = Stream().start(1, 1).put(0, 1).put(0, 2)  # its code of distances is one symbol, which isn't one of the 40
    for symbol in (0, 0, 0, 0, 77):
        alone.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)
    for bad in (streams[3][: want[3][0] // 8 - 1], alone.data()):
        with pytest.raises(ValueError):
            webp.decode_streams([streams[0], bad])
            webp.read_heads([bad])


def test_the_reader_calls_little_for_an_image():
    """Codes and pixels are read side by side, so that another image of a batch adds its few header fields alone."""
    rng = random.Random(4)
    media = webp.encode_all([webp.padded(" ".join(f"w{rng.randrange(3000)}" for _ in range(150)).encode()) for _ in range(240)])

    def calls(some):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "call"

        sys.setprofile(count)
        try:
            webp.decode_all(some)
        finally:
            sys.setprofile(None)
        return n

    assert calls(media) - calls(media[:120]) < 40 * 120
