"""Each stage of the pipeline on what the stage before kept."""

from collections import Counter

import pytest

import corpus_pipeline
from test_groups import clamped, exact_runs, jaccard_groups
from test_maps import WORD, base
from vectryx.llm import minhash, mixing, pieces, quality, substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "encoded"]
    for name, (docs, out) in list(stages.items())[:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_decisions(stages):
    docs, out = stages["quality_rules"]
    assert ids(out) == Counter(r.doc_id for r in quality.judge(docs).collect() if r.kept)
    docs, out = stages["near_duplicates"]
    assert ids(out) == Counter(r.doc_id for r in minhash.near_duplicates(docs, 5, 80).collect() if r.kept)
    docs, out = stages["repeated_passages"]
    cut = {r.doc_id: (r.start_word, r.n_words) for r in substring.passages(docs).collect()}
    after = {r.doc_id: r.text for r in out.collect()}
    for r in docs.collect():
        if r.doc_id not in cut:
            assert after[r.doc_id] == r.text
        elif r.doc_id in after:
            assert len(after[r.doc_id].encode().split()) < len(r.text.encode().split())
    docs, out = stages["source_mix"]
    assert ids(out) == +Counter({r.doc_id: r.repeats for r in mixing.mix(docs).collect()})
    docs, out = stages["encoded"]
    codec = pieces.codec(pieces.model_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids(out) == ids(docs)
    assert all(list(r.ids) == codec.library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out.collect())


def test_stages_by_brute_force(stages):
    """What stays, on what the stage before kept, without the operators: base rules, all pairs of sets, equal runs, water-filling, the library."""
    docs, out = stages["quality_rules"]
    kept = ids(out)
    for r in docs.collect():
        n, *_, repeat = base(r.text or "")
        assert not (kept[r.doc_id] and (n < 50 or 100 * repeat > 50 * n))
    docs, out = stages["near_duplicates"]
    groups = jaccard_groups({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert ids(out) == Counter(i for i, (_, component) in groups.items() if i == component)
    docs, out = stages["repeated_passages"]
    before, after = ({r.doc_id: r.text.split() for r in x.collect()} for x in (docs, out))
    longest = exact_runs({i: " ".join(w) for i, w in before.items()})
    for i, w in before.items():
        left = after.get(i, [])
        assert left == w or len(left) <= len(w) - 50  # a passage has 50 words at least
        if longest[i] >= 50:
            assert len(left) <= len(w) - longest[i]
        it = iter(w)
        assert all(x in it for x in left)  # nothing was put in or moved
    assert max((n for i, n in exact_runs({i: " ".join(w) for i, w in after.items()}).items()), default=0) < 50
    docs, out = stages["source_mix"]
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda x: (x is None, x))
    targets = dict(zip(order, clamped([sizes[x] for x in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    taken, most = Counter(), max(len(WORD.findall(r.text)) for r in docs.collect())
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[x] - t) <= most / 2 + 1 for x, t in targets.items()) and max(ids(out).values()) <= 2


def test_run_and_restart(spark, stages, tmp_path):
    want = ids(stages["encoded"][1])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF, str(tmp_path / "a")).collect()) == want
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["2-repeated_passages", "3-source_mix"]
    # a run that broke off while its third stage was written goes on from the second
    stages["near_duplicates"][1].write.parquet(str(tmp_path / "b" / "1-near_duplicates"))
    (tmp_path / "b" / "2-repeated_passages").mkdir()
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF, str(tmp_path / "b")).collect()) == want
    assert not (tmp_path / "b" / "0-quality_rules").exists()
