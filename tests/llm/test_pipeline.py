"""Each stage of the pipeline, on what the stage before kept, against plain versions."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_mixing import filled
from timberline.llm import langid, mixing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, found[-1], SMALL).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_keeps_documents(stages):
    before, after = stages[0].count(), stages[1].count()
    assert 0.98 * before <= after <= before


def test_exact_copies(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups["".join(words(r.text))].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(min(g)[1] for g in groups.values())


def test_near_copies(stages):
    sets = {}
    for r in stages[2].collect():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in stages[3].collect()) == [i for i in ids if find(i) == i]
    assert len([i for i in ids if find(i) != i]) > 0


def test_mix(stages):
    size, taken, whole = Counter(), Counter(), {}
    for r in stages[3].collect():
        size[r.source] += len(words(r.text))
        whole[r.doc_id] = words(r.text)
    for r in stages[4].collect():
        w = words(r.text)
        taken[r.source] += len(w)
        assert w == whole[r.doc_id][: len(w)] and r.n_chars == len(r.text)
    want = filled(size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_sequences(stages):
    from tokenizers import Tokenizer

    from timberline.llm.packing import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    rows = stages[5].collect()
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in rows:
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert got == want and max(fill.values()) <= 4096
    assert len(fill) <= 1.02 * sum(want.values()) / 4096 + 2


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_awkward_rows_and_none(spark, awkward, nothing, tmp_path):
    """Each stage on what the one before kept, row by row: repeated ids, null ids, equal rows, texts without words."""
    before = spark.conf.get(corpus_pipeline.BATCH)
    for name, docs in (("awkward", awkward), ("nothing", nothing)):
        kept = [docs]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / f"{name}{k}"))
            kept.append(spark.read.parquet(str(tmp_path / f"{name}{k}")))
            assert kept[-1].columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:5]]
        if name == "nothing":
            assert not any(rows) and not kept[5].count()
            continue
        model = langid.fit(awkward)
        assert Counter(rows[1]) == Counter(r for r in rows[0] if model.predict([r[1]])[2][0])
        groups = defaultdict(list)
        for i, t in rows[1]:
            groups["".join(words(t))].append((-len(t), i is None, i, t))
        assert sorted(rows[2], key=str) == sorted([min(g)[2:] for g in groups.values()], key=str)
        sets = []
        for i, t in sorted(rows[2], key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
            sets.append(((i, t), {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}))
        first = [r for k, (r, s) in enumerate(sets) if not any(s and 100 * len(s & o) >= 80 * len(s | o) for _, o in sets[:k])]
        assert sorted(rows[3], key=str) == sorted(first, key=str) and len(first) < len(sets)
        plan = {(r.doc_id, r.size): r.taken for r in mixing.plan(kept[3]).collect()}
        taken = defaultdict(int)
        for i, t in rows[4]:
            taken[i] += len(words(t))
        assert dict(taken) == {i: n for (i, _), n in plan.items() if n}
        assert {r.doc_id for r in kept[5].collect()} == set(taken)
    assert spark.conf.get(corpus_pipeline.BATCH) == before


def test_stages_decide_row_by_row(spark, tmp_path):
    """Unique texts stay that share their id, or its absence, with copies."""
    prose = [f"{a} and {b} with the {c} of some other {a} near" for a, b, c in zip("house river garden winter stone".split(), "table mirror candle ladder bridge".split(), "night field forest morning city".split(), strict=True)]
    pairs = [(1, prose[0]), (2, prose[0].replace(" ", "  ")), (2, prose[1]), (2, prose[2]), (None, prose[0]), (None, prose[3]), (3, prose[4]), (3, prose[4])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact_copies(spark, df, SMALL)
    assert Counter("".join(words(r.text)) for r in once.collect()) == Counter({"".join(words(t)) for t in prose})
    near = corpus_pipeline.near_copies(spark, df, SMALL)
    assert Counter(" ".join(words(r.text)) for r in near.collect()) == Counter(set(prose))
