"""Classifiers, rules, joins, shards and the pipeline."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tesserae.llm import components, cotraining, jaccard_join, language_id, stratified_shards, toxicity, weak_supervision  # noqa: E402


def test_gradients():
    rng = np.random.default_rng(0)
    block = next(toxicity.tb.blocks(pa.array(["some words here and there", "other words there"])))
    found, hashes, data = toxicity.words_of(block)
    distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    lexicon = toxicity.Lexicon(data, found.start[first], found.end[first])
    network = toxicity.Network(distinct[:4], (np.array([3, 1, 0, 2, 0]), np.array([4, 4, 4, 4, 0])), (rng.random(1 << toxicity.GRAM_BITS),) * 2, 0.3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    at, mask, _ = toxicity.windows(found.offsets)
    index = np.where(mask, word[at], len(distinct))
    slope = np.array([0.7, -0.3])

    def value():
        x, _ = network.inputs(distinct, lexicon)
        return float(network.forward(x.astype(float), index, mask.astype(float)) @ slope)

    x, parts = network.inputs(distinct, lexicon)
    _, kept = network.forward(x.astype(float), index, mask.astype(float), keep=True)
    g = network.backward(x.astype(float), parts, kept, slope)
    for name in ("Wf", "Ub", "cf", "A", "u", "o", "k"):
        place = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        for sign in (1, -1):
            network.p[name][place] += sign * 1e-3 * (1 if sign == 1 else 2)
            if sign == 1:
                up = value()
        down = value()
        network.p[name][place] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][place]) < 0.05 * abs(g[name][place]) + 1e-4


def word(rng):
    return "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 7)))


def test_toxicity(spark, make, awkward):
    rng = np.random.default_rng(2)
    bad = ["wretch", "vermin", "filthoid", "filthish"]
    texts, labels = [], []
    for i in range(400):
        words = [word(rng) for _ in range(rng.integers(5, 120))]
        if i % 4 == 0:
            words[rng.integers(len(words))] = bad[i // 4 % 4]
        texts.append((100 + i, " ".join(words)))
        labels.append((100 + i, 1, int(i % 4 == 0)))
    docs = make([*awkward, *texts])
    given = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(docs, given.where("doc_id is null or doc_id < 400"))
    rows = toxicity.scored(docs, scorer).collect()
    assert len(rows) == len(awkward) + len(texts) and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[2] == score[3] == score[4] == 0
    held = [(score[i], t) for i, _, t in labels if i >= 400]
    right = np.mean([(s >= toxicity.THRESHOLD) == t for s, t in held])
    assert right > 0.9
    left = toxicity.without_toxic(docs, scorer)
    assert left.columns == docs.columns and left.count() == sum(r.score < toxicity.THRESHOLD for r in rows)
    assert toxicity.scored(make([]), scorer).count() == 0
    none = toxicity.fit(make([]), given)
    assert all(0 <= r.score < 0.01 for r in toxicity.scored(make(awkward), none).collect())


def test_language(make, awkward):
    rng = np.random.default_rng(3)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(rng.integers(3, 80)))

    one = make([(1000 + i, text("aeioulmnst")) for i in range(120)], lang="xa")
    two = make([(2000 + i, text("éàèçuopqrz")) for i in range(120)], lang="xb")
    docs = one.unionByName(two).unionByName(make(awkward, lang=None))
    model = language_id.fit(docs.where("doc_id % 5 != 0"))
    rows = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    held = [(rows[i].lang_pred, "xa" if i < 2000 else "xb") for i in [*range(1000, 1120, 5), *range(2000, 2120, 5)]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].doubtful for i in (2, 3, 4))
    assert rows[6].lang_pred in ("xa", "xb") and 0 <= rows[6].score <= 1
    assert language_id.predicted(make([]), model).count() == 0
    empty = language_id.fit(make([]))
    assert {r.lang_pred for r in language_id.predicted(make(awkward), empty).collect()} == {"und"}
    single = language_id.fit(one)
    assert {r.lang_pred for r in language_id.predicted(make(awkward), single).collect()} == {"und", "xa"}


def test_cotraining(spark, make, awkward):
    rng = np.random.default_rng(4)
    good, bad, labels = [], [], []
    for i in range(300):
        words = [word(rng) for _ in range(rng.integers(20, 60))]
        if i % 3 == 0:
            bad.append((100 + i, "###".join(words)))
        else:
            good.append((100 + i, " ".join(words)))
        if i < 240:
            labels.append((100 + i, int(i % 3 != 0), 0))
    docs = make(good, source="clean").unionByName(make(bad, source="dump")).unionByName(make(awkward, source=None, lang=None))
    given = spark.createDataFrame([*labels, (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    pair = cotraining.fit(docs, given)
    rows = cotraining.scored(docs, pair).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id: r.kept for r in rows}
    assert np.mean([kept[100 + i] == (i % 3 != 0) for i in range(240, 300)]) > 0.95
    assert cotraining.scored(make([]), pair).count() == 0
    constant = cotraining.fit(docs, given.limit(0))
    assert len({r.score for r in cotraining.scored(docs, constant).collect()}) == 1


def test_cotraining_searches_all_documents(spark, make):
    """A rare kind of junk that comes last in the order of hashes, behind more than 4,000 unlabelled documents."""
    rng = np.random.default_rng(5)
    order = [r.id for r in spark.range(10_000, 14_400).orderBy(F.xxhash64("id"), "id").collect()]
    rare, labelled = order[-60:], range(240)

    def text(junk=""):
        return (junk or " ").join(word(rng) for _ in range(rng.integers(20, 40)))

    clean = make([(i, text()) for i in [*(i for i in labelled if i % 3), *order[:-60]]], source="clean")
    dump = make([(i, text("###")) for i in labelled if i % 3 == 0], source="dump").unionByName(make([(i, text(" @@@ ")) for i in rare], source="dump"))
    given = spark.createDataFrame([(i, int(i % 3 != 0)) for i in labelled], "doc_id long, quality int")
    docs = clean.unionByName(dump)
    pair = cotraining.fit(docs, given)
    junk, good = (pa.array([text(kind) for _ in range(20)]) for kind in (" @@@ ", ""))
    low, high = (pair.views[0].logit(cotraining.content(next(cotraining.tb.blocks(x)))) for x in (junk, good))
    assert low.max() < 0 < np.median(high)


def test_cotraining_chooses_the_surest(spark, make, awkward):
    docs = make([(i, "#" * (5 + i % 200) + "a" * (5 + i % 300)) for i in range(900)]).unionByName(make(awkward))
    model = [cotraining.Logistic((1 << cotraining.BITS) + 3), cotraining.Logistic(2 * cotraining.KNOWN + 5)]
    model[1].w[-5] = 10.0
    model[1].b = -5.5
    keyed = docs.where("text is not null").withColumn("key", F.xxhash64("text"))
    given = spark.createDataFrame([(7,), (599,)], "doc_id long")
    picks = cotraining.surest(keyed, given, {}, model, [np.zeros(0, np.int64)] * 2, (3, 40))
    assert picks[0, 0] == picks[0, 1] == []
    size = {r.key: np.log1p(len(r.text.encode())) - 5.5 for r in keyed.collect() if r.doc_id not in (7, 599)}
    for value, n in ((0, 3), (1, 40)):
        sure = sorted((-round(z if value else -z, 4), key) for key, z in size.items() if (z if value else -z) >= np.log(9))
        got = [key for _, key in picks[1, value]]
        assert len(got) == min(n, len(sure)) > 0 and len(set(got)) == len(got)
        assert np.allclose([size[k] for k in got], [-s if value else s for s, _ in sure[: len(got)]], atol=1e-3)
    again = cotraining.surest(keyed, given, {}, model, [np.array([key for _, key in picks[1, 1]]), np.zeros(0, np.int64)], (3, 40))
    assert not set(again[1, 1]) & set(picks[1, 1])


SPACE = r"[\x20\x09-\x0D]+"


def brute_measures(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_measures_and_posteriors(make, awkward):
    rng = np.random.default_rng(6)
    texts = [(100 + i, "".join(rng.choice(["a ", "b ", "cd ", "e\n", "#x ", "Ü ", "\t\n"], rng.integers(0, 200)))) for i in range(150)]
    docs = make([*awkward, *texts])
    rows = weak_supervision.judged(docs).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i or -1, *brute_measures(t)) for i, t in [*awkward, *texts])
    names = list(weak_supervision.RULES)
    votes = np.array([[np.nan if r[f"v_{n}"] is None else r[f"v_{n}"] for n in names] for r in rows], float)
    a = b = np.full(len(names), weak_supervision.START)
    prior = weak_supervision.PRIOR

    def posterior():
        up = np.where(np.isnan(votes), 0, np.where(votes == 1, np.log(a / (1 - b)), np.log((1 - a) / b)))
        return 1 / (1 + np.exp(-(up.sum(1) + np.log(prior / (1 - prior)))))

    low, high = weak_supervision.LOW, weak_supervision.HIGH
    for _ in range(weak_supervision.ITERATIONS):
        p = posterior()[:, None]
        cast = ~np.isnan(votes)
        a = np.clip((((votes == 1) * p).sum(0) + 1) / ((cast * p).sum(0) + 2), low, high)
        b = np.clip((((votes == 0) * (1 - p)).sum(0) + 1) / ((cast * (1 - p)).sum(0) + 2), low, high)
        prior = min(high, max(1 - high, (p.sum() + 1) / (len(p) + 2)))
    assert np.allclose(posterior(), [r.posterior for r in rows], atol=1e-6)
    assert weak_supervision.judged(make([])).count() == 0


def brute_components(docs, width=5):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def similar_documents():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for c in range(6):
        base = list(rng.choice(words, rng.integers(20, 80)))
        for k in range(25):  # drifting copies: chains whose ends aren't similar
            base[rng.integers(len(base))] = str(rng.choice(words))
            docs.append((1000 * c + k, " ".join(base) if k % 7 else "  ".join(base).upper()))
    passage = list(rng.choice(words, 60))
    docs += [(9000 + i, " ".join([*rng.choice(words, 30), *passage])) for i in range(40)]
    docs += [(9500 + i, "one two three") for i in range(3)] + [(9600, "one two"), (9601, ""), (9602, " "), (9603, "one two three four five"), (9604, "One Two Three Four FIVE")]
    return docs


@pytest.mark.parametrize("partitions, sent", [(3, None), (40, None), (5, 0)])
def test_components_of_similar_documents(make, partitions, sent):
    docs = similar_documents()
    found = jaccard_join.jaccard_components(make(docs).repartition(partitions), sent=sent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(docs)


def test_links_between_similar_documents(make):
    docs = similar_documents()
    sets, first = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets[i] = first.setdefault(s, i) if s else i
    whole = {i: s for s, i in first.items()}
    want = {(x, y) for x in whole for y in whole if x < y and 100 * len(whole[x] & whole[y]) >= 75 * len(whole[x] | whole[y])}
    links, rows = jaccard_join.jaccard_links(make(docs))
    assert {tuple(r) for r in links.select("x", "y").collect()} == want
    assert {r.doc_id: (r.class_id, r.links) for r in rows.collect()} == {i: (c, sum(c in p for p in want)) for i, c in sets.items()}


def test_shingle_counts_do_not_depend_on_partitions(make):
    docs = make([(i, f"a b c d e f{i % 7} g h i j {i}") for i in range(60)])
    seen = [sorted(map(tuple, jaccard_join.shingle_counts(docs.repartition(n), total, least=3).collect())) for n, total in ((2, 10), (30, 10**8))]
    assert seen[0] == seen[1] and max(n for _, n in seen[0]) == 60


def test_similar_documents_of_awkward_rows(make, awkward):
    rows = jaccard_join.jaccard_components(make(awkward)).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[11].component_id == by[11].class_id == 1 and by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[None].component_id is None and by[None].n_shingles > 0 and by[12].component_id == 12
    assert jaccard_join.jaccard_components(make([])).count() == 0
    left = jaccard_join.one_per_component(make(awkward))
    assert left.columns == make(awkward).columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 12]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 1), (5, 3), (3, 9), (9, 5), (None, 4), (7, None)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 100 for i in range(100, 161)} | {1: 1, 3: 3, 5: 3, 9: 3}
    assert {r.id: r.component for r in found} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows_per_stretch", [10, 100_000])
def test_shards(make, awkward, rows_per_stretch):
    docs = make([(i, f"t{i % 50}") for i in range(500)], source="big").unionByName(make([(1000 + i, None) for i in range(131)], source=None))
    docs = docs.unionByName(make([(2000 + i, "é") for i in range(40)], source="small")).unionByName(make(awkward))
    rows = stratified_shards.interleaved(docs, 16, rows_per_stretch=rows_per_stretch).collect()
    assert len(rows) == docs.count()
    for shard in range(16):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) in (len(rows) // 16, len(rows) // 16 + 1)
        assert abs(sum(r.source == "big" for r in own) - 500 / 16) <= 2 and abs(sum(r.source == "small" for r in own) - 40 / 16) <= 2
    assert {r.size for r in rows if r.doc_id is not None and r.doc_id >= 2000} == {3} and stratified_shards.interleaved(make([])).count() == 0
    again = {(r.doc_id, r.text_crc32): r.shard for r in stratified_shards.interleaved(docs, 16, rows_per_stretch=77).collect() if r.doc_id != 5}
    assert again == {(r.doc_id, r.text_crc32): r.shard for r in rows if r.doc_id != 5}


def test_pipeline_of_awkward_rows(spark, make, awkward, tmp_path):
    folder = str(tmp_path)
    make(awkward).drop("score", "label").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a text without an id has words too")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    assert None not in ids and 11 not in ids and {2, 3, 4, 8, 12} <= set(ids)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_begin_with_collected_executors(spark, make, tmp_path):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.encode(spark, make([(1, "one two")]), str(tmp_path))
    assert full() > before
