"""Each operator against brute force, an exact round trip or held-out rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import plain
from quernmill.llm import bpe, bytescan, components, decontaminate, fingerprints, fmindex, langid, neardup, pii, quality, secretscan, substrings, toxicity

words = plain.words


def invented(rng, n, vocabulary=4000):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_word_hashes_tell_words_apart():
    texts = ["Ab cd, ab", "", "é1-é1", "ab"]
    data, offs = bytescan.lowered(pa.array(texts))
    own = bytescan.Words(data, offs)
    assert np.diff(own.first).tolist() == [3, 0, 2, 1]
    h = own.hash
    assert h[0] == h[2] == h[5] != h[1] and h[3] == h[4]
    assert h[0] == bytescan.hash_words("ab")[0]


def test_samples_collide_as_often_as_weighted_sets_overlap():
    rng = random.Random(1)
    errors = []
    for _ in range(40):
        a = invented(rng, 150, 60)
        b = edited(rng, a, rng.random())
        x, y = Counter(words(a)), Counter(words(b))
        true = sum((x & y).values()) / sum((x | y).values())
        f = fingerprints.fingerprint_texts(pa.array([a, b]), 1024).to_pylist()
        errors.append(np.mean(np.array(f[0]) == np.array(f[1])) - true)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.03


def test_registers_agree_as_often_as_distributions_overlap():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        a = invented(rng, 200, 80)
        b = edited(rng, a, rng.random() * 0.5) + " " + a[: rng.randrange(1, 400)]
        grams = [Counter(zip(w, w[1:], w[2:], strict=False)) for w in (words(a), words(b))]
        x, y = ({k: v / sum(g.values()) for k, v in g.items()} for g in grams)
        # probability Jaccard: for each common element, one over the sum of the greater ratios
        true = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        s, _ = neardup.sign_texts(pa.array([a, b]))
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_near_duplicates_find_planted_groups(spark):
    rng = random.Random(3)
    rows, truth, n = [], {}, 0
    for g in range(60):
        base = invented(rng, rng.choice([40, 150, 600]))
        for k in range(rng.choice([1, 1, 2, 3, 40])):
            rows.append((n, base if k % 3 == 1 else edited(rng, base, 0.04) if k else base))
            truth[n] = g
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root_id"] for r in neardup.groups(docs).collect()}
    assert all(truth[a] == truth[b] for a, b in got.items())
    want = [d for d in truth if min(x for x in truth if truth[x] == truth[d]) != d]
    assert sum(got.get(d, d) != d for d in want) >= 0.95 * len(want)


def test_bucket_edges_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 25))
        sigs = rng.integers(0, 3, (n, 40)).astype(np.uint8)
        sigs[rng.integers(0, n, n // 2)] = sigs[0]
        least = int(np.ceil(0.4 * 40))
        one, two = components.Forest(), components.Forest()
        for i in range(n):
            for j in range(i):
                if (sigs[i] == sigs[j]).sum() >= least:
                    one.join(i, j)
        for a, b in neardup.bucket_edges(np.arange(n), sigs, 0.4):
            two.join(a, b)
        assert [one.find(i) for i in range(n)] == [two.find(i) for i in range(n)]


@pytest.mark.parametrize(("bucket", "side", "stars"), [(4096, 2048, 6), (8, 5, 6), (8, 5, 1), (2, 3, 2), (20, 7, 3)])
def test_links_of_buckets_of_any_size_connect_what_all_pairs_connect(spark, bucket, side, stars):
    """Near copies of one text, chains of ever farther ones, and strangers that share a bucket."""
    rng = np.random.default_rng(41)
    base = rng.integers(0, 250, neardup.REGISTERS).astype(np.uint8)
    sigs = []
    for k in range(90):
        x = base.copy()
        at = rng.permutation(neardup.REGISTERS)[: [6, 60, 70, 80, 128][k % 5]]
        x[at] = rng.integers(0, 250, len(at))
        sigs.append(x)
    for k in range(40):  # a chain: each is similar to the one before it only
        x = sigs[-1].copy()
        at = rng.permutation(neardup.REGISTERS)[:55]
        x[at] = rng.integers(0, 250, len(at))
        sigs.append(x)
    least = int(np.ceil(neardup.THRESHOLD * neardup.REGISTERS))
    keys = {k: sorted(rng.choice(len(sigs), size, replace=False).tolist()) for k, size in enumerate((130, 130, 100, 40, 9, 3, 1))}
    want, got = components.Forest(), components.Forest()
    for members in keys.values():
        for i in members:
            for j in members:
                if j < i and (sigs[i] == sigs[j]).sum() >= least:
                    want.join(i, j)
    keyed = spark.createDataFrame([(i, k) for k, members in keys.items() for i in members], "node long, key long")
    heads = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "node long, sig binary")
    for r in neardup.bucket_links(keyed, heads, bucket, side, stars).collect():
        got.join(r["a"], r["b"])
    assert [got.find(i) for i in range(len(sigs))] == [want.find(i) for i in range(len(sigs))]


def test_near_duplicates_of_a_large_bucket(spark):
    """A boilerplate page in 120 versions is one group, whether or not its buckets fit a row."""
    rng = random.Random(42)
    page = invented(rng, 200, 10**6)
    docs = [(i, edited(rng, page, 0.03)) for i in range(120)] + [(200 + i, invented(rng, 200, 10**6)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"bucket": 10, "side": 7, "stars": 2}):
        got = {r["doc_id"]: r["root_id"] for r in neardup.groups(frame, **sizes).collect()}
        assert got == {i: 0 for i in range(120)}


def test_local_stars_in_pieces_connect_the_same():
    rng, forest, want = random.Random(43), components.Forest(), components.Forest()
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges[k : k + 10]]), pa.array([b for _, b in edges[k : k + 10]])], ["a", "b"]) for k in range(0, 150, 10)]
    for a, b in edges:
        want.join(a, b)
    for out in components.local_stars(iter(batches), 15):
        for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    assert [forest.find(x) for x in range(200)] == [want.find(x) for x in range(200)]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(100)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.find(x) for e in edges for x in e if forest.find(x) != x}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r["node"]: r["root"] for r in components.components(frame).collect()} == want


def test_components_never_return_unfinished_edges(spark):
    path = list(range(300))
    random.Random(6).shuffle(path)
    frame = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long").repartition(16)
    with pytest.raises(RuntimeError):
        components.components(frame, rounds=1)
    assert {tuple(r) for r in components.components(frame).collect()} == {(x, 0) for x in range(1, 300)}


smith_waterman = plain.smith_waterman


def test_alignment_against_the_plain_recurrence():
    rng = random.Random(6)
    pairs = [([rng.randrange(5) for _ in range(rng.randrange(1, 40))], [rng.randrange(5) for _ in range(rng.randrange(1, 20))]) for _ in range(200)]
    got = decontaminate.align([np.array(p, np.uint64) * 8 for p, _ in pairs], [np.array(q, np.uint64) * 8 for _, q in pairs], cells=400)
    assert np.allclose(got, [smith_waterman(p, q) for p, q in pairs])


def scores(frame):
    return {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in frame.collect()}


@pytest.mark.parametrize("vocabulary", [900, 40])
def test_decontamination_finds_what_aligning_everything_finds(spark, vocabulary):
    """All pairs that align and share a trigram, with the score of aligning the whole document; and as many in slices."""
    rng = random.Random(7)
    items = [(i, invented(rng, rng.randrange(12, 50), vocabulary)) for i in range(20)]
    items += [(30, items[3][1]), (31, edited(rng, items[4][1], 0.1))]
    docs = []
    for d in range(120):
        text = invented(rng, rng.randrange(5, 300), vocabulary)
        if d % 3 == 0:
            text += " " + edited(rng, rng.choice(items)[1], rng.choice([0, 0.1, 0.2])) + " " + invented(rng, 30, vocabulary)
        docs.append((d, text))
    trigrams = lambda t: set(zip(words(t), words(t)[1:], words(t)[2:], strict=False))
    want = {(d, i): round(x, 9) for d, t in docs for i, y in items if trigrams(t) & trigrams(y) and (x := smith_waterman(words(t), words(y))) >= decontaminate.THRESHOLD}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = scores(decontaminate.matches(d, b))
    assert got == want and len(want) > 20
    assert scores(decontaminate.matches(d, b, limit=300)) == want
    clean = {k for k, _ in docs} - {k for k, _ in want}
    assert {r["doc_id"] for r in decontaminate.keep_clean(d, b, limit=300).collect()} == clean


def test_trigrams_that_the_corpus_is_full_of_are_no_seeds(spark):
    """A common trigram joins nothing; copies of an item, exact or edited, however many, don't make its trigrams common."""
    rng = random.Random(72)
    items = [(i, f"{invented(rng, 10, 10**6)} one of the {invented(rng, 12, 10**6)}") for i in range(4)] + [(9, "one of the")]
    broken = " ".join(f"z{k}" if k % 5 == 2 else w for k, w in enumerate(items[1][1].split()))
    docs = [(d, f"{invented(rng, 9, 10**6)} one of the {invented(rng, 9, 10**6)}") for d in range(200)]
    docs += [(1000 + d, items[0][1]) for d in range(200)] + [(2000 + d, f"{broken} {d}") for d in range(200)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = b.select("item_id", "text").mapInArrow(decontaminate._item_grams, "item long, size long, gram long").distinct()
    seeds = {r["item"]: r["count"] for r in decontaminate.seeds_of(d, grams).groupBy("item").count().collect()}
    assert seeds == dict.fromkeys(range(4), 23 - 1 + 21) | {9: 1}
    got = set(scores(decontaminate.matches(d, b)))
    assert {x for x in got if x[1] != 9} == {(1000 + k, 0) for k in range(200)} | {(2000 + k, 1) for k in range(200)}
    assert {x[0] for x in got if x[1] == 9} == {k for k, t in docs if "one of the" in t}


@pytest.mark.parametrize("full", [False, True])
def test_rarity_counts_every_context_of_every_document(spark, monkeypatch, full):
    """Trigrams in just as many contexts as are allowed are seeds, those in one more aren't, although the limit is many times FLOOR; nor do runs count that the bit set holds by mistake."""
    monkeypatch.setattr(decontaminate, "FLOOR", 5)
    monkeypatch.setattr(decontaminate, "RARE", 0.05)
    if full:
        made = decontaminate.BitSet.__init__

        def all_ones(self, expected):
            made(self, expected)
            self.bits[:] = 255

        monkeypatch.setattr(decontaminate.BitSet, "__init__", all_ones)
    rng = random.Random(73)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(40)]
    parts = [[] for _ in range(400)]
    for i in range(40):
        for d in rng.sample(range(400), 20 + i % 2):
            parts[d].append(f"a{i} b{i} c{i} {invented(rng, 3, 10**6)}")
        for d in rng.sample(range(400), 30):
            parts[d].append(f"{items[i][1]} {invented(rng, 3, 10**6)}")
    d = spark.createDataFrame([(k, f"{invented(rng, 3, 10**6)} {' '.join(x)}") for k, x in enumerate(parts)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    grams = b.select("item_id", "text").mapInArrow(decontaminate._item_grams, "item long, size long, gram long").distinct()
    for limit in (10**6, 50):
        seeds = {r["item"]: r["count"] for r in decontaminate.seeds_of(d, grams, limit).groupBy("item").count().collect()}
        assert seeds == {i: 2 + 4 - i % 2 for i in range(40)}


def test_pipeline_drops_what_exact_rarity_finds(spark, monkeypatch, tmp_path):
    """Half an item is dropped wherever its one trigram stands in just as many contexts as are allowed, and kept if in one more."""
    import corpus_pipeline

    monkeypatch.setattr(decontaminate, "FLOOR", 5)
    monkeypatch.setattr(decontaminate, "RARE", 0.05)
    rng = random.Random(74)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(20)]
    docs = [(1000 * i + k, f"{invented(rng, 5, 10**6)} a{i} b{i} c{i} {invented(rng, 5, 10**6)}") for i in range(20) for k in range(20 + i % 2)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in docs if r[0] // 1000 % 2)


@pytest.mark.parametrize("copies", [0, 1, 5])
def test_edited_copies_are_found_beside_exact_ones(spark, copies):
    rng = random.Random(71)
    item = invented(rng, 40, 10**6)
    broken = " ".join(f"z{k}" if k % 5 == 2 else w for k, w in enumerate(item.split()))
    docs = [(d, f"{invented(rng, 30, 10**6)} {item if d else broken} {invented(rng, 30, 10**6)}") for d in range(copies + 1)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.matches(d, b).collect()}
    assert got == pytest.approx({0: smith_waterman(words(docs[0][1]), words(item))} | {k: 1.0 for k in range(1, copies + 1)})
    assert got[0] >= decontaminate.THRESHOLD


def test_index_against_all_windows():
    rng = np.random.default_rng(8)
    for _ in range(25):
        base = rng.integers(0, 4, 60)
        seqs = []
        for _ in range(12):
            x = rng.integers(0, 4, rng.integers(1, 30)).tolist()
            if rng.random() < 0.7:
                a = int(rng.integers(0, 40))
                x += base[a : a + int(rng.integers(3, 20))].tolist() + rng.integers(0, 4, 3).tolist()
            seqs.append(x)
        owner, w = rng.integers(0, 8, 12), 6
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
        flat = np.concatenate([np.array(s) for s in seqs])
        index = fmindex.FMIndex(flat, bounds, owner, 64)
        q, a, b = fmindex.shared_windows(index, flat, bounds[:-1], bounds[1:], w)
        got = {(int(x), int(k - bounds[x])) for x, s, e in zip(q, a, b, strict=True) for k in range(s, e - w + 1)}
        held = defaultdict(set)
        for i, s in enumerate(seqs):
            for k in range(len(s) - w + 1):
                held[tuple(s[k : k + w])].add(owner[i])
        assert got == {(i, k) for i, s in enumerate(seqs) for k in range(len(s) - w + 1) if len(held[tuple(s[k : k + w])]) > 1}


def all_repeats(docs, window):
    held = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            held[tuple(w[k : k + window])].add(i)
    out = set()
    for i, t in docs:
        w, now = words(t), None
        for k in range(len(w) - window + 1):
            if len(held[tuple(w[k : k + window])]) > 1:
                if now and k <= now[1]:
                    now[1] = k + window
                else:
                    if now:
                        out.add((i, *now))
                    now = [k, k + window]
        if now:
            out.add((i, *now))
    return out


def repeated(spark, docs, **options):
    return sorted(tuple(r) for r in substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect())


@pytest.mark.parametrize("heavy", [substrings.HEAVY_WORDS, 300, 0])
def test_repeats_against_all_windows(spark, heavy):
    rng = random.Random(9)
    shared = [invented(rng, n) for n in (49, 50, 51, 120, 400)]
    docs = [(i, " ".join([invented(rng, rng.randrange(0, 80)), rng.choice(shared), invented(rng, rng.randrange(0, 80))])) for i in range(40)]
    docs += [(100, "la " * 300), (101, "la " * 120 + invented(rng, 60)), (102, edited(rng, shared[4], 0.02))]
    docs += docs[:3]  # repeated rows are one document
    assert repeated(spark, docs, heavy_words=heavy) == sorted(all_repeats(docs, substrings.WINDOW))


def test_a_passage_that_most_documents_have_is_split(spark):
    """One passage in 300 documents, each time in another context: its keys are heavy, all others aren't."""
    rng = random.Random(91)
    passage = invented(rng, 70)
    docs = [(i, f"{invented(rng, 45, 10**6)} {passage} {invented(rng, 45, 10**6)}") for i in range(300)] + [(400 + i, invented(rng, 100, 10**6)) for i in range(50)]
    assert repeated(spark, docs, heavy_words=5000) == repeated(spark, docs) == [(i, 45, 115) for i in range(300)]


def test_bpe_is_that_of_the_whole_text():
    own, rng = bpe.codec(), random.Random(10)
    for n in range(400):
        text = "".join(rng.choice("ab \n\t'st1é！日  .  ") for _ in range(rng.randint(0, 300)))
        tokens = own.encode(text, leaf=rng.randint(1, 40))
        assert tokens.tolist() == own.leaf(text)
        assert own.decode_tree(tokens, leaf=rng.randint(1, 9)).decode() == text


def test_pii_on_lines_not_trained_on():
    model = pii.train(pii.labelled())
    rows = pii._lines(4242, 300)
    r, k, s, e = pii.find_texts(pa.array([t for t, _ in rows]), model)
    got = {(int(a), int(c), int(d), pii.KINDS[b]) for a, b, c, d in zip(r, k, s, e, strict=True)}
    want = {(i, a, b, kind) for i, (_, found) in enumerate(rows) for a, b, kind in found}
    assert len(got & want) > 0.97 * len(want) and len(got & want) > 0.97 * len(got)


def test_viterbi_with_sure_words_against_plain_viterbi():
    rng = np.random.default_rng(11)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        scores = rng.normal(0, 2, (n, 8))
        scores[rng.random(n) < 0.6, 0] += 12
        moves = rng.normal(0, 1, (8, 8))
        cut = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 2)]))
        want = np.concatenate([pii.viterbi(scores[None, a:b], moves)[0] for a, b in zip(cut[:-1], cut[1:], strict=True)])
        assert pii.decode(scores, cut, moves).tolist() == want.tolist()


def test_language_of_texts_not_trained_on():
    rng = random.Random(12)
    parts = {"xx": "ka lo mi tu ren sol".split(), "yy": "sch ung ein keit ver st".split()}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(120))
    model = langid.train([(lang, make(lang)) for lang in parts for _ in range(40)])
    rows = [(lang, make(lang)) for lang in parts for _ in range(50)]
    got, _ = langid.classify_texts(pa.array([t for _, t in rows] + ["ok"]), model)
    assert sum(g == lang for g, (lang, _) in zip(got, rows, strict=False)) >= 98 and got[-1] == langid.UNKNOWN


def test_toxic_misspellings_are_found():
    rng = random.Random(13)
    bad = ["worthless", "disgusting", "pathetic"]
    bend = lambda w: w[:3] + rng.choice("xyz") + w[4:]
    make = lambda toxic, f: " ".join([*invented(rng, 40).split(), *([f(rng.choice(bad))] if toxic else []), *invented(rng, 20).split()])
    y = np.array([i % 2 for i in range(300)])
    model = toxicity.train([make(t, lambda w: w) for t in y], y)
    p = toxicity.score_texts(pa.array([make(t, bend) for t in y]), model)
    assert (p[y == 1] >= model.threshold).mean() > 0.8 and (p[y == 0] >= model.threshold).mean() < 0.05


def test_quality_on_texts_not_trained_on():
    rng = random.Random(14)
    make = lambda good: invented(rng, rng.randint(5, 200)) if good else " ".join(w + rng.choice(["###", "%%%"]) for w in invented(rng, rng.randint(5, 200)).split())
    y = np.array([i % 2 for i in range(200)])
    model = quality.train([make(t) for t in y], y)
    assert ((quality.score_texts(pa.array([make(t) for t in y]), model) >= 0.5) == y).mean() > 0.97


def test_chunks_cover_every_byte():
    filters = np.zeros((quality.TAPS, 256, quality.FILTERS), np.float32)
    filters[:, ord("Q"), 0] = 1.0
    model = quality.Model(filters, np.zeros(quality.FILTERS, np.float32), np.concatenate([np.zeros(quality.FILTERS), [1.0], np.zeros(quality.FILTERS - 1)]), -0.5)
    for n in (0, 1, 255, 256, 511, 5000):
        assert quality.score_texts(pa.array(["a" * n + "Q" + "b" * 700]), model)[0] > 0.6
    assert quality.score_texts(pa.array(["a" * 3000]), model)[0] < 0.4


TOKEN = "ghp_" + "a1B2" * 9


def plain_findings(history, rules):
    """(path, rule, version, occurrences) of every version (path, text), by re."""
    return {(p, r.name, r.version, n) for p, t in history if t is not None for r in rules for n in Counter(re.findall(r.pattern, t)).values()}


def findings(frame):
    return {(r["doc_id"], r["rule"], r["version"], r["occurrences"]) for r in frame.collect()}


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, f"x {TOKEN} y {TOKEN}"), (2, f"x {TOKEN} y {TOKEN}"), (3, "clean")], "doc_id long, text string")
    ledger, found = secretscan.scan(first)
    assert ledger.count() == 2 * len(secretscan.RULES)
    assert [(r["rule"], r["occurrences"]) for r in found.collect()] == [("github_token", 2)]
    later = first.unionByName(spark.createDataFrame([(3, f"now {TOKEN}")], "doc_id long, text string"))
    new, more = secretscan.scan(later, ledger)
    assert new.select("blob").distinct().count() == 1 and more.count() == 1
    raised = tuple(secretscan.Rule(r.name, 2 if r.name == "github_token" else r.version, r.pattern, r.anchors) for r in secretscan.RULES)
    again, _ = secretscan.scan(later, ledger.unionByName(new), raised)
    assert {(r["rule"], r["version"]) for r in again.collect()} == {("github_token", 2)} and again.count() == 3


def test_ledger_over_several_scans_against_plain_python(spark, tmp_path):
    """A second version, a new path for a known blob, a path that is gone, a raised rule and one without anchors."""
    folder, history = f"{tmp_path}/kept", []
    own = secretscan.Rule("mine@x", 1, r"zz_[A-Z0-9]{16}")
    scans = [
        ([(1, f"x {TOKEN} y {TOKEN}"), (2, "clean"), (2, "clean"), (3, None), (None, f"null {TOKEN}"), (4, "zz_ABCDEF1234567890")], secretscan.RULES),
        ([(2, f"now {TOKEN}"), (5, f"x {TOKEN} y {TOKEN}")], secretscan.RULES),
        ([(2, "clean again")], (*secretscan.RULES, own)),
        ([(6, "zz_ABCDEF1234567890 and zz_ABCDEF1234567890")], (*secretscan.RULES, own)),
        ([], (*secretscan.RULES, own)),
        ([(4, "zz_ABCDEF1234567890"), (1, "x")], (secretscan.Rule("github_token", 2, r"gh[op]_[A-Za-z0-9]{36}", ("gh",)), own)),
    ]
    seen = set()
    for rows, rules in scans:
        history += rows
        got = findings(secretscan.update(spark.createDataFrame(rows, "doc_id long, text string"), folder, rules))
        texts = {t for _, t in rows if t is not None}
        seen |= {(t, r.name, r.version) for t in texts for r in rules}
        # a rule has only been tried on blobs that a scan with it had before it
        want = plain_findings(history, rules)
        want = {w for w in want if any((t, w[1], w[2]) in seen and w in plain_findings([(w[0], t)], rules) for p, t in history if p == w[0])}
        assert got == want
        assert spark.read.parquet(f"{folder}/ledger").count() == len(seen)
    assert spark.read.parquet(f"{folder}/versions").count() == len({(p, t) for p, t in history if t is not None})


def test_lost_ledger_rows_are_scanned_again_and_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"x {TOKEN}"), (2, "clean")], "doc_id long, text string")
    first = findings(secretscan.update(docs, f"{tmp_path}/kept"))
    spark.createDataFrame([], secretscan.LEDGER).write.mode("overwrite").parquet(f"{tmp_path}/kept/ledger")
    assert findings(secretscan.update(docs, f"{tmp_path}/kept")) == first == {(1, "github_token", 1, 1)}


def test_anchors_are_proved_from_the_pattern():
    for pattern, anchors in (("a(?:bc|d)e", ("b",)), ("(?i)abc", ("abc",)), ("(?:ab)*c", ("ab",)), ("[a-z]+", ("a",)), ("ab?c", ("ab",))):
        with pytest.raises(ValueError):
            secretscan.Rule("r", 1, pattern, anchors)
    for pattern, anchors in (("a(?:bc|d)e", ("a",)), ("(?:ab)+c", ("ab",)), ("ab?c", ("ab", "ac")), (r"\bx[yz]-\w*", ("xy-", "xz"))):
        assert secretscan.Rule("r", 1, pattern, anchors).anchors == anchors


def test_rules_of_one_name_and_version_are_an_error(spark):
    with pytest.raises(ValueError):
        secretscan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), rules=(secretscan.RULES[0], secretscan.RULES[0]))


def test_query_scans_against_its_ledger(spark, tmp_path, monkeypatch):
    docs = [(1, f"x {TOKEN} y {TOKEN}"), (2, f"x {TOKEN} y {TOKEN}"), (3, "clean"), (4, None), (5, "token = 'abcdefghij0123456789'")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scans, plain = [], secretscan.scan_rows

    def counted(*args):
        new, found = plain(*args)
        scans.append(new.count())
        return new, found

    monkeypatch.setattr(secretscan, "shared_folder", lambda spark: f"{tmp_path}/kept")
    monkeypatch.setattr(secretscan, "scan_rows", counted)
    assert findings(secretscan.op10_secret_scan(spark, str(tmp_path))) == plain_findings(docs, secretscan.RULES) != set()
    assert scans == [3 * (len(secretscan.RULES) - 1), 3]


ODD = ["", "   ", "!!!", "É ü 日本", "a", "MIXED Case Words here", "x" * 700, "tab\tand\nline  ends ", "ab " * 400]


def test_toxicity_against_plain_python():
    rng = random.Random(21)
    y = np.array([i % 2 for i in range(200)])
    texts = [" ".join([*invented(rng, 30).split(), *(["worthless"] if t else []), *invented(rng, 9).split()]) for t in y]
    model = toxicity.train(texts, y)
    some = [*texts[:60], *ODD, None]
    assert np.allclose(toxicity.score_texts(pa.array(some), model), [plain.toxic_probability(t, model) for t in some], atol=1e-9)


def test_quality_against_plain_python():
    rng = random.Random(22)
    y = np.array([i % 2 for i in range(80)])
    texts = [invented(rng, rng.randint(1, 60)) + ("" if t else " ###") for t in y]
    model = quality.train(texts, y, epochs=2)
    some = [*texts[:8], *ODD, invented(rng, 260), None]
    assert np.allclose(quality.score_texts(pa.array(some), model), [plain.good_probability(t, model) for t in some], atol=1e-4)


def test_language_against_plain_python():
    rng = random.Random(23)
    parts = {"xx": "ka lo mi tu ren sol".split(), "yy": "sch ung ein keit ver st".split(), "zz": "pra dor une elle ais".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    model = langid.train([(lang, make(lang, 100)) for lang in parts for _ in range(20)])
    some = [make(lang, n) for lang in parts for n in (1, 3, 10, 60, 2000)] + [make("xx", 500) + make("yy", 500), *ODD, None]
    got, _ = langid.classify_texts(pa.array(some), model)
    assert got == [plain.language(t, model) for t in some] and {"xx", "yy", "zz", "und"} <= set(got)


def feature_rows(raw):
    return pii.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def test_pii_features_tell_shapes_apart():
    """Cores are those of the plain version, and two words share a feature just where their plain shapes are the same."""
    lines = [t for t, _ in pii._lines(77, 40)]
    data, offs = bytescan.buffers(pa.array(lines))
    rows, start, end, first = pii.features(data, offs)
    cores, shapes = [], []
    for k, line in enumerate(lines):
        raw = line.encode()
        for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw):
            a, b = plain.core(m.group())
            cores.append((offs[k] + m.start() + a, offs[k] + m.start() + b))
            shapes.append(plain.shapes(m.group()[a:b]))
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == cores
    for feature, shape in ((0, 0), (1, 1), (2, 2), (6, 3)):
        seen = {}
        for row, own in zip(rows[:, feature].tolist(), shapes, strict=True):
            assert seen.setdefault(own[shape] if shape != 2 else min(own[2], 20), row) == row
        assert len(set(seen.values())) >= 0.98 * len(seen)


def test_masked_texts_against_plain_python():
    model = pii.train(pii.labelled(400), epochs=30)
    some = [t for t, _ in pii._lines(78, 60)] + [*ODD, None]
    assert pii.mask_texts(pa.array(some), model).to_pylist() == [plain.masked(t, model, feature_rows) for t in some]


#: Written by hand, with formats that the labelled table has and some that it hasn't: (text, kinds in order).
BY_HAND = [
    ("Please contact John.O'Neil@sub.mail.co.uk for details.", ["EMAIL"]),
    ("Link: <a href=mailto:bob@example.com>", ["EMAIL"]),
    ("My address is maria_garcia99@correo.com.mx, thanks!", ["EMAIL"]),
    ("cc: k.larsen+news@uni-bergen.no; root@localhost.localdomain", ["EMAIL", "EMAIL"]),
    ("Reply-To: \"Anna\" <anna.svensson@foretag.se>", ["EMAIL"]),
    ("The server 192.168.0.1:8080 refused, then 10.0.0.254 answered.", ["IP", "IP"]),
    ("Ping from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 failed", ["IP"]),
    ("inet6 fe80::1ff:fe23:4567:890a up", ["IP"]),
    ("Amex 3782 822463 10005 exp 04/27", ["CARD"]),
    ("Visa: 4111-1111-1111-1111.", ["CARD"]),
    ("paid with 5500005555555559 yesterday", ["CARD"]),
    ("Call 0207 946 0958 after six", ["PHONE"]),
    ("Tel. +49 (0)30 901820, Fax on request", ["PHONE"]),
    ("ring me on (020) 7946 0018 or +1-202-555-0143", ["PHONE", "PHONE"]),
    ("phone: 555-867-5309", ["PHONE"]),
    ("WhatsApp +33 6 12 34 56 78 s'il vous plaît", ["PHONE"]),
    ("SSN 078-05-1120 was leaked", ["SSN"]),
    ("IBAN DE89 3704 0044 0532 0130 00 at the bank", ["IBAN"]),
    ("Konto: GB29NWBK60161331926819", ["IBAN"]),
    ("Überweisung an AT61 1904 3002 3457 3201", ["IBAN"]),
    ("Meeting at 12:30 on 2024-05-06 in room 204.", []),
    ("Version 1.2.3 fixes 14 bugs, see issue #4521", []),
    ("std::vector<int> and a::b are C++ names", []),
    ("Order 12345678 has 30 items for $45.20 (10% off)", []),
    ("It's 3.14159 or so; he said 'no' at 10:15:30.", []),
    ("The ratio was 3:2 and the score 101-99", []),
]


def test_pii_by_hand():
    model = pii.train(pii.labelled())
    r, k, _, _ = pii.find_texts(pa.array([t for t, _ in BY_HAND]), model)
    got = [[pii.KINDS[kind] for row, kind in zip(r, k, strict=True) if row == i] for i in range(len(BY_HAND))]
    found = sum((Counter(a) & Counter(b)).total() for a, (_, b) in zip(got, BY_HAND, strict=True))
    wanted, given = sum(len(b) for _, b in BY_HAND), sum(map(len, got))
    print(f"recall {found}/{wanted}, precision {found}/{given}", [(t, a) for a, (t, b) in zip(got, BY_HAND, strict=True) if a != b])
    assert found >= 0.9 * wanted and found >= 0.95 * given


def test_texts_longer_than_a_chunk(spark):
    """One text of three chunks, for every operator that works in chunks, against what its parts or its plan give."""
    rng = random.Random(24)
    filler = invented(rng, 230_000, 10**6)
    assert len(filler) > 3 * bytescan.CHUNK_BYTES
    item, token = invented(rng, 40, 10**7), "ghp_" + "a1B2" * 9
    long = f"{filler} {item} worthless mail ann.12@mail3.example.com {token} {filler[:1000]}"
    passage = invented(rng, 60, 10**7)
    docs = spark.createDataFrame([(1, long + " " + passage), (2, long + " " + passage), (3, f"short {passage}"), (4, item)], "doc_id long, text string")
    assert {r["doc_id"]: r["root_id"] for r in neardup.groups(docs).collect()} == {1: 1, 2: 1}
    assert {(r["doc_id"], r["score"]) for r in decontaminate.matches(docs, docs.where("doc_id = 4").withColumnRenamed("doc_id", "item_id")).collect()} == {(1, 1.0), (2, 1.0), (4, 1.0)}
    n = len(words(long)) + 60
    repeats = {tuple(r) for r in substrings.repeats(docs).collect()}
    assert {(1, 0, n), (2, 0, n), (3, 1, 61)} <= repeats
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert f[1] == f[2] != f[3]
    assert all(r["round_trip"] for r in bpe.encode_docs(docs).collect())
    y = np.array([i % 2 for i in range(200)])
    model = toxicity.train([" ".join([*invented(rng, 30).split(), *(["worthless"] if t else [])]) for t in y], y)
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, model).collect()}
    assert p[1] == p[2] >= toxicity.score_texts(pa.array([f"{item} worthless mail"]), model)[0] - 1e-9
    found = pii.find(docs, pii.train(pii.labelled(400), epochs=30)).where("kind = 'EMAIL'").collect()
    assert {(r["doc_id"], r["value"]) for r in found} == {(1, "ann.12@mail3.example.com"), (2, "ann.12@mail3.example.com")}
    assert all(long[r["start"] : r["end"]] == r["value"] for r in found)
    assert {(r["rule"], r["occurrences"]) for r in secretscan.scan(docs)[1].collect()} == {("github_token", 1)}


def _tables(spark, folder, docs, labels, benchmark, kind="doc_id long, text string, lang string, source string, n_chars long"):
    for name, rows, schema in (("documents", docs, kind), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_against_plain_python(spark, tmp_path):
    """All rows of the pipeline's result, from plain versions of its stages; the models are those that it trains."""
    import corpus_pipeline

    rng = random.Random(31)
    item = invented(rng, 30, 10**6)
    docs = [(i, invented(rng, rng.randrange(10, 60), 10**6)) for i in range(80)]
    docs += [(100 + i, f"{invented(rng, 20, 10**6)} {rng.choice(['worthless', 'disgusting'])} {invented(rng, 20, 10**6)}") for i in range(60)]
    docs += [(200 + i, edited(rng, docs[i][1], 0.05)) for i in range(8)] + [(220, docs[9][1]), (9, docs[9][1])]
    docs += [(230, f"{invented(rng, 9)} {edited(rng, item, 0.1)} {invented(rng, 9)}"), (231, item), (240, "mail ann.12@mail3.example.com or 10.1.2.3 now"), (250, ""), (251, None), (252, " ! "), (None, "no id but some words here")]
    labels = [(d, 1, int(100 <= d < 200)) for d, _ in docs if d is not None and d < 200]
    _tables(spark, str(tmp_path), [(d, t, "en", "s", len(t or "")) for d, t in docs], labels, [(0, item), (1, None), (2, "x")])
    got = sorted((r["doc_id"], None if r["tokens"] is None else list(np.frombuffer(r["tokens"], bpe.codec().kind))) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["doc_id"] is not None)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judge = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = [(d, t) for d, t in docs if plain.toxic_probability(t, judge) < judge.threshold]
    stay = Counter(plain.representatives([r for r in rows if r[1]]))
    texts = {(d, t) for d, t in rows if t}
    rows = [(d, t) for d, t in texts if stay[d if d is not None else 0]] + [(d, t) for d, t in rows if not t]
    rows = [(d, t) for d, t in rows if not plain.holds(t, item)]
    model, own = pii.train(pii.labelled()), bpe.codec()
    want = sorted((d, None if t is None else own.leaf(plain.masked(t, model, feature_rows))) for d, t in rows if d is not None)
    assert got == want and len(want) > 60 and not any(d in (9, 220) for d, _ in want if (9, docs[9][1]) not in rows)


def test_pipeline_on_empty_null_and_clashing_input(spark, tmp_path):
    import corpus_pipeline

    _tables(spark, f"{tmp_path}/empty", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    kind = "doc_id long, text string, lang string, source string, n_chars long, node long, gone string, row string, item long, sig binary, decision string"
    rows = [(None, None, None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "g", "r", 2, b"x", "d"), (1, "same text twice", "en", "s", 15, 1, "g", "r", 2, b"x", "d"), (1, "same text twice", "en", "s", 15, 1, "g", "r", 2, b"x", "d")]
    _tables(spark, f"{tmp_path}/odd", rows, [(None, None, None), (1, 1, 0)], [(None, None), (1, "")], kind)
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert out.columns == docs.columns and out.count() == (3 if name == "near_duplicates" else 4), name
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] or 0) for r in got)[:2] == [(0, 0), (1, 0)] and len(got) == 3


@pytest.mark.parametrize("slack", [0, 1])
def test_pipeline_on_planted_rows(spark, tmp_path, slack):
    import corpus_pipeline

    rng = random.Random(15 + slack)
    item = invented(rng, 40, 10**6)
    docs, labels, n = [], [], 0

    def add(text, toxic=None):
        nonlocal n
        docs.append((n, text, "en", "s", len(text)))
        if toxic is not None:
            labels.append((n, 1, toxic))
        n += 1

    clean = [invented(rng, 80, 10**6) for _ in range(120)]
    for t in clean:
        add(t, 0)
    for _ in range(60):
        w = invented(rng, 60, 10**6).split()
        add(" ".join([*w[:30], rng.choice(["worthless", "disgusting", "pathetic"]), *w[30:]]), 1)
    add(clean[5])
    add(edited(rng, clean[6], 0.02))
    add(invented(rng, 30, 10**6) + " " + item)
    add(clean[7][:200] + " write to ann.12@mail3.example.com today " + invented(rng, 80, 10**6))
    folder = str(tmp_path)
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(0, item)], "item_id long, text string")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = set(rows)
    assert all(r["round_trip"] for r in rows.values())
    assert len(kept & set(range(120))) >= 117 and not kept & {180, 181, 182}
    assert len(kept & set(range(120, 180))) <= 9
    own = bpe.codec()
    assert "[EMAIL]" in own.decode(np.frombuffer(rows[183]["tokens"], own.kind)).decode()
