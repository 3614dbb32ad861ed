import random

import numpy as np
import pytest

from plumeria.llm import passages
from plumeria.llm.components import connected_components
from plumeria.llm.mixing import mix_sources
from plumeria.llm.ngram_join import Parts, divide_skip, ngram_jaccard_join
from plumeria.llm.passages import dedup_passages
from plumeria.llm.queries import op2_passages, op3_ngram_join
from plumeria.llm.textkernels import U

from . import brute

SF = "/root/testdata/sf0.001"


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "über", "naïve", "x", "yy", "Zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 8, 30, 60]))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(r.choice([" ", "\n", "  "]).join(w))
    return [(i * 3, t) for i, t in enumerate(out)] + [(1000, None), (1001, ""), (1002, " \t")]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 70)])
def test_join_equals_brute_force(spark, words, percent):
    rows = corpus(words)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cluster string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(df, words, percent, block=300).collect()}
    assert got == brute.jaccard_join(rows, words, percent)


def test_join_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in op3_ngram_join(spark, SF).collect()}
    assert got == brute.jaccard_join(rows, 3, 90)


def test_join_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (2, text + " z"), (None, text), (9, "other words here")]
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in ngram_jaccard_join(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rep int, component_id string"), 3, 90).collect()), key=str)
    assert [x[:2] for x in got] == [(2, 2), (5, 2), (5, 2), (9, 9), (None, None)] or [x[:2] for x in got][:4] == [(2, 2), (5, 2), (5, 2), (9, 9)]


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 5)])
def test_join_of_one_large_cluster(spark, percent, words):
    r = random.Random(percent)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(60)] = f"v{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard_join(rows, words, percent)
    for block in (1000, 200_000):  # many blocks, and one
        assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_jaccard_join(df, words, percent, block).collect()} == want


def test_words_of_very_long_texts():
    from plumeria.llm.textkernels import words_of

    r = random.Random(3)
    for text in [" ".join("x" * r.choice([1, 3, 40, 200]) + "É" * r.choice([0, 1, 9]) for _ in range(200)), "a" * 1000, " " * 500 + "b" * 77, "q " * 300 + "z" * 400, "z" * 400 + " q" * 300]:
        b = np.frombuffer(text.encode(), np.uint8)
        want, first = words_of(b, np.array([0, len(b)]))
        for long in (16, 50, 333):
            got, at = words_of(b, np.array([0, len(b)]), long=long)
            assert np.array_equal(got, want) and at.tolist() == first.tolist()


def test_join_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(df).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_share_a_part(percent):
    parts = Parts(percent, 4000)
    r = np.random.default_rng(percent)
    for s in [*range(1, 60), 200, 999]:
        for _ in range(5):
            a = np.unique(r.integers(0, 1 << 63, s).astype(U))
            b = a.copy()
            grow = r.integers(0, 3)
            while True:  # as far apart as a link allows
                c = b[r.permutation(len(b))[: len(b) - 1]] if grow == 0 else np.append(b, U(r.integers(0, 1 << 63)))
                both = len(np.intersect1d(a, c))
                if not len(c) or 100 * both < percent * (len(a) + len(c) - both):
                    break
                b = np.unique(c)
                grow = r.integers(0, 3)
            x = parts.signatures(np.sort(a), np.array([0, len(a)]))[0]
            y = parts.signatures(np.sort(b), np.array([0, len(b)]))[0]
            assert len(np.intersect1d(x, y))


def test_divide_skip_equals_counting():
    r = np.random.default_rng(3)
    base = r.integers(0, 500, (6, 40))
    sets = [np.unique(np.where(r.random(40) < 0.1, r.integers(0, 500, 40), base[r.integers(0, 6)])).astype(U) for _ in range(60)]
    for percent in (60, 80, 90):
        want = {(i, k) for i in range(60) for k in range(i + 1, 60) if 100 * (n := len(np.intersect1d(sets[i], sets[k]))) >= percent * (len(sets[i]) + len(sets[k]) - n)}
        assert set(zip(*map(np.ndarray.tolist, divide_skip(sets, None, percent)))) == want
        a, b = divide_skip(sets[:30], sets[30:], percent)
        assert set(zip(a.tolist(), (b + 30).tolist())) == {p for p in want if p[0] < 30 <= p[1]}


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [p for p in links if None not in p]
    assert got == brute.components({x for p in real for x in p}, real)


def test_components_of_ascending_paths(spark):
    links = [(i, i + 1) for i in range(4000)] + [(i, i + s) for i in range(10_000, 10_500) for s in (1, 2, 3)] + [(20_000, i) for i in range(20_001, 20_500)] + [(30_000 - i, 30_000) for i in range(500)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute.components({x for p in links for x in p}, links)


def test_join_of_a_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(90)]  # each like the next two only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(df, 3, 90).collect()}
    assert got == brute.jaccard_join(rows, 3, 90) and {c for _, c, _ in got.values()} == {0}


@pytest.mark.parametrize("k,anchor", [(50, 24), (12, 5)])
def test_passages_equal_brute_force(spark, k, anchor):
    rows = corpus(7) + [(2000, "á" * 200), (2001, "á" * 130 + "b"), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 120)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows] + [(None, "x" * 80, "k")], "doc_id long, text string, kind string")
    got = dedup_passages(df, k, anchor).collect()
    want = brute.cut(rows, k)
    for r in got:
        if r.doc_id is None:
            assert (r.n_bytes, r.n_removed) == (80, 0)
        else:
            n, removed, spans, kept = want[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, brute.sha256(kept)), r.doc_id
            assert r.text == kept.decode("utf-8", "ignore") and r.own__kind == "k"
    assert len(got) == len(rows) + 1


@pytest.mark.parametrize("rows", [[(1, "hello world")], [(1, ""), (2, "")], [(1, "a"), (2, "b")], [(1, None), (2, None)], [(None, "x" * 80)]])
def test_passages_of_short_texts_only(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: (len((t or "").encode()), 0) for d, t in rows}


@pytest.mark.parametrize("k,anchor,hot,sample", [(150, 18, 10**9, 1), (300, 18, 10**9, 1), (50, 18, 2, 1), (12, 5, 1, 1)])
def test_passages_of_any_length_and_hot_anchors(spark, k, anchor, hot, sample):
    r = random.Random(k)
    base = ["".join(r.choice("abcde fgh") for _ in range(400)) for _ in range(4)]
    rows = [(i, "".join(r.choice(base)[(a := r.randrange(300)) : a + r.randrange(40, 400)] + r.choice(["", "Copyright by the same people, "]) for _ in range(3))) for i in range(60)]
    want = brute.cut(rows, k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in dedup_passages(df, k, anchor, hot=hot, sample=sample).collect()}
    assert got == {d: (*x[:3], brute.sha256(x[3])) for d, x in want.items()} and sum(x[1] for x in got.values())


def alike_strings(seed, k, m):
    """Strings of up to 2k-m bytes around few anchors, with context in common on either side, and their anchors' hashes."""
    r = random.Random(seed)
    letters, strings, anchors = b"abcde", [], []
    for _ in range(12):
        base = bytes(r.choice(letters) for _ in range(2 * k - m))
        for _ in range(r.randrange(1, 9)):
            s = bytearray(base)
            for _ in range(r.choice([0, 1, 1, 2]) if k > m else 0):
                i = r.choice([r.randrange(k - m), r.randrange(k, 2 * k - m)])
                s[i] = r.choice(letters)
            lo, hi = r.randrange(k - m + 1), r.randrange(k, 2 * k - m + 1)
            lo = max(0, min(lo, hi - k))
            strings.append(bytes(s[lo:hi]))
            anchors.append(base[k - m : k])
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    hashes = {a: passages.mix(np.array([sum((x + 1) * pow(passages.BASE, i, 1 << 64) for i, x in enumerate(a)) % (1 << 64)], U))[0] for a in anchors}
    return strings, text, ends, np.array([hashes[a] for a in anchors], U)


@pytest.mark.parametrize("k,m,block", [(50, 18, 1 << 16), (50, 18, 100), (12, 5, 37), (20, 20, 64), (300, 18, 500)])
def test_equal_windows_equal_a_dictionary(monkeypatch, k, m, block):
    import tempfile

    monkeypatch.setattr(passages, "BLOCK", block)
    monkeypatch.setattr(passages, "COLLECTION", 2000)
    for seed in range(4):
        strings, text, ends, anchor = alike_strings(seed, k, m)
        doc = np.random.default_rng(seed).permutation(len(strings)) + 5
        least = {}
        for s, d, a in zip(strings, doc, anchor):
            for i in range(len(s) - k + 1):
                w = (a, s[i : i + k])
                least[w] = min(d, least.get(w, d))
        with tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
            got = passages.equal_windows(text, ends, doc, anchor, k, m, [one, two])
            whole = passages.collection_windows(text, ends, doc, k, [one, two])
        for s, e, a in zip(strings, ends, anchor):
            for i in range(len(s) - k + 1):
                assert got[e - len(s) + i] == least[a, s[i : i + k]]
                assert whole[e - len(s) + i] == min(least[b, s[i : i + k]] for b in set(anchor.tolist()) if (b, s[i : i + k]) in least)


def test_transforms_hold_only_what_may_be_equal(monkeypatch):
    """Fragments that share their anchor and 10 bytes at each side have no equal window of 50 bytes; they cost no rounds."""
    r = random.Random(1)
    middle = bytes(r.choice(b"abcdefgh") for _ in range(38))
    strings = [bytes(r.choice(b"pqrs") for _ in range(22)) + middle + bytes(r.choice(b"tuvw") for _ in range(22)) for _ in range(50)]
    strings += [b"p" * 22 + middle + b"t" * 22, b"q" * 22 + middle + b"t" * 22]  # the right half is equal
    anchor = passages.mix(np.array([sum((x + 1) * pow(passages.BASE, i, 1 << 64) for i, x in enumerate(middle[10:28])) % (1 << 64)], U))
    text, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    first, last = passages.common_parts(text, ends, np.repeat(anchor, len(strings)), 50, 18)
    assert [i for i, n in enumerate(last - first) if n] == [50, 51]
    for i in (50, 51):
        s = text[first[i] : last[i]].tobytes()
        assert len(s) < 82 and middle + b"t" * 22 in s


def test_passages_refuse_lengths_they_cannot_hold(spark):
    for k, anchor in ((2001, 18), (10, 18)):
        with pytest.raises(ValueError):
            dedup_passages(spark.createDataFrame([], "doc_id long, text string"), k, anchor)


def test_passages_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "x" * 60, 5, "h"), (1, "x" * 60, 5, "h"), (2, "y" * 10 + "x" * 60, 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, home string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.own__n_bytes, r.own__home) for r in dedup_passages(df).collect())
    assert got == [(1, 60, 0, 5, "h"), (1, 60, 0, 5, "h"), (2, 70, 60, 6, None)]


def test_passages_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.cut(rows, 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_passages(spark, SF).collect()}
    assert got == {d: (*x[:3], brute.sha256(x[3])) for d, x in want.items()}


def test_passages_of_an_empty_table(spark):
    assert dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(40), r.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(800)] + [(5000, None, "a"), (5001, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(mix_sources(df.repartition(n)).collect()) for n in (3, 7))
    assert first == second and len(first) == len(rows)
    source = {d: s for d, _, s in rows}
    total, targets = sum(x.size for x in first), {}
    for x in first:
        assert 0 <= x.taken <= 3 * x.size and x.taken % max(x.size, 1) == 0
        t = targets.setdefault(source[x.doc_id], [x.target, x.source_size, 0])
        t[2] += x.taken
    assert sum(t[0] for t in targets.values()) == pytest.approx(total)
    for target, size, taken in targets.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 40
    # weights 5, 2, 1, 5, 2, 1 in code point order with null last
    free = {s: t[0] / w for s, t, w in zip(sorted(filter(None, targets)) + [None], [targets[s] for s in sorted(filter(None, targets)) + [None]], [5, 2, 1, 5, 2, 1]) if t[0] < 3 * t[1] - 1e-6}
    assert max(free.values()) == pytest.approx(min(free.values()))
    assert mix_sources(df.limit(0)).count() == 0


def test_mix_of_repeated_rows_and_clashing_columns(spark):
    rows = [(k % 50, "w " * (k % 7), "a", 1, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long, tag int")
    got = mix_sources(df, keep=("tag",)).collect()
    assert sorted(x.tag for x in got) == list(range(200)) and all(x.size == (x.tag % 7) and x.taken <= 3 * x.size for x in got)
    assert abs(sum(x.taken for x in got) - got[0].target) <= 14


def test_fingerprints_by_home():
    from plumeria.llm.passages import by_home

    r = np.random.default_rng(1)
    for top in (5, 1 << 30):
        to, finger = r.integers(0, 5, 300) * (top // 5), r.integers(0, 40, 300).astype(U)
        got = {v: f.tolist() for v, f in by_home(to, finger)}
        assert got == {v: sorted(set(finger[to == v].tolist())) for v in set(to.tolist())}
    assert list(by_home(np.zeros(0, np.int64), np.zeros(0, U))) == []
