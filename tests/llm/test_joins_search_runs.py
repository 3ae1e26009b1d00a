import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import ball_tree, partenum
from ledgerloom.llm.ball_tree import Best, BallTree, Vectors, lexical_search, search_portion, terms_of
from ledgerloom.llm.common import words_of
from ledgerloom.llm.partenum import bands_of, differing, shingle_set, signatures, similar_groups
from ledgerloom.llm.periodic_runs import periodic_runs, repeated_tail, run_digests, runs_of
from tests.llm.conftest import LONG, TEXT, key

# --- periodic runs


def slow_runs(words, min_length=6, min_exponent=4):
    """From every period and every stretch of equal words at that distance."""
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            least = next(p for p in range(1, q + 1) if part[p:] == part[: length - p])
            if least == q and length >= max(min_length, min_exponent * q):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words = [rng.choice(b"abc"[: rng.randint(1, 3)].decode()).encode() for _ in range(rng.randint(0, 40))]
        root = words[: rng.randint(1, 6)]
        at = rng.randint(0, len(words))
        texts.append(words[:at] + root * rng.randint(0, 8) + words[at:])
    assert runs_of(texts, 6, 4) == [slow_runs(t) for t in texts]
    assert runs_of(texts, 2, 2) == [slow_runs(t, 2, 2) for t in texts]
    assert runs_of(texts, 9, 3) == [slow_runs(t, 9, 3) for t in texts]


def test_runs_of_one_word_and_of_powers():
    many = [b"a"] * 5_000
    assert runs_of([many], 6, 4) == [[(0, 5_000, 1)]]
    fibonacci = [b"a"], [b"a", b"b"]
    for _ in range(12):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs_of([fibonacci[1] * 5], 6, 4) == [slow_runs(fibonacci[1] * 5)]
    assert runs_of([], 6, 4) == [] and runs_of([[], [b"x"]], 6, 4) == [[], []]


def slow_digest(doc_id, text):
    words = words_of(text)
    if doc_id is not None and words:
        h = crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def short(text, words=700):
    return text and " ".join(text.split(" ")[:words])


def test_run_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, short(r.text, 400)) for r in documents.select("doc_id", "text").collect()]
    rows += [(10_000 + i, " ".join(f"w{k}" for k in range(i))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = run_digests(periodic_runs(df, rewrite=repeated_tail)).collect()
    assert sorted(map(tuple, found)) == sorted(slow_digest(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in found) > 5


def test_runs_on_odd_inputs(spark, odd, none):
    found = periodic_runs(odd).collect()
    assert sorted((key((r.doc_id, r.n_words)) for r in found)) == sorted(
        key((r.doc_id, len(words_of(r.text)))) for r in odd.collect()
    )
    assert all(r.collapsed is not None for r in found)
    assert run_digests(periodic_runs(none, rewrite=repeated_tail)).count() == 0
    empty = run_digests(periodic_runs(odd.where("doc_id = 2"), rewrite=repeated_tail)).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(empty) == (2, 0, None, None, None, None, nothing, nothing)
    text = run_digests(periodic_runs(spark.createDataFrame([("x", "a b " * 9)], "doc_id string, text string")))
    assert text.first()[1:6] == (1, 0, 18, 2, 9000)
    with pytest.raises(ValueError):
        periodic_runs(odd, min_exponent=1)


# --- Jaccard join


def slow_set(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def slow_components(rows, percent=90, width=3):
    sets = [slow_set(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(
        key((doc, len(sets[i]), least.get(top(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows)
    )


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind > 0)] = [f"new{rng.randrange(10**6)}"] if kind < 2 else []
    return words


def groups_of_copies(seed, count=25, copies=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 300))]
        for _ in range(copies):
            rows.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 40)))))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,block", [(0, 1 << 20), (1, 400)])
def test_groups_equal_all_pairs(spark, seed, block):
    rows = groups_of_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(df, percent=90, block=block).collect()
    assert sorted(map(key, found)) == slow_components(rows)


@pytest.mark.parametrize("percent,width", [(80, 5), (60, 2), (100, 3)])
def test_groups_at_other_similarities(spark, percent, width):
    rows = groups_of_copies(7, count=12, copies=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(df, percent=percent, width=width).collect()
    assert sorted(map(key, found)) == slow_components(rows, percent, width)


def test_groups_on_odd_inputs(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(key, similar_groups(odd).collect())) == slow_components(rows)
    assert similar_groups(none).count() == 0
    # many different texts under one id
    rng = random.Random(3)
    rows = [(5, " ".join(edited(rng, TEXT.split(), rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, similar_groups(df).collect())) == slow_components(rows)


@pytest.mark.parametrize("percent", [90, 75])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        size = int(rng.integers(1, 500))
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        k = differing(2 * len(a), percent)
        drop = int(rng.integers(0, k + 1))
        b = a[rng.permutation(len(a))[: max(1, len(a) - drop)]]
        more = rng.integers(0, 1 << 62, int(rng.integers(0, k + 1))).astype(np.uint64)
        b = np.unique(np.concatenate([b, more]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        same = np.array_equal(a, b)
        shared = np.intersect1d(signatures(a, percent), signatures(b, percent))
        assert same or len(shared)


def test_bands_hold_a_set_and_its_partners():
    for size in range(1, 3_000, 7):
        own = bands_of(size, 90)
        for partner in (size, size + size // 20, 100 * size // 90):
            larger = max(size, partner)
            assert {b for b, _ in bands_of(partner, 90)} & {b for b, _ in own}
            assert [high for _, high in bands_of(larger, 90)][0] >= larger
    assert len(shingle_set([], 3, partenum.WordHashes())) == 0


# --- ranked search


def slow_search(rows, items, top=20):
    counts = [(doc, Counter(terms_of(t))) for doc, t in rows]
    counts = [(doc, c) for doc, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(
                ball_tree.weight(n, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms_of(text) if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(map(key, out))


def test_terms():
    assert [t.decode() for t in terms_of("Ab_c-9 été\x00İx\x7fy ﬁ")] == ["ab", "c", "9", "été", "İx", "y", "ﬁ"]


@pytest.mark.parametrize("portion_chars", [1 << 24, 1500])
def test_search_equals_all_scores(spark, documents, sf, portion_chars):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = lexical_search(documents, items, portion_chars=portion_chars)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = slow_search(rows, [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(key, found.collect())) == wanted


def test_search_with_ties_and_odd_inputs(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [("a", "the FIRST line"), ("b", None), ("c", ""), ("d", "nowhere"), ("e", "text1 of1 of1"),
             (None, "数据 été one"), ("f", LONG)]
    table = spark.createDataFrame([(*i, None, "x") for i in items], "item_id string, text string, score string, rank string")
    assert sorted(map(key, lexical_search(odd, table).collect())) == slow_search(rows, items)
    assert lexical_search(none, table).count() == 0
    assert lexical_search(odd, table.where("false")).count() == 0
    ties = spark.createDataFrame([(100 - i, "same words here") for i in range(50)], "doc_id long, text string")
    found = lexical_search(ties, table.where("item_id = 'a'"), item_text="item_id")
    assert found.count() == 0
    one = spark.createDataFrame([(7, "words")], "item_id long, text string")
    assert [r.doc_id for r in lexical_search(ties, one).orderBy("rank").collect()] == list(range(51, 71))


def test_bounds_hold_and_prune():
    """No row's product exceeds its nodes' bounds; of clustered rows few leaves are scored."""
    rng = np.random.default_rng(4)
    topic = np.arange(1500) % 10
    cols = np.array([np.arange(8) + 20 * t for t in topic])
    values = rng.integers(10**5, 10**6, (10, 8))[topic] + rng.integers(0, 10**4, (1500, 8))
    vectors = Vectors(np.arange(1501) * 8, cols.ravel(), values.ravel())
    q = np.zeros((200, 3), dtype=np.int64)
    for j in range(3):
        q[20 * j : 20 * j + 20, j] = rng.integers(1, 20_000, 20)
    scale = np.sqrt(np.maximum(q.max(axis=1), 1))
    tree = BallTree(vectors, scale, leaf=32)
    bounds = tree.bounds(q / scale[:, None])
    for j in range(3):
        exact = vectors.products(q[:, j])
        for node, (rows, _) in tree.leaves.items():
            assert bounds[node, j] >= exact[rows].max()
        assert bounds[0, j] >= exact.max()
        best = Best(20)
        best.ids = list(range(1500))
        scored = tree.search(bounds[:, j], q[:, j].copy(), best)
        assert sorted(-s for s, _, _ in best.found) == sorted(exact)[-20:]
        assert scored < len(tree.leaves) / 2


def test_one_portion_after_another():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([[0, 1], [], [1]], pa.list_(pa.int32())),
         pa.array([[2, 1], [], [5]], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"],
    )
    whole, parts = [Best(2), Best(2)], [Best(2), Best(2)]
    items = [{0: 900, 1: 30}, {1: 10}]
    search_portion(batch, items, whole, 2, 3, 15)
    for i in range(3):
        search_portion(batch.slice(i, 1), items, parts, 2, 3, 15)
    assert [sorted(b.found) for b in whole] == [sorted(b.found) for b in parts]
    assert [len(b.found) for b in whole] == [2, 2]
