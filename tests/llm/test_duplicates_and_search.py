import random
import string
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import latent, simhash
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.latent import answer_of, common_subsequence, contaminated
from ledgerloom.llm.line_templates import line_report, parse_leaf, without_recurring_lines
from tests.llm.conftest import ROWS, TEXT, key


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# --- components


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)]
    pairs += [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in connected_components(df).collect()}
    wanted = components(pairs, {x for p in pairs for x in p})
    assert found == {n: r for n, r in wanted.items() if n != r}
    assert connected_components(df.where("false")).count() == 0


# --- SimHash


def slow_fingerprint(text):
    words = (text or "").encode().translate(
        bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    ).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """Smallest id of each row's group, from all pairs."""
    fps = sorted({fp for _, fp in rows})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i:] if (a ^ b).bit_count() <= 4]
    root = components(links, fps)
    least = defaultdict(lambda: None)
    for i, fp in rows:
        if i is not None and (least[root[fp]] is None or i < least[root[fp]]):
            least[root[fp]] = i
    return {fp: least[root[fp]] for fp in fps}


def test_near_duplicates_on_the_table(documents):
    docs = documents.select("doc_id", "text").collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    wanted = slow_groups(rows)
    found = simhash.near_duplicates(documents).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted(
        (i, f"{fp:016x}", wanted[fp]) for i, fp in rows
    )


def test_near_duplicates_on_odd_rows(odd, none):
    rows = [(i, slow_fingerprint(t)) for i, t in ROWS]
    wanted = slow_groups(rows)
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(found, key=key) == sorted(((i, f"{f:016x}", wanted[f]) for i, f in rows), key=key)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("split", [20_000, 40])
def test_links_of_dense_and_sparse_fingerprints(spark, split):
    """Crowded keys that are dealt out in blocks lose no link."""
    rng = random.Random(split)
    center = rng.getrandbits(64)
    dense = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    sparse = {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(dense | sparse)
    df = spark.createDataFrame(
        [(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"
    )
    found = simhash.near_links(df, 4, split=split).collect()
    got = components(
        [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in found], fps
    )
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i:] if (a ^ b).bit_count() <= 4]
    assert got == components(links, fps)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(0)
    costs = rng.random((3, 6))
    cost, chosen = simhash.allocate(costs, 2)
    every = [
        (costs[0, a + 1] + costs[1, b + 1] + costs[2, c + 1], [a, b, c])
        for a in range(-1, 5) for b in range(-1, 5) for c in range(-1, 5) if a + b + c == 2
    ]
    assert chosen == min(every)[1] and cost == pytest.approx(min(every)[0])


# --- line templates


def test_parse_leaf_generalises():
    lines = [f"user {n} left the room today".split() for n in ("ann", "bob", "eve")]
    lines.append("quite another line of six tokens".split()[:6])
    of, made = parse_leaf(lines, 0.7)
    assert of[:3] == [0, 0, 0] and of[3] == 1
    assert made[0] == "user <*> left the room today"


def test_recurring_lines(spark):
    common = "all of our articles are free to read"
    rows = [(i, f"{'abcdefgh'[i]} text of its own number {i * 'x'} here\n{common}") for i in range(4)]
    rows += [(10 + i, f"posted today by {n} on our page\nsome {n} {n} {n} {n} words") for i, n in
             enumerate(("ann", "bob", "eve"))]
    rows += [(20 + i, "copied text of one line\nand another line of it") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id: r.dropped_lines for r in line_report(df).collect()}
    assert all(dropped[i] == [1] for i in range(4))
    assert all(dropped[i] == [0] for i in (10, 11, 12))
    assert all(dropped[i] == [] for i in range(20, 25))  # one text, however often
    kept = {r.doc_id: r.text for r in without_recurring_lines(df, keep_first=True).collect()}
    assert common in kept[0] and common not in kept[1]
    deeper = {r.doc_id: r.dropped_lines for r in line_report(df, crowded=1).collect()}
    assert all(deeper[i] == [1] for i in range(4))


def names_of(n):
    return ["".join("abcdefghijklmnopqrstuvwxyz"[n // 26**k % 26] for k in range(4)) for n in range(n)]


@pytest.mark.parametrize("count,crowded", [(190, 2_000), (210, 64), (900, 64), (2_100, 2_000)])
def test_a_template_is_found_in_leaves_of_any_size(spark, count, crowded):
    """Whatever the number of variants against the limit of a leaf, all are dropped."""
    rows = [(i, f"text {w} of its own {w}{w}\nposted today by {w} on our page") for i, w in enumerate(names_of(count))]
    rows += [(10_000 + i, f"posted today by nobody at all {w} {w}{w}") for i, w in enumerate(names_of(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id: r.dropped_lines for r in line_report(df, crowded=crowded).collect()}
    assert all(1 in dropped[i] for i in range(count))


def test_crowded_leaves_keep_other_templates_apart(spark):
    """One leaf of several templates and of lines alike to nothing."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, wanted = [], {}
    for i in range(300):
        kind = i % 4
        line = ["news of the {0} week are out now", "news of the old {0} {1} go on here",
                "news of the {0} {1} {2} {3} {4}", "news of the town say {0} is in"][kind]
        rows.append((i, line.format(*[word() for _ in range(5)])))
        wanted[i] = kind in (0, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (2_000, 64):
        found = {r.doc_id: r.n_dropped for r in line_report(df, crowded=crowded).collect()}
        assert all(found[i] == 1 for i in wanted if wanted[i])
        assert not any(found[i] for i in wanted if i % 4 == 2)


def _mixed_lines(count, words, seed):
    """Lines of one leaf that are alike by chance, some more than others."""
    rng = random.Random(seed)
    return sorted({
        " ".join(["so", "it", "was", *(rng.choice(words[: 2 + 3 * k]) for k in range(1, 8))])
        for _ in range(count)
    })


def test_what_is_found_does_not_hang_on_where_leaves_are_parsed(spark):
    """The same decisions with every leaf dealt out, some, or none."""
    lines = _mixed_lines(600, names_of(24), 5)
    rows = [(i, f"{line}\nposted today by {line.split()[-1]} on our page") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [
        {r.doc_id: r.dropped_lines for r in line_report(df, crowded=crowded).collect()}
        for crowded in (1, 100, 2_000)
    ]
    assert found[0] == found[1] == found[2]
    assert 0 < sum(0 in d for d in found[0].values()) < len(lines)


@pytest.mark.parametrize("similar", [0.0, 0.5, 0.7, 1.0])
def test_parse_leaf_compares_all_that_can_be_similar(similar):
    lines = [line.split() for line in _mixed_lines(300, [*names_of(20), "<*>"], 6)]
    made, of = [], []
    for line in lines:
        alike = [sum(a == b != "<*>" for a, b in zip(t, line)) for t in made]
        best = max(range(len(made)), key=lambda k: (alike[k], -k), default=None)
        if best is not None:
            constant = max(*(sum(w != "<*>" for w in t) for t in (line, made[best])), 1)
            if alike[best] < similar * constant:
                best = None
        if best is None:
            of.append(len(made))
            made.append(list(line))
        else:
            of.append(best)
            made[best] = [a if a == b else "<*>" for a, b in zip(made[best], line)]
    assert parse_leaf(lines, similar) == (of, [" ".join(t) for t in made])


def test_short_digit_and_long_lines_recur(spark):
    """Lines without a template recur as they stand, long ones from two texts on."""
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'xyzuvw'[i % 6]}" for i in range(60))
    own = ("ann went", "bob stayed", "eve slept", "dan ate")
    rows = [(i, f"Les.\n{w} for a while\n2020 31\n{i}{i} 7\n\n{w}") for i, w in enumerate(own)]
    rows += [(10 + i, f"{w} twice\n{long}\nonly {'ab'[i]} two") for i, w in enumerate(own[:2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id: r.dropped_lines for r in line_report(df).collect()}
    assert all(dropped[i] == [0, 2] for i in range(4))
    assert all(dropped[i] == [1] for i in (10, 11))


def test_lines_of_odd_rows(odd, none):
    report = line_report(odd).collect()
    assert len(report) == len(ROWS)
    assert all(r.n_lines == 0 for r in report if r.doc_id in (2, 3))
    cut = without_recurring_lines(odd)
    assert cut.columns == odd.columns and cut.count() == len(ROWS)
    assert line_report(none).count() == 0 and without_recurring_lines(none).count() == 0


# --- decontamination


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([bytes([rng.randrange(97, 103)]) for _ in range(rng.randint(1, 40))] for _ in "ab")
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert common_subsequence(masks, len(a), b) == slow_common(a, b)


def test_answers():
    assert answer_of("What is it? Answer: a cat").strip() == "a cat"
    assert answer_of("One thing. And the last one.") == "And the last one."
    assert answer_of("") == ""


def test_benchmark_items_are_found(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    docs = documents.select("doc_id", "text").collect()
    whole = {(r.doc_id, i) for r in docs for i, t in texts.items() if t in r.text}
    found = {(r.doc_id, r.item_id) for r in contaminated(documents, items).collect()}
    assert whole and whole <= found
    assert len(found - whole) <= 0.1 * len(whole) + 1
    rng = random.Random(3)
    words = texts[2].split()
    loose = " ".join(w for w in words if rng.random() > 0.15)
    planted = documents.select("doc_id", "text").limit(50).unionAll(
        spark.createDataFrame([(-1, f"Some words before it. {loose} And words after.")],
                              "doc_id long, text string"))
    assert (-1, 2) in {(r.doc_id, r.item_id) for r in contaminated(planted, items).collect()}


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, TEXT), (2, None), (3, ""), (None, TEXT), (1, TEXT)], "item_id long, text string"
    )
    found = contaminated(odd, items).collect()
    assert {r.doc_id for r in found} == {1, 4, None}
    assert len(found) == 5 * 3  # every row that holds it, for every item row
    assert contaminated(none, items).count() == 0
    assert contaminated(odd, items.where("false")).count() == 0


def test_items_longer_than_a_portion(spark):
    """One very long item hides no other, and is found itself."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3_000)}" for _ in range(10_000))
    short = "the quick brown fox jumps over the lazy dog near the old river bank. answer: a fox"
    docs = spark.createDataFrame(
        [(1, f"some words come first. {short} and others follow."), (2, f"before it {long} after it"),
         (3, "nothing of the kind is in this text, whatever else it may hold")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(1, 1), (2, 2)}


def test_the_latent_space_is_of_all_documents(spark, monkeypatch):
    """Every row reaches the pass of the fit, the sums are those of all passages, and the
    directions those of their whole matrix, which has fewer than the sketch."""
    texts = [f"text{i % 3} of words{i % 2} about topic{i % 5} and more" for i in range(9_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    items = spark.createDataFrame([(1, "an item of its own words. answer: yes")],
                                  "item_id long, text string")
    seen = []

    def sums(partial, width, before=latent._sum_arrays):
        seen.append(before(partial, width))
        return seen[-1]

    monkeypatch.setattr(latent, "_sum_arrays", sums)
    contaminated(docs, items, rank=16, buckets=256)
    counted, sketch = latent.counted_sketch(docs.select("text"), 256, 24, 48, 7)
    memo = latent.Buckets(256)
    basis = np.random.default_rng(7).standard_normal((256, 24)).astype(np.float32)
    rows = np.array([np.bincount(memo.of(latent.raw_words(t)), minlength=256) for t in texts], float)
    assert counted.total == 9_000
    assert np.array_equal(counted.documents, (rows > 0).sum(0))
    assert np.array_equal(counted.words, rows.sum(0))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    got = np.concatenate([seen[0][b] for b in sorted(seen[0])])[:-1, :24]
    for found in (got, sketch):
        assert np.allclose(found, rows.T @ (rows @ basis), rtol=1e-3, atol=2e-2)
    assert len(seen) == 2  # one pass for each call
    # what the space makes of the texts' likeness is what the whole matrix would
    space = latent.latent_space(sketch, [], counted.idf, 16, 48, 7)
    rows *= counted.idf
    values, vectors = np.linalg.eigh(rows.T @ rows)
    exact = vectors / np.sqrt(np.maximum(values, 1e-2 * values.max()))
    some = rows[:60]
    assert np.allclose((some @ space) @ (some @ space).T, (some @ exact) @ (some @ exact).T, rtol=0.02, atol=1e-6)


def test_words_of_many_texts_have_the_buckets_of_single_words(monkeypatch):
    rng = random.Random(4)
    signs = "ab.,!?'\"()-é數\x1c\u00a0 \t\n\r\x0b\x0c"
    texts = [t for _, t in ROWS] + ["", " ", "...", "x" * 31, "x" * 32, "." * 40 + "x" + "." * 40, "\ud800 A"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(300)]
    for portion in (1, 1 << 18):
        monkeypatch.setattr(latent, "PORTION", portion)
        found = list(latent.words_found(texts, 1 << 14))
        assert len(found) == len(texts)
        for text, own in zip(texts, found, strict=True):
            words = latent.raw_words(text)
            assert own.buckets.tolist() == latent.Buckets(1 << 14).of(words).tolist()
            assert own.terms(-5, len(words) + 5) == latent.stripped(words)
            assert own.terms(2, 7) == latent.stripped(words[2:7])


def test_words_are_not_hashed_one_by_one(monkeypatch):
    """A search over words never met before has nothing to do for each of them in Python."""
    item = latent.Item(1, latent.terms("an item of some words"), [])
    search = latent.Searcher([item], np.ones((64, 2)), np.zeros(64, dtype=bool), 0.05, 0.6, 0.8, 0.5).search
    calls = []
    monkeypatch.setattr(latent, "crc32", lambda w, before=latent.crc32: calls.append(w) or before(w))
    found = search([" ".join(f"new{i}" for i in range(5_000)), "here an item of some words is", "w" * 50])
    assert [len(f) for f in found] == [0, 1, 0] and calls == [b"w" * 50]


def test_passages_of_many_texts():
    """Cut, counted and normed as text by text."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 7, 8, 9, 40, 0, 3)]
    basis = rng.standard_normal((50, 6)).astype(np.float32)
    got, wanted = np.zeros((50, 6)), np.zeros((50, 6))
    latent.Passages(texts, 50, 8).add_sketch(got, basis)
    for text in texts:
        for start in range(0, len(text), 8):
            row = np.bincount(text[start : start + 8], minlength=50).astype(float)
            row /= np.linalg.norm(row)
            wanted += np.outer(row, row @ basis)
    assert np.allclose(got, wanted, atol=1e-4)
    latent.Passages([], 50, 8).add_sketch(got, basis)


@pytest.mark.parametrize("count", [1, 8])
def test_copies_in_a_corpus_of_few_texts(spark, sf, count):
    """Words that nothing else holds, around an item, do not drown it."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    around = " ".join(f"beta{i}" for i in range(80))
    texts = [r.text for r in items.orderBy("item_id").limit(count).collect()]
    rows = [(i, f"{around} {t} {around}") for i, t in enumerate(texts)] + [(100, around)]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {r.doc_id for r in found.collect()} == set(range(count))


@pytest.mark.parametrize("share", [0.6, 0.7, 0.8])
def test_no_paraphrase_is_lost_to_the_cosine(spark, sf, documents, share):
    """All that a comparison with every window finds, the words kept lying far apart."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rng, texts = random.Random(11), [r.text for r in documents.limit(60).collect()]
    pool = [w for t in texts for w in t.split()]
    rows = []
    for item in items.collect():
        words = item.text.split()
        for far in (0.0, 0.4, 0.55, 0.6):
            kept = set(rng.sample(range(len(words)), -int(-share * len(words) // 1)))
            out = rng.sample(pool, 20)
            for i, w in enumerate(words):
                out += [w] * (i in kept)
                while rng.random() < far:
                    out.append(rng.choice(pool))
            rows.append((len(rows), " ".join(out + rng.sample(pool, 20))))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(planted, items, min_cosine=-2.0).collect()}
    assert len(whole) > 0.5 * len(rows)
    assert {(r.doc_id, r.item_id) for r in contaminated(planted, items).collect()} == whole
