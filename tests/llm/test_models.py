import math
import random
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm_scoring
from ledgerloom.llm.common import lower_words
from ledgerloom.llm.language_id import (
    address, declared, gram_counts, grams, page_language, visible,
)
from ledgerloom.llm.line_crf import Field, line_quality, lines_of
from ledgerloom.llm.lm_scoring import lm_scores
from ledgerloom.llm.ppm import END, Trie, stream, stream_of
from ledgerloom.llm.toxicity import Machine, sigmoid, toxicity
from tests.llm.conftest import ROWS, key

# --- prediction by partial matching


def built(texts, order, most_nodes=1 << 20):
    trie = Trie(most_nodes)
    data, _ = stream(texts)
    trie.start(np.bincount(data[1:], minlength=256))
    while len(trie.child) <= order:
        keys, counts = trie.count_next(data, len(trie.child))
        before, last = np.divmod(keys, trie.width)
        shorter = Counter()
        for k, n in zip(before.tolist(), counts.tolist(), strict=True):
            shorter[k] += n
        trie.deepen(*(np.array(list(x), dtype=np.int64) for x in (shorter, shorter.values())))
        if len(trie.child) <= order:
            node = trie.child[-1][before].astype(np.int64)
            use = (last > 0) & (node > 0) & (counts >= trie.least)
            trie.deepen((node * trie.width + last)[use], counts[use])
    return trie.prepare()


def slow_code(texts, text, order):
    """Plain PPM with exclusion of the longer context's symbols."""
    counts = Counter()
    for t in texts:
        s = b"\xff" + b" ".join(t.encode().lower().split()) + b"\xff"
        for i in range(1, len(s)):
            for d in range(min(order, i) + 1):
                counts[s[i - d : i], s[i]] += 1
    follow = {}
    for (context, symbol), n in counts.items():
        follow.setdefault(context, {})[symbol] = n
    s, total = b"\xff" + b" ".join(text.encode().lower().split()) + b"\xff", 0.0
    for i in range(1, len(s)):
        contexts = [s[i - d : i] for d in range(min(order, i), -1, -1)]
        seen = set()
        for c in (c for c in contexts if c in follow):
            rest = {x: n for x, n in follow[c].items() if x not in seen}
            escape = len(follow[c])
            norm = sum(rest.values()) + escape
            if s[i] in rest:
                total += math.log10(rest[s[i]] / norm)
                break
            total += math.log10(escape / norm)
            seen |= follow[c].keys()
        else:
            total -= math.log10(256 - len(follow.get(b"", {})))
    return total


@pytest.mark.parametrize("order", [2, 3, 4])
def test_code_lengths_equal_plain_ppm(order):
    texts = ["Abra cadabra abra", "", "a bar  a cab\nabra", "été été", "cab"]
    trie = built(texts, order)
    for text in [*texts, "abracadabra", "zebra", "x", "abé"]:
        data, _ = stream([text])
        assert trie.code_lengths(data).sum() == pytest.approx(slow_code(texts, text, order), rel=1e-4)


def test_next_symbol_chances_add_up_to_one():
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog"]
    for most in (1 << 20, 16):  # a whole trie and a pruned one
        trie = built(texts, 3, most)
        for before in (b"\xff", b"\xffthe ", b"\xffzq", b"\xffa c"):
            total = sum(
                10.0 ** float(trie.code_lengths(
                    np.frombuffer(before + bytes([x]), dtype=np.uint8))[-1])
                for x in range(256)
            )
            assert total == pytest.approx(1.0, rel=1e-3)
    assert END == 255


def check_base(rows, docs):
    counts, texts = Counter(), 0
    for i, t in docs:
        if i is None or crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            texts += 1
    total, kinds = sum(counts.values()) + texts, len(counts) + (texts > 0)
    wanted = []
    for i, t in docs:
        words = (t or "").encode().lower().split()
        c = [counts[w] for w in words] + [texts]
        base = sum(math.log10((n + 1) / (total + kinds + 1)) for n in c)
        held = i is not None and crc32(str(i).encode()) % 7 == 2
        wanted.append((i, held, len(c), sum(n > 0 for n in c), total, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
           for r in rows]
    assert sorted(got, key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("common", [1, 1 << 18])
def test_base_scores(documents, common):
    rows = lm_scores(documents, order=3, common=common).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores_of_odd_rows(odd, none):
    rows = lm_scores(odd, order=3).collect()
    check_base(rows, ROWS)
    assert lm_scores(none, order=3).count() == 0
    untrained = lm_scores(odd.where("doc_id = 7"), order=3, modulus=1, held=0).first()
    assert untrained.base_score == 0 and untrained.train_tokens == 0
    assert untrained.score == pytest.approx(-math.log10(256) * (len("one two.") + 1), rel=1e-5)


@pytest.mark.parametrize("order,frequent", [(0, 1 << 21), (2, 0), (4, 30), (6, 0), (6, 1 << 21)])
def test_scores_equal_plain_ppm_whatever_goes_out(spark, order, frequent):
    """No string is left out, and it does not matter which are joined."""
    rng = random.Random(order)
    texts = [
        " ".join(rng.choice(["ab", "abc", "Bca", "cab", "b\u00e4", "a\x00b", "zz"]) for _ in range(rng.randint(0, 9)))
        for _ in range(60)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = [t for i, t in enumerate(texts) if crc32(str(i).encode()) % 7 != 2]
    rows = lm_scores(df, order=order, frequent=frequent).collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = slow_code(learned, texts[row.doc_id], order)
        assert row.score == pytest.approx(wanted, rel=1e-9)


def test_rare_strings_count_in_large_corpora(spark):
    """Of some millions of symbols, a string of two or three occurrences still counts."""
    rows = [(i, "the same words of all the texts " * 120) for i in range(2_000)]
    rows += [(10_001 + i, "qxz jvk") for i in range(2)] + [(10_050, "qxz jvk"), (10_051, "kvj zxq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [t for i, t in rows if crc32(str(i).encode()) % 7 != 2]
    counts = Counter(texts)
    got = {r.doc_id: r.score for r in lm_scores(df).collect()}
    assert counts["qxz jvk"] >= 2 and len(texts[0]) * counts[texts[0]] > 4 << 20
    assert got[10_050] - got[10_051] > 10


# --- toxicity


def test_portions_equal_words_of_single_texts():
    rng = random.Random(6)
    signs = "aB.é數\x1c\u00a0 \t\n\r\x0b\x0c"
    texts = [t or "" for _, t in ROWS] + ["", " ", " a ", "x" * 31, "x" * 32, "X" * 40]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(300)]
    hashes = {}
    for some in (texts, [""], texts[-1:]):
        portion, lists = lm_scoring.Portion.of(some), [lower_words(t) for t in some]
        data, _ = stream_of(lists)
        assert portion.symbols.tobytes() == data.tobytes()
        assert np.diff(portion.cuts).tolist() == [len(w) for w in lists]
        keys = portion.words().tolist()
        for word, key_of in zip([w for words in lists for w in words], keys, strict=True):
            assert hashes.setdefault(word, key_of) == key_of
    assert len(set(hashes.values())) == len(hashes)


def test_words_of_texts_are_not_hashed_one_by_one(spark, monkeypatch):
    """Counting has nothing to do in Python for each different word of usual length."""
    calls, parts = [], []
    monkeypatch.setattr(lm_scoring, "word_hash",
                        lambda w, before=lm_scoring.word_hash: calls.append(w) or before(w))

    class Narrow:
        def mapInArrow(self, run, kinds):
            parts.append(run)
            return spark.createDataFrame([], kinds)

    lm_scoring.counted(Narrow(), 3, 7, 2)
    texts = [" ".join(f"new{i}" for i in range(2_000)), "y" * 40 + " new1"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [3, 3], "text": texts})
    rows = [r for out in parts[0](iter([batch])) for r in out.to_pylist()]
    assert sorted(r["n"] for r in rows if r["kind"] == lm_scoring.WORD) == [1] * 2_000 + [2]
    assert calls == [b"y" * 40]



def test_machine_equals_all_pairs():
    rng = np.random.default_rng(2)
    machine = Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    docs = [np.array([1, 4, 7]), np.array([], dtype=np.int64), np.array([2]), np.arange(20)]
    starts = np.cumsum([0, *map(len, docs)])
    for doc, got in zip(docs, machine.logits(np.concatenate(docs), starts), strict=True):
        pairs = sum(machine.vector[a] @ machine.vector[b] for a in doc for b in doc if a < b)
        assert got == pytest.approx(0.3 + machine.weight[doc].sum() + pairs)


def test_pairs_are_learned_beyond_weights(spark):
    """An insult or a group's name alone is fine, both together are not."""
    rows, labels = [], []
    for i in range(400):
        insult, group = i % 2, i // 2 % 2
        words = ["plain", "words", *(["stupid"] * insult), *(["folk"] * group)]
        rows.append((i, " ".join(words)))
        labels.append((i, insult & group))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = toxicity(docs, marks, epochs=60, rate=0.3, penalty=1e-4)
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in scores.collect())


def area(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p, n in product(pos, neg)) / (len(pos) * len(neg))


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity, "toxic", 0.8), (line_quality, "quality", 0.95)])
def test_held_out_ranking(spark, score, label, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert area([(r.score, r[label]) for r in rows]) >= least


@pytest.mark.parametrize("score", [toxicity, line_quality])
def test_scores_of_odd_documents(spark, odd, none, score):
    schema = "doc_id long, toxic int, quality int, text string"
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2, "x") for i in range(12)] + [(None, 1, 1, None), (1, None, None, "")],
        schema,
    )
    rows = score(odd, labels).collect()
    assert len(rows) == len(ROWS)
    held = lambda i: i is not None and crc32(str(i).encode()) % 5 == 0
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    assert score(none, labels).count() == 0
    untaught = score(odd, labels.where("false")).collect()
    assert {r.score for r in untaught} == {0.5}


# --- the line field


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(4)
    field = Field(np.zeros(1), rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        own = rng.normal(size=n).tolist()
        weight = {}
        for labels in product((0, 1), repeat=n):
            score = sum(o for o, y in zip(own, labels, strict=True) if y)
            score += sum(field.pair[a, b] for a, b in zip(labels, labels[1:], strict=False))
            weight[labels] = math.exp(score)
        total = sum(weight.values())
        good, pairs = field.marginals(own)
        for t in range(n):
            assert good[t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)
        for t, four in zip(range(n - 1, 0, -1), pairs, strict=True):
            wanted = [sum(w for y, w in weight.items() if (y[t - 1], y[t]) == ab) / total
                      for ab in ((0, 0), (0, 1), (1, 0), (1, 1))]
            assert four == pytest.approx(wanted)
    assert lines_of(None)[0].shape == lines_of(" \n")[0].shape
    assert sigmoid(np.array([0.0])) == 0.5


# --- language of pages


def test_page_parts():
    html = "<html xml:lang='de-AT'><script>if (a<b) x='en';</script><!-- no --><p>Gr&uuml;n</p>"
    assert visible(html).split() == ["Grün"]
    assert declared(html) == "de" and declared(None) == declared("<p>") == "-"
    assert address("https://user@www.Shop.example.DE:80/x") == ("www.shop.example.de", "example.de", "de")
    assert address(None) == address("nonsense") == ("-", "-", "-")


def test_evidence_is_fused(spark, documents, none):
    texts = {r.lang: r.text for r in documents.where("n_chars > 400").select("lang", "text").collect()}
    rows = [(i, f"https://h{i % 3}.site.{'de' if lang == 'de' else 'com'}/p", f"<html lang={lang}><p>{t}")
            for i, (lang, t) in enumerate(sorted(texts.items()) * 12)]
    rows += [(100, None, None), (101, "https://h0.site.de/q", "<html lang=de><p>"), (None, "x", "")]
    rows += [rows[0]] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "fit", F.lit("clash"))
    found = page_language(pages, documents).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    for i, (lang, _) in enumerate(sorted(texts.items()) * 12):
        assert by[i].lang == lang and 0 < by[i].confidence <= 1
    assert by[101].lang == "de" and by[101].text_lang is None  # markup and address alone
    assert by[100].declared == by[100].host == "-"
    assert page_language(pages.where("false"), documents).count() == 0
    assert {r.lang for r in page_language(pages, none).collect()} == {None}


def test_a_rare_language_is_learned_in_full(spark):
    """One text among thousands counts, and so does every text of the others."""
    rows = [(i, "the same plain words of a page", "en") for i in range(6_000)]
    rows += [(10_000 + i, f"y{'abcdefghij'[i]}z qwx jkq", "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, counts = gram_counts(docs, 1 << 12, 64)
    assert langs == ["en", "xx"]
    for lang, found in zip(langs, counts, strict=True):
        wanted = sum(np.bincount(grams(t, 1 << 12), minlength=1 << 12) for _, t, k in rows if k == lang)
        assert (found == wanted).all()


# --- bounded samples, linear scans


def test_fit_samples_are_bounded_by_rows(spark):
    """One id on thousands of rows, ids with two labels: at most ``fit_rows`` texts."""
    from ledgerloom.llm.toxicity import labelled_sample

    docs = spark.createDataFrame(
        [(1, f"text {i}") for i in range(3_000)] + [(i, "same") for i in range(2, 60)] * 2,
        "doc_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 60)] + [(2, 1), (4, 1)], "doc_id long, toxic int"
    )
    some = labelled_sample(docs, labels, "toxic", 100, 5, 0).collect()
    assert len(some) == len({(r.doc_id, r.text) for r in some}) == 100
    assert all(r.label == 1 for r in some if r.doc_id in (2, 4))
    whole = labelled_sample(docs, labels, "toxic", 10_000, 5, 0)
    assert whole.where("doc_id = 1").count() in (0, 3_000)
    again = labelled_sample(docs.repartition(7), labels, "toxic", 100, 5, 0).collect()
    assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.text) for r in some}


def test_hidden_markup_goes_in_one_scan():
    import re
    import time

    from ledgerloom.llm.language_id import without_hidden

    slow = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
    pieces = ["<script>", "</script>", "</SCRIPT >", "<style x>", "</style>", "<!--", "-->", "a b", "<p>", "<!-->", "<scripts>"]
    rng = np.random.default_rng(3)
    for _ in range(500):
        html = "".join(rng.choice(pieces, rng.integers(0, 14)))
        assert without_hidden(html) == slow.sub(" ", html)
    began = time.perf_counter()
    without_hidden("<script> <style> <!-- " * 100_000)
    assert time.perf_counter() - began < 5


def test_scoring_holds_few_terms_at_once(monkeypatch):
    """Portions of a batch are scored one by one, with the scores of the whole."""
    from ledgerloom.llm import toxicity as tox

    rng = np.random.default_rng(3)
    terms = tox.Terms(1 << 10)
    machine = tox.Machine(0.1, rng.normal(size=1 << 10), rng.normal(0, 0.1, (1 << 10, 4)))
    texts = [" ".join(f"w{rng.integers(500)}" for _ in range(int(n))) for n in rng.integers(0, 60, 80)]
    texts += [None, "", "w1"]
    whole, sizes, before = tox.scores_of(machine, texts, terms), [], tox.Machine.logits

    def watched(self, found, starts):
        sizes.append(len(found))
        return before(self, found, starts)

    monkeypatch.setattr(tox, "PORTION", 300)
    monkeypatch.setattr(tox.Machine, "logits", watched)
    assert np.array_equal(tox.scores_of(machine, texts, terms), whole)
    assert len(sizes) > 5 and max(sizes) <= 300
    assert len(tox.scores_of(machine, [], terms)) == 0
