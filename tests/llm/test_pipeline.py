from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from ledgerloom.llm.simhash import fingerprint
from tests.llm.conftest import ROWS
from tests.llm.test_duplicates_and_search import components


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage keeps of the smallest tables."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.toPandas())
    for name, stage in pipeline.STAGES:
        folder = pipeline.new_folder(spark, "test")
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(kept):
    for before in kept[1:5]:
        assert list(before.columns) == list(kept[0].columns)
        assert (before.n_chars == before.text.str.len()).all()


def test_rejected_documents_go(kept, spark, sf):
    judged = entry.queries()["op1_quality_rules"](spark, sf).toPandas()
    assert set(kept[1].doc_id) == set(judged[judged.kept].doc_id)
    whole = dict(zip(kept[0].doc_id, kept[0].text, strict=True))
    assert all(set(t.split("\n")) <= set(whole[i].split("\n"))
               for i, t in zip(kept[1].doc_id, kept[1].text, strict=True))


def test_recurring_lines_stay_once(kept):
    texts = set(kept[1].text)
    held = Counter(w for t in texts for w in {" ".join(x.split()) for x in t.split("\n")}
                   if len(w.split()) >= 3 and not any(c.isdigit() for c in w))
    recurring = {w for w, n in held.items() if n >= 3}
    left = Counter(w for t in kept[2].text for w in {" ".join(x.split()) for x in t.split("\n")})
    assert recurring and all(left[w] == 1 for w in recurring)


def test_one_of_each_group_stays(kept):
    """Brute force over all pairs: candidates by the fingerprints of distinct words,
    links by the similarity of five-word shingles; nearly all similar pairs are found."""
    words = {i: t.encode().lower().split() for i, t in zip(kept[2].doc_id, kept[2].text, strict=True)}
    ids = sorted(words)
    fps = {i: fingerprint(sorted(set(w)), 1) for i, w in words.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 6]
    crowd = components(near, ids)
    similar = [
        (a, b) for a in ids for b in ids
        if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    ]
    links = [(a, b) for a, b in similar if crowd[a] == crowd[b]]
    assert set(kept[3].doc_id) == {i for i, root in components(links, ids).items() if i == root}
    assert len(links) >= 0.9 * len(similar) > 0


def test_benchmark_documents_go(kept, spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text
    holds = {i for i, t in zip(kept[3].doc_id, kept[3].text, strict=True) if any(x in t for x in items)}
    assert not holds & set(kept[4].doc_id)
    assert len(kept[4]) >= len(kept[3]) - len(holds) - 2  # paraphrases aside, nothing else goes


def test_all_tokens_are_packed(kept):
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = kept[5].sort_values(["doc_id", "start"])
    assert set(pieces.doc_id) == set(kept[4].doc_id)
    for i, text in zip(kept[4].doc_id, kept[4].text, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        own = pieces[pieces.doc_id == i]
        assert own.length.sum() == len(ids)
        assert all(crc32(ids[a : a + n].tobytes()) == c
                   for a, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    assert kept[5].groupby("sequence_id").length.sum().max() <= 2048


def test_odd_and_empty_rows(spark, sf, odd, none):
    docs = odd
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    assert 0 < docs.count() <= len(ROWS)
    assert pipeline.near_copies(spark, odd, sf).where("doc_id = 1").count() == 1
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_rows_of_one_id_are_told_apart(spark, sf):
    """A copy goes and another text of its id stays; the same for contaminated texts."""
    a = " ".join(f"alpha{i}" for i in range(80))
    b = " ".join(f"beta{i}" for i in range(80))
    docs = spark.createDataFrame([(1, a), (4, a), (4, b), (4, b), (9, a + " end")], "doc_id long, text string")
    found = sorted(map(tuple, pipeline.near_copies(spark, docs, sf).collect()))
    assert found == [(1, a), (4, b)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, f"{b} {item} {b}"), (1, b), (2, a)], "doc_id long, text string")
    left = {tuple(r) for r in pipeline.decontaminate(spark, docs, sf).collect()}
    assert left == {(1, b), (2, a)}


def test_clashing_columns_pass_through(spark, sf):
    names = ["row", "clean_text", "_hash", "_dropped", "_id", "_stays", "hash", "text_hash", "dropped",
             "group", "_row", "kept", "first", "line_no", "key", "found"]
    text = "This line is quite long enough to be kept as it stands.\nAnd so is this one, with more words in it."
    rows = [(i, f"{text} {'abcdefgh'[i] * 9} here.", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", *names]
        for r in docs.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
    assert docs.count() > 0


def test_registered():
    assert entry.queries()["pipeline"] is pipeline.run and "pipeline" not in entry.oracle_sql()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
