import random
from zlib import crc32

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from ledgerloom.llm import token_store
from ledgerloom.llm.packing import best_fit_decreasing, pack, sequences
from ledgerloom.llm.quality_rules import quality_rules
from ledgerloom.llm.tokens import Encoder
from ledgerloom.llm.wavelet import WaveletMatrix, build
from tests.llm.conftest import LONG, ROWS, TEXT

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return crc32(np.array(ids, dtype="<u4").tobytes())


# --- quality rules


def test_rules_on_odd_rows(odd, none):
    rows = quality_rules(odd).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.n_words): r for r in rows}
    for row in rows:
        if row.n_words == 0:
            assert row.base_failed and not row.kept and row.n_dup_lines == 0
    assert sum(r.n_words == 0 for r in rows) == 4
    assert by[1, len(TEXT.split())].kept and by[1, len(TEXT.split())].word_chars == len("".join(TEXT.split()))
    assert by[5, len(LONG.split())].n_repeat_words == 0
    assert quality_rules(none).count() == 0


def test_rules_count_repeats_and_lines(spark):
    def one(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return quality_rules(df).first()

    # the middle window overlaps itself: positions 0-6 are all in repeated windows
    assert one("a a a a a a a b c d e f").n_repeat_words == 7
    assert one("a b c d e x a b c d e").n_repeat_words == 10
    row = one("same line here.\n\nsame line here.\n \nother line here.")
    assert (row.n_dup_lines, row.n_lines) == (1, 3)
    good = "This is a good line with a number of words in it, and it ends.\n"
    assert one(good).kept
    assert not one(good.replace(" ", "### ")).kept
    assert not one("Home | News | Sport | Help | Login | Mail | Shop | Maps | Jobs | More | Last").kept
    assert not one("\n".join(f"Licensed under the terms of use number {i}." for i in range(5))).kept
    mixed = one(good + "Another one says much the same, but says it in its own way.\nHome | News | Help")
    assert mixed.kept and "|" not in mixed.clean_text


def test_verdict_can_be_filtered(odd):
    assert quality_rules(odd).where("kept").count() == 7  # five of the texts, the long one, the last


# --- tokens


def test_encoder_equals_the_library(documents, ids_of):
    encoder = Encoder(FILE, kept=500)  # so small that it is renewed all the time
    assert encoder.by_chunk
    texts = [r.text for r in documents.select("text").collect()] + [t or "" for _, t in ROWS] + [
        "<|endoftext|> x<|startoftext|>", "It's THEY'LL don't", "a.b,c. d.. e., .,", "x" * 3000,
    ]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == ids_of(text)


def test_encoder_keeps_what_comes_again():
    """Chunks that a corpus has once are not held, those that come again are; Latin
    letters and signs after them have the library's ids."""
    rng = random.Random(3)
    encoder = Encoder(FILE)
    letters, signs = "abtheèéßøÀÞİıǅ×ª'´ſ", [".", ",%%%", "&&&", "'s", ".'", "½", "_-", ""]
    texts = [
        " ".join("".join(rng.choices(letters, k=12)) + rng.choice(signs) for _ in range(40)) + " again, again"
        for _ in range(50)
    ]
    assert encoder.latin
    assert encoder.encode(texts) == encoder.whole(texts)
    assert b"again" in encoder.young and b"again," in encoder.young
    assert len(encoder.young) + len(encoder.old) < 200  # of 2,000 chunks


def test_encoder_falls_back_to_whole_texts():
    encoder = Encoder(path("byte_bpe_50k.json"))
    assert not encoder.by_chunk
    text = "  two  spaces and\n\nlines "
    library = Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text).ids
    assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == library


# --- packing


def plain_best_fit(sizes, capacity):
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= size
        else:
            room.append(capacity - size)
    return sorted(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 31, 64])
    counts = {s: rng.randint(1, 12) for s in range(1, capacity + 1) if rng.random() < 0.7}
    windows = {}
    ranks = {s: [] for s in counts}
    for size, rank, n, window, offset in best_fit_decreasing(counts, capacity).tolist():
        ranks[size] += range(rank, rank + n)
        for i in range(n):
            windows.setdefault(window + i, []).append((offset, size))
    assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items())
    left = []
    for pieces in windows.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        left.append(capacity - at)
    sizes = [s for s, n in counts.items() for _ in range(n)]
    assert sorted(left) == plain_best_fit(sizes, capacity)


def test_pack_on_odd_rows(odd, none, ids_of):
    packed = pack(odd, FILE, capacity=64, keep_ids=True)
    rows = packed.collect()
    wanted = sorted(crc(ids_of(t) + [1]) for _, t in ROWS if len(ids_of(t)) < 64)
    assert sorted(r.ids_crc32 for r in rows if r.doc_tokens <= 64) == wanted
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start)
    ids = ids_of(LONG) + [1]
    assert [r.start for r in long] == list(range(0, len(ids), 64))
    assert all(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in long)
    for row in sequences(packed).collect():
        at = 0
        for piece in row.pieces:
            assert piece.offset == at
            at += piece.length
        assert len(row.ids) == 4 * at <= 256
    assert pack(none, FILE).count() == 0


# --- token store


@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(max=40_000).astype(np.uint32)
    matrix = WaveletMatrix(build(ids, np.arange(2), np.array([n, 0])))
    assert (matrix.decode() == ids).all()
    assert [x.tolist() for x in matrix.documents()] == [[0, 1], [n, 0]]
    assert matrix.count(50_000) == 0
    for at in rng.integers(0, n, min(n, 20)).tolist():
        symbol = int(ids[at])
        places = np.flatnonzero(ids == symbol)
        assert matrix.access(at) == symbol
        assert matrix.count(symbol) == len(places)
        assert matrix.rank(symbol, at) == (places < at).sum()
        assert matrix.select(symbol, len(places) - 1) == places[-1]
    with pytest.raises(IndexError):
        matrix.select(60_000, 0)


def test_store_on_odd_rows(spark, odd, none, ids_of):
    path_ = token_store.new_folder(spark, "tokens")
    token_store.write_tokens(odd, path_, FILE, shard_tokens=100)
    rows = sorted(token_store.read_documents(spark, path_).collect(), key=lambda r: r.start)
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (len(ids_of(t)) + 1, crc(ids_of(t) + [2])) for _, t in ROWS
    )
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    ends = token_store.occurrences(spark, path_, 2).agg({"n": "sum"}).first()[0]
    assert ends >= len(ROWS)
    empty = token_store.new_folder(spark, "tokens")
    token_store.write_tokens(none, empty, FILE)
    assert token_store.read_documents(spark, empty).count() == 0
