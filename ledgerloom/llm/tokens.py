"""Token ids of whole texts, through the tokenizers library.

Texts repeat their words, so the library is asked once for each distinct chunk
between ASCII white space and the answer is kept. This is done only for
tokenizers that treat such chunks alone; the rules a chunk is taken apart by are
each tried on probe texts when an encoder is made, and a rule that changes an id
is not used. Chunks of Latin letters, with a run of signs after them or without, are
put to the tokenizer's model directly. The memo has a fixed size: it holds nothing a
text would lose.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

PROBES = (
    "One two  three.\tfour\nfive, six.. seven., EIGHT",
    "it's we'll  O'Clock 12 3 34, (x) - y it's. 5. a.b. c,d, 'tis,",
    "Über  été. 你好 世界. \U0001f600 \U0001f600, İstanbul ΣΑΣ straße, é. ́.",
    "a ́b   c d. zzzz,",
    " lead\r\nand trail \x0b\x0c",
)
WORDS = ("a", "the", "thandingedon", "zzzzqqq", "re", "s", "internationalization")
LATIN = ("été", "straße", "ÀÉÎÕÜ", "Þýÿ", "çaéñø", "ðæåö", "ouèon", "é", "zzùzz")
SIGNS = (".", ",", "!!", "$$$", "&&&", "***", "###", "%%%", ".***", ",%%%", "?!", '."', ").", "-_-",
         "@#", "[]", "{}|~", "<>=", "`^", "/\\:;", "+")
MET = 1 << 22  # places, by hash, for what a memo has met once; a power of two
LETTERS = re.compile("[a-zà-öø-ÿ]+")  # lower case of Latin letters that are one character each
SIGNED = re.compile(rb"(.*?[a-z\x80-\xff])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)  # no apostrophe


def byte_letters() -> dict[int, str]:
    """What byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Memo(dict):
    """Ids of chunks; one that is not there is asked for, and kept while there is room
    from the second time on. Most chunks of a text are met once and would fill it."""

    def __init__(self, find, most: int) -> None:
        super().__init__()
        self.find, self.most = find, most
        self.met, self.places = bytearray(MET), MET - 1

    def __missing__(self, chunk: bytes) -> bytes:
        ids, place = self.find(chunk), hash(chunk) & self.places
        if not self.met[place]:
            self.met[place] = 1
        elif len(self) < self.most:
            self[chunk] = ids
        return ids


class Encoder:
    """``encode`` turns texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, kept: int = 1 << 18) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        most = max(self.tokenizer.get_vocab().values(), default=0)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(most + 1)]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = kept  # entries of a generation of the memo, two of which are held
        self.young, self.old = Memo(self._find, 2 * kept), {}
        wanted = self.whole(list(PROBES))
        self.bare = self.folds = self.stops = self.latin = False
        self.by_chunk = self._as_chunks() == wanted
        for rule in ("folds", "stops"):
            setattr(self, rule, True)
            setattr(self, rule, self._as_chunks() == wanted)
        self.bare = [self._bare(w) for w in WORDS] == self.whole(list(WORDS))
        if self.bare and self.folds:
            both = [w + s for w in (*LATIN, *WORDS) for s in ("", *SIGNS)]
            self.latin = True
            self.latin = [self._find(t.encode().lower()) for t in both] == self.whole(both)
        self.young.clear()

    def _as_chunks(self) -> list[bytes]:
        self.young.clear()
        return [self._joined(p) for p in PROBES]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _bare(self, word: str) -> bytes:
        """Ids of a word that is its own normal form and its own pre-token."""
        named = self.id_bytes
        return b"".join([named[t.id] for t in self.model.tokenize(word)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self.whole(texts)
        return [
            self.whole([t])[0] if any(s in t for s in self.special) else self._joined(t)
            for t in texts
        ]

    def _joined(self, text: str) -> bytes:
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, Memo(self._find, 2 * self.kept)
        raw = text.encode("utf-8", "replace")
        chunks = (raw.lower() if self.folds else raw).split()
        return b"".join(map(self.young.__getitem__, chunks))

    def _find(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            return ids
        if self.bare and chunk.isalpha() and chunk.islower():  # of bytes: ASCII letters alone
            return self._bare(chunk.decode())
        if self.latin:
            signed = SIGNED.fullmatch(chunk)
            stem = chunk if signed is None else signed[1]
            word = stem.decode().lower()
            if LETTERS.fullmatch(word):
                if signed is not None:
                    return self.young[stem] + self._bare(signed[2].decode())
                return self._bare("".join([self.letters[b] for b in word.encode()]))
        elif self.stops and chunk[-1:] in (b".", b",") and chunk[:-1].decode()[-1:].isalpha():
            return self.young[chunk[:-1]] + self.young[chunk[-1:]]
        return self.whole([chunk.decode()])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
