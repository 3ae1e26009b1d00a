"""Prediction by partial matching over bytes: strings, their counts, code lengths.

A text is the stream of its lower-cased words, one space apart, and an end symbol.
A context of up to ``order`` symbols predicts the next symbol by the counts of what
follows it. What does not is reached by an escape to the next shorter context, where
the symbols of the longer one are excluded, and in the end by equal shares of the
symbols never seen. The escape of a context counts its distinct symbols.

A symbol with the symbols before it is one whole number (``string_keys``), and all
that its code length hangs on are counts of strings that share their latest symbols
with it. So ``log_probabilities`` takes the distinct strings of some groups, a group
being all those with the same latest ``SHALLOW + 1`` symbols of context, and the
levels of the shallow contexts, of which there are few.

``Trie`` is the same model in one process, its children arrays by depth; there a node
may be kept only if it makes up at least one part in ``most_nodes`` of all symbols,
and what is left out counts towards the escape.
"""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.common import lower_words

END = 0xFF  # no byte of UTF-8


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts in a row, an end symbol first and after each, and where
    each text's symbols start (from the second on)."""
    return stream_of([lower_words(t) for t in texts])


def stream_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the words of texts."""
    parts = [b" ".join(w) for w in words]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    joined = b"\xff" + b"".join([p + b"\xff" for p in parts])
    return np.frombuffer(joined, dtype=np.uint8), np.cumsum(sizes) - sizes + 1


def sums_of(
    keys: np.ndarray, counts: np.ndarray | None = None, sort: str = "quicksort"
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or what its counts add up to).
    A ``stable`` sort takes half the time where keys are a long run in order and some short ones."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind=sort)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


ORDER = 6  # symbols of context that a key has room for
SHALLOW = 2  # depth of the contexts all groups share
LENGTH, STRING = 56, (1 << 56) - 1  # where a key holds its length, and its string


def kept_bits(depth: int) -> int:
    """The bits of a key that hold the symbol and its latest ``depth`` of context."""
    return 0xFF | STRING & -(1 << LENGTH - 8 * depth)


def string_keys(data: np.ndarray, order: int) -> np.ndarray:
    """Every symbol of a stream but the first, with its context: the length of that, then
    the context from its latest symbol on, then the symbol."""
    wide = data.astype(np.int64)
    keys = wide[1:].copy()
    for d in range(1, min(order, len(keys)) + 1):
        keys[d - 1:] |= wide[:-d] << LENGTH - 8 * d
    keys |= order << LENGTH
    ends = np.flatnonzero(data == END)
    sizes = np.diff(ends)
    for t in range(1, order):  # a text's start is known by the end symbol alone
        at = ends[:-1][sizes >= t] + t - 1
        keys[at] = keys[at] & kept_bits(t) | t << LENGTH
    return keys


def found_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among known ones in order, and whether they are there."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def at_depth(keys: np.ndarray, depth: int) -> np.ndarray:
    """Context of some depth and symbol; of keys that are long enough."""
    return (keys & STRING) >> LENGTH - 8 * depth << 8 | keys & 0xFF


class Level:
    """Contexts of one depth, what follows them how often, and how much of the level
    above (one symbol shorter) their symbols take."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, above: Level | None):
        use = (keys >> LENGTH >= depth) & (counts > 0)
        self.depth = depth
        self.child, self.count = sums_of(at_depth(keys[use], depth), counts[use])
        own = self.child >> 8
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        self.context = own[first]
        self.total, self.taken = (np.zeros(len(first), dtype=np.int64) for _ in range(2))
        if len(first):
            self.total = np.add.reduceat(self.count, first)
            if above is not None:
                shorter, _ = found_in(above.child, own >> 8 << 8 | self.child & 0xFF)
                self.taken = np.add.reduceat(above.count[shorter], first)
        self.kinds = np.diff(np.append(first, len(own)))


def levels_of(keys: np.ndarray, counts: np.ndarray, depths: range, before: list[Level]) -> list[Level]:
    out = list(before)
    for depth in depths:
        out.append(Level(keys, counts, depth, out[-1] if out else None))
    return out[len(before):]


def log_probabilities(
    keys: np.ndarray, counts: np.ndarray, order: int, shallow: list[Level]
) -> np.ndarray:
    """log10 probability of the symbols of distinct strings, given their contexts;
    ``counts`` are their training occurrences, which may be 0."""
    levels = shallow + levels_of(keys, counts, range(len(shallow), order + 1), shallow)
    never = 256 - len(shallow[0].child)
    score = np.full(len(keys), -np.log10(max(never, 1)))
    # of the level above: what the next escape leads to, occurrences, weights
    last, seen, room, full = score.copy(), None, None, None
    for level in levels:
        at = at_depth(keys, level.depth)
        ctx, valid = found_in(level.context, at >> 8)
        valid &= keys >> LENGTH >= level.depth
        rows = np.flatnonzero(valid)
        ctx, at = ctx[rows], at[rows]
        child, hit = found_in(level.child, at)
        n = np.where(hit, level.count[child], 0) if len(level.child) else np.zeros(len(rows))
        if seen is not None:
            left = np.log10(np.maximum(full[rows] - level.taken[ctx], room[rows]))
            up = seen[rows]
            last[rows] = np.where(
                up > 0, np.log10(np.maximum(up, 1)), np.log10(room[rows]) + last[rows]
            ) - left
        kinds, total = level.kinds[ctx], level.total[ctx]
        score[rows] = np.where(
            n > 0, np.log10(np.maximum(n, 1)), np.log10(kinds) + last[rows]
        ) - np.log10(total + kinds)
        seen, room, full = (np.zeros(len(keys)) for _ in range(3))
        seen[rows], room[rows], full[rows] = n, kinds, total + kinds
    return score


class Trie:
    def __init__(self, most_nodes: int = 1 << 20) -> None:
        self.most_nodes = most_nodes
        self.total = 0  # training symbols
        self.code = np.zeros(256, dtype=np.int32)  # of a byte; 0: never seen
        self.width = 1
        self.child: list[np.ndarray] = []  # by depth of the context
        self.suffix: list[np.ndarray] = [np.zeros(2, dtype=np.int32)]
        self.count: list[np.ndarray] = [np.zeros(2)]  # by depth of the node

    # --- building, one depth at a time

    def start(self, singles: np.ndarray) -> None:
        """From the number of each byte."""
        self.total = int(singles.sum())
        self.count[0][1] = self.total
        bytes_seen = np.flatnonzero(singles)
        self.code[bytes_seen] = np.arange(1, len(bytes_seen) + 1)
        self.width = len(bytes_seen) + 1
        # children of the root, node 1
        self.deepen(self.width + self.code[bytes_seen].astype(np.int64), singles[bytes_seen])

    @property
    def least(self) -> int:
        """Occurrences a string needs to be a node."""
        return max(1, -(-self.total // self.most_nodes))

    def deepen(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add a depth: ``keys`` are ``context * width + symbol`` with their counts."""
        kept = counts >= (self.least if self.child else 1)
        keys, counts = keys[kept], counts[kept]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        child = np.zeros(len(self.count[-1]) * self.width, dtype=np.int32)
        child[keys] = np.arange(1, len(keys) + 1)
        context, symbol = np.divmod(keys, self.width)
        if self.child:
            up = self.child[-1][self.suffix[-1][context].astype(np.int64) * self.width + symbol]
        else:
            up = np.ones(len(keys), dtype=np.int32)  # a single symbol's suffix is the root
        self.child.append(child)
        self.suffix.append(np.append(0, up).astype(np.int32))
        self.count.append(np.append(0.0, counts))

    def contexts(self, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Context of ``depth`` symbols before, and code of, every symbol but the first."""
        codes = self.code[data]
        ends = data[:-1] == END
        context = np.ones(len(data) - 1, dtype=np.int64)
        for d in range(depth):
            context = self.next_context(context, codes, ends, d, data)
        return context, codes[1:]

    def next_context(self, context, codes, ends, d, data):
        """From the contexts of depth ``d`` to those of depth ``d + 1``."""
        before = self.child[d][context * self.width + codes[1:]]  # string that ends at a symbol
        first = self.child[0][self.width + codes[0]] if d == 0 else 0
        longer = np.append(np.int32(first), before[:-1]).astype(np.int64)
        if d:
            longer[ends] = 0  # a text's start is known by the end symbol alone
        return longer

    def count_next(self, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the strings two longer than contexts of ``depth``; the
        end has no symbol after it, and 0 in its place."""
        context, first = self.contexts(data, depth)
        second = np.append(first[1:], 0)
        second[data[1:] == END] = 0
        keys = (context * self.width + first) * self.width + second
        return sums_of(keys[context > 0])

    # --- coding

    def prepare(self) -> Trie:
        """The values of nodes that code lengths are sums of, in log10."""
        self.own, self.fresh, self.fall, self.below = [], [], [], []
        escape = []
        steps = [np.zeros(2)]
        for d, child in enumerate(self.child):
            n = len(self.count[d])
            parent, _ = np.divmod(np.flatnonzero(child), self.width)
            made = self.count[d + 1][1:]
            kinds = np.bincount(parent, minlength=n).astype(float)
            kept = np.bincount(parent, made, minlength=n)
            # a context is followed by a symbol as often as it occurs
            room = np.maximum(self.count[d] - kept, 0) + np.maximum(kinds, 1)
            # what its suffix loses when the context's children are excluded
            lost = np.bincount(parent, self.count[d][self.suffix_of_children(d)], minlength=n)
            escape.append(np.log10(room))
            self.own.append(np.log10(kept + room))
            if d:
                up = self.suffix[d]
                left = self.full[up] - lost
                rest = np.log10(np.maximum(left, self.room[up]))
                step = escape[d - 1][up] - rest
                steps.append(step + steps[d - 1][up])
                self.below.append(steps[d] + rest)
            else:
                self.below.append(np.zeros(n))
            self.fall.append(escape[d] - self.own[d] + steps[d])
            self.fresh.append(np.log10(np.maximum(np.append(0.0, made), 1)))
            self.full, self.room = kept + room, room
        never = 256 - int((self.code > 0).sum())
        self.novel = -np.log10(max(never, 1))
        self.first = np.cumsum([0, *map(len, self.own)])[:-1].astype(np.int32)
        self.own = np.concatenate(self.own).astype(np.float32)
        self.fall = np.concatenate(self.fall).astype(np.float32)
        self.below = [b.astype(np.float32) for b in self.below]
        self.fresh = [f.astype(np.float32) for f in self.fresh]
        return self

    def suffix_of_children(self, d: int) -> np.ndarray:
        """For the children of contexts of depth ``d``, in order: the node of the
        string without its first symbol, one depth less."""
        return self.suffix[d + 1][1:]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol but the first."""
        codes, ends = self.code[data], data[:-1] == END
        symbols = codes[1:]
        context = np.ones(len(symbols), dtype=np.int32)
        deepest = np.ones(len(symbols), dtype=np.int32)  # context, numbered over all depths
        tail = np.full(len(symbols), self.novel, dtype=np.float32)
        node = hit = valid = None
        for d, child in enumerate(self.child):
            if d:
                # the string that ended at the symbol before is the longer context
                context[1:] = node[:-1]
                context[0] = self.child[0][self.width + codes[0]] if d == 1 else 0
                if d > 1:
                    context[ends] = 0
                valid = context > 0
                np.subtract(tail, self.below[d][context], out=tail, where=hit & valid)
                np.copyto(deepest, context + self.first[d], where=valid)
            node = child[context * self.width + symbols]
            found = node > 0
            np.copyto(tail, self.fresh[d][node], where=found)
            hit = found if hit is None else (hit & ~valid) | found
        return np.where(hit, tail - self.own[deepest], tail + self.fall[deepest])
