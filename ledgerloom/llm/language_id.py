"""Language of web pages by Bayesian fusion of evidence.

For each language the evidence multiplies: how likely the page's text is (hashed
byte n-grams, learned from texts of known language), how likely such a page
declares the language it declares in its markup, how likely its address ends in its
suffix, and how common the language is on its host. The likelihoods of declarations
and suffixes and the host priors are learned from the pages themselves, as grouped
sums of the text's probabilities. Hosts are smoothed towards their domain, domains
towards all pages, and a page's own share is taken out of its priors.

Sums by host are partial aggregates, and their table, one row per host, is joined
back: a host with a third of all pages is a skewed key of a plain join.

The text model counts the n-grams of all texts of known language, a sum for each
language and bucket, so a rare language is learned from all it has. A null page or address, or one without text, is judged by
the evidence it has. Repeated rows are judged one by one. An empty table gives no
rows, and without texts of known language no page has a language. Of languages that
are as likely the first by name is taken. Pages of any length are read in one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import cut_lineage

HIDDEN = re.compile(r"<(script|style|noscript|template)\b|<!--", re.I)
CLOSED = {
    name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")
} | {"": re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
DECLARED = (
    re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", re.I),
    re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", re.I),
    re.compile(r"<meta\b[^>]*?og:locale[^>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", re.I),
)
ADDRESS = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)
NONE = "-"  # nothing declared, no address
GRAMS = (1, 2, 3, 4)


def without_hidden(html: str) -> str:
    """Elements that hold no text and comments as blanks, in one scan forward; what is
    opened and never closed stays."""
    out, at, begun, open_ended = [], 0, 0, set()
    while found := HIDDEN.search(html, at):
        name = (found[1] or "").lower()
        end = None if name in open_ended else CLOSED[name].search(html, found.end())
        if end is None:
            open_ended.add(name)  # nor is any later one of that name
            at = found.end()
            continue
        out += [html[begun : found.start()], " "]
        at = begun = end.end()
    return "".join([*out, html[begun:]])


def visible(html: str | None) -> str:
    return unescape(TAG.sub(" ", without_hidden(html or "")))


def declared(html: str | None) -> str:
    head = html or ""
    for pattern in DECLARED:
        found = pattern.search(head)
        if found:
            return found[1].lower()
    return NONE


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain and suffix."""
    found = ADDRESS.match((url or "").strip())
    host = found[1].lower().strip(".") if found else ""
    if not host:
        return NONE, NONE, NONE
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1]


def grams(text: str, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of a text in lower case, one space between words."""
    data = " ".join(text.lower().split()).encode("utf-8", "replace")
    if not data:
        return np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full(max(len(codes) - n + 1, 0), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        out.append((h ^ (h >> np.uint64(29))) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


def gram_counts(docs: DataFrame, buckets: int, max_langs: int) -> tuple[list[str], np.ndarray]:
    """Languages, and their counts of buckets, from all labelled texts."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    langs = [r["lang"] for r in known.select("lang").distinct().limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(),
                                  strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, dtype=np.int64)
                sums[lang] += np.bincount(grams(text or "", buckets), minlength=buckets)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                ["lang", "bucket", "n"],
            )

    rows = known.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    summed = rows.groupBy("lang", "bucket").agg(F.sum("n"))
    langs = sorted(langs)
    counts = np.zeros((len(langs), buckets))
    for lang, bucket, n in summed.collect():  # at most languages x buckets
        counts[langs.index(lang), bucket] = n
    return langs, counts


def read_pages(pages: DataFrame, logs: np.ndarray, id_col: str, most_grams: float) -> DataFrame:
    """Evidence of every page: host, domain, suffix, declaration, log-likelihoods.

    n-grams overlap, so they are not independent: a text counts as ``most_grams``
    of them at most."""
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(),
                                 strict=True):
                found = grams(visible(html), own.shape[1])
                n = len(found)
                fit = own[:, found].sum(axis=1) * min(1.0, most_grams / n) if n else np.zeros(len(own))
                rows.append((*address(url), declared(html), (fit - fit.max()).tolist(), n))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"),
                 *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["page_id", "host", "domain", "suffix", "declared", "fit", "n_grams"],
            )

    narrow = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"page_id {kind}, host string, domain string, suffix string, declared string, "
        "fit array<double>, n_grams long",
    )


def _shares(parts: list[Column]) -> list[Column]:
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def page_language(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    buckets: int = 1 << 14,
    max_langs: int = 64,
    most_grams: float = 60.0,
    strength: float = 5.0,
) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, suffix, host`` of every page.
    ``strength`` is the number of pages the next wider prior counts as."""
    langs, counts = gram_counts(docs, buckets, max_langs)
    if not langs:
        return pages.select(
            F.col(id_col).alias("page_id"), F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(NONE).alias("declared"),
            F.lit(NONE).alias("suffix"), F.lit(NONE).alias("host"),
        )
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets))
    n = len(langs)
    evidence = cut_lineage(read_pages(pages, logs, id_col, most_grams))
    texts = _shares([F.exp(F.col("fit")[i]) for i in range(n)])
    rows = evidence.select("*", *[p.alias(f"q{i}") for i, p in enumerate(texts)])

    def sums(*keys: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(f"q{i}").alias(f"{name}{i}") for i in range(n)])

    out = rows
    for key, name in (("declared", "d"), ("suffix", "s"), ("domain", "m"), ("host", "h")):
        out = out.join(sums(key, name=name), key)
    over_all = rows.agg(*[F.sum(f"q{i}") for i in range(n)]).first()  # one number a language
    out = out.withColumns({f"a{i}": F.lit(float(over_all[i] or 0.0)) for i in range(n)})

    def rest(name: str, i: int) -> Column:
        """What other pages say: a page's own share is taken out."""
        return F.greatest(F.col(f"{name}{i}") - F.col(f"q{i}"), F.lit(0.0))

    everywhere = _shares([rest("a", i) + 1.0 for i in range(n)])

    def towards(name: str, wider: list[Column]) -> list[Column]:
        own = [rest(name, i) for i in range(n)]
        total = sum(own[1:], own[0])
        return [(o + strength * w) / (total + strength) for o, w in zip(own, wider, strict=True)]

    out = out.select("*", *[p.alias(f"p{i}") for i, p in enumerate(everywhere)])
    out = out.select("*", *[
        p.alias(f"pm{i}") for i, p in enumerate(towards("m", [F.col(f"p{i}") for i in range(n)]))])
    out = out.select("*", *[
        p.alias(f"ph{i}") for i, p in enumerate(towards("h", [F.col(f"pm{i}") for i in range(n)]))])

    def likelihood(name: str, i: int) -> Column:
        """Of this declaration or suffix in language i, with one page for the unseen."""
        return (rest(name, i) + F.col(f"p{i}")) / (rest("a", i) + 1.0)

    odds = [
        F.log(F.col(f"ph{i}")) + F.log(likelihood("d", i)) + F.log(likelihood("s", i))
        + F.col("fit")[i]
        for i in range(n)
    ]
    scored = out.select("*", *[o.alias(f"o{i}") for i, o in enumerate(odds)])
    top = F.greatest(*[F.col(f"o{i}") for i in range(n)]) if n > 1 else F.col("o0")
    mass = sum((F.exp(F.col(f"o{i}") - F.col("top")) for i in range(1, n)),
               F.exp(F.col("o0") - F.col("top")))

    def best(prefix: str, value: Column) -> Column:
        found = F.lit(langs[-1])
        for i in range(n - 2, -1, -1):
            found = F.when(F.col(f"{prefix}{i}") >= value, langs[i]).otherwise(found)
        return found

    most = F.greatest(*[F.col(f"q{i}") for i in range(n)]) if n > 1 else F.col("q0")
    return scored.withColumn("top", top).select(
        "page_id",
        best("o", F.col("top")).alias("lang"),
        (1.0 / mass).alias("confidence"),
        F.when(F.col("n_grams") > 0, best("q", most)).alias("text_lang"),
        "declared", "suffix", "host",
    )
