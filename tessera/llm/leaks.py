"""Evaluation items whose text stands, wholly or in pieces, in training documents.

Q-gram filtering over letters and digits only: an item's character q-grams are looked up at every place of every document, hits of one document and item are counted in overlapping bands of
diagonals, and a window of a band is kept only where it shares as many q-grams as the edit budget leaves at least. What is kept is verified by banded alignment. Sentences that many items
share are no part of an item. The items are the stated set of queries: they are indexed in blocks of bounded size, and each block is held against all documents, whose texts are never shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import spread

#: Letters and digits of a passage at least, characters of a q-gram, and words of a passage that may differ, of Latin and of Chinese text.
PASSAGE, GRAM, EDITS = {False: 50, True: 20}, {False: 12, True: 5}, 1
#: Letters of an edited word, to either side.
WORD = {False: 6, True: 3}
#: Share of an item that its passages have to make up.
COVERED = 0.4
#: Items from which on a sentence is a shared rule.
SHARED = 3
#: Diagonals in half a band; letters of a passage of which so many at most may differ.
HALF_BAND, DIFFER = 24, 0.2
#: Q-grams of the items that one pass over the documents looks for.
BLOCK = 400_000
#: Characters of documents whose q-grams are held at once.
CHUNK = 2_000_000

SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
MARKUP = re.compile(r"<[^<>\n]{1,200}>|&(?:#?[A-Za-z0-9]{2,8});|\\[nrt]|\]\([^()\s]*\)")
CJK = re.compile("[㐀-鿿]")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Letters and digits in lower case, without markup and its escapes."""
    text = MARKUP.sub(lambda m: " " if m.group()[0] != "&" else f" {html.unescape(m.group())} " if ";" in m.group() else m.group(), text)
    return "".join(c for c in text.lower() if c.isalnum())


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    h = np.zeros(n, "uint64")
    for k in range(q):
        h = (h ^ codes[k : k + n].astype("uint64")) * PRIME
        h ^= h >> np.uint64(29)
    return h


def item_pieces(rows: list[tuple[int, list[tuple[str, bool]]]]) -> list[tuple[int, str, np.ndarray, bool]]:
    """(item_id, letters, own, chinese): own tells for each letter whether it belongs to a sentence of the item's own."""
    out = []
    for item, sentences in rows:
        own = np.concatenate([np.full(len(s), mine) for s, mine in sentences] or [np.zeros(0, bool)])
        letters = "".join(s for s, _ in sentences)
        out.append((item, letters, own, len(CJK.findall(letters)) * 2 > len(letters)))
    return out


def _index(pieces: list[tuple[int, str, np.ndarray, bool]], chinese: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, with the item and the place of each."""
    q, hashes, items, places = GRAM[chinese], [], [], []
    for k, (_, letters, own, zh) in enumerate(pieces):
        if zh != chinese:
            continue
        h = grams(np.array([ord(c) for c in letters], "uint32"), q)
        ours = np.convolve(own, np.ones(q, int), "valid") == q if len(own) >= q else np.zeros(0, bool)
        at = np.flatnonzero(ours)
        hashes.append(h[at])
        items.append(np.full(len(at), k, "int32"))
        places.append(at.astype("int32"))
    if not hashes:
        return np.zeros(0, "uint64"), np.zeros(0, "int32"), np.zeros(0, "int32")
    h, i, p = np.concatenate(hashes), np.concatenate(items), np.concatenate(places)
    order = np.argsort(h, kind="stable")
    return h[order], i[order], p[order]


def _lookup(index: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, item place) of each hit of the hashes h."""
    keys, items, places = index
    lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(h)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    src = np.repeat(lo, n) + within
    return at, items[src], places[src]


def least(chinese: bool) -> int:
    """Q-grams that a passage shares at least when EDITS of its words differ: each takes those that touch it."""
    q = GRAM[chinese]
    return PASSAGE[chinese] - q + 1 - EDITS * (q + WORD[chinese] - 1)


def _enough(key: np.ndarray, n: int) -> np.ndarray:
    """Which keys come up at least n times."""
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[of] >= n


def windows(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, chinese: bool) -> pd.DataFrame:
    """(doc, item, band, a, z, c, d): places [a, z) of a document and [c, d) of an item where a band shares enough q-grams."""
    q, size = GRAM[chinese], PASSAGE[chinese]
    diagonal = (at - place) // HALF_BAND
    two = pd.DataFrame({"doc": np.tile(doc, 2), "item": np.tile(item, 2), "band": np.concatenate([diagonal, diagonal - 1]), "at": np.tile(at, 2), "place": np.tile(place, 2)})
    two = two.sort_values(["doc", "item", "band", "at"], ignore_index=True)
    group = (two[["doc", "item", "band"]].diff().ne(0).any(axis=1)).cumsum().to_numpy()
    key = group * (int(two["at"].max() if len(two) else 0) + 2 * size) + two["at"].to_numpy()
    # of the places from this one on, those within the window
    end = np.searchsorted(key, key + size - q, "right")
    dense = end - np.arange(len(key)) >= least(chinese)
    mark = np.zeros(len(key) + 1, int)
    np.add.at(mark, np.flatnonzero(dense), 1)
    np.add.at(mark, end[dense], -1)
    two = two[np.cumsum(mark)[:-1] > 0].assign(key=key[np.cumsum(mark)[:-1] > 0])
    gap = two["key"].diff().fillna(0).to_numpy() > size
    two["run"] = gap.cumsum() if len(two) else 0
    out = two.groupby(["doc", "item", "band", "run"], as_index=False).agg(a=("at", "min"), z=("at", "max"), c=("place", "min"), d=("place", "max"))
    return out.assign(z=out["z"] + q, d=out["d"] + q)


def _union(spans: list[tuple[int, int]]) -> np.ndarray:
    """The places in any of the spans, in order."""
    return np.unique(np.concatenate([np.arange(a, z) for a, z in spans])) if spans else np.zeros(0, int)


def aligned(text: np.ndarray, item: np.ndarray, half: int) -> np.ndarray:
    """Which letters of ``item`` an alignment at least cost gives an equal letter of ``text``; it stays within ``half`` diagonals of the corner's."""
    n, m = len(text), len(item)
    half = half + abs(n - m)
    width, far = 2 * half + 1, 1 << 28
    places = np.arange(width, dtype="int32")
    row = np.where(places >= half, places - half, far).astype("int32")  # place k of row i is column i + k - half of the item
    padded = np.concatenate([np.zeros(half, "uint32"), item, np.zeros(max(0, n + half - m) + 1, "uint32")])
    steps = np.zeros((n + 1, width), "int8")  # 0: over the item only, 1: both, 2: over the text only
    down = np.full(width, far, "int32")
    # columns before the item are far, and from those behind it no step leads back
    for i in range(1, n + 1):
        both = row + (padded[i - 1 : i - 1 + width] != text[i - 1])
        np.add(row[1:], 1, out=down[:-1])
        best = np.minimum(both, down)
        row = np.minimum.accumulate(best - places) + places
        step = (both > down).astype("int8") + 1
        step[row < best] = 0
        steps[i] = step
    same = np.zeros(m, bool)
    i, j = n, m
    while i > 0 and j > 0:
        step = steps[i, j - i + half]
        if step == 1:
            same[j - 1] = item[j - 1] == text[i - 1]
            i, j = i - 1, j - 1
        elif step == 2:
            i -= 1
        else:
            j -= 1
    return same


def passages(same: np.ndarray, size: int) -> np.ndarray:
    """The letters within windows of ``size`` of which enough are the same."""
    if len(same) < size:
        return np.zeros(len(same), bool)
    enough = np.convolve(same, np.ones(size, int), "valid") >= (1 - DIFFER) * size
    return np.convolve(enough, np.ones(size, int), "full") > 0


def _covered(text: np.ndarray, letters: np.ndarray, own: np.ndarray, found: pd.DataFrame, chinese: bool) -> float:
    """The share of an item's own letters in passages of a document."""
    size, slack = PASSAGE[chinese], GRAM[chinese] + 2 * WORD[chinese]
    total = int(own.sum())
    # no more can be covered than the windows span with what an edited word hides at their ends
    bound = _union([(max(0, c - slack), min(len(own), d + slack)) for c, d in zip(found["c"], found["d"])])
    if own[bound].sum() < COVERED * total:
        return 0.0
    got = np.zeros(len(own), bool)
    for a, z, c, d in found[["a", "z", "c", "d"]].itertuples(index=False):
        a, c, z, d = max(0, a - min(slack, c, a)), max(0, c - min(slack, c, a)), min(len(text), z + slack), min(len(own), d + slack)
        if got[c:d].all():
            continue
        got[c:d] |= passages(aligned(text[a:z], letters[c:d], HALF_BAND), size)
    return float((got & own).sum()) / total


def _search(pieces: list[tuple[int, str, np.ndarray, bool]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {zh: _index(pieces, zh) for zh in (False, True)}
        letters = [np.array([ord(c) for c in p[1]], "uint32") for p in pieces]

        def of(ids: list, texts: list[np.ndarray]) -> pd.DataFrame:
            codes = np.concatenate([np.append(t, 0) for t in texts]).astype("uint32")
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            out = []
            for zh in (False, True):
                h = grams(codes, GRAM[zh])
                at, item, place = _lookup(index[zh], h)
                doc = np.searchsorted(starts, at, "right") - 1
                fits = at + GRAM[zh] <= starts[doc + 1] - 1
                doc, item, at, place = doc[fits], item[fits], at[fits] - starts[doc[fits]], place[fits]
                many = _enough(doc * len(pieces) + item, least(zh))
                doc, item, at, place = doc[many], item[many], at[many], place[many]
                found = windows(doc, item, at.astype("int64"), place.astype("int64"), zh)
                for (d, i), w in found.groupby(["doc", "item"]):
                    share = _covered(texts[d], letters[i], pieces[i][2], w, zh)
                    if share >= COVERED:
                        out.append((ids[d], pieces[i][0], share))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        for f in frames:
            ids, texts, held = [], [], 0
            for doc, text in zip(f["doc_id"], f["text"]):
                letters_of = plain(text)
                ids.append(doc)
                texts.append(np.frombuffer(letters_of.encode("utf-32-le", "surrogatepass"), "uint32"))
                held += len(letters_of)
                if held >= CHUNK:
                    yield of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield of(ids, texts)

    return run


def _sentences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for item, task in zip(f["item_id"], f["task"]):
            cut = [p for p in (plain(x) for x in SENTENCE.split(task)) if p]
            out += [(item, xxhash.xxh64_intdigest(task) - (1 << 63), k, s) for k, s in enumerate(cut)]
        yield pd.DataFrame(out, columns=["item_id", "task", "k", "s"])


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, share) of each document that gives away at least COVERED of an item.

    documents: (doc_id, text); items: (item_id, task), whatever further columns either has. share is that of the letters of the item's own sentences in passages of the document; several rows of one doc_id give
    the greatest. Null and blank texts and tasks, and items all of whose sentences are shared, give no rows; equal rows count once, of several tasks of one item_id each counts. ``block`` bounds the q-grams looked for in one pass.
    """
    cut = items.where("task is not null").select("item_id", "task").distinct().mapInPandas(_sentences, "item_id long, task long, k int, s string")
    rules = cut.select("item_id", "s").distinct().groupBy("s").agg((F.count("*") < SHARED).alias("own"))
    whole = cut.join(rules, "s").groupBy("item_id", "task").agg(F.sort_array(F.collect_list(F.struct("k", "s", "own"))).alias("sentences"), F.sum(F.length("s")).alias("letters"))
    blocks = max(1, -(-(whole.agg(F.sum("letters")).first()[0] or 0) // block))
    texts = spread(documents.where("text is not null and text != ''").select("doc_id", "text"))
    found = None
    for k in range(blocks):
        mine = [(r.item_id, [(x.s, x.own) for x in r.sentences]) for r in whole.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        pieces = [p for p in item_pieces(mine) if p[2].any()]
        got = texts.mapInPandas(_search(pieces), "doc_id long, item_id long, share double")
        found = got if found is None else found.unionByName(got)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
