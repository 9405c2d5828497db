"""Texts that lack their end, and how often each source cuts.

Near-copies are found by min-hash bands over five-word shingles, each text against all longer ones of its bucket that its size allows, and verified; where the end of the shorter is aligned within a line of the longer, it ends early.
In a crowded bucket the longest come first; texts that these leave open meet all others that hold the characters at which they end.
For all others the closing words tell: how often they end a line without a mark in all documents, against how often they go on. A text that ends openly at the length at which its source's texts pile up is cut as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import Stage, even_join, spread
from tessera.llm import closing

#: Words of a shingle, similarity of near-copies, bands, and rows of a band.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 12, 4
#: Characters of the shorter text's end that are aligned, and the last ones of these that have to be equal.
TAIL, MATCH = 60, 8
#: A share of its source's texts, texts, and times those of the next length, that make a length a limit, of so many characters at least; a limit of bytes is met up to a character below it.
PILE_SHARE, PILE, STANDS_OUT, LEAST_LIMIT, CHARACTER = 0.01, 3, 2, 100, 3
#: Words that end fewer of their lines than this do not close a text; a formula closes so many texts at least, and so many times those expected by chance.
TERMINAL, FORMULA, OFTEN = 0.5, 3, 10
SALTS = 8
#: Texts up to which all of a bucket are paired directly; texts a side that one task pairs in larger ones.
CROWD, BLOCK = 200, 1000
#: One pair settles a text: of crowded buckets one in so many pairs is compared, then more of those of the texts still open, at last all.
ROUNDS = (64, 8, 1)
#: Bits of the map of anchors that all tasks get, and bytes of one part of it.
BITS, PART_BYTES = 1 << 24, 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SEEDS = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(BANDS * ROWS)], "uint64")
COUNTS = "kind string, before string, word string, bare long, other long"
ENDS = "doc_id long, source string, chars int, bytes int, state string, kind string, before string, word string"
SIGNED = "h long, size int, shingles int, tail string, anchor long, band int, bucket long"


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct runs of SHINGLE words; a Chinese character is a word. A shorter text is one shingle."""
    words = [w for w in closing.tokens(text.lower()) if w != "\n"]
    return np.unique(np.array([xxhash.xxh64_intdigest("\x1f".join(words[k : k + SHINGLE])) for k in range(max(1, len(words) - SHINGLE + 1))], "uint64"))


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out, buckets = [], []
        for text in f["text"]:
            s = shingles(text)
            low = np.full(BANDS * ROWS, np.iinfo("uint64").max, "uint64")
            for at in range(0, len(s), 4096):  # a long text in pieces
                x = s[at : at + 4096, None] * SEEDS
                low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
            tail = end_of(text)
            may = may_end_early(tail)
            out.append((len(text), len(s), tail if may else None, anchor(tail) if may else 0))
            buckets += [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes()) - (1 << 63) for b in range(BANDS)]
        one = pd.DataFrame(out, columns=["size", "shingles", "tail", "anchor"]).assign(h=f["h"].to_numpy())
        every = one.loc[np.repeat(np.arange(len(one)), BANDS)]
        yield every.assign(band=np.tile(np.arange(BANDS), len(one)), bucket=np.array(buckets, "int64"))[[c.split()[0] for c in SIGNED.split(", ")]]


def end_of(text: str) -> str:
    """The last TAIL characters, without blanks, dots and remarks of an omission after them."""
    tail = text.rstrip().rstrip(closing.BROKEN)
    last = tail.rstrip()[-1:]  # the patterns end with these
    dots = closing.OMISSION.search(tail) if last and last in "])）】" else closing.DOTS.search(tail) if last and last in ".…" else None
    return (tail[: dots.start()] if dots else tail).rstrip()[-TAIL:]


def may_end_early(tail: str) -> bool:
    """Whether any text may go on after the tail: not if its last MATCH characters, which that text has as well, close a sentence."""
    last = tail[-MATCH:]
    return bool(tail) and not closing.CLOSED.search(last.rsplit("\n", 1)[-1] if "\n" in last else "x" + last)


def _runs(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of MATCH characters."""
    h = np.zeros(len(codes) - MATCH + 1, "uint64")
    for k in range(MATCH):
        h = (h ^ codes[k : len(h) + k].astype("uint64")) * MULTIPLIER
        h ^= h >> np.uint64(32)
    return h.astype("int64")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")


def anchor(tail: str) -> int:
    """A hash of the last MATCH characters of a tail; 0 for a shorter one."""
    if len(tail) < MATCH:
        return 0
    h = 0
    for c in tail[-MATCH:]:  # as _runs
        h = (h ^ ord(c)) * int(MULTIPLIER) % (1 << 64)
        h ^= h >> 32
    return h - (h >> 63 << 64)


def anchors(text: str) -> np.ndarray:
    """The distinct anchors of the tails after which the text may go on in its line."""
    codes = _codes(text)
    return np.unique(np.append(_runs(codes)[:-1][codes[MATCH:] != ord("\n")], 0)) if len(codes) > MATCH else np.zeros(1, "int64")


def _met(bits: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The anchors of each text that are among those asked for, by a bitmap of fixed size that may let others through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.unpackbits(np.frombuffer(bits, "uint8"), bitorder="little")
        for f in frames:
            found = [a[on[a & (BITS - 1)] == 1] for a in map(anchors, f["text"])]
            yield pd.DataFrame({"other": np.repeat(f["other"].to_numpy(), [len(a) for a in found]), "anchor": np.concatenate(found) if found else np.zeros(0, "int64")})

    return run


def ends_early(short: str, long: str) -> bool:
    """Whether the end of ``short`` is aligned within a line of ``long`` that goes on."""
    return aligned(end_of(short), len(short), long)


def aligned(tail: str, size: int, long: str) -> bool:
    """``ends_early`` of a text of ``size`` characters with this end."""
    lo = max(0, size - 4 * TAIL - (len(long) - size))
    body = long[lo:].rstrip()
    if not tail or not re.search(re.escape(tail[-MATCH:]) + r"[^\n]", body):
        return False
    a, b = np.array([ord(c) for c in tail]), np.array([ord(c) for c in body])
    row, places = np.zeros(len(b) + 1, "int32"), np.arange(len(b) + 1)
    for k, c in enumerate(a, 1):  # the tail ends anywhere in the body
        best = np.minimum(np.append(k, row[:-1] + (b != c)), row + 1)
        row = np.minimum.accumulate(best - places) + places
    end = int(len(b) - row[::-1].argmin())
    rest = body[end:]
    return bool(row[end] <= len(a) // 6 and body[:end].endswith(tail[-MATCH:]) and rest and rest[0] != "\n" and not closing.CLOSED.search(body[:end].rsplit("\n", 1)[-1]))


def _ending(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.loc[[aligned(*x) for x in zip(f["tail"], f["size"], f["long"])], ["h", "other"]]


def _alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = []
        for short, long in zip(f["short"], f["long"]):
            a, b = shingles(short), shingles(long)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SIMILAR * (len(a) + len(b) - both))
        yield f.loc[keep, ["h"]]


def _partners(pairs: DataFrame) -> DataFrame:
    """(h, size, tail, other), each pair once: of near-copies the smaller number of shingles is at least SIMILAR times the larger."""
    near = (F.col("size") < F.col("longer")) & (F.least("shingles", "others") >= SIMILAR * F.greatest("shingles", "others"))
    return pairs.where(near).select("h", "size", "tail", "other").dropDuplicates(["h", "other"])


def _early(pairs: DataFrame, texts: DataFrame, st: Stage) -> DataFrame:
    """(h) of the partners of which the shorter ends early against a near-copy; the ends are aligned first, and only what they leave is compared as a whole."""
    pairs = st.keep(pairs)
    long = texts.select(F.col("h").alias("other"), F.col("text").alias("long"))
    met = even_join(pairs, long, "other", "h").where(F.contains("long", F.substring("tail", -MATCH, MATCH)))
    left = st.keep(met.select("h", "size", "tail", "other", "long").mapInPandas(_ending, "h long, other long"))
    st.drop(pairs)
    short = st.keep(even_join(left, texts.select("h", F.col("text").alias("short")), "h", "other"))
    found = st.keep(even_join(short, long, "other", "h").select("h", "short", "long").mapInPandas(_alike, "h long").distinct())
    st.drop(left)
    st.drop(short)
    return found


def _short(members: DataFrame) -> DataFrame:
    return members.where("tail is not null").select("band", "bucket", "h", "size", "shingles", "tail", "anchor")


def _long(members: DataFrame) -> DataFrame:
    return members.select("band", "bucket", F.col("h").alias("other"), F.col("size").alias("longer"), F.col("shingles").alias("others"))


def _crossed(short: DataFrame, long: DataFrame, on: list[str], block: int) -> DataFrame:
    """All pairs of equal keys. A key of more than ``block`` rows on a side is dealt into squares of about that many rows a side, each for one task."""
    rows, columns = (df.groupBy(on).agg(F.ceil(F.count("*") / block).cast("int").alias(k)) for df, k in ((short, "rows_"), (long, "columns_")))
    hot = rows.join(columns, on).where("rows_ > 1 or columns_ > 1")
    rows, columns = F.coalesce("rows_", F.lit(1)), F.coalesce("columns_", F.lit(1))
    left = short.join(hot, on, "left").withColumn("row_", F.pmod(F.xxhash64("h"), rows).cast("int")).withColumn("column_", F.explode(F.sequence(F.lit(0), columns - 1))).drop("rows_", "columns_")
    right = long.join(hot, on, "left").withColumn("column_", F.pmod(F.xxhash64("other"), columns).cast("int")).withColumn("row_", F.explode(F.sequence(F.lit(0), rows - 1))).drop("rows_", "columns_")
    return left.join(right, [*on, "row_", "column_"]).drop("row_", "column_")


def _crowded(members: DataFrame, early: DataFrame, texts: DataFrame, st: Stage, block: int) -> DataFrame:
    """(h) of the texts of crowded buckets that end early and are not in ``early``."""
    # the longest of a bucket and class come first, as they settle most; sizes of near-copies are at most a class apart
    size_class = F.floor(F.log(F.col("shingles")) / F.log(F.lit(1.26))).cast("int")
    graded = members.join(early, "h", "left_anti").withColumn("class", size_class).withColumn("salt", F.pmod(F.hash("h"), F.lit(SALTS))).where("tail is not null")
    longest = members.withColumn("class", size_class).groupBy("band", "bucket", "class").agg(F.max(F.struct("size", "h", "shingles")).alias("top"))
    stand = longest.select("band", "bucket", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), F.col("top.h").alias("other"), F.col("top.size").alias("longer"), F.col("top.shingles").alias("others"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    first = _early(_partners(graded.join(stand, ["band", "bucket", "class", "salt"])), texts, st)
    # the rest meet all texts of their bucket that go on after the characters at which they end
    short = st.keep(_short(members).join(early.unionByName(first), "h", "left_anti"))
    bit = (F.col("anchor").bitwiseAND(BITS - 1) + 1).alias("bit")
    bits = bytearray(BITS // 8)
    for r in short.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        bits[(r["part"] - 1) * PART_BYTES : r["part"] * PART_BYTES] = r["bits"]
    on = ["band", "bucket", "anchor"]
    met = texts.join(members.select("h").distinct(), "h", "left_semi").select(F.col("h").alias("other"), "text").mapInPandas(_met(bytes(bits)), "other long, anchor long")
    long = st.keep(_long(members).join(met, "other").join(short.select(on).distinct(), on, "left_semi"))
    pairs = st.keep(_partners(_crossed(short, long, on, block)))
    for one_in in ROUNDS:
        some = pairs.where(F.pmod(F.xxhash64("h", "other"), F.lit(one_in)) == 0)
        first = first.unionByName(_early(some.join(first, "h", "left_anti"), texts, st))
    return first


def cut_copies(texts: DataFrame, st: Stage, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(h) of the distinct texts that end early against any longer near-copy of a bucket of theirs. texts: (h, text), one row each. ``crowd`` and ``block`` tell how the pairs are made, not which."""
    signed = st.keep(texts.select("h", "text").mapInPandas(_signed, SIGNED))
    several = signed.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.count("tail").alias("ends")).where("n > 1 and ends > 0").select("band", "bucket", "n")
    members = st.keep(signed.join(several, ["band", "bucket"]), crowded=F.count_if(F.col("n") > crowd))
    st.drop(signed)
    few = members.where(F.col("n") <= crowd)
    early = _early(_partners(_short(few).join(_long(few), ["band", "bucket"])), texts, st)
    if not members.seen["crowded"]:
        return early
    return early.unionByName(_crowded(members.where(F.col("n") > crowd), early, texts, st, block)).distinct()


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        seen: Counter = Counter()
        for text in f["text"]:
            closing.count(text, seen)
        yield pd.DataFrame([(k, b, w, n if bare else 0, 0 if bare else n) for (k, b, w, bare), n in seen.items()], columns=["kind", "before", "word", "bare", "other"])


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = [(i, s, len(t), len(t.encode("utf-8", "surrogatepass")), *closing.ending(t)) for i, s, t in zip(f["doc_id"], f["source"], f["text"])]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDS.split(", ")])


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, limit): lengths at which texts of a source pile up and beyond which hardly any goes."""
    size = ends.where("state != 'blank'").select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "n")).where(F.col("n") >= LEAST_LIMIT)
    bars = size.groupBy("source", "unit", "n").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("source", "unit").orderBy(F.col("c").desc(), F.col("n").desc()))
    first = bars.withColumn("place", place).where("place <= 2").groupBy("source", "unit").agg(F.max(F.when(F.col("place") == 1, F.struct("c", "n"))).alias("top"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("c"))), F.lit(0)).alias("next"))
    whole = bars.groupBy("source", "unit").agg(F.sum("c").alias("all")).withColumnsRenamed({"source": "s", "unit": "u"})
    top = first.join(whole, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u"))).where((F.col("top.c") >= PILE) & (F.col("top.c") >= PILE_SHARE * F.col("all")) & (F.col("top.c") >= STANDS_OUT * F.col("next"))).select("source", "unit", "all", F.col("top.n").alias("limit"))
    mine = top.select(F.col("source").alias("s"), F.col("unit").alias("u"), "all", "limit")
    beyond = bars.join(mine, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u"))).groupBy("source", "unit", "limit", "all").agg(F.sum(F.when(F.col("n") > F.col("limit") + 40, F.col("c")).otherwise(0)).alias("beyond"))
    return beyond.where(F.col("beyond") <= PILE_SHARE * F.col("all") / 5).select("source", "unit", "limit")


def _support(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, before, word, bare, other, longer) of the asked endings; longer counts the words they are the beginning of, after the same word."""
    near = counts.join(asked.select("kind", "before").distinct(), ["kind", "before"], "left_semi")
    parts = near.where("length(word) > 1").select("kind", "before", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"), (F.col("bare") + F.col("other")).alias("longer"))
    both = near.select("kind", "before", "word", "bare", "other", F.lit(0).cast("long").alias("longer")).unionByName(parts.select("kind", "before", "word", F.lit(0).cast("long").alias("bare"), F.lit(0).cast("long").alias("other"), "longer"))
    return both.groupBy("kind", "before", "word").agg(F.sum("bare").alias("bare"), F.sum("other").alias("other"), F.sum("longer").alias("longer"))


def terminality(ends: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(state, kind, before, word, terminality) of each open ending: the share of its occurrences that end a line bare, by the last two words or, where these are found nowhere else, the last;
    1 for words of which nothing is known and for formulas that close texts far more often than chance would."""
    asked = ends.where("state in ('open', 'dots')").groupBy("state", "kind", "before", "word").agg(F.count("*").alias("n"))
    # formulas close texts of any kind of last line
    closing2 = asked.groupBy("state", "before", "word").agg(F.sum("n").alias("closing"))
    closing1 = asked.groupBy("state", "kind", "word").agg(F.sum("n").alias("closing1"))
    rate = asked.groupBy("state").agg((F.sum("n") / F.lit(max(1, words))).alias("rate"))
    two = _support(counts, asked)
    one = _support(counts, asked.select("kind", F.lit("").alias("before")).distinct()).drop("before").withColumnsRenamed({"bare": "bare1", "other": "other1", "longer": "longer1"})
    every = asked.join(closing2, ["state", "before", "word"]).join(closing1, ["state", "kind", "word"]).join(two, ["kind", "before", "word"], "left").join(one, ["kind", "word"], "left").join(rate, "state")
    every = every.na.fill(0, ["bare", "other", "longer", "bare1", "other1", "longer1"])
    s2, s1 = F.col("bare") + F.col("other") + F.col("longer"), F.col("bare1") + F.col("other1") + F.col("longer1")

    def formula(closing_: Column, support: Column) -> Column:
        return (closing_ >= FORMULA) & (closing_ > OFTEN * (support * F.col("rate") + 0.1))

    score = F.when(formula(F.col("closing"), s2) | formula(F.col("closing1"), s1), 1.0).when(s2 > 0, F.col("bare") / s2).when(s1 > 0, F.col("bare1") / s1).otherwise(1.0)
    return every.select("state", "kind", "before", "word", score.alias("terminality"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut) of each document with text.

    documents: (doc_id, text, source), doc_id unique (of equal ones each row is judged); sources compare trimmed and without case, null is one source. Null and blank texts are not cut. Very long texts are read whole. An empty table gives an empty result.
    """
    st = Stage(documents.sparkSession, "truncated")
    rows = spread(documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where("text is not null"))
    ends = st.keep(rows.mapInPandas(_ends, ENDS))
    counts = st.keep(rows.select("text").mapInPandas(_counts, COUNTS).groupBy("kind", "before", "word").agg(F.sum("bare").alias("bare"), F.sum("other").alias("other")), words=F.sum(F.when(F.col("before") == "", F.col("bare") + F.col("other"))))
    texts = st.keep(rows.where("length(trim(text)) > 0").select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"]))
    early = cut_copies(texts, st)
    of_early = even_join(rows.select("doc_id", F.xxhash64("text").alias("h")), early, "h", "doc_id").select("doc_id").distinct().withColumn("early", F.lit(True))
    score = terminality(ends, counts, counts.seen["words"] or 0)
    at = limits(ends).groupBy("source").pivot("unit", ["chars", "bytes"]).agg(F.max("limit")).select(F.col("source").alias("of"), F.col("chars").alias("most_chars"), F.col("bytes").alias("most_bytes"))
    # closed texts all have the same, empty ending; only the others are looked up, and common ones spread
    ending = F.concat_ws("\x1f", "state", "kind", "before", "word")
    open_ = ends.where("state in ('open', 'dots')").withColumn("ending", ending)
    rated = even_join(open_, score.select(ending.alias("ending"), "terminality"), "ending", "doc_id", "left").drop("ending")
    every = rated.unionByName(ends.where("state not in ('open', 'dots')").withColumn("terminality", F.lit(None).cast("double")))
    judged = every.join(at, F.col("source").eqNullSafe(F.col("of")), "left").join(of_early, "doc_id", "left")
    full = F.coalesce((F.col("chars") == F.col("most_chars")) | (F.col("bytes") <= F.col("most_bytes")) & (F.col("bytes") > F.col("most_bytes") - F.when(F.col("bytes") > F.col("chars"), CHARACTER).otherwise(1)), F.lit(False))
    cut = F.coalesce("early", F.lit(False)) | F.col("state").isin("broken", "inside", "omitted") | (F.col("state").isin("open", "dots") & (full | (F.col("terminality") < TERMINAL)))
    return judged.select("doc_id", "source", cut.alias("cut"))
