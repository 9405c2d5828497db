"""Credentials in whole tables of texts: an index of literals, suppression of shared ones, a second scan of every text for the rest, and masking.

A value is confirmed by its place or form (``credential_text``) and by being rare: what stands in the files of many is a shared placeholder. Confirmed values are
looked for in all texts by an automaton, so that they come out where no telling name stands by them too. Which values a text may hold is told by a join on the characters they end with.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import Stage, even_join
from tessera.llm.credential_text import BEGIN_KEY, key_end, literals

#: Paths in which a value may stand, at most, unless its form alone makes it certain.
OWNERS = 10
#: Values of fewer characters are looked for only where a name tells them; their last ANCHOR characters find the values that may end at a place.
SHORTEST, ANCHOR = 8, 8
#: Bits of the map of anchors that all tasks get, and bytes of one part of it.
BITS, PART_BYTES = 1 << 24, 4096
WORDS = np.array([chr(c).isalnum() for c in range(128)])
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CERTAIN_FORMS = ("issued", "private key")
MASK = "********"
FOUND = "value string, form string, h string, line_no int, spans array<struct<a:int,z:int>>"
PIECE = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""")


def _spans(text: str, at: int, line: str, form: str, value: str) -> list[dict]:
    """Where in the text a literal of the line that begins at ``at`` has to be masked."""
    if form == "private key":
        begin = at + BEGIN_KEY.search(line).end()
        return [{"a": begin, "z": key_end(text, begin)}]
    if value in line:
        return [{"a": at + m.start(), "z": at + m.end()} for m in re.finditer(re.escape(value), line)]
    pieces = ((m.start(k), m.end(k), m.group(k)) for m in PIECE.finditer(line) for k in (1, 2) if m.group(k))
    return [{"a": at + a, "z": at + z} for a, z, piece in pieces if piece in value]


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in FOUND.split(", ")]
    for f in frames:
        out = []
        for h, text in zip(f.h, f.content):
            lines, starts = text.split("\n"), [0]
            for line in lines:
                starts.append(starts[-1] + len(line) + 1)
            for no, form, value in literals(text):
                spans = _spans(text, starts[no - 1], lines[no - 1], form, value)
                # a private key is its body; keys are told apart by it
                out.append((text[spans[0]["a"] : spans[0]["z"]] if form == "private key" else value, form, h, no, spans))
        yield pd.DataFrame(out, columns=columns)


def anchors(text: str) -> np.ndarray:
    """Hashes of the distinct ANCHOR characters at which a value may end: before a place where no word goes on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
    if len(codes) < ANCHOR:
        return np.zeros(0, "int64")
    plain = codes < 128
    word = np.where(plain, WORDS[np.minimum(codes, 127)], np.array([c.isalnum() for c in text]) if not plain.all() else False)
    ends = np.flatnonzero(~(word[ANCHOR - 1 :] & np.append(word[ANCHOR:], False)))
    h = np.zeros(len(ends), "uint64")
    for k in range(ANCHOR):
        h = (h ^ codes[ends + k].astype("uint64")) * MULTIPLIER
        h ^= h >> np.uint64(32)
    return np.unique(h).astype("int64")


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"value": f["value"], "anchor": [int(anchors(v[-ANCHOR:])[-1]) for v in f["value"]]})


def _met(bits: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The anchors of each text that are among those of the values, by a bitmap of fixed size that may let others through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.unpackbits(np.frombuffer(bits, "uint8"), bitorder="little")
        for f in frames:
            found = [a[on[a & (BITS - 1)] == 1] for a in map(anchors, f["content"])]
            yield pd.DataFrame({"h": np.repeat(f["h"].to_numpy(dtype=object), [len(a) for a in found]), "anchor": np.concatenate(found) if found else np.zeros(0, "int64")})

    return run


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every place of a text's candidate values that is not within a longer word; one automaton for all texts of a batch."""
    for f in frames:
        automaton = ahocorasick.Automaton()
        for v in {v for vs in f["values"] for v in vs}:
            automaton.add_word(v, v)
        automaton.make_automaton()
        out = []
        for h, text in zip(f["h"], f["content"]):
            for last, v in automaton.iter(text):
                a, z = last + 1 - len(v), last + 1
                if not (a and text[a - 1].isalnum() and v[0].isalnum() or z < len(text) and text[z].isalnum() and v[-1].isalnum()):
                    out.append((v, "again", h, text.count("\n", 0, a) + 1, [{"a": a, "z": z}]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def _rare(found: DataFrame, places: DataFrame) -> DataFrame:
    """(value, key): those of a certain form, or in few paths; key tells private keys."""
    of = found.groupBy("value", "h").agg(F.max(F.col("form").isin(*CERTAIN_FORMS)).alias("certain"), F.max(F.col("form") == "private key").alias("key"))
    per = even_join(places.select("h", "path").distinct(), of, "h", "path").groupBy("value", "path").agg(F.max("certain").alias("certain"), F.max("key").alias("key"))
    return per.groupBy("value").agg(F.count("*").alias("owners"), F.max("certain").alias("certain"), F.max("key").alias("key")).where(F.col("certain") | (F.col("owners") <= OWNERS)).select("value", "key")


def credentials(files: DataFrame) -> DataFrame:
    """(value, form, snapshot_id, path, h, line_no, spans) of each credential; spans count characters of the content from 0.

    files: (snapshot_id, path, content). h is the content's SHA-256; equal contents are read once. Null and empty contents hold none; equal rows count once. Confirmed values come back to the texts by the characters they end
    with, so that every text is scanned for the values that may stand in it and no task holds all values.
    """
    spark = files.sparkSession
    st = Stage(spark, "credentials")
    rows = files.where("content is not null and content != ''").select("snapshot_id", "path", F.sha2("content", 256).alias("h"), "content")
    places = st.keep(rows.select("snapshot_id", "path", "h").distinct())
    bodies = st.keep(rows.select("h", "content").dropDuplicates(["h"]))
    index = st.keep(bodies.mapInPandas(_index, FOUND))
    told = st.keep(_rare(index, places).where(f"not key and length(value) >= {SHORTEST}").select("value").mapInPandas(_told, "value string, anchor long"))
    # a bitmap of BITS bits, in parts of the size that the aggregate builds
    bit = (F.col("anchor").bitwiseAND(BITS - 1) + 1).alias("bit")
    parts = told.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = bytearray(BITS // 8)
    for r in parts:
        bits[(r["part"] - 1) * PART_BYTES : r["part"] * PART_BYTES] = r["bits"]
    met = bodies.mapInPandas(_met(bytes(bits)), "h string, anchor long")
    asked = even_join(met, told, "anchor", "h").groupBy("h").agg(F.collect_set("value").alias("values"))
    again = bodies.join(asked, "h").mapInPandas(_scan, FOUND)
    known = _rare(index, places).select("value")
    both = st.keep(index.join(known, "value", "left_semi").unionByName(again))
    # a value that only the second scan shows to be shared
    kept = both.join(_rare(both, places).select("value"), "value", "left_semi")
    return even_join(places, kept, "h", "path").select("value", "form", "snapshot_id", "path", "h", "line_no", "spans")


def _masked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for text, spans in zip(f.content, f.spans):
            pieces, done = [], 0
            if text is None:
                out.append(None)
                continue
            for s in sorted(spans if spans is not None else [], key=lambda s: (s["a"], -s["z"])):
                if s["z"] > done:
                    if s["a"] >= done:
                        pieces += [text[done : s["a"]], MASK]
                    done = s["z"]
            out.append("".join(pieces) + text[done:] if pieces else text)
        yield pd.DataFrame({"snapshot_id": f.snapshot_id, "path": f.path, "content": out})


def redacted(files: DataFrame, found: DataFrame) -> DataFrame:
    """(snapshot_id, path, content): each distinct text with the spans of ``credentials`` masked, all else unchanged; contents without credentials as they are."""
    spans = found.groupBy("h").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    texts = files.select("snapshot_id", "path", "content").distinct()
    return texts.withColumn("h", F.sha2("content", 256)).join(spans, "h", "left").select("snapshot_id", "path", "content", "spans").mapInPandas(_masked, "snapshot_id string, path string, content string")
