"""Mixing sources to target shares of all tokens, with few repeats.

Each document gets a hash-random key. Keys are uniform, so equal ranges of them are bins of bounded size whatever the source's; a prefix sum over the bins of a source, and one within each bin, give
every document its place in its source, and the last, partial epoch is cut where the budget ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import Stage, spread

#: Documents in one bin.
BIN_ROWS = 50_000
# Fixed value: how the public byte-level vocabularies split text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once; a longer text is split at line ends where it has any.
PIECE = 100_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """The place of a public vocabulary of byte ranks."""
    return str(Path(folder) / name)


def token_counts(texts: DataFrame, path: str) -> DataFrame:
    """``texts`` with the tokens of ``text`` under the vocabulary at ``path``; null and empty text has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        code = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

        def count(text: str) -> int:
            n, at = 0, 0
            while at < len(text):
                z = at + PIECE
                if z < len(text):
                    z = text.find("\n", z) + 1 or len(text)
                n += len(code.encode_ordinary(text[at:z]))
                at = z
            return n

        for f in frames:
            yield f.drop(columns="text").assign(tokens=[count(t) if t else 0 for t in f["text"]])

    kept = [c for c in texts.schema if c.name != "text"]
    return texts.mapInPandas(run, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in kept) + ", tokens long")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, rows, size, budget): tokens that each source gives. Without ``total`` it is the largest at which every source that has tokens reaches its share."""
    per = targets.join(sizes, "source", "left").na.fill(0, ["rows", "size"])
    most = per.where("size > 0 and target_share > 0").agg(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("most"))
    whole = per.join(most)
    aim = F.lit(float(total)) if total is not None else F.coalesce("most", F.lit(0.0))
    return whole.select("source", "target_share", "max_repeats", "rows", "size", F.least(F.floor(F.col("target_share") * aim + 1e-6), F.col("max_repeats") * F.col("size")).cast("long").alias("budget"))


def mixed(documents: DataFrame, targets: DataFrame, path: str, total: int | None = None, seed: int = 0, bin_rows: int = BIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repeats of each document, and the shares reached.

    documents: (doc_id, text, source); targets: (source, target_share, max_repeats), one row per source; sources compare trimmed and without case. Returns (doc_id, source, tokens, repeats) of the documents used at least
    once, and (source, target_share, max_repeats, documents, tokens, used, share, epochs) of each target. A document of a source without target, of null source, or without tokens is never used; a source without documents
    uses nothing and leaves the others their shares of the rest. The cut document of a source is left out, so that a budget is never exceeded. Ties of the random key go by doc_id; equal rows count as documents of their own.
    """
    st = Stage(documents.sparkSession, "mixing")
    clean = F.lower(F.trim("source"))
    wanted = targets.where("source is not null").select(clean.alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    rows = spread(documents.where("text is not null").select("doc_id", clean.alias("source"), "text"))
    sized = st.keep(token_counts(rows.where("source is not null"), path).where("tokens > 0").withColumn("key", F.xxhash64("doc_id", F.lit(seed))))
    plan = budgets(sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("size")), wanted, total)
    plan = st.keep(plan.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("size")))
    # the key as a fraction of its range gives the bin
    binned = sized.join(plan.select("source", "whole", "rest", F.ceil(F.col("rows") / bin_rows).alias("bins")), "source").withColumn("bin", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("bins")).cast("long"))
    before = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("t"))
    before = before.select("source", "bin", (F.sum("t").over(Window.partitionBy("source").orderBy("bin")) - F.col("t")).alias("before"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumn("upto", F.sum("tokens").over(within)).join(before, ["source", "bin"])
    chosen = placed.select("doc_id", "source", "tokens", (F.col("whole") + (F.col("before") + F.col("upto") <= F.col("rest")).cast("int")).cast("int").alias("repeats")).where("repeats > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    every = plan.join(used, "source", "left").na.fill(0, ["used"])
    sum_ = every.agg(F.sum("used").alias("all"))
    share = F.when(F.col("all") > 0, F.col("used") / F.col("all")).otherwise(0.0)
    report = every.join(sum_).select("source", "target_share", "max_repeats", F.col("rows").alias("documents"), F.col("size").alias("tokens"), "used", share.alias("share"), F.when(F.col("size") > 0, F.col("used") / F.col("size")).otherwise(0.0).alias("epochs"))
    return chosen, report
