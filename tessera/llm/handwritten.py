"""Generated, compressed, vendored and data files among source files.

A file is set aside for a notice in its header, found by a multi-pattern automaton over the texts at hand and carried to every row of the same content or place; for its path
(vendored folders, build output, lock files, suffixes of generators and minifiers); or for a size that nobody writes by hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices that tools put at the head of what they write.
NOTICES = (
    "<auto-generated", "<autogenerated", "@generated", "auto-generated", "autogenerated", "automatically generated", "automatically created", "code generated by", "code generated from", "file generated by",
    "file is generated", "file was generated", "file has been generated", "file was automatically", "file is automatically", "generated by the protocol buffer compiler", "generated code", "generated file", "generated source",
    "generated from", "machine generated", "machine-generated", "was produced by", "is produced by", "do not edit", "do not modify by hand", "don't edit", "changes will be lost", "will be overwritten", "automatisch erzeugt", "automatisch generiert",
    "nicht bearbeiten", "nicht von hand", "自动生成", "请勿编辑", "请勿修改", "不要手动修改",
)
#: Lines at the head of a text in which a notice counts, and characters of a line that are read; a minified file has no header but one line.
HEAD_LINES, HEAD_CHARS = 12, 400
# Folders whose files came from others, or from a build.
VENDORED = "node_modules|bower_components|jspm_packages|vendor|_vendor|vendored|third[_-]?party|3rd[_-]?party|external|externals|deps|site-packages|dist-packages|\\.?venv|virtualenv|pods|carthage/checkouts|godeps|gems|\\.yarn|\\.pnpm|\\.bundle|\\.cargo/registry|elm-stuff"
BUILT = "dist|out|obj/(?:debug|release)|bin/(?:debug|release)|target/(?:debug|release|classes|generated-sources)|build/(?:generated|intermediates|lib|js)|__generated__|generated|generated-sources|\\.next|\\.nuxt|deriveddata|__pycache__|\\.gradle|storybook-static"
# Names of the files that record resolved dependencies.
LOCKS = "package-lock\\.json|npm-shrinkwrap\\.json|yarn\\.lock|pnpm-lock\\.ya?ml|bun\\.lockb?|composer\\.lock|gemfile\\.lock|poetry\\.lock|pdm\\.lock|uv\\.lock|pipfile\\.lock|cargo\\.lock|go\\.sum|packages\\.lock\\.json|project\\.assets\\.json|paket\\.lock|mix\\.lock|pubspec\\.lock|podfile\\.lock|cartfile\\.resolved|package\\.resolved|flake\\.lock|gradle\\.lockfile|deno\\.lock|conan\\.lock|stack\\.yaml\\.lock|cabal\\.project\\.freeze|\\.terraform\\.lock\\.hcl|renv\\.lock|manifest\\.lock"
# How minifiers, bundlers and generators name their output.
MINIFIED = "[.\\-_]min\\.(?:js|mjs|cjs|css|html)|\\.(?:bundle|chunk|packed|prod)\\.(?:js|mjs|cjs|css)|\\.[0-9a-f]{8,}\\.(?:js|mjs|css)|[.\\-]\\d+\\.\\d+\\.\\d+\\.(?:js|css)|\\.(?:js|css|ts)\\.map"
GENERATED = (
    "\\.pb\\.(?:go|cc|h|rb|swift)|_pb2(?:_grpc)?\\.pyi?|_grpc_pb\\.js|_pb\\.(?:js|rb|d\\.ts)|\\.(?:g|gen|generated|designer|freezed|gr)\\.[a-z]{1,5}|\\.g\\.i\\.cs|_(?:gen|generated)\\.[a-z]{1,5}|\\.graphql\\.[jt]s|\\.tab\\.[ch](?:pp|c)?"
    "|lex\\.yy\\.c|\\.assemblyinfo\\.cs|\\+coredataproperties\\.swift|\\+coredataclass\\.swift|modelsnapshot\\.cs|\\.sql\\.go|_string\\.go|\\.swagger\\.json"
)
#: A generator's prefix counts only with the extension of its language.
PREFIXED = "zz_generated\\.[^/]*|(?:moc|qrc)_[^/]*\\.(?:cpp|cc)|ui_[^/]*\\.(?:h|py)|mock_[^/]*\\.go|r\\.java"
#: Versioned copies of libraries in folders for them.
VERSIONED = "(?:lib|libs|assets|static|js|css)/(?:[^/]+/)*[^/]+[-.@]\\d+(?:\\.\\d+)+(?:/[^/]+)*\\.(?:js|css|ts|map)"
#: Bytes above which no source or markup file was written by hand.
LARGE = 256 * 1024
#: Shares over which the rows of one content are spread.
SALTS = 8

RULES = {
    "vendored": f"(?:^|/)(?:{VENDORED})/",
    "built": f"(?:^|/)(?:{BUILT})/",
    "lock": f"(?:^|/)(?:{LOCKS})$",
    "minified": f"(?:{MINIFIED})$",
    "generated": f"(?:{GENERATED})$|(?:^|/)(?:{PREFIXED})$",
    "versioned": f"(?:^|/){VERSIONED}$",
}


def plain_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\\", "/"), r"^(?:\./)+", "")


def known_hash(c: Column) -> Column:
    """The comparable form of a content hash; null if it is unknown."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")
    return F.when(~bare.isin("", "pending"), bare)


def path_reason(path: Column) -> Column:
    """The first rule that a plain path meets, or null."""
    return F.coalesce(*[F.when(path.rlike(rule), F.lit(name)) for name, rule in RULES.items()])


def _noticed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = ahocorasick.Automaton()
    for n in NOTICES:
        found.add_word(n, n)
    found.make_automaton()
    comment = re.compile(r"""^\s*(?://|/\*|\*|#|--|;|%|<!--|\(\*|"|'|REM\b|dnl\b|<\?)""")
    for f in frames:
        keep = []
        for text in f.content:
            head = [line[:HEAD_CHARS] for line in text.split("\n", HEAD_LINES)[:HEAD_LINES]]
            keep.append(any(comment.match(line) and next(found.iter(line.lower()), None) is not None for line in head))
        yield f.loc[keep, ["snapshot_id", "path", "h"]]


def noticed(texts: DataFrame) -> DataFrame:
    """(snapshot_id, path, h) of the texts with a generator's notice in a remark at their head. texts: (snapshot_id, path, content_hash, content)."""
    rows = texts.where("content is not null and content != ''").select("snapshot_id", plain_path(F.col("path")).alias("path"), known_hash(F.col("content_hash")).alias("h"), "content")
    return rows.mapInPandas(_noticed, "snapshot_id string, path string, h string")


def _with_any(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``; the rows of one key are spread, as one content may hold a great part of them."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    many = keys.dropna().distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, [*on, "salt"], "left_semi").drop("salt")


def not_handwritten(files: DataFrame, texts: DataFrame, large: int = LARGE) -> DataFrame:
    """(id, reason): each files row, once per id, that is no hand-written source.

    files: (id, snapshot_id, path, content_hash, size, is_binary); texts: (snapshot_id, path, content_hash, content) of any part of them. Binary rows are left out, a null is_binary is none. A null path meets no rule;
    a null size is taken from rows of the same known content. Null, empty and very long contents are read as they are, only their header counts. Of several reasons the first in the order of RULES, then 'large', then 'notice'.
    """
    rows = files.where("id is not null and not coalesce(is_binary, false)").select("id", "snapshot_id", plain_path(F.col("path")).alias("path"), known_hash(F.col("content_hash")).alias("h"), "size")
    told = rows.withColumn("reason", F.coalesce(path_reason(F.col("path")), F.when(F.col("size") >= large, F.lit("large"))))
    by_itself = told.where("reason is not null").select("id", "reason")
    rest = told.where("reason is null")
    big = files.where(F.col("size") >= large).select(known_hash(F.col("content_hash")).alias("h"))
    by_copy = _with_any(rest.where("size is null and h is not null").select("id", "h"), big, ["h"]).select("id", F.lit("large").alias("reason"))
    marked = noticed(texts)
    by_content = _with_any(rest.where("h is not null").select("id", "h"), marked.select("h"), ["h"]).select("id", F.lit("notice").alias("reason"))
    by_place = _with_any(rest.select("id", "snapshot_id", "path"), marked.select("snapshot_id", "path"), ["snapshot_id", "path"]).select("id", F.lit("notice").alias("reason"))
    every = by_itself.unionByName(by_copy).unionByName(by_content).unionByName(by_place)
    order = F.array(*[F.lit(r) for r in [*RULES, "large", "notice"]])
    return every.groupBy("id").agg(F.min(F.array_position(order, F.col("reason"))).alias("k")).select("id", F.element_at(order, F.col("k").cast("int")).alias("reason"))
