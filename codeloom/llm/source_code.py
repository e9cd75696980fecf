"""Spark operators on source files: which do not parse, and the documented functions of those that do."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import docpairs, syntax
from codeloom.llm.lexing import EXTENSIONS, language_of, scan

#: Neighbouring chunks that are reduced first.
RUN = 64


def language_column(path: str = "path"):
    """The language a path's extension names, as a Column; null for null, no or unknown extension."""
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, ext)


@F.pandas_udf(T.BooleanType())
def _broken(lang: pd.Series, code: pd.Series) -> pd.Series:
    """Whether files of one chunk are broken: the map of the chunk is the map of the file. Null where there is no code."""
    return pd.Series([None if c is None else not syntax.parses(x, c) for x, c in zip(lang, code)], dtype=object)


def _cut(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, lang, code in zip(f["key"], f["lang"], f["code"]):
                parts = syntax.chunks(code, size)
                yield pd.DataFrame({"key": key, "lang": lang, "no": range(len(parts)), "part": parts})

    return run


@F.pandas_udf(T.StringType())
def _map(lang: pd.Series, no: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(syntax.state_map(x, p, n == 0)) for x, n, p in zip(lang, no, part)], dtype=object)


@F.pandas_udf(T.StringType())
def _reduce(lang: pd.Series, maps: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(syntax.reduce_maps(x, [json.loads(m) for m in ms])) for x, ms in zip(lang, maps)], dtype=object)


@F.pandas_udf(T.BooleanType())
def _judge(lang: pd.Series, whole: pd.Series) -> pd.Series:
    verdicts = [syntax.verdict(x, json.loads(m)) for x, m in zip(lang, whole)]
    return pd.Series([None if v is None else not v for v in verdicts], dtype=object)


def chunk_verdicts(files: DataFrame, size: int) -> DataFrame:
    """(key, lang, broken): the verdict on each (key, lang, code), whose chunks are spread, mapped by the lexer states they may
    begin in and reduced in two steps, neighbours first. ``broken`` is null where a chunk ends in a state beyond those of the maps."""
    parts = files.select("key", "lang", "code").mapInPandas(_cut(size), "key string, lang string, no int, part string").repartition("key", "lang", "no").dropDuplicates(["key", "lang", "no"])
    maps = parts.select("key", "lang", "no", _map("lang", "no", "part").alias("map"))
    for width in (RUN, None):
        run = F.lit(0) if width is None else F.floor(F.col("no") / width).cast("int")
        ordered = maps.withColumn("run", run).groupBy("key", "lang", "run").agg(F.array_sort(F.collect_list(F.struct("no", "map"))).alias("maps"))
        maps = ordered.select("key", "lang", F.col("run").alias("no"), _reduce("lang", F.col("maps.map")).alias("map"))
    return maps.select("key", "lang", _judge("lang", "map").alias("broken"))


def syntax_verdicts(files: DataFrame, *keep: str, chunk_chars: int = syntax.CHUNK_CHARS) -> DataFrame:
    """(file_id, *keep, lang, broken): one row for each row of ``files`` that has code and a known extension.

    ``files`` needs file_id, path and code; other columns are ignored unless named in ``keep``. Null code and unknown
    extensions give no row; empty code is valid; a byte order mark at the start is ignored. Every file is cut into chunks of
    ``chunk_chars``; maps of chunks are reduced to the map of the file, which gives the verdict. A file of one chunk is judged where it lies
    and not shuffled; the chunks of longer ones are spread over the cluster, each different content once, however many rows have
    it. ``chunk_chars`` changes no verdict: where maps leave it open, the file is scanned in order. Python is parsed by CPython, each file by one task.
    """
    base = files.select("file_id", *keep, "path", "code", language_column().alias("lang")).where("code IS NOT NULL AND lang IS NOT NULL")
    one = F.col("lang").eqNullSafe("python") | (F.length("code") <= chunk_chars)
    small = base.where(one).select("file_id", *keep, "lang", _broken("lang", "code").alias("broken"))
    big = base.where(~one).withColumn("key", F.sha2("code", 256))
    joined = big.join(chunk_verdicts(big, chunk_chars), ["key", "lang"])
    in_order = _broken("lang", F.when(F.col("broken").isNull(), F.col("code")))
    large = joined.select("file_id", *keep, "lang", F.coalesce("broken", in_order).alias("broken"))
    return small.unionByName(large)


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id): files whose code a parser of the language of their extension would reject, once each.

    Rows without file_id are left out; a file that comes several times is broken if any of its rows is.
    """
    return syntax_verdicts(files).where("broken AND file_id IS NOT NULL").select("file_id").distinct()


def broken_rates(files: DataFrame) -> DataFrame:
    """(project, language, files, broken_files, broken_rate) over files with code; a file's repeated rows count once.

    A null project is a group of its own. Language is that of the extension.
    """
    per_file = syntax_verdicts(files, "project").groupBy("file_id").agg(F.min("project").alias("project"), F.min("lang").alias("language"), F.max("broken").alias("broken"))
    return (
        per_file.groupBy("project", "language")
        .agg(F.count("*").alias("files"), F.sum(F.col("broken").cast("bigint")).alias("broken_files"))
        .withColumn("broken_rate", F.round(F.col("broken_files") / F.col("files"), 6))
    )


_NAME_SCHEMA = "file_id bigint, line_no int, fn_name string"
_PAIR_SCHEMA = _NAME_SCHEMA + ", path string, language string, signature string, docstring string, code string"


def _pairs(texts: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "line_no", "fn_name"] + ["path", "language", "signature", "docstring", "code"] * texts
        for f in frames:
            rows = []
            for file_id, path, code in zip(f["file_id"], f["path"], f["code"]):
                lang = language_of(path)
                if not code or lang is None:
                    continue
                text = code[1:] if code[:1] == "\ufeff" else code
                s = scan(text, lang)
                found = docpairs.documented(text, lang, s, texts, says=True)
                if not found:  # whether the file parses makes no difference then
                    continue
                if not (syntax.python_parses(text) if lang == "python" else syntax.scan_parses(lang, text, s)):
                    continue
                rows += [(file_id, d.line_no, d.name, path, lang, d.signature, d.doc, d.code) if texts else (file_id, d.line_no, d.name) for d in found]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def documented_functions(files: DataFrame, texts: bool = True) -> DataFrame:
    """(file_id, line_no, fn_name, path, language, signature, docstring, code): every function or method declaration with
    documentation that says something, in files that parse; once per declaration. Without ``texts`` the first three only.
    ``code`` is the function from its declaration to the end of its body. Only files with documentation are parsed: others have no rows anyway.

    ``files`` needs file_id, path and code. Null or empty code, null paths and unknown extensions give no row, broken files
    none either; a file that comes several times with equal content gives each declaration once. line_no is the 1-based line of the
    declared name. One pass over the code; only the found pairs are shuffled, to drop repeats.
    """
    found = files.select("file_id", "path", "code").where("code IS NOT NULL AND file_id IS NOT NULL").mapInPandas(_pairs(texts), _PAIR_SCHEMA if texts else _NAME_SCHEMA)
    return found.dropDuplicates(["file_id", "line_no", "fn_name"])
