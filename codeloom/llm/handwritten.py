"""Generated, minified, vendored and encoded files among source files.

Each file is lexed and a Re-Pair grammar inferred over its token classes: a grammar far smaller than the file marks generated
code and raw tables. Literals that make up most of a file and that a grammar over their characters can't shorten are
encoded data. Rules of locally consistent grammars over token texts, compared across repositories, mark copies of the same
code; who held a rule first wrote it. Minified and bundled code shows by the structure crowded on its lines, for which grammars have
no measure. What a file's path or first comment says of it is believed only together with such a sign: it lowers the
thresholds, and a file in a third-party folder is vendored unless its project holds the same rules elsewhere.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import repair
from codeloom.llm.grammars import WORDS
from codeloom.llm.lexing import Scan, language_of, scan
from codeloom.operators.skew import join_counted
from codeloom.session import Scratch

#: A grammar of at most this many symbols per token, and this many coded bits per token, marks a generated file of at least so many
#: tokens; in the second line, if it says that it is generated. A shorter one has no grammar to speak of and is believed.
GENERATED_RATIO, GENERATED_BITS, GENERATED_TOKENS = 0.27, 1.7, 40
CLAIMED_RATIO, CLAIMED_BITS = 0.45, 2.8
#: Encoded data: literals of at least BLOB_LITERAL characters make up BLOB_SHARE of the file, their characters come nearly
#: equally often (BLOB_EVEN of the bits an even alphabet needs), and their grammar keeps BLOB_CODED of these bits. Words of a language or lists of
#: names are uneven.
BLOB_LITERAL, BLOB_SHARE, BLOB_EVEN, BLOB_CODED = 40, 0.6, 0.93, 0.9
#: Minified: lines of at least so many code tokens hold that share of a file's tokens; the second, if its name says that it is minified.
MINIFIED_TOKENS, MINIFIED_SHARE, CLAIMED_SHARE = 120, 0.5, 0.2
#: Vendored: rules for at least PHRASE_TOKENS tokens that another repository held first make up VENDORED_SHARE of a file. A file of
#: SHORT_TOKENS to LONG_TOKENS tokens has one rule, that of all its tokens.
PHRASE_TOKENS, VENDORED_SHARE, SHORT_TOKENS, LONG_TOKENS = 48, 0.5, 24, 120
#: A file in a third-party folder is its project's own if files outside such folders hold this share of its tokens in the same rules.
NATIVE_SHARE = 0.5
#: Files, and characters, that are measured together.
BATCH_FILES, BATCH_CHARS = 500, 1 << 21

#: Path components and file names by which projects mark what a file is.
_GENERATED_PATH = re.compile(r"(?:^|/)(?:generated|__generated__|autogen)/|_pb2(?:_grpc)?\.\w+$|\.pb(?:\.gw)?\.\w+$|[._](?:gen|generated|designer)\.\w+$", re.I)
_MINIFIED_PATH = re.compile(r"[.-](?:min|bundle)\.(?:js|mjs|cjs)$", re.I)
_VENDORED_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|third[_-]?party|vendor|vendored|deps|externals?|extern|Pods|site-packages)/", re.I)
#: How tools mark their output.
_GENERATED_HEADER = re.compile(r"code generated\b.*\bdo not edit|@generated\b|<auto-?generated\b|\bauto-?generated by\b|\bautomatically generated\b|^\W*generated (?:by|from)\b", re.I | re.M)

_TOKENS = re.compile(r"\x02\x03*|[^\W\d]\w*|\d[\w.]*|[^\s\w\x03]")
_KEYWORDS = set(keyword.kwlist) | {w for ws in WORDS.values() for w in ws.split()}
_CACHE = 400_000


class _Classes(dict):
    """Token text -> small class number: literals, names, numbers, and every keyword and operator for itself."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c == "\x02":
            return 0
        if token in _KEYWORDS or not (c.isalnum() or c == "_"):
            found = 3 + xxhash.xxh32_intdigest(token) % 65521
        else:
            found = 1 if c.isdigit() else 2
        if len(self) > _CACHE:
            self.clear()
        self[token] = found
        return found


class _Hashes(dict):
    """Token text -> 64-bit hash; all literals are one token."""

    def __missing__(self, token: str) -> int:
        found = xxhash.xxh64_intdigest("\x02" if token[0] == "\x02" else token)
        if len(self) > _CACHE:
            self.clear()
        self[token] = found
        return found


_classes, _hashes = _Classes(), _Hashes()


def _header(code: str, masked: str, comments: list, strings: list) -> str:
    """The comments before the first code, or within the first five lines, and a docstring that opens the file."""
    code_at = re.search(r"[^\s]", masked)
    first = code_at.start() if code_at else len(masked)
    fifth = -1
    for _ in range(5):
        fifth = code.find("\n", fifth + 1)
        if fifth < 0:
            fifth = len(code)
            break
    parts = [code[t.start : t.end] for t in comments if t.kind != "directive" and (t.start <= first or t.start <= fifth and _starts_line(code, t.start))]
    if strings and strings[0].start == first:
        parts.append(code[strings[0].start : strings[0].end])
    return "\n".join(parts)


def _starts_line(code: str, pos: int) -> bool:
    """Only comments from a line's very start are headers; indented ones belong to members."""
    return pos == 0 or code[pos - 1] == "\n"


def _minified(masked: str, total: int, share: float) -> bool:
    crowded = 0
    for line in masked.split("\n"):
        if len(line) > 2 * MINIFIED_TOKENS:
            toks = _TOKENS.findall(line)
            plain = sum(1 for t in toks if t[0] == "\x02" or t[0].isdigit() or t in ",[]{}:")
            built = sum(1 for t in toks if t in "();=")
            if len(toks) >= MINIFIED_TOKENS and plain < 0.8 * len(toks) and built >= 0.15 * len(toks):
                crowded += len(toks)
    return total > 0 and crowded >= share * total


def _claims(path: str, code: str, s: Scan) -> bool:
    """Whether a file says that a tool wrote it."""
    return bool(_GENERATED_PATH.search(path) or _GENERATED_HEADER.search(_header(code, s.masked, s.comments, s.strings)))


class Measures(NamedTuple):
    kinds: list[str | None]  # generated, minified, encoded, or None
    tokens: np.ndarray
    rules: list[np.ndarray]  # each file's rules for PHRASE_TOKENS tokens or more, none for those that have a kind
    weights: list[np.ndarray]  # their tokens


def measure(paths: list[str | None], codes: list[str | None]) -> Measures:
    """What each file of a batch is by itself, and its rules."""
    n = len(paths)
    kinds: list[str | None] = [None] * n
    scans: list[tuple[str, Scan] | None] = [None] * n
    classes, texts, literals, owners = [], [], [], []
    empty = np.zeros(0, dtype=np.int64)
    for k, (path, code) in enumerate(zip(paths, codes)):
        if not code or not code.strip("\ufeff \t\r\n"):
            classes.append(empty)
            texts.append(empty.astype(np.uint64))
            continue
        if code[0] == "\ufeff":
            code = code[1:]
        path = path or ""
        s = scan(code, language_of(path) or "c")
        toks = _TOKENS.findall(s.masked)
        classes.append(np.fromiter(map(_classes.__getitem__, toks), dtype=np.int64, count=len(toks)))
        texts.append(np.fromiter(map(_hashes.__getitem__, toks), dtype=np.uint64, count=len(toks)))
        if _minified(s.masked, len(toks), CLAIMED_SHARE if _MINIFIED_PATH.search(path) else MINIFIED_SHARE):
            kinds[k] = "minified"
            continue
        scans[k] = code, s
        long = [t for t in s.strings if t.end - t.start >= BLOB_LITERAL]
        if sum(t.end - t.start for t in long) >= BLOB_SHARE * len(code):
            body = "".join(code[t.start + 1 : t.end - 1] for t in long)
            literals.append(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64))
            owners.append(k)
    g = repair.infer(classes)
    short = (g.length < GENERATED_TOKENS) & (g.length > 0)  # too short for a grammar to say anything
    long = g.length >= GENERATED_TOKENS
    likely = long & (g.size <= CLAIMED_RATIO * g.length) & (g.bits <= CLAIMED_BITS * g.length)
    plain = long & (g.size <= GENERATED_RATIO * g.length) & (g.bits <= GENERATED_BITS * g.length)
    for k in np.flatnonzero(short | likely):
        if kinds[k] is None and (plain[k] or _claims(paths[k] or "", *scans[k])):
            kinds[k] = "generated"
    if literals:
        coded = repair.infer(literals)
        for k, bits, plain, x in zip(owners, coded.bits, coded.plain_bits, literals):
            even = len(x) * np.log2(max(2, len(np.unique(x))))
            if plain >= BLOB_EVEN * even and bits >= BLOB_CODED * plain:
                kinds[k] = kinds[k] or "encoded"
    # Generated code and data are no evidence of copying.
    doc, rule, weight = repair.phrases([x if kind is None and len(x) > LONG_TOKENS else x[:0] for x, kind in zip(texts, kinds)], PHRASE_TOKENS)
    long = weight >= PHRASE_TOKENS
    cut = np.searchsorted(doc[long], np.arange(n + 1))
    rules = [rule[long][a:z] for a, z in zip(cut, cut[1:])]
    weights = [weight[long][a:z] for a, z in zip(cut, cut[1:])]
    for k, x in enumerate(texts):
        if kinds[k] is None and SHORT_TOKENS <= len(x) <= LONG_TOKENS:
            rules[k] = np.array([xxhash.xxh64_intdigest(x.tobytes())], dtype=np.uint64)
            weights[k] = np.array([len(x)])
    return Measures(kinds, g.length, rules, weights)


def _batches(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a frame, of BATCH_FILES files and BATCH_CHARS characters at most, or of one file."""
    size = f["code"].str.len().to_numpy()
    start = total = 0
    for k, chars in enumerate(size):
        if k > start and (k - start >= BATCH_FILES or total + chars > BATCH_CHARS):
            yield f.iloc[start:k]
            start, total = k, 0
        total += chars
    if start < len(f):
        yield f.iloc[start:]


_SCHEMA = "file_id bigint, repo bigint, since bigint, placed boolean, kind string, tokens bigint, rules array<bigint>, weights array<int>"


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in frames:
        for f in _batches(whole):
            m = measure(list(f["path"]), list(f["code"]))
            yield pd.DataFrame(
                {
                    "file_id": f["file_id"].to_numpy(),
                    "repo": f["repo"].to_numpy(),
                    "since": f["since"].to_numpy(),
                    "placed": [bool(p and _VENDORED_PATH.search(p)) for p in f["path"]],
                    "kind": m.kinds,
                    "tokens": m.tokens,
                    "rules": [r.astype(np.uint64).view(np.int64) for r in m.rules],
                    "weights": [w.astype(np.int32) for w in m.weights],
                }
            )


def not_handwritten(spark: SparkSession, files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """(file_id, kind): the files nobody wrote by hand in their project, once each, with why: generated (raw tables
    included), minified, encoded or vendored.

    ``files`` needs file_id, project, path and code; ``library`` code of known upstream files. Null, empty and blank code is no
    case; a null project is a repository of its own; a file that comes several times counts once. A rule that several repositories
    hold is native to the library, else to the repository whose first holder lies outside third-party folders, has the earliest
    modified_at (if ``files`` has that column; null is late) and the least file_id; in all others it is a copy. So the original of a copied file stays. One
    pass lexes and measures every file and is written; rules are then counted over all repositories with map-side combining and joined
    back, the most frequent ones by broadcast (see ``join_counted``). The result is written, the rest deleted.
    """
    scratch = Scratch(spark, "handwritten")
    since = F.least(F.greatest(F.coalesce(F.unix_micros("modified_at"), F.lit(2**52)), F.lit(0)), F.lit(2**52 - 1)) if dict(files.dtypes).get("modified_at") == "timestamp" else F.lit(0).cast("bigint")
    own = files.where("code IS NOT NULL AND file_id IS NOT NULL").select("file_id", F.xxhash64(F.coalesce("project", F.lit("\0none"))).alias("repo"), since.alias("since"), "path", "code")
    if library is not None:
        known = library.where("code IS NOT NULL").select(F.lit(None).cast("bigint").alias("file_id"), F.xxhash64(F.lit("\0library")).alias("repo"), F.lit(0).cast("bigint").alias("since"), F.col("file_name").alias("path"), "code")
        own = own.unionByName(known)
    measured = scratch.cut(own.mapInPandas(_measured, _SCHEMA))
    rows = measured.select(F.sum(F.size("rules"))).first()[0] or 0
    pairs = measured.where("size(rules) > 0").select("file_id", "repo", "since", "placed", F.explode(F.arrays_zip("rules", "weights")).alias("r")).select("file_id", "repo", "since", "placed", F.col("r.rules").alias("rule"), F.col("r.weights").alias("weight"))
    # Who comes first among a rule's holders, as one number: the library, then holders outside third-party folders, by date, by id.
    rank = F.expr("CAST(CAST(file_id IS NOT NULL AS INT) * 2 + CAST(placed AS INT) AS DECIMAL(1, 0)) * 4503599627370496 + CAST(since AS DECIMAL(16, 0))").cast("decimal(18,0)")
    rank = rank * F.lit(Decimal(2**63)) + F.coalesce("file_id", F.lit(0))
    counted = pairs.groupBy("rule").agg(F.min_by("repo", rank).alias("native"), F.count("*").alias("n"), (F.min("repo") != F.max("repo")).alias("foreign"))
    shared = scratch.cut(counted.where("n > 1"))
    asked = pairs.where("file_id IS NOT NULL").select("file_id", "repo", "placed", "rule", "weight")
    held = scratch.cut(join_counted(asked, shared, "rule", "n", rows))
    copied = held.where("foreign AND repo <> native").groupBy("file_id").agg(F.sum("weight").alias("copied"))
    elsewhere = held.where("NOT placed").select("rule", "repo").distinct()
    native = held.where("placed").select("file_id", "repo", "rule", "weight").join(elsewhere, ["rule", "repo"], "left_semi").groupBy("file_id").agg(F.sum("weight").alias("native"))
    # A file that comes k times has its rules k times: compare with the tokens of all its rows.
    per_file = measured.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("kind").alias("kind"), F.sum("tokens").alias("tokens"), F.max("placed").alias("placed"))
    zero = F.lit(0)
    copy = F.coalesce("copied", zero) >= VENDORED_SHARE * F.col("tokens")
    foreign = F.col("placed") & (F.coalesce("native", zero) < NATIVE_SHARE * F.col("tokens"))
    found = per_file.join(copied, "file_id", "left").join(native, "file_id", "left").withColumn("kind", F.coalesce("kind", F.when((F.col("tokens") > 0) & (copy | foreign), F.lit("vendored"))))
    result = scratch.cut(found.where("kind IS NOT NULL").select("file_id", "kind"))
    for done in (measured, shared, held):
        scratch.drop(done)
    return result
