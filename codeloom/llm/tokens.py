"""Encoding with a public byte-level BPE vocabulary as a streaming transducer, and its inverse.

Text is cut into words by the vocabulary's pattern, which needs a few characters of lookahead, and words into tokens by a
transducer over bytes. For every position it keeps the last token of the encoding of the word so far: the one token that ends there
and is compatible with the last token of the position where it starts. Compatible are neighbours that no merge of the list
would ever join across, so a path of compatible tokens is the encoding. A token is emitted once all paths that may still win share it,
which is the case at the latest when the merge list's sufficient lookahead, computed from the merges, has followed it. Words come in pieces, so the
transducer's state is bounded by a piece, the lookahead and the longest token, however long the word is.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _vocabulary() -> str:
    """Where the public tokenizers' files are: what their package says, else the folder they are installed in."""
    try:
        from public_tokenizers import path
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"
    return path("byte_bpe_50k.json")


#: The vocabulary's file; a parameter wherever it is used. It is read on the driver only.
VOCABULARY = _vocabulary()
#: Fixed value: the pattern of the vocabulary that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters behind a word that may decide where it ends: the longest contraction.
LOOKAHEAD = 3
#: Characters that are looked at together; words longer than WORD_CHARS are encoded as a stream and not remembered.
BLOCK_CHARS, WORD_CHARS = 1 << 16, 64
#: Characters of a piece of a long word.
PIECE_CHARS = 1 << 11
#: Words whose ids a process remembers.
CACHE_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merges and their ranks, from a tokenizer file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.size = max(ids.values()) + 1
        self.merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((ids[bytes(letters[c] for c in a)], ids[bytes(letters[c] for c in b)]))
        self.tokens: list[bytes] = [b""] * self.size
        for t, i in ids.items():
            self.tokens[i] = t
        made = [ids[self.tokens[a] + self.tokens[b]] for a, b in self.merges]
        mergeable = {i for i, t in enumerate(self.tokens) if len(t) == 1} | set(made)
        self.usable = sorted(mergeable)
        self.made = made
        self.longest = max(len(self.tokens[i]) for i in self.usable)
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """How many bytes behind a position can still change the tokens before it, at most.

        What follows changes what stands before only through merges: one that takes a symbol away from, or makes a new one for, a merge with its left
        neighbour, which comes later in the list, and so on to the left. So a change travels along a chain of merges each of which comes later than the one before
        and whose right side is the left side, or the product, of that one. This is the most bytes such a chain spans, found from the last merge to the first.
        """
        size = [len(t) for t in self.tokens]
        by_right: dict[int, int] = {}  # the longest chain that begins with a merge of this right side
        most = self.longest
        for (left, right), made in zip(reversed(self.merges), reversed(self.made)):
            span = size[made] + max(by_right.get(left, 0), by_right.get(made, 0))
            by_right[right] = max(by_right.get(right, 0), span)
            most = max(most, span)
        return most


class Transducer:
    """The encoder of one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.tokens = v.tokens
        self.rank = {}
        parent: dict[int, tuple[int, int, int]] = {}
        for r, (pair, token) in enumerate(zip(v.merges, v.made)):
            self.rank.setdefault(pair, r)
            parent.setdefault(token, (pair[0], pair[1], r))
        self.parts = parent
        self.longest = v.longest
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in v.usable:
            self.automaton.add_word(v.tokens[i].decode("latin-1"), (len(v.tokens[i]), i))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.lookahead = v.lookahead

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The nodes at one edge of a token's merge tree, each with the rank of the merge that takes it in."""
        cache = self.left if side == 0 else self.right
        found = cache.get(token)
        if found is None:
            found, until, node = [], float("inf"), token
            while True:
                found.append((node, until))
                split = self.parts.get(node)
                if split is None:
                    break
                node, until = split[side], split[2]
            cache[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` together is those two tokens.

        A merge joins across the seam if it comes before both the merge that takes in its left side within ``a`` and the one that takes in
        its right side within ``b``; at equal rank the one further left is applied first.
        """
        key = (a, b)
        found = self.known.get(key)
        if found is None:
            rank, found = self.rank, True
            for x, x_until in self._spine(a, 1):
                for y, y_until in self._spine(b, 0):
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        found = False
                        break
                if not found:
                    break
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = found
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            found = tuple(self.encode_bytes(self._pieces(word)))
            if len(word) <= WORD_CHARS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    @staticmethod
    def _pieces(word: str) -> Iterator[bytes]:
        for at in range(0, len(word), PIECE_CHARS):
            yield word[at : at + PIECE_CHARS].encode("utf-8")

    def encode_bytes(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Encodes one word that arrives in pieces; constant memory, each token as soon as it is certain.

        ``last`` holds for recent positions the last token of the encoding up to there. Position p can still be the start of a later
        token only if it lies within the longest token's length of the end.
        """
        last: dict[int, int] = {}
        emitted = end = 0
        tokens, compatible, longest = self.tokens, self.compatible, self.longest
        tail = b""  # bytes that a token may reach back into
        for piece in pieces:
            if not piece:
                continue
            text = tail + piece
            offset = end - len(tail)
            for at, (size, token) in self.automaton.iter(text.decode("latin-1")):
                stop = offset + at + 1
                if stop <= end or stop in last:
                    continue
                start = stop - size
                if start == 0 or start >= emitted and (before := last.get(start)) is not None and compatible(before, token):
                    last[stop] = token
            end += len(piece)
            tail = text[-(longest - 1) :]
            if end - emitted > self.lookahead + longest:
                settled = self._stable(last, emitted, end)
                yield from self._path(last, emitted, settled)
                emitted = settled
                for p in [p for p in last if p < settled]:
                    del last[p]
        yield from self._path(last, emitted, end)

    def _path(self, last: dict[int, int], start: int, end: int) -> list[int]:
        """The tokens from ``start`` to ``end``."""
        path, at = [], end
        while at > start:
            path.append(last[at])
            at -= len(self.tokens[last[at]])
        path.reverse()
        return path

    def _stable(self, last: dict[int, int], emitted: int, end: int) -> int:
        """The last position that the paths of all positions share at which a later token can start. Of these positions the last is replaced by the one
        before it on its path until one is left, so each is looked at once."""
        heads = [-p for p in range(end, max(emitted, end - self.longest), -1)]
        known = set(heads)
        heapq.heapify(heads)
        while len(heads) > 1:
            p = -heapq.heappop(heads)
            before = -max(emitted, p - len(self.tokens[last[p]]))
            if before not in known:
                known.add(before)
                heapq.heappush(heads, before)
        return -heads[0]

    def words_of(self, text: str) -> Iterator[str]:
        """The words of a text, looked at in blocks; a word is final once LOOKAHEAD characters follow it."""
        if len(text) <= BLOCK_CHARS:
            yield from self.pattern.findall(text)
            return
        at, size = 0, len(text)
        while at < size:
            stop = min(size, at + BLOCK_CHARS)
            done = at
            while True:
                for m in self.pattern.finditer(text, at, stop):
                    if stop < size and m.end() > stop - LOOKAHEAD:
                        break
                    yield m[0]
                    done = m.end()
                if done > at or stop == size:
                    break
                stop = min(size, stop + BLOCK_CHARS)  # one word fills the block
            at = done

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty text."""
        out: list[int] = []
        if text:
            known, more = self.words, out.extend
            for word in self.words_of(text):
                more(known.get(word) or self.encode_word(word))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, each character once all its bytes are there; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = machine.decode(self.tokens[i])
            if piece:
                yield piece
        rest = machine.decode(b"", True)
        if rest:
            yield rest


_BUILT: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    key = shared.value.size, len(shared.value.merges), hash(shared.value.merges[-1])
    if key not in _BUILT:
        _BUILT[key] = Transducer(shared.value)
    return _BUILT[key]


def ids_udf(spark: SparkSession, path: str = VOCABULARY):
    """A Pandas UDF text -> ids. The vocabulary is broadcast once; its size is that of the file."""
    shared = spark.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        encode = _transducer(shared).encode
        return pd.Series([encode(t) for t in text], dtype=object)

    return ids


def count_udf(spark: SparkSession, path: str = VOCABULARY):
    """A Pandas UDF text -> number of tokens, 0 for null and empty text."""
    shared = spark.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = _transducer(shared).encode
        return pd.Series([len(encode(t)) for t in text], dtype="int64")

    return count


def text_udf(spark: SparkSession, path: str = VOCABULARY):
    """A Pandas UDF ids -> text; null for null."""
    shared = spark.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        decode = _transducer(shared).decode
        return pd.Series([None if i is None else "".join(decode(i)) for i in ids], dtype=object)

    return text


def encoded(spark: SparkSession, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each row's text without special tokens, whose strings are ordinary text; an empty list for
    empty and for null text. No shuffle; repeated rows are kept; columns beside doc_id and text are ignored."""
    return documents.select("doc_id", ids_udf(spark, path)("text").alias("ids"))


def round_trips(spark: SparkSession, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, chars, same): the characters of the text that decoding the ids gives, and whether it is the text (of a null text the empty one)."""
    with_ids = documents.select("doc_id", "text", ids_udf(spark, path)("text").alias("ids"))
    back = with_ids.select("doc_id", "text", text_udf(spark, path)("ids").alias("back"))
    return back.select("doc_id", F.length("back").cast("bigint").alias("chars"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))
