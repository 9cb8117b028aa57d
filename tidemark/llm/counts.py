"""Token counts of every prefix of a text, by dynamic programming, for questions of truncation and budget.

A sequence of byte-pair tokens is what the merges make of its bytes exactly if every two neighbours are what the
merges make of theirs: the first merge across a border would be made in the pair alone as well.  So the tokens of
a prefix are those of a shorter prefix and one more token that ends here and fits the last one before it, and
there is just one such token.  The counts of all prefixes of a word thus come from one pass over its bytes, with a
table of last tokens (inside a word) and the marked tokens that may end one; words add up.

Stored is a document's ``deltas``: how the count changes with each character, a signed byte each (four bytes each,
``width``, in a document where a change needs them).  ``at`` and ``longest`` answer from that column alone:
tokens of any prefix, and the longest prefix within a budget, without a text or a tokenizer.

A prefix is one of the composed text (NFC, as the tokenizer sees it, special tokens apart); its count is that of the
prefix as a text of its own, so it may fall: a longer word can have fewer tokens.  The numbers of characters are those of the composed text.

Edge cases: a null or empty text has no tokens and no characters; a special token's string in a text is that token; words of any
length take a table as long as the word; invalid UTF-8 counts as replacement characters; repeated rows and ids are counted row by
row; columns of the input that have a result's name, in any case, are replaced, all others pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import math
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from tidemark.llm._frames import cut, utf8, with_arrow
from tidemark.llm.bpe import SEGMENT, public_path
from tidemark.llm.bpe import _byte_chars as byte_chars

#: How this vocabulary's tokenizer splits a text in lower case (fixed values); white space between the pieces is dropped.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE = r"\p{White_Space}"
PIECE = "|".join(CONTRACTIONS) + rf"|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Words and pairs of tokens that are remembered; what is forgotten is computed again.
REMEMBERED = 1 << 18
MADE = "n_chars bigint, n_tokens bigint, width int, deltas binary"


@lru_cache(maxsize=1)
def _unknown() -> regex.Pattern:
    """Characters that Python's tables of characters don't have, but the tokenizer's may."""
    missing = [i for i in range(0x20000) if unicodedata.category(chr(i)) == "Cn"]
    ends = [i for i in missing if unicodedata.category(chr(i + 1)) != "Cn" or i == missing[-1]]
    starts = [i for i in missing if unicodedata.category(chr(i - 1)) != "Cn"]
    return regex.compile("[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def _known(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _unknown().search(text)
    return True


def compose(text: str) -> str:
    """NFC, as the tokenizer's library has it."""
    if text.isascii() or _known(text):
        return unicodedata.normalize("NFC", text)
    return normalizers.NFC().normalize_str(text)


def lower(text: str) -> str:
    """Lower case character by character (no final sigma), as the tokenizer's library has it."""
    if text.isascii() or _known(text):
        return text.replace("Σ", "σ").lower()
    return normalizers.Lowercase().normalize_str(text)


class _Remembered(dict):
    """Values by key; when full, it goes on with an empty table and what is asked for again from the full one."""

    def __init__(self, of):
        self.of, self.old = of, {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        self[key] = out = self.of(key) if out is None else out
        return out


class PrefixCounts:
    """A tokenizer with word ends, from its vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_chars()
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        # a token's bytes, and whether it ends a word, from how it is made: its string alone may be read in two ways
        made = {vocab[c + m]: (bytes([b]), bool(m)) for c, b in byte_of.items() for m in ("", mark)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            made[new] = (made[a][0] + made[b][0], made[b][1])
            self.merge[a, b] = (rank, new)
        rank_of = {new: rank for rank, new in self.merge.values()}
        if any(rank_of.get(x, -1) >= rank for pair, (rank, _) in self.merge.items() for x in pair):
            raise ValueError("a merge takes tokens that are made later")
        self.made = made
        self.parts = {new: pair for pair, (_, new) in self.merge.items()}
        self.inside = {s: i for i, (s, ends) in made.items() if not ends}
        self.ending = {s: i for i, (s, ends) in made.items() if ends}
        self.found = ahocorasick.Automaton()  # all tokens that end at a byte
        for s in self.inside.keys() | self.ending.keys():
            self.found.add_word(s.decode("latin-1"), (len(s), self.inside.get(s, -1), self.ending.get(s, -1)))
        self.found.make_automaton()
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._split = regex.compile(rf" ?(?:{PIECE})|{SPACE}")
        self._space = regex.compile(SPACE)
        self.sound, self.fits = _Remembered(self._sound), _Remembered(self._fits)
        self.right, self.left = _Remembered(lambda t: self._edge(t, 1)), _Remembered(lambda t: self._edge(t, 0))
        self.narrow = _Remembered(self._narrow)

    def merged(self, ids: list[int]) -> list[int]:
        """What the merges make of some tokens' bytes: the merge of least rank first, from the left."""
        while len(ids) > 1:
            best = min((m for m in ((self.merge.get(p), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))) if m[0]), key=lambda m: (m[0][0], m[1]), default=None)
            if best is None:
                break
            (_, new), at = best
            ids[at : at + 2] = [new]
        return ids

    def _sound(self, token: int) -> bool:
        """Whether the merges make this token of its bytes."""
        data, ends = self.made[token]
        return self.merged([self.inside[data[i : i + 1]] for i in range(len(data) - ends)] + ([self.ending[data[-1:]]] if ends else [])) == [token]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one side of a token while it is made, each with the rank of the merge that takes it."""
        out, taken = [], math.inf
        while token in self.parts:
            out.append((token, taken))
            taken, token = self.merge[self.parts[token]][0], self.parts[token][side]
        return [*out, (token, taken)]

    def _fits(self, pair: int) -> bool:
        """Whether a token (the low 20 bits) may follow another (or, after -1, begin a word): no merge across the border comes before both sides are taken."""
        a, b = pair >> 20, pair & 0xFFFFF
        if a < 0 or not self.sound[b]:
            return self.sound[b]
        for x, x_taken in self.right[a]:
            for y, y_taken in self.left[b]:
                m = self.merge.get((x, y))
                if m and m[0] < x_taken and m[0] <= y_taken:  # of equal ranks the left one comes first
                    return False
        return True

    def word(self, word: str) -> list[int]:
        """The counts of a word's prefixes, by characters, each as a word of its own."""
        data = word.encode("utf-8", "replace")
        n, fits = len(data), self.fits
        last, count, out = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        seen = 0  # up to here last tokens are known; all tokens that end at a byte come together, long ones first
        for end, (size, inside, ending) in self.found.iter(data.decode("latin-1")):
            end += 1
            at = end - size
            before = last[at] << 20
            if seen < end and inside >= 0 and fits[before | inside]:
                last[end], count[end], seen = inside, count[at] + 1, end
            if ending >= 0 and not out[end] and fits[before | ending]:
                out[end] = count[at] + 1
        return out[1:] if len(word) == n else [out[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def changes(self, piece: str) -> list[int]:
        """How the count changes with each character of a piece, a space in front of it included."""
        word = piece[1:] if piece[0] == " " else "" if self._space.match(piece) else piece
        counts = self.word(word)
        if len(word) == 3 and word in CONTRACTIONS:  # short of its last letter it isn't one, and is split
            counts[1] = counts[0] + self.word(word[1])[0]
        return [0] * (len(piece) - len(word)) + [b - a for a, b in zip([0, *counts], counts, strict=False)]

    def _narrow(self, piece: str) -> bytes:
        return array("b", self.changes(piece)).tobytes()

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without special tokens, some at a time."""
        at = 0
        while at < len(text):
            to = at + SEGMENT
            if to < len(text):  # white space only begins pieces
                gap = self._space.search(text, to)
                to = gap.start() if gap else len(text)
            if to - at <= 4 * SEGMENT:
                yield self._split.findall(text, at, to)
            else:
                few: list[str] = []
                for m in self._split.finditer(text, at, to):
                    few.append(m[0])
                    if len(few) == 4096:
                        yield few
                        few = []
                yield few
            at = to

    def _plain(self, text: str, wide: bool) -> Iterator[bytes]:
        """Changes by character of a composed text without special tokens."""
        for pieces in self._pieces(lower(text)):
            if wide:
                yield b"".join(array("i", self.changes(p)).tobytes() for p in pieces)
            else:
                yield b"".join([self.narrow[p] if len(p) <= 64 else self._narrow(p) for p in pieces])

    def _span(self, text: str, wide: bool) -> bytes:
        kind = np.int32 if wide else np.int8
        out = b"".join(self._plain(text, wide))
        if "İ" in text:  # two characters in lower case
            where = np.array([i for i, c in enumerate(text) if c == "İ"])
            each = np.frombuffer(out, kind).astype(np.int64)
            second = where + np.arange(1, len(where) + 1)
            each[second - 1] += each[second]
            each = np.delete(each, second)
            if len(each) and abs(each).max() > np.iinfo(kind).max:
                raise OverflowError
            out = each.astype(kind).tobytes()
        return out

    def deltas(self, text: str) -> tuple[int, bytes]:
        """(width, changes by character of the composed text)."""
        try:
            return 1, self._deltas(text, False)
        except OverflowError:  # a change of more than a signed byte
            return 4, self._deltas(text, True)

    def _deltas(self, text: str, wide: bool) -> bytes:
        kind, out, at = np.dtype(np.int32 if wide else np.int8), [], 0
        for m in [*self._cut.finditer(text), None] if self._cut else [None]:
            special = m[0] if m else ""
            part = compose(text[at : m.start() if m else len(text)])
            # up to its last character a special token is text like any other
            changes = self._span(part + special[:-1], wide)
            out.append(changes)
            if m:
                each = np.frombuffer(changes, kind).astype(np.int64)
                jump = 1 - int(each[len(part) :].sum())
                out.append(np.array([jump], kind).tobytes() if abs(jump) < np.iinfo(kind).max else self._too_much())
                at = m.end()
        return b"".join(out)

    @staticmethod
    def _too_much() -> bytes:
        raise OverflowError


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def composed(text: str, specials: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")) -> str:
    """The text whose prefixes are counted."""
    cut_at = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")
    return "".join(p if p in specials else compose(p) for p in cut_at.split(text))


def prefix_counts(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """df with n_chars, n_tokens, width and deltas."""
    path = path or public_path("word_bpe_49k.json")

    def make(texts: list[bytes | None]) -> dict:
        of, out = counter(path), {k.split()[0]: [] for k in MADE.split(", ")}
        for t in texts:
            width, deltas = of.deltas((t or b"").decode("utf-8", "replace"))
            each = np.frombuffer(deltas, np.int8 if width == 1 else np.int32)
            for k, v in zip(out, (len(each), int(each.sum(dtype=np.int64)), width, deltas), strict=True):
                out[k].append(v)
        return out

    return with_arrow(df, [utf8(df[f"`{text_col}`"])], make, MADE)


def stored(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of all prefixes of docs as a table (id, n_bytes, MADE): texts are read for it once, and all questions read it."""
    few = docs.select(docs[f"`{id_col}`"].alias(id_col), F.coalesce(F.octet_length(utf8(docs[f"`{text_col}`"])), F.lit(0)).cast("bigint").alias("n_bytes"), docs[f"`{text_col}`"].alias("text"))
    return cut(prefix_counts(few, path).drop("text"), "prefix-counts", compression="zstd")


def _sums(width: int, deltas: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.frombuffer(deltas, np.int8 if width == 1 else np.int32), dtype=np.int64)))


def at(book: DataFrame, chars: Column, name: str = "tokens_at") -> DataFrame:
    """The book with the token count of each row's first ``chars`` characters (all, if it has fewer; none, if that is null or negative)."""

    def make(widths: list[int], deltas: list[bytes], chars: list[int | None]) -> dict:
        sums = map(_sums, widths, deltas)
        return {name: [int(s[min(max(n or 0, 0), len(s) - 1)]) for s, n in zip(sums, chars, strict=True)]}

    return with_arrow(book, [book["width"], book["deltas"], chars.cast("bigint")], make, f"{name} bigint")


def longest(book: DataFrame, budget: Column, name: str = "kept_chars") -> DataFrame:
    """The book with the number of characters of each row's longest prefix of at most ``budget`` tokens (null or negative: none fit, 0)."""

    def make(widths: list[int], deltas: list[bytes], budgets: list[int | None]) -> dict:
        sums = map(_sums, widths, deltas)
        return {name: [max(0, int(np.flatnonzero(s <= b)[-1])) if (b if b is not None else -1) >= 0 else 0 for s, b in zip(sums, budgets, strict=True)]}

    return with_arrow(book, [book["width"], book["deltas"], budget.cast("bigint")], make, f"{name} bigint")


def op11(documents: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Every document's count, whether it is over the limit, and how many characters of it fit, all from the stored prefix counts."""
    book = longest(stored(documents, path), F.lit(limit))
    return book.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", "kept_chars")
