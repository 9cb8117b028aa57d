"""Byte-level BPE as a streaming transducer with a bounded lookahead, and its incremental decoder.

Encoding: texts are cut at the special tokens, then by the tokenizer's splitting pattern, and the
merges run inside each piece.  Pieces come from segments of a text that end where the pattern must
break, or one by one where it doesn't break for long.  A piece has no length limit either: ``lookahead`` bytes past a
token are enough to know that it is final, so a long piece is encoded in a window, and tokens that
end before the window's last ``lookahead`` bytes are emitted.  So beside the text itself, memory doesn't grow with it;
``digests`` hashes tokens as they come, and only ``encode`` (a column of ids) gathers them.

The lookahead: merges are applied in the order of their ranks, so what happens on the right can
only change what happens on the left through a merge of lower rank that overlaps the other's right
end, and that one in turn through a still lower one.  ``lookahead`` adds up the longest such chain
of merge strings, each a step to the right of the one before.

Edge cases: null is the empty text, which has no tokens; a special token's string in a text is that
token; pieces of any length, invalid or partial UTF-8 in decoding (replacement characters, also
where a character is split between tokens); equal texts have equal results.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm._frames import utf8, with_arrow

#: The splitting pattern of this vocabulary's tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are split at a time, and pieces whose tokens are remembered.
SEGMENT, REMEMBERED = 1 << 16, 1 << 18


def _byte_chars() -> dict[str, int]:
    """The vocabulary file's printable stand-in for each byte, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(strings: list[bytes]) -> int:
    """Bytes past a token's end that decide it, from the merged strings in the order of their ranks."""
    reach: dict[bytes, int] = {}  # how far a chain goes past a prefix of one of the strings so far
    most = 0
    for s in strings:
        own = max((reach.get(s[i:], 0) for i in range(len(s))), default=0)
        most = max(most, own + len(s))
        for i in range(1, len(s)):
            p = s[:i]
            if reach.get(p, 0) < own + len(s) - i:
                reach[p] = own + len(s) - i
    return most


class _Pieces(dict):
    """Token ids (as int32 bytes) by piece; forgets all when full."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """A tokenizer from its vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.single = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.merge = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        none: dict[int, int] = {}  # of the many tokens that no merge begins with
        self.rank, self.made = [none] * len(self.bytes_of), [vocab[a + b] for a, b in pairs]
        for k, (rank, _) in self.merge.items():
            if self.rank[k >> 32] is none:
                self.rank[k >> 32] = {}
            self.rank[k >> 32][k & 0xFFFFFFFF] = rank
        self.first = [[self.rank[a].get(b, len(pairs)) for b in self.single] for a in self.single]  # by two bytes
        self.lookahead = sufficient_lookahead([raw(a + b) for a, b in pairs])
        self.special = special
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._split, self._pieces = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self._break = regex.compile(r"(?<=\S) (?=\S)")
        self.pieces = _Pieces(self._piece)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    def _short(self, data: bytes) -> list[int]:
        """As _window, with the ranks of all neighbours in a list: n steps a merge, each a fast one."""
        single, first, rank, made = self.single, self.first, self.rank, self.made
        never = len(made)
        ids = [single[b] for b in data]
        ranks = [first[a][b] for a, b in zip(data, data[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            new = made[best]
            ids[i : i + 2] = (new,)
            del ranks[i]
            if i:
                ranks[i - 1] = rank[ids[i - 1]].get(new, never)
            if i < len(ranks):
                ranks[i] = rank[new].get(ids[i + 1], never)
        return ids

    def _window(self, ids: list[int]) -> list[int]:
        """As _short, with a queue of merges: n log n steps."""
        n, merge = len(ids), self.merge
        after, before, queue = [*range(1, n + 1)], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if m := merge.get(ids[i] << 32 | ids[i + 1]):
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get(new << 32 | ids[after[i]]):
                    heapq.heappush(queue, (m[0], i, m[1], new, ids[after[i]]))
            if before[i] >= 0 and (m := merge.get(ids[before[i]] << 32 | new)):
                heapq.heappush(queue, (m[0], before[i], m[1], ids[before[i]], new))
        return [i for i in ids if i >= 0]

    def stream(self, piece: str | bytes, window: int | None = None) -> Iterator[list[int]]:
        """The tokens of one piece, as soon as they are final; holds two windows of its bytes."""
        window = window or 2 * self.lookahead
        held, at = b"", 0
        while at < len(piece) or held:
            while at < len(piece) and len(held) < window:
                part = piece[at : at + window]
                held += part if isinstance(part, bytes) else part.encode("utf-8", "surrogatepass")
                at += len(part)
            ids = self._window([self.single[b] for b in held])
            if at >= len(piece):
                yield ids
                return
            stop, final = 0, []
            for i in ids:
                if stop + len(self.bytes_of[i]) > len(held) - self.lookahead:
                    break
                stop += len(self.bytes_of[i])
                final.append(i)
            if not final:
                window *= 2
                continue
            held = held[stop:]
            yield final

    def _piece(self, data: bytes) -> list[int]:
        if len(data) <= 48:
            return self._short(data)
        return [i for ids in self.stream(data) for i in ids]

    def _segments(self, text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """Where [begin, end) of a text may be cut: at breaks that the pattern has as well."""
        while end - begin > SEGMENT:
            m = self._break.search(text, begin + SEGMENT - 1, end)
            if not m:
                break
            yield begin, m.start()
            begin = m.start()
        yield begin, end

    def _plain(self, text: str, begin: int, end: int) -> Iterator[np.ndarray]:
        """Tokens of a stretch without special tokens."""
        for i, j in self._segments(text, begin, end):
            if j - i <= 2 * SEGMENT:
                yield np.frombuffer(b"".join(map(self.pieces.__getitem__, self._split(text[i:j]))), np.int32)
                continue
            few: list[bytes] = []
            for m in self._pieces(text[i:j]):  # no break for long: piece by piece, long ones window by window
                if m.end() - m.start() <= 64:
                    few.append(self.pieces[m[0]])
                if few and (len(few) == 4096 or m.end() - m.start() > 64):
                    yield np.frombuffer(b"".join(few), np.int32)
                    few = []
                if m.end() - m.start() > 64:
                    for ids in self.stream(m[0]):
                        yield np.array(ids, np.int32)
            yield np.frombuffer(b"".join(few), np.int32)

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The text's token ids, in parts of bounded size, as they become final."""
        at = 0
        for m in self._cut.finditer(text) if self._cut else ():
            if m.start() > at:
                yield from self._plain(text, at, m.start())
            yield np.array([self.special[m[0]]], np.int32)
            at = m.end()
        if at < len(text):
            yield from self._plain(text, at, len(text))

    def decode(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text from token ids; what a chunk leaves of a character waits for the next."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield state.decode(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        yield state.decode(b"", True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BytePairs:
    return BytePairs(path)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """df with ``ids array<int>``."""
    path = path or public_path()

    def make(texts: list[bytes | None]) -> dict:
        t = tokenizer(path)
        join = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts])
        return {"ids": [join(t.encode((x or b"").decode("utf-8", "replace"))) for x in texts]}

    return with_arrow(df, [utf8(df[f"`{text_col}`"])], make, "ids array<int>")


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """df with ``decoded string``."""
    path = path or public_path()

    def make(ids: list[list[int] | None]) -> dict:
        return {"decoded": ["".join(tokenizer(path).decode([np.array(x or [], np.int32)])) for x in ids]}

    return with_arrow(df, [df[f"`{ids_col}`"]], make, "decoded string")


def digests(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 in place of the text; both ways in one stream."""
    path = path or public_path()

    def make(texts: list[bytes | None]) -> dict:
        t = tokenizer(path)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in texts:
            count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

            def passing(chunks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
                nonlocal count
                for ids in chunks:
                    if len(ids):
                        ids_hash.update((("," if count else "") + ",".join(map(t.text_of.__getitem__, ids.tolist()))).encode())  # noqa: B023
                        count += len(ids)
                    yield ids

            for s in t.decode(passing(t.encode((x or b"").decode("utf-8", "replace")))):
                text_hash.update(s.encode("utf-8"))
            for k, v in zip(out, (count, ids_hash.hexdigest(), text_hash.hexdigest()), strict=True):
                out[k].append(v)
        return out

    return with_arrow(df, [utf8(df[f"`{text_col}`"])], make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").drop(text_col)


def op8(documents: DataFrame, path: str | None = None) -> DataFrame:
    return digests(documents.select("doc_id", "text"), path)
