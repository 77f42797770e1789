"""Exact token counts at every prefix of a text, by dynamic programming over its pieces.

A byte-level BPE vocabulary never merges across the pieces that its split pattern makes, so the count at a
prefix is the count at the last piece boundary before it plus the count of a piece's own prefix. The counts of all
byte prefixes of every piece follow ``count[k] = count[k - len(t)] + 1`` where t is the last token of the prefix
of k bytes: the longest vocabulary entry that ends there and that the library keeps beside the last token before
it. A text's total, its stored running sum over pieces (``ends`` and ``counts``) and the answers to budgets all
come from these counts; a worker remembers the totals of pieces it has met. New pieces of a batch are counted in
order, and what a piece shares with the one before, at their start, is counted once.

Texts that a plain reading of the pattern does not cover (characters beyond the Latin blocks, where Unicode
versions could differ, or a special token's string inside, which is a piece of its own) are cut by the library's
own pre-tokenizer. White space at the end of a prefix is one piece there, even where the whole text cuts it.

Defined cases: null is the empty text with 0 tokens; extra columns are ignored; repeated rows are counted
each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Distinct pieces that one worker remembers, none of over LONG_PIECE characters; beyond it the memory starts afresh.
REMEMBERED, LONG_PIECE = 400_000, 2000
#: What the pattern takes for white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# texts of these characters are split here; all others by the library
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa1-\u02af]*")
# what the library's \p{L} and \p{N} hold among these characters
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


class PrefixCounter:
    """Token counts of texts and their prefixes for one byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known = _Totals(self)
        self.apart: dict[int, bool] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, vocabulary))
        #: The number of each entry; -1 for what only begins one.
        self.starts = dict.fromkeys((entry[:k] for entry in vocabulary for k in range(1, len(entry))), -1) | vocabulary

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by the library itself."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def learn(self, pieces: set[str]) -> None:
        """Remembers the totals of ``pieces`` that have not been met, but for those of over LONG_PIECE characters."""
        new = {p for p in pieces if p not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        before, count, last = "", [0], [-1]
        for piece in sorted(p for p in new if len(p) <= LONG_PIECE):
            data, same = _spelled(piece), 0
            for x, y in zip(before, data):  # noqa: B905  to the end of the shorter
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self._extend(data, count, last)
            self.known[piece] = 1 if piece in self.specials else count[-1]
            before = data

    def total(self, piece: str) -> int:
        """Tokens of one piece; remembered."""
        if len(piece) > LONG_PIECE:
            return 1 if piece in self.specials else self.inner(piece)[-1]
        self.learn({piece})
        return self.known[piece]

    def split(self, text: str) -> list[str]:
        """The pieces of any text, end to end."""
        if self.is_plain(text):
            return _PIECES.findall(text)
        found = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            found += [part] * (k % 2) or [part[a:b] for _, (a, b) in cut(part)]
        return found

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """(end of each piece in characters, tokens up to it), both starting at 0."""
        pieces = self.split(text)
        return _running(pieces, map(self.known.__getitem__, pieces))

    def rows(self, texts: list[str], limit: int, running: bool) -> Iterator[tuple[int, int, tuple[list[int], list[int]] | None]]:
        """(tokens, characters of the longest prefix within ``limit``, prefixes if ``running``) of each text."""
        split = [self.split(text) for text in texts]
        self.learn(set().union(*split))
        for text, pieces in zip(texts, split, strict=True):
            totals = list(map(self.known.__getitem__, pieces))
            total = sum(totals)
            known = _running(pieces, totals) if running or total > limit else None
            yield total, len(text) if total <= limit else self.fit(text, limit, known), known

    def inner(self, piece: str, budget: int | None = None) -> list[int]:
        """Tokens of every prefix of one piece, by its number of bytes from 0 on.

        With ``budget`` the list ends where no longer prefix can have so few tokens.
        """
        count = [0]
        self._extend(_spelled(piece), count, [-1], budget)
        return count

    def _extend(self, data: str, count: list[int], last: list[int], budget: int | None = None) -> None:
        """Carries the recursion on to the end of ``data``: tokens of each prefix, and the last of them by its number."""
        number, apart, low, over = self.starts.get, self.apart, 0, 0
        for k in range(len(count), len(data) + 1):
            for a in range(low, k):
                token = number(data[a:k])
                if token is None:
                    # nothing begins so, and so nothing longer from here
                    if a == low:
                        low = a + 1
                elif token >= 0:
                    if a:
                        pair = last[a] << 32 | token
                        stay = apart.get(pair)
                        if not (self._stay_apart(pair) if stay is None else stay):
                            continue
                    count.append(count[a] + 1)
                    last.append(token)
                    break
            if budget is not None:
                # a prefix has one token more than one of the ``longest`` before it
                over = over + 1 if count[-1] > budget else 0
                if over >= self.longest:
                    break

    def _stay_apart(self, pair: int) -> bool:
        """Whether the library keeps two tokens, given by their numbers, side by side; remembered."""
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        numbers = [pair >> 32, pair & 0xFFFFFFFF]
        got = self.apart[pair] = [t.id for t in self.model.tokenize("".join(map(self.model.id_to_token, numbers)))] == numbers
        return got

    def _inside(self, block: str, budget: int) -> int:
        """Characters of the longest prefix of one piece with at most ``budget`` tokens."""
        if budget <= 0:
            return 0
        counts = self.inner(block, budget)
        ends = enumerate(accumulate((len(c.encode()) for c in block), initial=0))
        return max(k for k, at in ends if at < len(counts) and counts[at] <= budget)

    def fit(self, text: str, budget: int, known: tuple[list[int], list[int]] | None = None) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens, up to the end of the piece where the budget falls."""
        ends, counts = known or self.prefixes(text)
        at = bisect_right(counts, budget) - 1
        if at < 0 or at == len(ends) - 1:
            return ends[max(at, 0)]
        piece = text[ends[at] : ends[at + 1]]
        blank = len(piece) - len(piece.lstrip(SPACE))
        inside = self._inside(piece, budget - counts[at]) if blank < len(piece) else 0
        if inside > blank:
            return ends[at] + inside
        first = at  # white space that ends the prefix is one piece
        while first and not text[ends[first - 1] : ends[first]].strip(SPACE):
            first -= 1
        return ends[first] + self._inside(text[ends[first] : ends[at] + blank], budget - counts[first])

    def truncate(self, text: str, budget: int) -> str:
        """The longest run of whole pieces from the start with at most ``budget`` tokens; if none fits, what fits of the first."""
        ends, counts = known = self.prefixes(text)
        at = bisect_right(counts, budget) - 1
        while 0 < at < len(ends) - 1 and text[ends[at] - 1] in SPACE and self.whole([text[: ends[at]]])[0] > budget:
            at -= 1
        return text[: ends[at]] if at > 0 else text[: self.fit(text, budget, known)]


class _Totals(dict[str, int]):
    """Tokens of the pieces met so far; others are counted when asked for."""

    def __init__(self, own: PrefixCounter):
        self.own = own

    def __missing__(self, piece: str) -> int:
        return self.own.total(piece)


def _running(pieces: list[str], totals: Iterable[int]) -> tuple[list[int], list[int]]:
    return list(accumulate(map(len, pieces), initial=0)), list(accumulate(totals, initial=0))


def _spelled(piece: str) -> str:
    """A piece as vocabularies write it, one character a byte."""
    return piece.encode().decode("latin-1").translate(_byte_alphabet())


@cache
def _byte_alphabet() -> list[str]:
    """The printable characters that byte-level vocabularies write bytes with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, store: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit).

    ``store`` adds the arrays ``ends`` and ``counts`` of every text.
    """
    fields = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", ends array<int>, counts array<int>" * store

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                total, fit, known = zip(*own.rows(texts, limit, store), strict=True)
                arrays = [part.column(0), part.column(2), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fit, pa.int64())]
                if store:
                    arrays += [pa.array([k[side] for k in known], pa.list_(pa.int32())) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in fields.split(", ")])

    text = F.col("text").cast("string")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return picked.mapInArrow(count, fields)
