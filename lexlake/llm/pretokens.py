"""Encoding of whole columns by a byte-pair tokenizer, one encoding for each different word.

Byte-pair merges never cross a pre-token, so a text's ids are those of its pre-tokens in turn.
Pre-tokens are found with numpy from a table of character classes. A table of fixed size remembers
the words seen before with their ids; only the others go to the encoder. Words are found in it by a hash and
then compared character by character, so a false hit can't give false ids. What the table rules can't express
(special tokens in the text, characters that normalisation would change) takes the encoder's own path.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lexlake.llm.scan import U64, blocks, ragged, span_hashes

OTHER, LETTER, NUMBER, SPACE, ODD = 0, 1, 2, 3, 4
#: Unicode's White_Space. Fixed values.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """A class for each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_SPACES] = SPACE
    return out


@lru_cache(1)
def lowering() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point; whether NFC or lower-casing does more to it than that."""
    n = sys.maxunicode + 1
    low, odd = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    odd[0x1100:0x1200] = odd[0xD800:0xE000] = True
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        y = x.lower()
        if len(y) != 1 or unicodedata.category(x)[0] == "M" or not unicodedata.is_normalized("NFC", x) or not unicodedata.is_normalized("NFC", y):
            odd[c] = True
        else:
            low[c] = ord(y)
    return low, odd


def _contractions(cps: np.ndarray, first: np.ndarray, doc_end: np.ndarray, may: np.ndarray, space: np.ndarray) -> None:
    """Join 's 't 'm 'd 're 've 'll to one token where an apostrophe starts one (in place)."""
    at = np.flatnonzero(may & (cps == 0x27))
    at = at[(at + 1 < doc_end[at]) & ~space[np.minimum(at + 1, len(cps) - 1)]]
    if not len(at):
        return
    a, b = cps[np.minimum(at + 1, len(cps) - 1)], cps[np.minimum(at + 2, len(cps) - 1)]
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (at + 2 < doc_end[at])
    first[at[one | two] + 1] = False
    first[at[two] + 2] = False
    for x, k in ((at[one], 2), (at[two], 3)):
        after = x + k
        first[after[after < doc_end[x]]] = True


def byte_pretokens(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the byte-level tokenizer's pre-tokens: a space goes with the word after it."""
    n = len(cps)
    kind = classes()[cps]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    space = kind == SPACE
    follows = np.zeros(n, bool)  # a character after white space of the same text
    follows[1:] = ~space[1:] & space[:-1]
    follows[inner] = False
    at = np.flatnonzero(follows)
    first[at - 1] = True
    first[at] = cps[at - 1] != 0x20
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    _contractions(cps, first, doc_end, first & ~space, kind != LETTER)
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


def word_pretokens(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As above for the lower-casing word tokenizer: white space goes, digits stand alone. cps: lower case."""
    n = len(cps)
    kind = classes()[cps]
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    first[offsets[(offsets > 0) & (offsets < n)]] = True
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    _contractions(cps, first, doc_end, first.copy(), kind != LETTER)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    kept = kind[starts] != SPACE
    return starts[kept], ends[kept]


class _Pool:
    """Runs of 32-bit values that grow at the end: run k is values[at[k] : at[k] + length[k]]."""

    def __init__(self) -> None:
        self.at, self.length, self.values = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new runs with these lengths."""
        n, used = self.n, self.used
        self.n, self.used = n + len(lengths), used + len(flat)
        while len(self.at) < self.n:
            self.at, self.length = np.resize(self.at, 2 * len(self.at)), np.resize(self.length, 2 * len(self.at))
        while len(self.values) < self.used:
            self.values = np.resize(self.values, 2 * len(self.values))
        self.at[n : self.n], self.length[n : self.n] = used + np.cumsum(lengths) - lengths, lengths
        self.values[used : self.used] = flat
        return np.arange(n, self.n)

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these runs one after the other, and their lengths."""
        lengths = self.length[which].astype(np.int64)
        return self.values[ragged(self.at[which], lengths)], lengths


class PretokenEncoder:
    """Ids of texts, from encode_words: words -> ids of each.

    scheme: "byte" or "word". specials: special tokens that stand for themselves in a text, with their ids.
    fallback: ids of one text that the tables don't cover (the word scheme only). largest: the largest id of the vocabulary.
    slots, pool: sizes of the table and of the words and ids that it refers to; it starts anew when they are used up.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[Sequence[int]]], scheme: str, specials: dict[str, int], fallback: Callable[[str], Sequence[int]] | None = None, largest: int = 0xFFFFFFFF, slots: int = 1 << 21, pool: int = 1 << 24):
        self.encode_words, self.scheme, self.specials, self.fallback, self.largest = encode_words, scheme, specials, fallback, largest
        self.slots, self.limit, self.shift = slots, pool, U64(64 - slots.bit_length() + 1)
        self.forget()

    def forget(self) -> None:
        """Begin with an empty table."""
        self.keys, self.entry = np.zeros(self.slots, U64), np.zeros(self.slots, np.int32)
        self.ids, self.words = _Pool(), _Pool()

    def _add(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries for the words at starts and ends."""
        found = self.encode_words([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.words.add(cps[ragged(starts, ends - starts)], ends - starts)
        return self.ids.add(np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths)

    def _same(self, entry: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word is its entry's, character by character."""
        n = ends - starts
        same = self.words.length[entry] == n
        which = np.flatnonzero(same)
        here, there = ragged(starts[which], n[which]), ragged(self.words.at[entry[which]], n[which])
        differ = np.flatnonzero(cps[here] != self.words.values[there])
        same[which[np.searchsorted(np.cumsum(n[which]), differ, "right")]] = False
        return same

    def _block(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the offsets (in code points) of text; where each one's begin (n + 1)."""
        if self.ids.used + self.words.used > self.limit:
            self.forget()
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if self.scheme == "word":
            cps = lowering()[0][cps]
            text = cps.tobytes().decode("utf-32-le")
        if not len(cps):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = (byte_pretokens if self.scheme == "byte" else word_pretokens)(cps, offsets)
        h = span_hashes(cps, starts, ends)
        slot = (h >> self.shift).astype(np.int64)
        entry = np.where(self.keys[slot] == h, self.entry[slot], -1)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            made = self._add(text, cps, starts[one], ends[one])
            entry[new] = made[back]
            place = (keys >> self.shift).astype(np.int64)
            self.keys[place], self.entry[place] = keys, made
        false = np.flatnonzero(~self._same(entry, cps, starts, ends))
        if len(false):
            entry[false] = self._add(text, cps, starts[false], ends[false])
        ids, lengths = self.ids.runs(entry)
        before = np.append(0, np.cumsum(lengths))
        return ids, before[np.searchsorted(starts, offsets)]

    def _text(self, text: str) -> np.ndarray:
        """Ids of one text that holds special tokens or odd characters."""
        if self.fallback is not None:
            return np.asarray(self.fallback(text), np.uint32)
        out, rest = [], text
        while rest:
            hits = [(p, -len(s), s) for s in self.specials if (p := rest.find(s)) >= 0]
            p, _, s = min(hits, default=(len(rest), 0, ""))
            if p:
                out.append(self._block(rest[:p], np.array([0, p]))[0])
            if s:
                out.append(np.array([self.specials[s]], np.uint32))
            rest = rest[p + len(s) :]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_blocks(self, column: pa.Array):
        """(first row, row after the last, ids, offsets of each row's ids) for runs of rows."""
        for i, j, data, at in blocks(column):
            text = data.tobytes().decode("utf-8")
            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
            ids, where = self._block(text, chars)
            odd = set()
            for s in self.specials:
                p = text.find(s)
                while p >= 0:
                    odd.add(int(np.searchsorted(chars, p, "right")) - 1)
                    p = text.find(s, p + 1)
            if self.scheme == "word" and not text.isascii():
                cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                odd.update((np.searchsorted(chars, np.flatnonzero(lowering()[1][cps]), "right") - 1).tolist())
            if odd:
                parts = [self._text(text[chars[k] : chars[k + 1]]) if k in odd else ids[where[k] : where[k + 1]] for k in range(j - i)]
                ids, where = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
            yield i, j, ids, where


@lru_cache(4)
def library_encoder(path: str, scheme: str) -> PretokenEncoder:
    """An encoder whose words are encoded by the tokenizers library from the tokenizer file at path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode_words(found: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    fallback = None if scheme == "byte" else lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return PretokenEncoder(encode_words, scheme, specials, fallback, max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0))
