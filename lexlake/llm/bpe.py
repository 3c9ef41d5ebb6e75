"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has exactly one encoding, hence one last token. A token that ends at a
position is that last token if it is compatible with the last token of what comes before it: merging
the two by the tokenizer's rules must leave the seam between them alone. An automaton over the vocabulary
reports, for every position, all tokens that are suffixes of the prefix there; the first compatible one is kept.
Following the last tokens back from the end gives the tokenizer's exact ids in time linear in the matches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.pretokens import PretokenEncoder

#: Pairs whose test is remembered; then the memory starts anew.
PAIRS = 1 << 20
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class PrefixBpe:
    """A byte-level BPE vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.to_chars = alphabet
        back = {c: b for b, c in enumerate(alphabet)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [f"{i}," for i in range(size)]

        self.rank: dict[tuple[int, int], int] = {}
        made_by: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocab[a], vocab[b]
            self.rank.setdefault((x, y), r)
            made_by.setdefault(vocab[a + b], (r, x, y))
        # Down each edge of a token's merge tree: (part at the edge, rank of the merge that takes it up).
        self.right_edge, self.left_edge = [()] * size, [()] * size
        self.automaton = ahocorasick.Automaton()
        self.length = [0] * size
        for token, i in vocab.items():
            if len(token) > 1 and i not in made_by or token in self.specials:
                continue
            for edge, side in ((self.right_edge, 2), (self.left_edge, 1)):
                steps, part, taken = [], i, _NEVER
                while True:
                    steps.append((part, taken))
                    if part not in made_by:
                        break
                    taken, part = made_by[part][0], made_by[part][side]
                edge[i] = tuple(steps)
            self.length[i] = len(token)
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text followed by b's text is a, b.

        The seam breaks if some part at a's right edge and some part at b's left edge merge while both are
        still there: before either is taken up by its own side. Of equal merges the left one comes first.
        """
        rank = self.rank
        for x, x_taken in self.right_edge[a]:
            for y, y_taken in self.left_edge[b]:
                r = rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        chars = self.to_chars
        word = "".join([chars[b] for b in word.encode()])
        last, length, known = [0] * (len(word) + 1), self.length, self.known
        found = -1
        for end, token in self.automaton.iter(word):
            if end == found:
                continue
            q = end + 1 - length[token]
            if q:
                pair = last[q] << 32 | token
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.compatible(last[q], token)
                if not ok:
                    continue
            last[end + 1] = token
            found = end
        if len(known) > PAIRS:
            known.clear()
        out, p = [], len(word)
        while p:
            out.append(last[p])
            p -= length[last[p]]
        return out[::-1]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.encode_word(w) for w in words]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def prefix_encoder(path: str) -> tuple[PrefixBpe, PretokenEncoder]:
    bpe = PrefixBpe(path)
    return bpe, PretokenEncoder(bpe.encode_words, "byte", bpe.specials)


def bpe_round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids: key, n_tokens, ids_sha256, decoded_sha256 (and ids).

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. A null
    text counts as empty: no ids, and the hashes of nothing. Rows stay as they are, repeated or not; columns
    other than key and text are not read. Special tokens in a text become their ids. No shuffle.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    fields = [rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = prefix_encoder(tokenizer)
        for batch in batches:
            for i, j, ids, at in encoder.encode_blocks(batch.column(1)):
                flat, at = ids.tolist(), at.tolist()
                shas, texts = [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = flat[a:b]
                    shas.append(hashlib.sha256("".join(map(bpe.decimal.__getitem__, own))[:-1].encode()).hexdigest())
                    texts.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(shas), pa.array(texts)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(encode, T.StructType(fields))
