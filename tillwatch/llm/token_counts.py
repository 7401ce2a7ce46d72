"""Token counts by whole-token shortcut.

Before any text is read, the vocabulary is proved: a vocabulary string counts as
whole when the merges alone turn its bytes into that one token. A text is split
into pre-tokens; those that are whole count one each, and only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies split a text; white space is the Unicode property.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Merged pre-tokens remembered per worker; the memory is emptied when full.
REMEMBERED = 200_000


class TokenCounter:
    """Number of tokens of a text for a byte-level ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        kind = tokenizer.pre_tokenizer
        if not isinstance(kind, pre_tokenizers.ByteLevel) or kind.add_prefix_space or tokenizer.normalizer:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self._merge = tokenizer.model.tokenize
        self._as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._split = regex.compile(PRE_TOKENS).findall
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        longest_first = sorted(special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, longest_first))) if special else None
        self._whole = frozenset(self._proved(tokenizer))
        self._merged: dict[str, int] = {}

    def _proved(self, tokenizer) -> Iterator[str]:
        for token in tokenizer.get_vocab(with_added_tokens=False):
            text = tokenizer.decoder.decode([token])
            if "".join(x for x, _ in self._as_bytes(text)) == token and len(self._merge(token)) == 1:
                yield text

    def _rest(self, piece: str) -> int:
        n = self._merged.get(piece)
        if n is None:
            if len(self._merged) >= REMEMBERED:
                self._merged.clear()
            n = self._merged[piece] = sum(len(self._merge(x)) for x, _ in self._as_bytes(piece))
        return n

    def _plain(self, text: str) -> int:
        pieces = self._split(text)
        whole, rest = self._whole, self._rest
        return len(pieces) + sum([rest(p) - 1 for p in pieces if p not in whole])

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self._special is None:
            return self._plain(text)
        found = len(self._special.findall(text))
        if not found:
            return self._plain(text)
        return found + sum(self._plain(part) for part in self._special.split(text) if part)


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of ``text`` (null and empty: 0) for the vocabulary file ``path``.

    No begin, end or padding tokens; a special string inside a text is its one token.
    ``path`` must exist on the executors. Rows are independent: repeated, tied or very
    long texts need nothing from each other, and other columns are not touched.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count_of = counter(path)
        for texts in batches:
            yield pd.Series([count_of(t) for t in texts], dtype="int64")

    return count(text)
