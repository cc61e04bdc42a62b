"""Token counts of a public tokenizer, with a cache over the parts its own pattern splits at."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every function takes another path.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES, LONG = 400_000, 40


def encoder(path: str):
    """The byte-level BPE of a ``.tiktoken`` file; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens. The pattern never joins a word with what stands before its space, so texts are counted word by word.

    A space beside other white space belongs to a longer run, which must not be split there: such texts are encoded whole, so
    the count equals ``len(encode_ordinary(text))`` for every text.
    """

    def __init__(self, path: str) -> None:
        import regex

        self.enc, self.seen, self.parts = encoder(path), {}, {}
        self.split = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> int:
        first, *words = text.split(" ")
        if not words:
            return self._word(text)
        last = words.pop()
        if first[-1:].isspace() or last[:1].isspace() or not last:
            return len(self.enc.encode_ordinary(text))
        n, seen = self._word(first) + self._word(" " + last), self.seen
        try:
            return n + sum(map(seen.__getitem__, words))
        except KeyError:
            pass
        except TypeError:
            return len(self.enc.encode_ordinary(text))
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        for w in words:
            k = seen.get(w)
            if k is None:
                if not w or w[0].isspace() or w[-1].isspace():
                    seen[w] = None
                    return len(self.enc.encode_ordinary(text))
                k = self._word(" " + w)
                if len(w) <= LONG:  # a longer one is hardly ever met again
                    seen[w] = k
            n += k
        return n

    def _word(self, w: str) -> int:
        """A word; one without spaces between its parts (as in Japanese) by its parts."""
        if len(w) <= LONG:
            return len(self.enc.encode_ordinary(w))
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        n = 0
        for p in self.split(w):
            k = self.parts.get(p)
            if k is None:
                k = self.parts[p] = len(self.enc.encode_ordinary(p))
            n += k
        return n


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column; null for null."""
    path = os.path.join(tokenizers, vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = Counter(path)
        for s in batches:
            yield pd.Series([None if t is None else n(t) for t in s], dtype="Int64")

    return count(text)
