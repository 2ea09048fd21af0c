"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token are proven
whole. A pre-token that is such a string counts as one token without any merge. Only the rest goes through the merges,
and only their number is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import _SCAN, Cache, Encoder, _Unsettled
from quire.llm.common import small_batches, text_of


def whole_tokens(enc: Encoder) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as that one token."""
    found = []
    for i, data in enumerate(enc.token_bytes):
        try:
            word = data.decode()
        except UnicodeDecodeError:
            continue
        if word and word not in enc.specials and enc.pre_tokens(word) == [word] and enc.merge(data) == i.to_bytes(4, "little"):
            found.append(word)
    return frozenset(found)


class Counter:
    """Counts tokens with one tokenizer, in one Python process."""

    def __init__(self, path: str, cache: int = 400_000):
        self.enc = Encoder(path)
        self.whole = whole_tokens(self.enc)
        self._cache = Cache(self.pre_token, cache)

    def count(self, text: str) -> int:
        enc = self.enc
        if enc._special is not None and any(s in text for s in enc.specials):
            return sum(1 if i % 2 else self._plain(x) for i, x in enumerate(enc._special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        try:
            return sum(map(self._cache.__getitem__, _SCAN.findall(text)))
        except _Unsettled:
            return sum(map(self.pre_token, self.enc.pre_tokens(text)))

    def pre_token(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.enc.merge(piece.encode())) // 4


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text; a null text has none. Special strings count as one token.

    No shuffle; repeated rows and other columns stay, a column already called ``out`` is replaced, and an empty table gives an empty table.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf(T.LongType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(tokenizer)
        for batch in texts:
            yield pa.array([c.count(x or "") for x in batch.to_pylist()], pa.int64())

    return df.withColumn(out, run(text_of(text)))
