"""Words of a text counted in its own row, so that no token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polescale.functions import text
from polescale.functions.text import tokens

#: Tokens that a worker counts at once (a longer text is counted alone), and rows that it hands back at once.
TOKENS, ROWS = 1 << 20, 1 << 16


def parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs ``at, end`` of rows of about ``most`` entries together."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def n_tokens(tokenize=tokens):
    """Number of tokens of ``body``."""
    return F.size((text.words if tokenize is tokens else tokenize)(F.col("body"))).cast("long")


def row_words(texts: DataFrame, *keys: str, tokenize=tokens, places: bool = False) -> DataFrame:
    """``keys, word, pos, n`` for each row of ``texts`` (body) and each of its words; rows alike in ``keys`` are not put together.

    With ``places`` also ``at``, the word's places in the row, in order.
    """
    plain = tokenize is tokens  # words alone go to the workers
    rows = texts.select(*keys, (text.words if plain else tokenize)(F.col("body")).alias("_t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*keys, "word", "pos", "n"] + ["at"] * places

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(len(keys))
        length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        own = lists.flatten()
        word, pos = (own, None) if plain else (own.flatten()[own.type.get_field_index(c)] for c in ("word", "pos"))
        word, pos = word.dictionary_encode("encode"), (pa.array(["X"]) if plain else pos).dictionary_encode("encode")
        row, kinds_of = np.repeat(np.arange(len(length)), length), max(1, len(pos.dictionary))
        size = max(1, len(word.dictionary)) * kinds_of
        key = row * size + word.indices.to_numpy().astype(np.int64) * kinds_of + (0 if plain else pos.indices.to_numpy())
        order = np.argsort(key, kind="stable") if places else None
        key = key[order] if places else np.sort(key)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.r_[start, len(key)]), key[start]
        cols = [b.column(i).take(pa.array(key // size)) for i in range(len(keys))]
        cols += [word.dictionary.take(pa.array(key % size // kinds_of)), pos.dictionary.take(pa.array(key % kinds_of)), pa.array(n.astype(np.int64))]
        if places:
            first = np.r_[0, np.cumsum(length)[:-1]]
            at = (np.arange(len(row)) - first[row])[order] if len(row) else np.zeros(0)
            cols.append(pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(at.astype(np.int32))))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in parts(b.column(len(keys)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), TOKENS):
                out = counted(b.slice(at, end - at))
                for i in range(0, out.num_rows, ROWS):
                    yield out.slice(i, ROWS)

    return rows.mapInArrow(run, f"{kinds}, word string, pos string, n long" + ", at array<int>" * places)
