"""Exact token counts at every prefix, by dynamic programming over byte-pair merges.

A text is cut into pieces by the tokenizer's pattern; merges never cross a
piece. Inside a piece, let last[i] be the last token of the encoding of its
first i bytes. It is the one token t that ends at i for which last[i -
len(t)] and t are *compatible*: encoding their bytes together gives the two
tokens again. So count[i] = count[i - len(t)] + 1, a count for every prefix
in one pass, and a truncation or a budget question needs no new encoding.

Two tokens are compatible if no merge across their border happens before the
pieces beside it are merged away within their own tokens.

A text cut short may be cut into other pieces at its end: a run of white space
is one piece where nothing follows it, half of a contraction is two, and half
of a special string is ordinary text. The counts of those prefixes are put
right, so each is what the library gives for the text cut there.

``prefix_table`` stores the counts of all prefixes of a text as ``steps``, a
signed byte for each byte of text: by how much the count changes with the
character that ends there (``INSIDE``, where none ends; four bytes each for a
text with a step of 127 or more). ``count_tokens`` stores that table and reads
totals from it; ``budgets`` and ``truncations`` answer from it alone.

Supported: ``tokenizers`` files of byte-level BPE with the library's usual
pattern, and added tokens that are plain strings. Special strings in a text
count as the one token the library makes of them.

Defined results: null text is empty and has 0 bytes and 0 tokens. Rows are
judged one by one, so repeated rows, or rows with null ids, are repeated; a
text of exactly the limit is not over it; an empty table gives an empty
result; extra columns, with whatever names, are not read. Texts of any length
are taken whole; pieces above ``CACHED`` bytes are counted without being
remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polescale.llm.common import Workspace

LIMIT = 1024
CACHED, MOST_CACHED = 256, 1 << 20
NEVER = 1 << 60
#: Step at a byte that ends no character.
INSIDE = -128


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of texts and of their prefixes for one vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or word borders are not supported")
        self.piece = regex.compile(public_tokenizers.PATTERN)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), r in self.rank.items():
            self.parts.setdefault(a + b, (a, b, r))
        self.tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.longest = max(map(len, self.tokens))
        self.fits = lru_cache(1 << 20)(self._fits)
        self.whole = cache(self._whole)
        self.left = cache(lambda t: self._spine(t, 0))
        self.right = cache(lambda t: self._spine(t, 1))
        self.tokens = {t for t in self.tokens if self.whole(t)}
        self.space = regex.compile(r"\s+")
        self.before_word = regex.compile(r"\s{2,}(?=\S)")
        self.steps_of = _Steps(self)
        self.regained = lru_cache(1 << 16)(self._regained)

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces that lie at one border of the token while it is built, each with the rank at which it is merged away."""
        out, until = [(token, NEVER)], NEVER
        while token in self.parts:
            *both, until = self.parts[token]
            token = both[side]
            out.append((token, until))
        return out

    def _fits(self, a: bytes, b: bytes) -> bool:
        rank, left = self.rank, self.left(b)
        for x, gone_x in self.right(a):
            for y, gone_y in left:
                # of equal merges the left one goes first
                if (x, y) in rank and (r := rank[x, y]) < gone_x and r <= gone_y:
                    return False
        return True

    def _whole(self, token: bytes) -> bool:
        """Whether encoding the token's bytes gives the token."""
        if len(token) == 1:
            return True
        a, b, r = self.parts[token]
        if not (self.whole(a) and self.whole(b)):
            return False
        for x, gone_x in self.right(a):
            for y, gone_y in self.left(b):
                q = self.rank.get((x, y), NEVER)
                if q < gone_x and q <= gone_y and q < r:
                    return False
        return True

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of the first 0, 1, ... len(piece) bytes of one piece."""
        last: list[bytes | None] = [None]
        out = [0]
        tokens, fits, longest = self.tokens, self.fits, self.longest
        start = 0  # of the last token so far: often the next one is that with a byte more
        for i in range(1, len(piece) + 1):
            t = piece[start:i]
            if t not in tokens or start and not fits(last[start], t):
                for start in range(i - longest if i > longest else 0, i):
                    t = piece[start:i]
                    if t in tokens and (start == 0 or fits(last[start], t)):
                        break
                else:
                    raise ValueError(f"no encoding ends at byte {i} of {piece[:80]!r}")
            last.append(t)
            out.append(out[start] + 1)
        return out

    def runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special strings."""
        if self.special is None or not self.special.search(text):
            yield text, False
        else:
            for k, part in enumerate(self.special.split(text)):
                if part:
                    yield part, bool(k % 2)

    def prefixes(self, piece: str) -> np.ndarray:
        """Steps of the prefixes of one piece (int32)."""
        raw = piece.encode()
        count = self._corrected(piece, self.counts(raw))
        ends = np.append(np.frombuffer(raw, np.uint8)[1:] & 0xC0 != 0x80, True)
        out = np.full(len(raw), INSIDE, np.int32)
        out[ends] = np.diff(np.array(count, np.int64)[1:][ends], prepend=0)
        return out

    def _corrected(self, piece: str, count: list[int]) -> list[int]:
        if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # half a contraction is an apostrophe and letters
            for k in range(2, len(piece)):
                count[len(piece[:k].encode())] = sum(self.steps_of.total(p) for p in self.piece.findall(piece[:k]))
        return count

    def short(self, piece: str, raw: bytes) -> bytes:
        """Steps of a piece of fewer than 128 bytes, where none needs more than a byte."""
        count = self._corrected(piece, self.counts(raw))
        if len(raw) == len(piece):
            return bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])
        out, last = bytearray(), 0
        for i, c in enumerate(count[1:], 1):
            if i < len(raw) and raw[i] & 0xC0 == 0x80:
                out.append(INSIDE & 255)
            else:
                out.append((c - last) & 255)
                last = c
        return bytes(out)

    def _regained(self, run: str) -> int:
        """Tokens that a run of white space takes at the end of a text, less those before a word up to the same place."""
        last = self.steps_of.steps(run[-1])
        return self.steps_of.total(run) - self.steps_of.total(run[:-1]) - int(last[last != INSIDE].sum())

    def _ordinary(self, run: str) -> np.ndarray:
        """Steps of a stretch without special strings."""
        parts = list(map(self.steps_of.__getitem__, self.piece.findall(run)))
        if None in parts:
            out = np.concatenate([self.prefixes(p) for p in self.piece.findall(run)])
        else:
            out = np.frombuffer(b"".join(parts), np.int8)
        last = at = 0
        fixed = None
        for m in self.before_word.finditer(run):
            if more := self.regained(m[0]):
                fixed = out.astype(np.int32) if fixed is None else fixed
                at += len(run[last : m.end()].encode())
                last = m.end()
                fixed[at - 1] += more
                fixed[at - 1 + len(run[last].encode())] -= more
        return out if fixed is None else fixed

    def steps(self, text: str) -> np.ndarray:
        """Steps of all prefixes of a text."""
        out, done = [], ""
        for run, special in self.runs(text):
            if not special:
                done = run
                out.append(self._ordinary(run))
                continue
            # cut within, it is ordinary text behind the last two pieces of what stands before
            tail = "".join(self.piece.findall(done)[-2:])
            base = self._total(tail)
            inner = np.full(len(run.encode()), INSIDE, np.int32)
            before = 0
            for k in range(1, len(run) + 1):
                now = 1 if k == len(run) else self._total(tail + run[:k]) - base
                inner[len(run[:k].encode()) - 1] = now - before
                before = now
            out.append(inner)
            done = ""
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int8), *out])

    def _total(self, run: str) -> int:
        return sum(map(self.steps_of.total, self.piece.findall(run)))


def packed(steps: np.ndarray) -> bytes:
    """A byte a step, or four where one of them needs more."""
    if steps.dtype == np.int8:
        return steps.tobytes()
    if not len(steps) or np.abs(steps).max() < 128 or (steps[steps != INSIDE].size and np.abs(steps[steps != INSIDE]).max() < 127):
        return steps.astype(np.int8).tobytes()
    return np.where(steps == INSIDE, np.iinfo(np.int32).min, steps).astype(np.int32).tobytes()


def counts_of(steps: bytes, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a text's characters in bytes, and the tokens of the text up to each; both begin with 0."""
    x = np.frombuffer(steps, np.int8 if len(steps) == n_bytes else np.int32)
    ends = np.flatnonzero(x != np.iinfo(x.dtype).min)
    return np.append(0, ends + 1), np.append(0, np.cumsum(x[ends], dtype=np.int64))


class _Steps(dict):
    """Piece -> steps of its prefixes as bytes, None where they need more; forgets everything when it grows too large."""

    def __init__(self, owner: PrefixCounter):
        super().__init__()
        self.owner = owner
        self.totals: dict[str, int] = {}

    def __missing__(self, piece: str) -> bytes | None:
        raw = piece.encode()
        if len(raw) < 128:
            own = self.owner.short(piece, raw)
        else:
            steps = self.owner.prefixes(piece)
            own = packed(steps)
            own = own if len(own) == len(steps) else None
        if len(raw) <= CACHED:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[piece] = own
        return own

    def steps(self, piece: str) -> np.ndarray:
        own = self[piece]
        return self.owner.prefixes(piece) if own is None else np.frombuffer(own, np.int8)

    def total(self, piece: str) -> int:
        if (n := self.totals.get(piece)) is None:
            n = self.owner.counts(piece.encode())[-1] if piece else 0
            if len(piece) <= CACHED:
                if len(self.totals) >= MOST_CACHED:
                    self.totals.clear()
                self.totals[piece] = n
        return n


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, steps`` for each row of ``docs``: the exact tokens of every prefix of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [x.as_py() or "" for x in b.column(1).slice(at, 256)]
                found = [packed(c.steps(x)) for x in texts]
                size = [len(x.encode()) for x in texts]
                n = [int(counts_of(x, k)[1][-1]) for x, k in zip(found, size, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "steps"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, steps binary")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, from its stored prefix table."""
    table = Workspace(docs.sparkSession, "tokens").save(prefix_table(docs, path), "prefixes")
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def budgets(table: DataFrame, budget: int) -> DataFrame:
    """``doc_id, fit_bytes, fit_tokens``: the longest prefix (of whole characters) of at most ``budget`` tokens, from a prefix table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, steps in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ends, counts = counts_of(steps.as_buffer() if n else b"", n)
                k = int(np.flatnonzero(counts <= max(0, budget))[-1])
                out.append((int(ends[k]), int(counts[k])))
            size, tokens = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "fit_bytes", "fit_tokens"])

    return table.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, fit_bytes long, fit_tokens long")


def truncations(table: DataFrame, n_bytes: int) -> DataFrame:
    """``doc_id, cut_bytes, cut_tokens``: the whole characters in a text's first ``n_bytes`` bytes and their tokens, from a prefix table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, steps in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ends, counts = counts_of(steps.as_buffer() if n else b"", n)
                k = int(np.searchsorted(ends, max(0, n_bytes), "right")) - 1
                out.append((int(ends[k]), int(counts[k])))
            size, tokens = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "cut_bytes", "cut_tokens"])

    return table.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, cut_bytes long, cut_tokens long")
