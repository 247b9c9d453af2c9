"""Replaceable models: embedding and entailment, run over Arrow batches, loaded once for each Python worker.

A provider is a zero-argument callable, shipped to the executors, that
returns the model: ``embed(list of texts) -> array (n, d)`` or
``entail(text, hypotheses) -> {hypothesis: probability}``.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
_loaded: dict = {}


def once(provider: Callable):
    """The provider's model, loaded at the first call in this process."""
    key = (getattr(provider, "__module__", ""), getattr(provider, "__qualname__", repr(provider)))
    if key not in _loaded:
        _loaded[key] = provider()
    return _loaded[key]


def device(name: str | None, cuda: bool = False) -> str:
    """Of a setting: empty, -1 or cpu is the CPU, a number a CUDA device, other names pass; without CUDA the CPU."""
    wish = (name or "").strip()
    if wish in ("", "-1", "cpu"):
        return "cpu"
    wish = f"cuda:{wish}" if wish.isdigit() else wish
    if wish.startswith("cuda") and not cuda:
        log.warning("no CUDA device; running on the CPU instead of %s", wish)
        return "cpu"
    return wish


def embed(chunks: DataFrame, provider: Callable, column: str = "text") -> DataFrame:
    """Adds ``embedding array<double>``, in place: no shuffle. A text that a batch repeats is embedded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(provider)
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).dictionary_encode()
            known = texts.dictionary.to_pylist()
            v = np.asarray(model(known), float).reshape(len(known), -1) if known else np.zeros((0, 0))
            found = pa.array(list(v), pa.list_(pa.float64())).take(texts.indices)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "embedding"])

    kinds = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return chunks.mapInArrow(run, kinds)


def entail(chunks: DataFrame, hypotheses: list[str], provider: Callable) -> DataFrame:
    """``doc_id, chunk_id, hypothesis, p``; a chunk on which the model fails has one row with null p.

    In place: no shuffle. A text that a batch repeats is asked about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(provider)
        for b in batches:
            known: dict[str, list[tuple]] = {}
            row, names, values = [], [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                if text not in known:
                    try:
                        found = model(text, hypotheses)
                        known[text] = [(h, float(found[h])) for h in hypotheses if h in found]
                    except Exception as e:  # one chunk must not end the run; it is left out of the means
                        log.warning("entailment failed on a chunk: %s", e)
                        known[text] = [(hypotheses[0], None)]
                for h, p in known[text]:
                    row.append(r)
                    names.append(h)
                    values.append(p)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "chunk_id", "hypothesis", "p"])

    kind = {f.name: f.dataType for f in chunks.schema.fields}
    kinds = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("chunk_id", kind["chunk_id"]), T.StructField("hypothesis", T.StringType()), T.StructField("p", T.DoubleType())])
    return chunks.where(F.length(F.trim(F.col("text"))) > 0).select("doc_id", "chunk_id", "text").mapInArrow(run, kinds)


def hashed_embedder(dimensions: int = 64) -> Callable:
    """A deterministic stand-in: signed hashes of words, summed and normalised."""

    def load():
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for i, t in enumerate(texts):
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                    out[i, h % dimensions] += 1 if h >> 63 else -1
                out[i] /= np.linalg.norm(out[i]) or 1
            return out

        return model

    load.__qualname__ = f"hashed_embedder({dimensions})"
    return load


def overlap_entailment() -> Callable:
    """A deterministic stand-in: the share of a hypothesis's words that the text has."""

    def load():
        def model(text: str, hypotheses: list[str]) -> dict[str, float]:
            have = set(re.findall(r"\w+", text.lower()))
            words = {h: set(re.findall(r"\w+", h.lower())) for h in hypotheses}
            return {h: len(w & have) / max(1, len(w)) for h, w in words.items()}

        return model

    load.__qualname__ = "overlap_entailment"
    return load
