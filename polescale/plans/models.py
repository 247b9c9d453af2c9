"""Pretrained models as providers, where their packages are installed; each is loaded once for a Python worker.

Devices come from ``POLESCALE_EMBEDDER_DEVICE`` and ``POLESCALE_NLI_DEVICE``
(of the executors): see :func:`polescale.plans.providers.device`.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from polescale.config import POS_KEPT
from polescale.functions.text import keep_lemmas
from polescale.plans.providers import device, once

log = logging.getLogger(__name__)

# Public names of the models, and the tokens that the embedder's position table holds.
TAGGER, EMBEDDER, ENTAILMENT = "fr_core_news_lg", "dangvantuan/sentence-camembert-large", "cmarkea/distilcamembert-base-nli"
MOST_TOKENS = 512
PACKAGES = {"tagger": "spacy", "embedder": "sentence_transformers", "entailment": "transformers"}
TAGGED = "array<struct<lemma:string,pos:string,is_stop:boolean,is_punct:boolean,is_space:boolean>>"


def installed(kind: str) -> bool:
    return find_spec(PACKAGES[kind]) is not None


def has_cuda() -> bool:
    try:
        import torch

        return bool(torch.cuda.is_available())
    except Exception:  # torch missing or broken: the CPU will do
        return False


def entailment_device(name: str | None, cuda: bool) -> int:
    """Number of a CUDA device, or -1: for a setting that is empty, negative or no number, or without CUDA."""
    wish = (name or "").strip()
    try:
        number = int(wish or -1)
    except ValueError:
        log.warning("%r is no device number; running on the CPU", wish)
        return -1
    if number < 0:
        return -1
    if not cuda:
        log.warning("no CUDA device; running on the CPU instead of %d", number)
        return -1
    return number


def embedder(name: str = EMBEDDER) -> Callable:
    """Provider of sentence embeddings; longer inputs are cut to what the model can hold."""

    def load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, device=device(os.environ.get("POLESCALE_EMBEDDER_DEVICE"), has_cuda()))
        if getattr(model, "max_seq_length", None):
            model.max_seq_length = min(model.max_seq_length, MOST_TOKENS)
        return lambda texts: np.asarray(model.encode(texts), float)

    load.__qualname__ = f"embedder({name})"
    return load


def entailment(name: str = ENTAILMENT) -> Callable:
    """Provider of zero-shot entailment probabilities; answers are read by label, as their order is not the question's."""

    def load():
        from transformers import pipeline

        pipe = pipeline(task="zero-shot-classification", model=name, tokenizer=name, device=entailment_device(os.environ.get("POLESCALE_NLI_DEVICE"), has_cuda()))

        def model(text: str, hypotheses: list[str]) -> dict[str, float]:
            got = pipe(text, candidate_labels=hypotheses, multi_label=True, truncation=True)
            return dict(zip(got["labels"], map(float, got["scores"]), strict=True))

        return model

    load.__qualname__ = f"entailment({name})"
    return load


def tagger(name: str = TAGGER) -> Callable:
    """Provider of tagged tokens: ``tag(texts) -> [[(lemma, pos, is_stop, is_punct, is_space)]]``."""

    def load():
        import spacy

        try:
            nlp = spacy.load(name)
        except OSError as e:
            raise OSError(f"no tagger {name!r}; python -m spacy download {name} installs it") from e
        return lambda texts: [[(t.lemma_, t.pos_, t.is_stop, t.is_punct, t.is_space) for t in doc] for doc in nlp.pipe(texts)]

    load.__qualname__ = f"tagger({name})"
    return load


def lemmas(provider: Callable, pos: tuple[str, ...] = POS_KEPT) -> Callable[[Column], Column]:
    """A ``tokenize`` for lexicons and scores: the content lemmas that a tagger finds."""
    @F.pandas_udf(TAGGED)
    def tagged(texts: pd.Series) -> pd.Series:
        names = ("lemma", "pos", "is_stop", "is_punct", "is_space")
        return pd.Series([[dict(zip(names, t, strict=True)) for t in doc] for doc in once(provider)([x or "" for x in texts])])

    return lambda text: keep_lemmas(tagged(text), pos)
