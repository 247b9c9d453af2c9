"""Model providers with stand-in packages, and the full result of scoring."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from polescale import config
from polescale.operators import wordscores
from polescale.plans import models, providers, score

P, G, H, L = config.POLES


class Sentences:
    def __init__(self, name, device):
        self.name, self.device, self.max_seq_length = name, device, 514

    def encode(self, texts):
        return [[len(t), self.max_seq_length] for t in texts]


def pipe(task, model, tokenizer, device):
    def ask(text, candidate_labels, multi_label, truncation):
        assert multi_label and truncation and task == "zero-shot-classification"
        order = sorted(candidate_labels, reverse=True)  # not the order asked in
        return {"labels": order, "scores": [1.0 if x in text else 0.25 for x in order]}

    ask.device = device
    return ask


class Token:
    def __init__(self, w):
        self.lemma_, self.pos_ = w.lower().rstrip("s."), "NOUN" if len(w) > 3 else "DET"
        self.is_stop, self.is_punct, self.is_space = w == "avec", w == ".", False


@pytest.fixture()
def packages(monkeypatch):
    cuda = types.SimpleNamespace(is_available=lambda: False)

    def load(name):
        if name == "absent":
            raise OSError("E050")
        return types.SimpleNamespace(pipe=lambda texts: ([Token(w) for w in t.split()] for t in texts))

    for name, more in {"torch": {"cuda": cuda}, "sentence_transformers": {"SentenceTransformer": Sentences}, "transformers": {"pipeline": pipe}, "spacy": {"load": load}}.items():
        m = types.ModuleType(name)
        m.__dict__.update(more)
        monkeypatch.setitem(sys.modules, name, m)
    return cuda


def test_loading(packages, monkeypatch):
    assert models.embedder()()(["abc", ""]).tolist() == [[3, 512], [0, 512]], "inputs are cut to what the model holds"
    got = models.entailment()()("x and y", ["x", "z"])
    assert got == {"x": 1.0, "z": 0.25}
    assert models.tagger()()(["Les maisons avec . arbres"])[0][1][:2] == ("maison", "NOUN")
    with pytest.raises(OSError, match="spacy download absent"):
        models.tagger("absent")()


def test_devices(packages):
    assert [models.entailment_device(x, True) for x in (None, " ", "-1", "x", "2", "-5")] == [-1, -1, -1, -1, 2, -1]
    assert models.entailment_device("0", False) == -1 and not models.has_cuda()
    packages.is_available = lambda: True
    assert models.has_cuda()


def test_lemmas_reach_the_lexicon(spark):
    def provider():
        return lambda texts: [[(w.lower(), "NOUN" if len(w) > 2 else "DET", w == "avec", False, False) for w in t.split()] for t in texts]

    texts = spark.createDataFrame([("a", "p", "Terre terre la avec"), ("b", "q", None)], "slug string, pole string, body string")
    got = {(r.slug, r.word, r.pos, r.n) for r in wordscores.document_counts(texts, models.lemmas(provider)).collect()}
    assert got == {("a", "terre", "NOUN", 2)}


def test_embedding_in_place(spark):
    calls = []

    def provider():
        return lambda texts: calls.append(len(texts)) or np.array([[len(t)] for t in texts])

    rows = spark.createDataFrame([(1, 0, "aa"), (1, 1, "aa"), (2, 0, "b")], "doc_id long, chunk_id int, text string")
    df = providers.embed(rows, provider)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0, "aa", [2.0]), (1, 1, "aa", [2.0]), (2, 0, "b", [1.0])]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def payload(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    args = {"entailment": providers.overlap_entailment(), "model": "m", "hypotheses_file": "h.yml"} | more
    return {r.doc_id: r.asDict(True) for r in score.score_payload(spark, docs, providers.hashed_embedder(), **args).collect()}


def test_payload(spark):
    got = payload(spark, ["Ce texte défend les milieux vivants. Nous dépendons des sols.", None], gamma=0.5)
    r = got[0]
    assert r["pole_order"] == list(config.POLES) and r["labels"] == config.LABELS and r["dominant_pole"] == max(r["scores"], key=r["scores"].get)
    assert r["blend_gamma"] == 0.5 and r["blend_alpha"] is None and set(r["cosine_scores"]) == set(r["stance_scores"]) == set(config.POLES)
    s = r["stance"]
    assert (s["method"], s["model"], s["hypotheses_file"], s["n_chunks"], s["error"]) == ("nli_zero_shot", "m", "h.yml", 1, None)
    assert s["hypotheses_pro"][P] == list(config.DEFAULT_HYPOTHESES[0].pro) and s["scores"] == r["stance_scores"]
    d = s["details"][P]
    assert s["per_hypothesis"][P]["pro"] == pytest.approx([d["pro_mean"]]) and s["scores"][P] == pytest.approx(d["pro_mean"] - d["contra_mean"])
    raw = {p: max(0.0, r["cosine_scores"][p] + 0.5 * r["stance_scores"][p]) for p in config.POLES}
    assert r["scores"] == pytest.approx({p: x / sum(raw.values()) for p, x in raw.items()})
    empty = got[1]
    assert set(empty["scores"].values()) == {0.0} and empty["cosine_scores"] is None and empty["blend_gamma"] is None
    assert empty["stance"]["error"] == "empty_text" and empty["stance"]["model"] is None and empty["stance"]["details"] is None and empty["stance"]["n_chunks"] == 0


def test_payload_variants(spark):
    alpha = payload(spark, ["Un texte."], gamma=None, alpha=2.0)[0]
    assert alpha["blend_alpha"] == 1.0 and alpha["blend_gamma"] is None and alpha["scores"] == pytest.approx(alpha["cosine_scores"])
    bare = payload(spark, ["Un texte."], use_stance=False)[0]
    assert "stance" not in bare and "cosine_scores" not in bare and sum(bare["scores"].values()) == pytest.approx(1)
    lost = payload(spark, ["Un texte."], entailment=None)[0]
    assert lost["stance"]["error"] == "nli_model_unavailable" and lost["cosine_scores"] is None and lost["stance"]["scores"] == dict.fromkeys(config.POLES, 0.0)


def test_slices_without_sentences(spark):
    from polescale.functions import text as tx

    none = lambda x: F.array().cast("array<string>")  # noqa: E731  a splitter that finds no sentence
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "text string")
    got = [r.c for r in df.select(tx.chunks(F.col("text"), 2, none).alias("c")).collect()]
    assert got == [["a b", "c d", "e"], [], []]
