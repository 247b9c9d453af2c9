"""Poles, axes, label folding and stance hypotheses, with loaders for YAML files of the same shape.

Order is data: ties between poles go to the first one.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Label variants and their poles.
FOLD = {
    "local+": "local",
    "local-": "local",
    "local": "local",
    "global+": "global",
    "global-": "global",
    "global": "global",
    "horssol": "hors_sol",
    "hors-sol": "hors_sol",
    "hors_sol": "hors_sol",
    "terrestre": "terrestre",
}

# Display labels in pole order.
LABELS = {"terrestre": "Terrestre", "global": "Global", "hors_sol": "Hors-Sol", "local": "Local"}
POLES = tuple(LABELS)

# Axes as (minus pole at -1, plus pole at +1).
AXES = {"hors-sol-terrestre": ("hors_sol", "terrestre"), "local-global": ("local", "global")}

# Roles of the audit block.
SEED, INVERSION_HOLD, TEST, SANITY = "SEED", "INVERSION-HOLD", "TEST", "SANITY"

# Constants of the method.
CHUNK_WORDS = 256
WINDOW_SENTENCES = 3
MIN_PARAGRAPHS = 3
LONG_TEXT = 1500
TAU, TAU_SCORE, TAU_FLOOR = 0.05, 0.03, 1e-6
GAMMA = 1.0
LOWE_ALPHA = 0.5
CI_PERCENTILES = (2.5, 97.5)
WORD_CI_DOCS, WORD_CI_SEED, WORD_CI_DRAWS = 3, 12345, 500
TEXT_CI_SEED, TEXT_CI_DRAWS = 42, 1000
MIN_DOCS_PER_POLE = 5
DIGITS = 6
POS_KEPT = ("NOUN", "VERB", "ADJ", "PROPN")


@dataclass(frozen=True)
class Pole:
    key: str
    label: str
    seeds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Hypotheses:
    key: str
    label: str
    pro: tuple[str, ...] = ()
    contra: tuple[str, ...] = ()


#: Short seed sentences of our own; a deployment passes its YAML file.
DEFAULT_POLES = (
    Pole("terrestre", "Terrestre", ("Nous dépendons des sols et des vivants qui nous entourent.", "Habiter, c'est prendre soin du milieu dont on vit.")),
    Pole("global", "Global", ("L'ouverture des marchés apporte la prospérité à tous.", "Le progrès ne connaît pas de frontières.")),
    Pole("hors_sol", "Hors-Sol", ("La technique nous libérera des limites de la planète.", "Rien ne nous oblige à rester attachés à la Terre.")),
    Pole("local", "Local", ("Protégeons notre pays, nos frontières et nos traditions.", "Chez nous, nous décidons entre nous.")),
)
DEFAULT_HYPOTHESES = (
    Hypotheses("terrestre", "Terrestre", ("Ce texte défend les milieux vivants.",), ("Ce texte nie la dépendance aux milieux vivants.",)),
    Hypotheses("global", "Global", ("Ce texte défend la mondialisation.",), ("Ce texte critique la mondialisation.",)),
    Hypotheses("hors_sol", "Hors-Sol", ("Ce texte croit à une sortie hors de la Terre.",), ("Ce texte refuse la fuite technologique.",)),
    Hypotheses("local", "Local", ("Ce texte défend la nation fermée.",), ("Ce texte critique le repli national.",)),
)


def _yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_poles(path: str | Path, block: str = "poles") -> tuple[Pole, ...]:
    """``poles:`` (or ``themes:``) of a YAML file: key -> label (the key itself if absent) and seeds."""
    return tuple(Pole(k, (v or {}).get("label", k), tuple((v or {}).get("seeds") or ())) for k, v in (_yaml(path).get(block) or {}).items())


def load_hypotheses(path: str | Path) -> tuple[Hypotheses, ...]:
    found = (_yaml(path).get("poles") or _yaml(path)).items()
    return tuple(Hypotheses(k, v.get("label", k), tuple(v.get("hypotheses_pro") or ()), tuple(v.get("hypotheses_contra") or ())) for k, v in found if isinstance(v, dict))


def poles_frame(spark: SparkSession, poles: tuple[Pole, ...] = DEFAULT_POLES) -> DataFrame:
    rows = [(i, p.key, p.label, list(p.seeds) or [p.label]) for i, p in enumerate(poles)]
    return spark.createDataFrame(rows, "pole_ord int, pole string, label string, seeds array<string>")


def hypotheses_frame(spark: SparkSession, hypotheses: tuple[Hypotheses, ...] = DEFAULT_HYPOTHESES) -> DataFrame:
    rows = [(i, h.key, side, k, t) for i, h in enumerate(hypotheses) for side, texts in (("pro", h.pro), ("contra", h.contra)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pole_ord int, pole string, polarity string, idx int, hypothesis string")


def axis_poles(axis: str) -> tuple[str, str]:
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis!r}; known: {', '.join(AXES)}")
    return AXES[axis]
