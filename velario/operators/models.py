"""Model layers of detection: a named-entity tagger, a zero-shot tagger and an analysis service.

Each model is loaded once for each Python worker, only when its setting is on and its package is
there; otherwise its layer finds nothing and the rules stand alone. No model is ever downloaded
unless the settings allow it. ``Settings.from_env`` reads the switches of a deployment.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.functions import lexicon as lex
from velario.functions import names
from velario.functions.identifiers import CIF, EMAIL, IBAN, NIF
from velario.operators.detect import _candidates, distinct_texts, entity_rows, model_layer, substring_counts

#: Begin of a place that is an address; fixed values.
STREETS = ("C/", "Calle", "Avenida", "Plaza", "Paseo")
_TRUE = ("1", "true", "yes", "on")

Extract = Callable[[list[str]], list[list[tuple[str, str, float]]]]
Layer = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What a deployment switches on; names of the variables are those of the fields, with VELARIO_ before."""

    tagger: bool = False
    tagger_model: str = "es_core_news_md"
    zero_shot: bool = False
    zero_shot_model: str = "urchade/gliner_multi-v2.1"
    zero_shot_threshold: float = 0.5
    zero_shot_labels: tuple[str, ...] = tuple(lex.MODEL_LABEL_KINDS)
    allow_download: bool = False
    service: bool = False
    service_model: str = "es_core_news_md"
    service_threshold: float = 0.4
    ocr: bool = False
    ocr_language: str = "spa"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Numbers that can't be read keep their default; an empty list of labels means all."""
        found = {}
        for name, kind in cls.__annotations__.items():
            raw = env.get(f"VELARIO_{name.upper()}", "").strip()
            default = getattr(cls, name)
            if not raw:
                continue
            if kind == "bool":
                found[name] = raw.lower() in _TRUE
            elif kind == "float":
                try:
                    found[name] = float(raw)
                except ValueError:
                    found[name] = default
            elif kind == "str":
                found[name] = raw
            else:
                found[name] = tuple(x.strip() for x in raw.split(",") if x.strip()) or default
        return cls(**found)


@lru_cache(maxsize=2)
def _tagger(model: str):
    try:
        import spacy

        return spacy.load(model)
    except Exception:
        return None


@lru_cache(maxsize=2)
def _zero_shot(model: str, download: bool):
    if not download:
        os.environ.update(HF_HUB_OFFLINE="1", TRANSFORMERS_OFFLINE="1", HF_HUB_DISABLE_TELEMETRY="1")
    try:
        from gliner import GLiNER

        return GLiNER.from_pretrained(model, local_files_only=not download)
    except Exception:
        return None


@lru_cache(maxsize=2)
def _service(model: str):
    try:
        from presidio_analyzer import AnalyzerEngine
        from presidio_analyzer.nlp_engine import NlpEngineProvider

        engine = NlpEngineProvider(nlp_configuration={"nlp_engine_name": "spacy", "models": [{"lang_code": "es", "model_name": model}]}).create_engine()
        return AnalyzerEngine(nlp_engine=engine, supported_languages=["es"])
    except Exception:
        return None


def tagger_extract(settings: Settings) -> Extract:
    def extract(texts: list[str]) -> list[list[tuple[str, str, float]]]:
        model = _tagger(settings.tagger_model)
        if model is None:
            return [[] for _ in texts]
        off = [p for p in model.pipe_names if p not in ("ner", "tok2vec", "transformer")]
        return [[(e.text, e.label_, 1.0) for e in doc.ents] for doc in model.pipe(texts, batch_size=64, disable=off)]

    return extract


def zero_shot_extract(settings: Settings) -> Extract:
    def extract(texts: list[str]) -> list[list[tuple[str, str, float]]]:
        model = _zero_shot(settings.zero_shot_model, settings.allow_download)
        if model is None:
            return [[] for _ in texts]
        found = (model.predict_entities(t, list(settings.zero_shot_labels), threshold=settings.zero_shot_threshold) for t in texts)
        return [[(e["text"], e["label"], float(e.get("score", 0))) for e in entities] for entities in found]

    return extract


def service_extract(settings: Settings) -> Extract:
    def extract(texts: list[str]) -> list[list[tuple[str, str, float]]]:
        engine = _service(settings.service_model)
        if engine is None:
            return [[] for _ in texts]
        return [[(t[r.start : r.end], r.entity_type, float(r.score)) for r in engine.analyze(text=t, language="es", entities=list(lex.SERVICE_LABEL_KINDS))] for t in texts]

    return extract


def bare(text: Column) -> Column:
    """Without blanks and punctuation at its ends."""
    return F.regexp_replace(text, r"^[ .,;:\"'()]+|[ .,;:\"'()]+$", "")


def is_noise(value: Column) -> Column:
    """What no tagger may give: short or numeric texts, identifiers, stop words, artefacts, lone given names."""
    whole = [value.rlike(f"(?U)^(?:{p})$") for p in (CIF, NIF, IBAN, EMAIL)]
    found = (F.length(value) < 2) | names.is_stopword(value) | names.is_artefact(value) | names.is_lone_given_name(value) | names.is_numeric_text(value)
    for w in whole:
        found = found | w
    return found


def tagged_names(extract: Extract) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(fragments, structured candidates) -> (names as (kind, text, count), addresses as candidates).

    Companies lose an accounting prefix, persons stay as they are, places that begin like a street
    are addresses. A name counts once for each time it is tagged in a distinct text.
    """

    def run(fragments: DataFrame, structured: DataFrame) -> tuple[DataFrame, DataFrame]:
        raw = entity_rows(distinct_texts(fragments), extract).select(bare(F.col("text")).alias("text"), "label")
        kept = raw.where(~is_noise(F.col("text"))).join(structured.select("text").distinct(), "text", "left_anti")
        company = kept.where("label = 'ORG'").select(F.lit("ORG").alias("kind"), names.strip_accounting_prefix(F.col("text")).alias("text")).where(~names.is_stopword(F.col("text")))
        person = kept.where("label = 'PER'").select(F.lit("PER").alias("kind"), "text")
        counted = company.unionByName(person).groupBy("kind", "text").agg(F.count(F.lit(1)).alias("count"))
        street = F.lit(False)
        for s in STREETS:
            street = street | F.col("text").startswith(s)
        places = substring_counts(kept.where((F.col("label") == "LOC") & street).select("text").distinct(), fragments, "text")
        return counted, _candidates(places, "ADDRESS", "regex")

    return run


def layers(settings: Settings) -> tuple[Layer, ...]:
    """The layers that the settings switch on, in their order."""
    out: list[Layer] = []
    if settings.zero_shot:
        out.append(model_layer(zero_shot_extract(settings), "zero-shot", lex.MODEL_LABEL_KINDS, settings.zero_shot_threshold, other_kind="ORG", drop_given_names=False))
    if settings.service:
        out.append(model_layer(service_extract(settings), "service", lex.SERVICE_LABEL_KINDS, settings.service_threshold, other_kind="PER", clean=bare))
    return tuple(out)


def ocr_reader(settings: Settings) -> Callable[[list[bytes]], str] | None:
    """Reads page images where OCR is switched on and its program is there; else pages stay unread."""
    if not settings.ocr:
        return None

    def read(images: list[bytes]) -> str:
        try:
            import io

            import pytesseract
            from PIL import Image

            return "\n".join(pytesseract.image_to_string(Image.open(io.BytesIO(i)), lang=settings.ocr_language) for i in images)
        except Exception:
            return ""

    return read
