"""Entity and relation mentions from chunks: prompts, injectable model calls, and the parsing of their answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoloom.functions.textfn import preview

ENTITIES = "array<struct<entity_name:string,entity_type:string,entity_description:string>>"
RELATIONS = "array<struct<source_entity:string,target_entity:string,relationship_keywords:string,relationship_description:string>>"
ANSWER = f"struct<entities:{ENTITIES},relationships:{RELATIONS}>"
ONTOLOGY = {
    "COMPANY": ("an enterprise or other organisation", ("Apple", "Siemens")),
    "PERSON": ("somebody with a name or an office", ("the chief executive",)),
    "PRODUCT": ("goods or a service on offer", ("iPhone",)),
    "FINANCIAL_METRIC": ("a figure of accounts or markets", ("revenue", "margin")),
    "BUSINESS_CONCEPT": ("a plan, practice or idea of business", ("supply chain",)),
    "MARKET": ("a market, sector or segment", ("automobiles",)),
    "TECHNOLOGY": ("a technique or technical field", ("machine learning",)),
    "GEOGRAPHIC": ("a place, country or region", ("Germany",)),
}
EXTRACT = "List what the text below says of these kinds of entities: {types}.\nAnswer with JSON: entities (entity_name, entity_type, entity_description) and relationships (source_entity, target_entity, relationship_keywords, relationship_description).\n\nText:\n"
ASK = "Split the question into JSON lists high_level_keywords (themes) and low_level_keywords (names).\n\nQuestion:\n"
ANSWERING = "Answer from the context alone.\n{time}\n\n{context}\n\nQuestion: {question}"
STOP = frozenset("a an and are as at be by did do does for from had has have how in is it its of on or that the their this to was were what when where which who why will with".split())


Ontology = dict[str, tuple[str, tuple[str, ...]]]


def entity_types(ontology: Ontology = ONTOLOGY) -> list[tuple[str, str, list[str]]]:
    """(name, description, examples) of the ontology."""
    return [(k, d, list(e)) for k, (d, e) in ontology.items()]


def read_ontology(path: str) -> Ontology:
    """From JSON: names to descriptions, or to objects with a description (also description_en) and examples; such a table may be under entity_types."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    found = found.get("entity_types", found)
    return {k: (v, ()) if isinstance(v, str) else (v.get("description") or v.get("description_en") or "", tuple(v.get("examples") or ())) for k, v in found.items()}


def fill(template: str, **values: str) -> str:
    """Every placeholder once; braces in the values stay as they are."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m.group(1), m.group(0)), template)


def rule_extractor(system: str, text: str) -> str:
    """Offline model: runs of capitalised words are entities, neighbours in a sentence are related."""
    entities, relations = {}, []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w&]*(?: [A-Z][\w&]*)*", sentence)))
        for n in names:
            entities.setdefault(n, {"entity_name": n, "entity_type": "BUSINESS_CONCEPT", "entity_description": sentence})
        relations += [{"source_entity": a, "target_entity": b, "relationship_keywords": "mentioned with", "relationship_description": sentence} for a, b in zip(names, names[1:])]
    return json.dumps({"entities": list(entities.values()), "relationships": relations})


def rule_keywords(question: str) -> tuple[list[str], list[str]]:
    """Offline keywords: (all but stop words, those with a capital)."""
    words = [w for w in re.findall(r"\w+", question) if w.lower() not in STOP]
    return list(dict.fromkeys(words)), [w for w in dict.fromkeys(words) if w[0].isupper()] or list(dict.fromkeys(words))


def _listed(x: object) -> list[str]:
    return list(dict.fromkeys(w.strip() for w in x if isinstance(w, str) and w.strip())) if isinstance(x, list) else []


def model_keywords(model: Callable[[str, str], str], prompt: str = ASK) -> Callable[[str], tuple[list[str], list[str]]]:
    """Keywords by a model that answers with JSON; empty lists where the call fails or the answer isn't such JSON."""

    def keywords(question: str) -> tuple[list[str], list[str]]:
        try:
            answer = model(prompt, question)
            found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
            return _listed(found.get("high_level_keywords")), _listed(found.get("low_level_keywords"))
        except Exception:  # noqa: BLE001 - a failed call gives no keywords
            return [], []

    return keywords


def asked(chunks: DataFrame, model: Callable[[str, str], str] = rule_extractor, ontology: Ontology = ONTOLOGY, prompt: str = EXTRACT) -> DataFrame:
    """chunks with ``answer``, the model's raw text; null where the call failed."""
    system = fill(prompt, types=", ".join(f"{k} ({d})" if d else k for k, (d, _) in ontology.items()))

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else model(system, t)
            except Exception:  # noqa: BLE001 - a failed call gives no mentions
                return None

        return texts.map(one)

    return chunks.withColumn("answer", call(F.col("content")))


def parsed(answer: Column) -> Column:
    return F.from_json(answer, ANSWER)


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def entity_mentions(answers: DataFrame) -> DataFrame:
    """answers: chunk_id, doc_id, chunk_index, date, doc_ord, answer. Bad JSON gives nothing; missing fields get defaults."""
    x = answers.select("chunk_id", F.col("doc_id").cast("string").alias("source_doc_id"), "date", "doc_ord", "chunk_index", F.posexplode(parsed(F.col("answer"))["entities"]).alias("i", "e"))
    return x.select(_or(F.col("e.entity_name"), "").alias("name"), _or(F.col("e.entity_type"), "Other").alias("type"), _or(F.col("e.entity_description"), "").alias("description"), "source_doc_id", "chunk_id", "date", "doc_ord", _ord().alias("ord"))


def relation_mentions(answers: DataFrame) -> DataFrame:
    x = answers.select("chunk_id", F.col("doc_id").cast("string").alias("source_doc_id"), "date", "doc_ord", "chunk_index", preview(F.col("content"), 200).alias("evidence"), F.posexplode(parsed(F.col("answer"))["relationships"]).alias("i", "r"))
    return x.select(
        _or(F.col("r.source_entity"), "").alias("source"), _or(F.col("r.target_entity"), "").alias("target"), _or(F.col("r.relationship_keywords"), "related").alias("keywords"),
        _or(F.col("r.relationship_description"), "").alias("description"), "evidence", "source_doc_id", "chunk_id", "date", "doc_ord", _ord().alias("ord"),
    )


def _ord() -> Column:
    """Place in the order of mentions: document, chunk, item."""
    return F.col("doc_ord").cast("long") * (1 << 40) + F.col("chunk_index").cast("long") * (1 << 20) + F.col("i").cast("long")


def stats(model: str = "offline", temperature: float = 0.0, ontology: Ontology = ONTOLOGY) -> dict[str, object]:
    return {"model": model, "temperature": temperature, "entity_types": len(ontology)}
