"""Chunks of interface definitions for retrieval, and their ingestion."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.operators.retrieval import chunk_hash, headings, word_windows
from selvage.sources.parsers import DEPTH, WSDL, XS, load


def _inlined(node: object, schemas: dict) -> object:
    """The node with each reference next to what it refers to, one level deep."""
    if isinstance(node, dict):
        if isinstance(node.get("$ref"), str):
            return {"$ref": node["$ref"], "$inlined": schemas.get(node["$ref"].rsplit("/", 1)[-1])}
        return {k: _inlined(v, schemas) for k, v in node.items()}
    return [_inlined(v, schemas) for v in node] if isinstance(node, list) else node


def _openapi(content: bytes) -> list[tuple[str, str]]:
    schemas = ((load(content) or {}).get("components") or {}).get("schemas") or {}
    return [(name, json.dumps({name: _inlined(node, schemas)}, sort_keys=True, ensure_ascii=False)) for name, node in schemas.items()]


def _avro(content: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []

    def walk(node: object, depth: int = 0) -> None:
        if depth > DEPTH:
            return
        if isinstance(node, dict):
            if node.get("type") in ("record", "enum", "fixed") and "name" in node:
                out.append((node["name"], json.dumps(node, sort_keys=True, ensure_ascii=False)))
            for v in node.values():
                walk(v, depth + 1)
        elif isinstance(node, list):
            for v in node:
                walk(v, depth + 1)

    walk(load(content))
    return out


def _xml(content: bytes) -> list[tuple[str, str]]:
    root = ET.fromstring(content)
    types = {t.get("name"): t for t in root.iter(f"{XS}complexType") if t.get("name")}

    def whole(t: ET.Element, seen: tuple[str, ...] = ()) -> str:
        base = next((e.get("base", "").rsplit(":", 1)[-1] for e in t.iter(f"{XS}extension")), None)
        own = ET.tostring(t, encoding="unicode")
        return whole(types[base], (*seen, base)) + own if base in types and base not in seen else own

    out = [(name, whole(t)) for name, t in types.items()]
    out += [(e.get("name"), ET.tostring(e, encoding="unicode")) for e in root.iter(f"{XS}element") if e.get("name") and e.find(f"{XS}complexType") is not None]
    return out + [(o.get("name"), ET.tostring(o, encoding="unicode")) for p in root.iter(f"{WSDL}portType") for o in p.findall(f"{WSDL}operation")]


_BY_TYPE = {"application/json": _openapi, "application/yaml": _openapi, "application/xml": _xml, "application/avro+json": _avro, "application/vnd.apache.avro+json": _avro}


def chunk_contracts(artefacts: DataFrame) -> DataFrame:
    """artefactId, name, text of each component of artefacts(artefactId, mediaType, content); unreadable and other documents give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, kind, content in zip(frame["artefactId"], frame["mediaType"], frame["content"]):
                try:
                    out += [(i, n, t) for n, t in _BY_TYPE.get(kind, lambda c: [])(bytes(content))]
                except (ValueError, AttributeError, ET.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["artefactId", "name", "text"])

    return artefacts.select("artefactId", "mediaType", "content").mapInPandas(run, "artefactId string, name string, text string")


def chunk_pages(pages: DataFrame, size: int = 900, overlap: float = 0.15) -> DataFrame:
    """artefactId, name, text of pages(artefactId, html): windows of words below each heading."""
    each = pages.select("artefactId", F.explode(headings(F.col("html"))).alias("h"))
    return each.select("artefactId", F.col("h.heading").alias("name"), F.explode(word_windows(F.col("h.body"), size, overlap)).alias("text"))


def ingest(chunks: DataFrame, stored: DataFrame | None, run_id: str) -> DataFrame:
    """New chunks with their hash: of those of one run and hash one, and none that the run has stored already."""
    hashed = chunks.withColumn("chunk_hash", chunk_hash(F.col("text"))).withColumn("run_id", F.lit(run_id))
    new = hashed.groupBy("run_id", "chunk_hash").agg(F.min(F.struct("artefactId", "name", "text")).alias("c")).select("run_id", "chunk_hash", "c.*")
    return new if stored is None else new.join(stored.select("run_id", "chunk_hash"), ["run_id", "chunk_hash"], "left_anti")
