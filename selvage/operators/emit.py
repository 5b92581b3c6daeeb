"""Emission: schemas, logical model, release manifests, release differences."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON Schema of each data type.
SCHEMA_TYPES = {
    "string": {"type": "string"}, "integer": {"type": "integer"}, "decimal": {"type": "number"}, "boolean": {"type": "boolean"},
    "date": {"type": "string", "format": "date"}, "dateTime": {"type": "string", "format": "date-time"}, "time": {"type": "string", "format": "time"},
    "duration": {"type": "string", "format": "duration"}, "binary": {"type": "string", "contentEncoding": "base64"}, "object": {"type": "object"},
    "array": {"type": "array"}, "reference": {"type": "string"}, "unknown": {},
}


def serialise(document: object) -> bytes:
    """Sorted keys, two spaces, UTF-8, one line feed at the end: the same document is the same bytes."""
    return (json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def schema_of(data_type: Column) -> Column:
    """JSON Schema of a data type, as JSON."""
    out = None
    for name, schema in SCHEMA_TYPES.items():
        text = F.lit(json.dumps(schema, sort_keys=True))
        out = F.when(data_type == name, text) if out is None else out.when(data_type == name, text)
    return out.otherwise("{}")


def entity_schemas(candidates: DataFrame) -> DataFrame:
    """entity, scope (core or extension:region), document: a JSON Schema for each. One aggregation; an entity has as many
    attributes as its schema lists."""
    required = F.col("obligation.level") == "mandatory"
    row = F.struct("attribute", schema_of(F.col("dataType")).alias("schema"), "cardinality", required.alias("required"), "rationale", "weight", F.col("ratification.sme").alias("owner"))
    each = candidates.groupBy("entity", F.col("placement").alias("scope")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return each.mapInPandas(_documents, "entity string, scope string, document string")


def _documents(frames):  # noqa: ANN001, ANN202
    import pandas as pd

    for frame in frames:
        out = []
        for entity, scope, rows in zip(frame["entity"], frame["scope"], frame["rows"]):
            properties = {}
            for r in rows:
                schema = json.loads(r["schema"])
                if str(r["cardinality"]).endswith("n"):
                    schema = {"type": "array", "items": schema}
                if scope != "core":
                    schema |= {"x-rationale": r["rationale"], "x-weight": None if r["weight"] is None else int(r["weight"]), "x-owner": r["owner"]}
                properties[r["attribute"]] = schema
            document = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": entity, "type": "object", "additionalProperties": False, "properties": properties, "required": sorted(r["attribute"] for r in rows if r["required"])}
            if scope != "core":
                document["x-scope"] = scope
            out.append((entity, scope, serialise(document).decode()))
        yield pd.DataFrame(out, columns=["entity", "scope", "document"])


#: Fixed value: composite types that every schema may refer to.
COMMON_SCHEMAS = {
    "MonetaryAmount": {"type": "object", "properties": {"amount": {"type": "number"}, "currency": {"type": "string", "pattern": "^[A-Z]{3}$"}}, "required": ["amount", "currency"], "additionalProperties": False},
    "Identifier": {"type": "object", "properties": {"value": {"type": "string"}, "scheme": {"type": "string"}, "issuer": {"type": "string"}}, "required": ["value", "scheme"], "additionalProperties": False},
}


def openapi(entities: list[str], title: str, version: str) -> dict:
    """An OpenAPI document that only refers to the entities' schemas."""
    return {"openapi": "3.1.0", "info": {"title": title, "version": version}, "paths": {}, "components": {"schemas": {e: {"$ref": f"core/{e}.schema.json"} for e in sorted(entities)}}}


def logical_model(candidates: DataFrame) -> DataFrame:
    """entity, model (JSON): attributes with their lineage and who ratified them."""
    row = F.struct("attribute", "dataType", "cardinality", "placement", F.array_sort("clusterRefs").alias("derivedFrom"), F.col("ratification.sme").alias("ratifiedBy"))
    each = candidates.groupBy("entity").agg(F.array_sort(F.collect_list(row)).alias("attributes"))
    return each.select("entity", F.to_json(F.struct(F.lit("Entity").alias("@type"), F.col("entity").alias("name"), "attributes")).alias("model"))


def release(domain: str, version: str, run_id: str, artefacts: dict[str, bytes], coverage: dict, key: bytes) -> dict:
    """A signed manifest; refused unless every gate passes."""
    if not all(coverage.get(g) for g in ("gate1Pass", "gate2Pass", "gate3Pass")):
        raise ValueError("a coverage gate does not pass")
    body = {"domain": domain, "version": version, "runId": run_id, "coverage": coverage, "artefacts": [{"path": p, "sha256": hashlib.sha256(b).hexdigest()} for p, b in sorted(artefacts.items())]}
    return body | {"signature": hmac.new(key, serialise(body), hashlib.sha256).hexdigest()}


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed), breaking: of releases' artefacts(path, sha256). Extensions never break."""
    old, new = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    out = old.join(new, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")
    return out.withColumn("breaking", (F.col("change") != "added") & ~F.contains("path", F.lit("extension")))
