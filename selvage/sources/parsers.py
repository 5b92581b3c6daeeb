"""Parsers of interface definitions into attribute rows.

Documents are trees of unbounded depth, so they are walked in Python, one document at a time, inside mapInPandas; type tables
are plain dictionaries. An unreadable document gives one row with `error` set.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

XS = "{http://www.w3.org/2001/XMLSchema}"
WSDL = "{http://schemas.xmlsoap.org/wsdl/}"
#: Deepest nesting that is walked; a cycle ends there.
DEPTH = 32

#: Normalised types. There is no binary floating point type; what is not listed is unknown.
OPENAPI_TYPES = {
    ("string", None): "string", ("string", "date"): "date", ("string", "date-time"): "dateTime", ("string", "byte"): "binary",
    ("integer", None): "integer", ("integer", "int32"): "integer", ("integer", "int64"): "integer", ("number", None): "decimal", ("number", "double"): "decimal",
    ("number", "float"): "decimal", ("boolean", None): "boolean", ("object", None): "object", ("array", None): "array",
}
XSD_TYPES = {
    "string": "string", "token": "string", "int": "integer", "long": "integer", "integer": "integer", "decimal": "decimal", "boolean": "boolean", "date": "date",
    "dateTime": "dateTime", "base64Binary": "binary", "IDREF": "reference", "anyType": "unknown", "time": "time", "duration": "duration",
}
AVRO_TYPES = {"string": "string", "int": "integer", "long": "integer", "boolean": "boolean", "bytes": "binary", "record": "object", "array": "array"}
AVRO_LOGICAL = {"decimal": "decimal", "date": "date", "timestamp-millis": "dateTime", "timestamp-micros": "dateTime"}
BITS = {("integer", None): 64, ("integer", "int32"): 32, ("integer", "int64"): 64, "int": 32, "long": 64, "integer": 64}

ATTRIBUTE = (
    "attributeId string, runId string, region string, sourceContract string, path string, localName string, dataType string, "
    "typeDetail struct<bits:int,offsetRequired:boolean,refTarget:string,choiceGroup:string,substitutionHead:boolean,substitutionOf:string,explicitNull:boolean,inheritedFrom:string>, "
    "cardinality string, obligation struct<level:string,condition:string>, enumeration array<struct<value:string,meaning:string,source:string>>, "
    "constraints array<struct<kind:string,expression:string,source:string>>, semantics struct<description:string>, parentPath string, evidenceTier int, inferred boolean, evidenceRefs array<string>, error string"
)
_DETAILS = ("bits", "offsetRequired", "refTarget", "choiceGroup", "substitutionHead", "substitutionOf", "explicitNull", "inheritedFrom")


def load(text: bytes) -> object:
    """JSON, or YAML where that library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and no YAML library is installed") from None
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(str(error)) from None


class Rows:
    """Attribute rows of one document."""

    def __init__(self, source: dict) -> None:
        self.source, self.rows = source, []

    def add(self, path: str, kind: str, parent: str | None, locator: str, *, required: bool, many: bool = False, level: str | None = None, description: str | None = None, values: tuple = (), constraints: tuple = (), **detail: object) -> dict:
        s = self.source
        row = {
            "attributeId": f"attr://{s['region']}/{s['artefactId']}/{path}", "runId": s["runId"], "region": s["region"], "sourceContract": s["artefactId"], "path": path,
            "localName": path.rsplit(".", 1)[-1], "dataType": kind, "typeDetail": {k: detail.get(k) for k in _DETAILS} if detail else None,
            "cardinality": f"{int(required)}..{'n' if many else '1'}", "obligation": {"level": level or ("mandatory" if required else "optional"), "condition": None},
            "enumeration": [{"value": str(v), "meaning": None, "source": "declared"} for v in values] or None,
            "constraints": [{"kind": k, "expression": e, "source": "schema"} for k, e in constraints] or None,
            "semantics": {"description": description} if description else None, "parentPath": parent, "evidenceTier": s["evidenceTier"], "inferred": False,
            "evidenceRefs": [f"evref://{s['region']}/{s['system']}/{s['artefactId']}@{s['contentHash'][:16]}#{locator}"], "error": None,
        }
        self.rows.append(row)
        return row


# --- OpenAPI and JSON Schema -------------------------------------------------------------------------------------------------


def _limits(node: dict) -> tuple:
    named = (("minLength", "length"), ("maxLength", "length"), ("pattern", "pattern"), ("minimum", "range"), ("maximum", "range"))
    return tuple((kind, node[k] if k == "pattern" else f"{k}={node[k]}") for k, kind in named if k in node)


def _openapi_node(rows: Rows, node: object, path: str, parent: str | None, pointer: str, required: bool, own: bool = True, depth: int = 0) -> None:
    if not isinstance(node, dict) or depth > DEPTH:
        return
    put = lambda kind, **detail: rows.add(path, kind, parent, pointer, required=required, description=node.get("description"), values=tuple(node.get("enum") or ()), constraints=_limits(node), **detail)
    kind = node.get("type") if isinstance(node.get("type"), str) else None
    if "$ref" in node:
        if own:
            put("reference", refTarget=node["$ref"])
    elif kind == "object" and isinstance(node.get("properties"), dict):
        if own:
            put("object")
        needed = set(node.get("required") or ())
        for name, child in node["properties"].items():
            _openapi_node(rows, child, f"{path}.{name}", path, f"{pointer}/properties/{name.replace('~', '~0').replace('/', '~1')}", name in needed, depth=depth + 1)
    elif kind == "array":
        _openapi_node(rows, node.get("items") or {}, path, parent, f"{pointer}/items", required, depth=depth + 1)
        if rows.rows and rows.rows[-1]["path"] == path:  # only a scalar item is marked as many
            rows.rows[-1]["cardinality"] = f"{int(required)}..n"
    elif own:
        key = (kind, node.get("format"))
        known = OPENAPI_TYPES.get(key) or OPENAPI_TYPES.get((kind, None), "unknown")
        detail = {"bits": BITS[key if key in BITS else (kind, None)]} if kind == "integer" else {"offsetRequired": True} if known == "dateTime" else {}
        put(known, **detail)


def openapi(rows: Rows, content: bytes) -> None:
    document = load(content)
    if not isinstance(document, dict):
        raise ValueError("not an object")
    for name, node in ((document.get("components") or {}).get("schemas") or {}).items():
        _openapi_node(rows, node, name, None, f"/components/schemas/{name}", True, own=False)
    for route, methods in (document.get("paths") or {}).items():
        for method, operation in methods.items() if isinstance(methods, dict) else ():
            for i, p in enumerate(operation.get("parameters") or () if isinstance(operation, dict) else ()):
                if isinstance(p, dict) and isinstance(p.get("schema"), dict):
                    node = p["schema"] | ({"description": p["description"]} if "description" in p else {})
                    pointer = f"/paths/{route.replace('~', '~0').replace('/', '~1')}/{method}/parameters/{i}/schema"
                    _openapi_node(rows, node, f"{operation.get('operationId') or method}.{p.get('name')}", None, pointer, bool(p.get("required")))


# --- XML Schema and WSDL -----------------------------------------------------------------------------------------------------


def _local(name: str | None) -> str:
    return (name or "").rsplit(":", 1)[-1]


def _says(element: ET.Element) -> str | None:
    text = element.find(f"{XS}annotation/{XS}documentation")
    return "".join(text.itertext()).strip() or None if text is not None else None


class _Schema:
    def __init__(self, rows: Rows, root: ET.Element) -> None:
        self.rows, self.root = rows, root
        self.types = {t.get("name"): t for t in root.findall(f"{XS}complexType")}
        self.heads = {_local(e.get("substitutionGroup")) for e in root.findall(f"{XS}element")} - {""}
        self.top = {e.get("name"): e for e in root.findall(f"{XS}element")}

    def run(self) -> None:
        for e in self.root.findall(f"{XS}element"):
            detail = {}
            if e.get("name") in self.heads:
                detail["substitutionHead"] = True
            if e.get("substitutionGroup"):
                s = self.rows.source
                detail["substitutionOf"] = f"attr://{s['region']}/{s['artefactId']}/{_local(e.get('substitutionGroup'))}"
            self.element(e, None, 0, **detail)

    def element(self, e: ET.Element, parent: str | None, depth: int, level: str | None = None, **detail: object) -> None:
        name = e.get("name") or _local(e.get("ref"))
        if not name or depth > DEPTH:
            return
        path = f"{parent}.{name}" if parent else name
        required, many = e.get("minOccurs", "1") != "0", e.get("maxOccurs", "1") not in ("0", "1")
        if e.get("nillable") == "true":
            detail["explicitNull"] = True
        body = e.find(f"{XS}complexType")
        body = body if body is not None else self.types.get(_local(e.get("type")))
        put = lambda kind, **more: self.rows.add(path, kind, parent, f"//{path.replace('.', '/')}", required=required, many=many, level=level, description=_says(e), **detail, **more)
        if e.get("ref"):
            put("reference", refTarget=_local(e.get("ref")))
        elif body is not None:
            put("object")
            self.content(body, path, depth + 1)
        else:
            base = _local(e.get("type"))
            put(XSD_TYPES.get(base, "unknown"), **({"bits": BITS[base]} if base in BITS else {"offsetRequired": False} if base == "dateTime" else {}))

    def content(self, body: ET.Element, path: str, depth: int, inherited: str | None = None) -> None:
        extension = body.find(f"{XS}complexContent/{XS}extension")
        if extension is not None:
            base = _local(extension.get("base"))
            if base in self.types and depth <= DEPTH:
                self.content(self.types[base], path, depth + 1, base)
            self.content(extension, path, depth, inherited)
            return
        more = {"inheritedFrom": inherited} if inherited else {}
        for group in (*body.findall(f"{XS}sequence"), *body.findall(f"{XS}all"), *body.findall(f"{XS}choice")):
            self.group(group, path, depth, more)
        for a in body.findall(f"{XS}attribute"):
            base = _local(a.get("type"))
            name = f"{path}.{a.get('name')}"
            self.rows.add(name, XSD_TYPES.get(base, "unknown"), path, f"//{path.replace('.', '/')}/@{a.get('name')}", required=a.get("use") == "required", description=_says(a), **({"bits": BITS[base]} if base in BITS else {}), **more)

    def group(self, group: ET.Element, path: str, depth: int, more: dict) -> None:
        chosen = group.tag == f"{XS}choice"
        for child in group:
            if child.tag == f"{XS}element":
                self.element(child, path, depth, level="conditional" if chosen else None, **more, **({"choiceGroup": group.get("id") or f"{path}.choice"} if chosen else {}))
            elif child.tag in (f"{XS}sequence", f"{XS}all", f"{XS}choice"):
                self.group(child, path, depth, more)


def xsd(rows: Rows, content: bytes) -> None:
    root = ET.fromstring(content)
    if root.tag == f"{WSDL}definitions":
        for schema in root.findall(f"{WSDL}types/{XS}schema"):
            _Schema(rows, schema).run()
    elif root.tag == f"{XS}schema":
        _Schema(rows, root).run()
    else:
        raise ValueError(f"no parser for {root.tag}")


# --- Avro --------------------------------------------------------------------------------------------------------------------


def _avro_field(rows: Rows, name: str, kind: object, path: str, parent: str, says: str | None, many: bool = False, depth: int = 0) -> None:
    if depth > DEPTH:
        return
    put = lambda k, **d: rows.add(path, k, parent, f"#{path}", required=True, description=says, **d)
    row = None
    if isinstance(kind, dict) and kind.get("type") == "record":
        row = put("object")
        for f in kind.get("fields") or ():
            _avro_field(rows, f["name"], f["type"], f"{path}.{f['name']}", path, f.get("doc"), depth=depth + 1)
    elif isinstance(kind, dict) and kind.get("type") == "array":
        _avro_field(rows, name, kind.get("items"), path, parent, says, True, depth + 1)
    else:
        base, logical = (kind.get("type"), kind.get("logicalType")) if isinstance(kind, dict) else (kind, None)
        known = AVRO_LOGICAL.get(logical) or (AVRO_TYPES.get(base, "unknown") if isinstance(base, str) else "unknown")
        row = put(known, **({"bits": BITS[base]} if known == "integer" else {"offsetRequired": False} if known == "dateTime" else {}))
    if many and row is not None:
        row["cardinality"] = "0..n"


def avro(rows: Rows, content: bytes) -> None:
    document = load(content)
    if not isinstance(document, dict) or document.get("type") != "record":
        raise ValueError("not an Avro record")
    for f in document.get("fields") or ():
        _avro_field(rows, f["name"], f["type"], f"{document['name']}.{f['name']}", document["name"], f.get("doc"))


def parse(source: dict, content: bytes) -> list[dict]:
    """Attribute rows of one document, by its media type and content; an unreadable one gives a row with its error."""
    rows = Rows(source)
    try:
        if source["mediaType"] == "application/xml":
            xsd(rows, content)
        elif source["mediaType"] in ("application/vnd.apache.avro+json", "application/avro+json") or source.get("uri", "").endswith(".avsc"):
            avro(rows, content)
        elif source["mediaType"] in ("application/json", "application/yaml"):
            openapi(rows, content)
        else:
            raise ValueError(f"no parser for {source['mediaType']}")
    except (ValueError, KeyError, TypeError, AttributeError, ET.ParseError) as error:
        return [{"sourceContract": source["artefactId"], "runId": source["runId"], "region": source["region"], "error": f"{type(error).__name__}: {error}"}]
    return rows.rows


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["attributeId", "runId", "region", "sourceContract", "path", "localName", "dataType", "typeDetail", "cardinality", "obligation", "enumeration", "constraints", "semantics", "parentPath", "evidenceTier", "inferred", "evidenceRefs", "error"]
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            rows += parse(r, bytes(r["content"]))
        out = pd.DataFrame(rows, columns=names).astype(object)
        yield out.where(out.notna(), None)


def attributes(artefacts: DataFrame) -> DataFrame:
    """Attribute rows of artefacts(artefactId, runId, region, system, uri, mediaType, contentHash, evidenceTier, content)."""
    own = artefacts.select("artefactId", "runId", "region", "system", "uri", "mediaType", "contentHash", "evidenceTier", "content")
    return own.mapInPandas(_parse, ATTRIBUTE)


# --- places of texts in a document ---------------------------------------------------------------------------------------------

_EXAMPLES, _PROSE = {"example", "examples", "default", "const"}, {"description", "summary", "title"}


def structure(content: bytes, media_type: str) -> tuple[list[str], list[str], list[str]]:
    """Structural texts, examples and prose of a document; one that cannot be read, or what lies deeper than four times
    DEPTH, is prose as a whole."""
    structural, examples, prose = [], [], []

    def literals(node: object) -> None:
        if isinstance(node, dict):
            for v in node.values():
                literals(v)
        elif isinstance(node, list):
            for v in node:
                literals(v)
        elif node is not None:
            examples.append(str(node))

    def walk(node: object, depth: int = 0) -> None:
        if depth > DEPTH * 4:  # too deep to be placed: the gate must see it all the same
            prose.append(json.dumps(node, ensure_ascii=False))
        elif isinstance(node, dict):
            for k, v in node.items():
                if k in _EXAMPLES:
                    literals(v)
                elif k in _PROSE and isinstance(v, str):
                    prose.append(v)
                elif k in ("name", "type") and isinstance(v, str):
                    structural.append(v)
                else:
                    structural.append(str(k))
                    walk(v, depth + 1)
        elif isinstance(node, list):
            for v in node:
                walk(v, depth + 1)

    try:
        if media_type in ("application/json", "application/yaml", "application/avro+json", "application/vnd.apache.avro+json"):
            document = load(content)
            if not isinstance(document, dict | list):
                raise ValueError("a bare text")
            walk(document)
            return structural, examples, prose
        if media_type == "application/xml":
            for e in ET.fromstring(content).iter():
                if e.tag == f"{XS}documentation":
                    prose.append("".join(e.itertext()).strip())
                else:
                    structural.extend(v for k, v in e.attrib.items() if k in ("name", "type", "ref", "base"))
                    examples.extend(v for k, v in e.attrib.items() if k in ("default", "fixed"))
            return structural, examples, prose
    except (ValueError, RecursionError, ET.ParseError):
        pass
    return [], [], [content.decode("utf-8", "replace")]


def structures(artefacts: DataFrame, *keep: str) -> DataFrame:
    """keep's columns of artefacts(content, mediaType) with structural, examples and prose (arrays)."""
    kinds = {f.name: f.dataType.simpleString() for f in artefacts.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [structure(bytes(c), m) for c, m in zip(frame["content"], frame["mediaType"])]
            yield frame[list(keep)].assign(structural=[f[0] for f in found], examples=[f[1] for f in found], prose=[f[2] for f in found])

    return artefacts.select(*keep, *[c for c in ("content", "mediaType") if c not in keep]).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", structural array<string>, examples array<string>, prose array<string>")
