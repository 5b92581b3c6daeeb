"""Settings with their defaults. A run may override any of them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


class ConfigError(ValueError):
    """A setting that contradicts another one."""


#: Similarity weights, compatible types, abbreviations, lexicons, lookup tables.
WEIGHTS = {"lexical": 0.27, "embedding": 0.05, "type": 0.20, "constraints": 0.27, "context": 0.21}
TYPE_COMPATIBILITY = {("date", "dateTime"): 0.85, ("string", "date"): 0.55, ("decimal", "integer"): 0.70, ("string", "boolean"): 0.30, ("object", "string"): 0.10}
ABBREVIATIONS = {
    "dt": "date", "dttm": "dateTime", "amt": "amount", "nbr": "number", "cd": "code", "ind": "indicator",
    "desc": "description", "ref": "reference", "no": "number", "qty": "quantity", "sinistre": "claim", "police": "policy",
}
TEMPORAL = ("date", "time", "timestamp", "at", "when", "occurred", "datetime")
MONETARY = ("amount", "reserve", "premium", "price", "cost", "fee", "value", "sum", "total")
IDENTIFIER = ("id", "identifier", "code", "number", "ref")
ALLOWED_ABBREVIATIONS = ("id", "ref", "uri", "iso")
REGIONS = ("us", "uk", "eu")
DATA_TYPES = ("string", "integer", "decimal", "boolean", "date", "dateTime", "time", "duration", "binary", "object", "array", "reference", "unknown")
TYPE_FAMILY = {
    "string": "text", "integer": "numeric", "decimal": "numeric", "boolean": "flag", "date": "temporal", "dateTime": "temporal",
    "time": "temporal", "duration": "temporal", "binary": "opaque", "object": "structural", "array": "structural", "reference": "structural", "unknown": "opaque",
}
SENSITIVE = ("diagnosis", "psychiatric", "hiv", "substance abuse", "criminal conviction", "bankruptcy", "county court judgment", "domestic violence")
DOMAIN_TOKENS = ("claim", "fnol", "loss", "incident", "claimant", "settlement", "reserve", "sinistre")
MEDIA_TYPES = {
    ".yaml": "application/yaml", ".yml": "application/yaml", ".json": "application/json", ".xsd": "application/xml", ".wsdl": "application/xml",
    ".xml": "application/xml", ".md": "text/markdown", ".avsc": "application/json",
}
EVIDENCE_TIER = {"git": 1, "ado": 1, "bitbucket": 1, "gitlab": 1, "catalogue": 2, "confluence": 3, "jira": 3, "vendor": 4}
OBLIGATION_WEIGHT = {"mandatory": 5, "conditional": 3, "optional": 1}
OBLIGATION_RANK = {"mandatory": 3, "conditional": 2, "optional": 1}


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    link: float = 0.72
    review: float = 0.55
    block_max: int = 40
    block_top_k: int = 25
    region_floor: float = 0.85
    domain_target: float = 0.90
    resolution: dict[str, float] = field(default_factory=lambda: {"core": 1.0, "extension": 0.5, "gap": 0.0})
    relevance_keep: float = 0.65
    relevance_drop: float = 0.20
    relevance_weights: dict[str, float] = field(default_factory=lambda: {"path": 0.60, "catalogue": 0.20, "gateway": 0.10, "kind": 0.10})
    domain_tokens: tuple[str, ...] = DOMAIN_TOKENS
    policy_version: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    chunk_words: int = 900
    chunk_overlap: float = 0.15
    embed_dimensions: int = 8

    def __post_init__(self) -> None:
        if not 0 <= self.relevance_drop <= self.relevance_keep <= 1:
            raise ConfigError("relevance_drop must not exceed relevance_keep")
        if not 0 <= self.review <= self.link <= 1:
            raise ConfigError("review must not exceed link")
        if self.block_max < 2 or not 0 <= self.chunk_overlap < 1:
            raise ConfigError("block_max must be at least 2 and chunk_overlap in [0, 1)")

    def with_overrides(self, **values: object) -> Settings:
        """A copy with other values; unknown names raise TypeError."""
        return replace(self, **values)

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "SELVAGE_") -> Settings:
        """Defaults, overridden by a JSON file (or YAML, where that library is installed) and then by the environment:
        SELVAGE_LINK=0.7 sets `link`; values are JSON, anything else is a text. Unknown names raise ConfigError."""
        values: dict[str, object] = {}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            try:
                values = json.loads(text)
            except ValueError:
                import yaml

                values = yaml.safe_load(text)
            if not isinstance(values, dict):
                raise ConfigError(f"{path} does not hold settings")
        for name, text in (os.environ if environment is None else environment).items():
            if name.startswith(prefix):
                try:
                    values[name[len(prefix) :].lower()] = json.loads(text)
                except ValueError:
                    values[name[len(prefix) :].lower()] = text
        kinds = {f.name: f for f in fields(cls)}
        if unknown := set(values) - set(kinds):
            raise ConfigError(f"unknown setting {min(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
