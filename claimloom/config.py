"""One configuration for every command: graph names, paths, limits."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

SDO = "https://schema.org/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file, if there is one; comments, ``export`` and quotes around a value are allowed."""
    if not os.path.isfile(path):
        return {}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value.split(" #")[0].strip()
    return out


@dataclass(frozen=True)
class Config:
    """Values come from ``CLAIMLOOM_<NAME>`` where the environment or a ``.env`` file sets it, in this order, else from the defaults."""

    namespace: str = "https://example.org/claims/ns#"
    organization_id: str = "organization_site"
    publisher_name: str = "Fact check site"
    publisher_url: str = "https://example.org/"
    license_url: str = "https://creativecommons.org/licenses/by/3.0/"
    site_url: str = "https://example.org/"
    ignore_urls: tuple[str, ...] = ()
    exclude_ids: tuple[str, ...] = ("0_0",)
    null_literals: str = "drop"  # or "none_string": null text becomes the literal "None"
    articles_path: str = "articles"
    mappings_path: str = "mappings"
    cache_path: str = "page_cache"
    cache_expiry_s: int = 3600
    text_window: int = 256
    min_similarity: float = 0.25
    claim_limit: int = 100
    prefixes: dict[str, str] = field(default_factory=lambda: {"sdo": SDO, "skos": SKOS, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD})

    @classmethod
    def from_env(cls, dotenv: str = ".env", **given) -> Config:
        out, known = {}, _dotenv(dotenv) | os.environ
        for f in fields(cls):
            value = known.get(f"CLAIMLOOM_{f.name.upper()}")
            if f.name in given:
                out[f.name] = given[f.name]
            elif value is not None and f.name != "prefixes":
                out[f.name] = tuple(value.split(",")) if isinstance(f.default, tuple) else type(f.default)(value)
        return cls(**out)
