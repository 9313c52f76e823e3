"""Settings of a project: a YAML file over environment variables over defaults. Broken files count as empty."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

try:
    import yaml
except ImportError:  # settings then come from the environment and defaults
    yaml = None


@dataclass
class ProjectConfig:
    name: str = ""
    path: str = "."
    chunk_size: int = 50
    chunk_overlap: int = 10
    embed_dim: int = 64
    min_summary_lines: int = 8
    token_budget: int = 4000
    interval_s: int = 600

    @classmethod
    def load(cls, file: str | None = None, name: str | None = None, env: dict[str, str] | None = None) -> ProjectConfig:
        env = dict(os.environ) if env is None else env
        given = read_yaml(file)
        given = given.get("project", given)
        out = cls()
        for f in fields(cls):
            raw = given.get(f.name, env.get(f"MILLRACE_{f.name.upper()}"))
            if raw is not None:
                try:
                    setattr(out, f.name, type(getattr(out, f.name))(raw))
                except (TypeError, ValueError):
                    pass
        out.name = name or out.name
        return out


def read_yaml(file: str | None) -> dict:
    if not file or yaml is None:
        return {}
    try:
        with open(file, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except (OSError, yaml.YAMLError):
        return {}
    return data if isinstance(data, dict) else {}


def services(file: str) -> list[dict]:
    """Service rows of an override file; a port that is no whole number is dropped."""
    out = []
    for s in read_yaml(file).get("services") or []:
        if isinstance(s, dict) and s.get("name"):
            port = s.get("port")
            out.append({"name": str(s["name"]), "description": str(s.get("description") or ""), "role": str(s.get("role") or ""), "tech_stack": [str(t) for t in s.get("tech_stack") or []], "port": int(port) if isinstance(port, int) else None, "files": [str(f) for f in s.get("files") or []], "file_glob": s.get("file_glob")})
    return out


def probes(file: str) -> tuple[str, list[dict]]:
    data = read_yaml(file)
    rows = [{"query": str(p["query"]), "expected_files": list(p.get("expected_files") or []), "expected_symbols": list(p.get("expected_symbols") or [])} for p in data.get("probes") or [] if isinstance(p, dict) and p.get("query")]
    return str(data.get("repo") or ""), rows
