"""Settings: defaults, overlay from a file, lookup in a folder."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# File patterns of the default index.
INCLUDES = ("**/*.go", "**/*.py", "**/*.js", "**/*.ts", "**/*.java", "**/*.c", "**/*.cpp", "**/*.h", "**/*.rs", "**/*.md", "**/*.txt")
EXCLUDES = ("**/node_modules/**", "**/vendor/**", "**/.git/**", "**/dist/**", "**/build/**", "**/__pycache__/**", "**/*.min.js")


@dataclass(frozen=True)
class IndexConfig:
    includes: tuple[str, ...] = INCLUDES
    excludes: tuple[str, ...] = EXCLUDES
    language: str = "auto"
    stemming: bool = True
    chunk_tokens: int = 512
    chunk_overlap: int = 50
    k1: float = 1.2
    b: float = 0.75
    ast_chunking: bool = True


@dataclass(frozen=True)
class RetrieveConfig:
    top_k: int = 20
    mmr_lambda: float = 0.7
    dedup_jaccard: float = 0.8
    path_boost_weight: float = 0.3
    hybrid_enabled: bool = False
    rrf_k: int = 60
    bm25_weight: float = 0.5
    min_score_threshold: float = 0.0


@dataclass(frozen=True)
class EmbeddingConfig:
    enabled: bool = False
    provider: str = "openai"
    model: str = "text-embedding-3-small"
    api_key_env: str = "OPENAI_API_KEY"
    base_url: str = ""
    dimension: int = 1536
    batch_size: int = 100


@dataclass(frozen=True)
class PackConfig:
    token_budget: int = 4000
    recency_boost: float = 0.1
    summarize: bool = False
    output: str = "json"


@dataclass(frozen=True)
class LoggingConfig:
    level: str = "info"


@dataclass(frozen=True)
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    retrieve: RetrieveConfig = field(default_factory=RetrieveConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    pack: PackConfig = field(default_factory=PackConfig)
    logging: LoggingConfig = field(default_factory=LoggingConfig)

    @classmethod
    def load(cls, path: str | Path) -> "Config":
        """Defaults overlaid by a YAML or JSON file; a missing file is no error."""
        path = Path(path)
        return overlay(cls(), parse_settings(path.read_text())) if path.exists() else cls()

    @classmethod
    def find(cls, folder: str | Path) -> "Config":
        """rag.yaml, else .rag/config.yaml, else the defaults."""
        for name in ("rag.yaml", ".rag/config.yaml"):
            if (Path(folder) / name).exists():
                return cls.load(Path(folder) / name)
        return cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(to_yaml(dataclasses.asdict(self)))

    def index_hash(self) -> str:
        """A hash of the settings that a stored index depends on."""
        i, e = self.index, self.embedding
        kept = {"stemming": i.stemming, "chunk_tokens": i.chunk_tokens, "chunk_overlap": i.chunk_overlap, "k1": i.k1, "b": i.b, "ast_chunking": i.ast_chunking, "emb_enabled": e.enabled, "emb_provider": e.provider, "emb_model": e.model}
        return hashlib.sha256(json.dumps(kept, separators=(",", ":")).encode()).hexdigest()[:16]


def overlay(config, values: dict[str, Any]):
    """A copy of ``config`` with the given values; unknown keys are ignored."""
    changes = {}
    for f in dataclasses.fields(config):
        if f.name in values and values[f.name] is not None:
            old, new = getattr(config, f.name), values[f.name]
            if dataclasses.is_dataclass(old):
                new = overlay(old, new)
            elif isinstance(old, tuple):
                new = tuple(new)
            elif isinstance(old, float):
                new = float(new)
            changes[f.name] = new
    return dataclasses.replace(config, **changes)


def parse_settings(text: str) -> dict[str, Any]:
    """JSON, or the part of YAML that settings use: nested maps, lists of scalars, comments."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any]] = [(-1, root)]
    pending: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = _uncommented(raw).rstrip()
        if not line.strip():
            continue
        indent, line = len(line) - len(line.lstrip()), line.strip()
        if line.startswith("- ") or line == "-":
            if pending:
                holder, key = pending
                if not isinstance(holder.get(key), list):
                    holder[key] = []
                holder[key].append(_scalar(line[1:].strip()))
            continue
        while indent <= stack[-1][0]:
            stack.pop()
        key, _, value = line.partition(":")
        key, value, parent = key.strip().strip("\"'"), value.strip(), stack[-1][1]
        if value:
            parent[key] = _scalar(value)
        else:
            parent[key] = {}
            stack.append((indent, parent[key]))
            pending = (parent, key)
    return root


def _uncommented(line: str) -> str:
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _scalar(value: str) -> Any:
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    words = {"true": True, "false": False, "null": None, "~": None}
    if value.lower() in words:
        return words[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def to_yaml(values: dict[str, Any], indent: int = 0) -> str:
    out, pad = "", "  " * indent
    for key, value in values.items():
        if isinstance(value, dict):
            out += f"{pad}{key}:\n{to_yaml(value, indent + 1)}"
        elif isinstance(value, (list, tuple)):
            out += f"{pad}{key}:\n" + "".join(f"{pad}  - {json.dumps(v)}\n" for v in value)
        else:
            out += f"{pad}{key}: {json.dumps(value)}\n"
    return out
