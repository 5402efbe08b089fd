"""Settings: a file of JSON (or YAML, where its package is there), then the environment over it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Environment variables are named by this and the setting in capitals.
PREFIX = "LODESTONE_"
_TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Collection:
    """A folder of files: by ``glob``, or by ``extensions`` if there are any."""

    path: str
    glob: str = "**/*.md"
    extensions: tuple[str, ...] = ()
    convert: bool = True


@dataclass(frozen=True)
class Settings:
    collections: dict[str, Collection] = field(default_factory=dict)
    index: str = "lodestone-index"
    target_chunk_size: int = 1024
    max_chunk_size: int = 2048
    strip_links: bool = True
    vector_quantization: str = "none"
    embed_batch_size: int = 16
    fts_limit: int = 50
    vec_limit: int = 50
    rerank_candidates: int = 20
    default_limit: int = 10
    max_chunks_per_response: int = 30
    image_concurrency: int = 4
    stem: bool = True
    deep: bool = False
    xml: bool = False


def _typed(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in _TRUE
    return int(value) if isinstance(like, int) else str(value)


def _read(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yml", ".yaml"):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """The settings of a file, with the environment over them; without a file, defaults.

    A relative index lies beside the file. Unknown names are an error, so that none is misspelt.
    """
    env = dict(os.environ) if environment is None else environment
    path = path or env.get(PREFIX + "CONFIG")
    data = _read(Path(path).expanduser()) if path else {}
    known = {f.name: f for f in fields(Settings)}
    if wrong := set(data) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
    out: dict[str, Any] = {}
    for name, c in (data.pop("collections", None) or {}).items():
        ext = c.get("extensions") or ()
        ext = (ext,) if isinstance(ext, str) else tuple(ext)
        out.setdefault("collections", {})[name] = Collection(c.get("path", ""), c.get("glob", "**/*.md"), ext, c.get("convert", True))
    for name, f in known.items():
        if name != "collections":
            raw = env.get(PREFIX + name.upper(), data.get(name))
            if raw is not None:
                out[name] = _typed(raw, f.default)
    if path and not Path(out.get("index", known["index"].default)).is_absolute() and "://" not in out.get("index", ""):
        out["index"] = str(Path(path).expanduser().parent / out.get("index", known["index"].default))
    return Settings(**out)
