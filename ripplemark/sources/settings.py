"""Hand-written settings: options with their order of precedence, lessons, contracts and sign patterns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    max_hop: int = 2
    split_threshold: int = 50
    edges_a_root: int = 6
    edges_a_node: int = 12
    fix_days: int = 360
    test_globs: tuple[str, ...] = ()


def load(file: str | None = None, **flags: object) -> Settings:
    """Flags before the file before the defaults; an unknown name or a value of another type is an error."""
    got = json.loads(Path(file).read_text()) if file else {}
    out = Settings()
    known = {f.name: type(getattr(out, f.name)) for f in fields(Settings)}
    for source in (got, {k: v for k, v in flags.items() if v is not None}):
        for k, v in source.items():
            if k not in known:
                raise ValueError(f"no such setting: {k}")
            v = tuple(v) if known[k] is tuple and isinstance(v, list) else v
            if not isinstance(v, known[k]) or (known[k] is int and (isinstance(v, bool) or v < 0)):
                raise ValueError(f"{k} must be {known[k].__name__}, not {v!r}")
            out = replace(out, **{k: v})
    return out


def lessons(path: str) -> list[dict]:
    """A list of lessons: id, title, ask, and at least one of tokens_any, name_glob, path_glob, sub_reason."""
    out, seen = json.loads(Path(path).read_text()), set()
    for x in out["lessons"] if isinstance(out, dict) else out:
        if not all(isinstance(x.get(k), str) and x[k] for k in ("id", "title", "ask")):
            raise ValueError(f"a lesson needs id, title and ask: {x}")
        if x["id"] in seen:
            raise ValueError(f"two lessons called {x['id']}")
        if not any(x.get(k) for k in ("tokens_any", "name_glob", "path_glob", "sub_reason")):
            raise ValueError(f"lesson {x['id']} matches nothing")
        seen.add(x["id"])
    return out["lessons"] if isinstance(out, dict) else out


def patterns(path: str) -> dict[str, str]:
    """Signs by category, each a regular expression that compiles."""
    out = json.loads(Path(path).read_text())
    for k, v in out.items():
        try:
            re.compile(v)
        except (re.error, TypeError) as e:
            raise ValueError(f"{k}: {e}") from None
    return out


def symbol_list(text: str) -> list[str]:
    """Names given as JSON or with commas; what looks like a file is refused."""
    text = text.strip()
    names = json.loads(text) if text.startswith("[") else [x.strip() for x in text.split(",")]
    names = list(dict.fromkeys(x for x in names if x))
    for x in names:
        if re.search(r"[/\\]|\.(?:c|cc|cpp|cxx|h|hh|hpp|hxx)$", x):
            raise ValueError(f"{x} is a file, not a symbol")
    if not names:
        raise ValueError("no symbols given")
    return names
