"""Which steps of a pipeline are stale, and its layered settings; driver-side and small."""

from __future__ import annotations

import difflib
import hashlib
import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


def stamp(path: str | Path) -> list:
    """Size and time of a file, or of all files of a folder."""
    p = Path(path)
    if not p.exists():
        return []
    files = [p] if p.is_file() else sorted(x for x in p.rglob("*") if x.is_file())
    return [[str(f.relative_to(p.parent)), f.stat().st_size, f.stat().st_mtime_ns] for f in files]


@dataclass
class Step:
    """A step reads paths, writes paths, and depends on some settings."""

    name: str
    run: Callable[[], None]
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    version: int = 1


def signature(step: Step) -> str:
    what = {"version": step.version, "settings": step.settings, "reads": [stamp(r) for r in step.reads]}
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def run_stale(steps: list[Step], state_file: str | Path, force: set[str] = frozenset(), dry_run: bool = False) -> list[tuple[str, str]]:
    """Runs, in order, the steps that are new, changed, forced or without their outputs; ``(name, reason)`` of each."""
    p = Path(state_file)
    state = json.loads(p.read_text()) if p.exists() else {}
    done = []
    for s in steps:
        old = state.get(s.name)
        sig = signature(s)
        if s.name in force:
            why = "forced"
        elif old is None:
            why = "never run"
        elif old["signature"] != sig:
            why = "inputs or settings changed"
        elif any(not Path(w).exists() for w in s.writes):
            why = "an output is missing"
        elif old["outputs"] != [stamp(w) for w in s.writes]:
            why = "an output was changed by hand: kept"
        else:
            continue
        done.append((s.name, why))
        if dry_run:
            continue
        if not why.endswith("kept"):
            s.run()
        state[s.name] = {"signature": signature(s), "outputs": [stamp(w) for w in s.writes]}
        tmp = p.with_suffix(".tmp")
        tmp.write_text(json.dumps(state))
        tmp.replace(p)
    return done


def read_settings(path: str | Path, known: set[str] | None = None, section: str | None = None, _open: tuple = ()) -> dict:
    """Settings of a TOML file over those that it ``extends``; the section's win over the top level's. Unknown names are refused with the nearest known one."""
    p = Path(path).resolve()
    if p in _open:
        raise ValueError(f"{p} extends itself")
    raw = tomllib.loads(p.read_text())
    base: dict = {}
    for other in [raw.pop("extends")] if isinstance(raw.get("extends"), str) else raw.pop("extends", []):
        base |= read_settings(p.parent / other, known, section, (*_open, p))
    own = {k: v for k, v in raw.items() if not isinstance(v, dict)} | (raw.get(section, {}) if section else {})
    if known is not None:
        for k in own:
            if k not in known:
                near = difflib.get_close_matches(k, known, 1)
                raise ValueError(f"{p}: unknown setting {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return base | own
