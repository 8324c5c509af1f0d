"""Options of a run and where they come from; resolved before a plan is built."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """budget: most tokens of a result, None for no limit; stubs: replace function bodies instead
    of stripping comments; smart: drop near-duplicate blocks; strip_docs: doc comments go too;
    patterns: regular expressions to remove."""

    budget: int | None = None
    stubs: bool = False
    smart: bool = False
    strip_docs: bool = False
    patterns: tuple[str, ...] = field(default=())

    def key(self) -> str:
        """All options as text, for cache keys."""
        return json.dumps(asdict(self), sort_keys=True)


def merge(config: Options, given: Options, budget: int | None = None) -> Options:
    """Flags of either; patterns of both in order, each once; the budget override, else the given one, else the config's."""
    return Options(
        budget=next((b for b in (budget, given.budget, config.budget) if b is not None), None),
        stubs=config.stubs or given.stubs,
        smart=config.smart or given.smart,
        strip_docs=config.strip_docs or given.strip_docs,
        patterns=tuple(dict.fromkeys((*config.patterns, *given.patterns))),
    )


def load(*candidates: str | Path) -> Options:
    """The first of the files that exists decides alone; one that can't be parsed counts as missing.

    Tables: [defaults] budget, stubs, smart, strip_docs; [strip] patterns.
    """
    for path in map(Path, candidates):
        try:
            with path.open("rb") as f:
                data = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError):
            continue
        base, strip = data.get("defaults", {}), data.get("strip", {})
        known = {k: base[k] for k in ("budget", "stubs", "smart", "strip_docs") if k in base}
        return replace(Options(), **known, patterns=tuple(strip.get("patterns", ())))
    return Options()
