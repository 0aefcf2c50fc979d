"""Options of a run: defaults, a configuration file of `key=value` lines, and what is given."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


class UnknownOption(ValueError):
    """A key that is no option."""


@dataclass(frozen=True)
class Options:
    block_size: int = -1  # KiB; -1: by size, 0: stream
    threshold: int = 1
    sample_size: int = 0
    segment_size: int = 128  # MB
    separator: str = "pipe"
    fast: bool = False
    large: bool = False
    deep: bool = False
    threads: int = 0  # 0: all cores
    output: str = ""

    @classmethod
    def load(cls, config: str | None = None, **given) -> Options:
        """Given values win over the file, the file over the defaults; unknown keys are refused."""
        out = cls()
        if config is not None:
            out = replace(out, **_typed(dict(_lines(Path(config).read_text()))))
        return replace(out, **_typed(given))


def _lines(text: str):
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, _, value = line.partition("=")
            yield key.strip(), value.strip()


def _typed(values: dict) -> dict:
    kinds = {f.name: type(f.default) for f in fields(Options)}
    out = {}
    for key, value in values.items():
        name = key.replace("-", "_")
        if name not in kinds:
            raise UnknownOption(key)
        if kinds[name] is bool and isinstance(value, str):
            value = value.lower() in ("1", "true", "yes", "on")
        out[name] = kinds[name](value)
    return out
