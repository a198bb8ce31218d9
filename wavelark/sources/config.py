"""Collector profiles: `key = value` files, typed access and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_KEY = re.compile(r"[A-Za-z0-9._-]{1,128}")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"'}
MOST_LINE, MOST_ENTRIES = 8192, 4096


class ConfigError(ValueError):
    pass


def _value(text: str, number: int) -> str:
    """A value, its quotes and escapes resolved, a comment cut."""
    if not text.startswith('"'):
        return text.split("#", 1)[0].strip()
    out, i = [], 1
    while i < len(text):
        c = text[i]
        if c == '"':
            if text[i + 1 :].split("#", 1)[0].strip():
                raise ConfigError(f"line {number}: text after a quoted value")
            return "".join(out)
        if c == "\\":
            i += 1
            if i >= len(text) or text[i] not in _ESCAPES:
                raise ConfigError(f"line {number}: unknown escape")
            c = _ESCAPES[text[i]]
        out.append(c)
        i += 1
    raise ConfigError(f"line {number}: unterminated quote")


@dataclass
class Config:
    """Entries in order; of a repeated key the last holds."""

    entries: list[tuple[str, str]] = field(default_factory=list)

    @property
    def values(self) -> dict[str, str]:
        return dict(self.entries)

    def text(self, key: str, default: str = "") -> str:
        return self.values.get(key, default)

    def integer(self, key: str, default: int = 0) -> int:
        """The default also stands in for what isn't an integer."""
        try:
            return int(self.values[key])
        except (KeyError, ValueError):
            return default

    def flag(self, key: str, default: bool = False) -> bool:
        """A value that is there is true for true, 1 and yes only."""
        return self.values[key] in ("true", "1", "yes") if key in self.values else default


def parse(text: str) -> Config:
    """Reads a config; the first wrong line is an error."""
    out = Config()
    if "\0" in text:
        raise ConfigError("NUL in config")
    for number, line in enumerate(text.splitlines(), 1):
        if len(line.encode()) > MOST_LINE:
            raise ConfigError(f"line {number}: too long")
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, sign, value = line.partition("=")
        key = key.strip()
        if not sign or not _KEY.fullmatch(key):
            raise ConfigError(f"line {number}: no key")
        if len(out.entries) == MOST_ENTRIES:
            raise ConfigError("too many entries")
        out.entries.append((key, _value(value.strip(), number)))
    return out


@dataclass(frozen=True)
class Rule:
    """What a key must hold: text, flag or integer within bounds."""

    key: str
    kind: str
    required: bool = False
    low: int = 0
    high: int = 2**63 - 1


COLLECTOR = (
    Rule("collector.name", "text", True),
    Rule("collector.region", "integer", False, 0, 65535),
    Rule("collector.id", "integer", False, 0, 65535),
    Rule("archive.path", "text"),
    Rule("archive.rotate_bytes", "integer"),
    Rule("archive.enabled", "flag"),
    Rule("stream.idle_timeout_ns", "integer"),
)


def validate(config: Config, rules: tuple[Rule, ...] = COLLECTOR) -> list[str]:
    """The issues of a config."""
    issues = []
    for r in rules:
        value = config.values.get(r.key)
        if value is None:
            if r.required:
                issues.append(f"{r.key} is missing")
        elif r.kind == "flag" and value not in ("true", "false", "1", "0", "yes", "no"):
            issues.append(f"{r.key} is no flag")
        elif r.kind == "integer":
            if not re.fullmatch(r"[+-]?\d+", value):
                issues.append(f"{r.key} is no integer")
            elif not r.low <= int(value) <= r.high:
                issues.append(f"{r.key} is out of range")
    return issues


@dataclass(frozen=True)
class Profile:
    """A collector's settings with their defaults."""

    name: str
    region: int
    idle_timeout_ns: int
    rotate_bytes: int
    warnings: tuple[str, ...]


def profile(config: Config) -> Profile:
    """The profile of a config; issues are errors, odd settings warnings."""
    if issues := validate(config):
        raise ConfigError("; ".join(issues))
    rotate = config.integer("archive.rotate_bytes")
    idle = config.integer("stream.idle_timeout_ns", 30_000_000_000)
    warned = tuple(w for w, on in (("archive never rotates", rotate == 0), ("idle timeout below a second", idle < 1_000_000_000)) if on)
    return Profile(config.text("collector.name"), config.integer("collector.region"), idle, rotate, warned)
