"""Settings of a run.  A flag wins over the environment, that over the file, that over the default."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

from lectern.functions import values as V

# Fixed values.
DEFAULTS = {"engine": "kokoro", "accent": "uk", "gender": "female", "voice": None, "speed": 1.0, "format": "mp3", "header": False}
CHOICES = {"accent": tuple(V.ACCENTS), "gender": ("female", "male"), "format": ("mp3", "m4a", "wav")}
SPEEDS = (0.5, 2.0)

PREFIX = "LECTERN_"
_YES, _NO = {"true", "yes", "1"}, {"false", "no", "0"}


class SettingsError(ValueError):
    pass


def checked(name: str, value, origin: str):
    """The value in its proper form, or an error that names it and where it came from."""
    wrong = SettingsError(f"invalid {name} {value!r} in {origin}")
    if name == "voice":
        return str(value) if value else None
    if name == "speed":
        try:
            speed = float(value)
        except (TypeError, ValueError):
            raise wrong from None
        if not SPEEDS[0] <= speed <= SPEEDS[1]:
            raise SettingsError(f"speed {speed} in {origin} is not within {SPEEDS[0]} to {SPEEDS[1]}")
        return speed
    if name == "header":
        low = value if isinstance(value, bool) else str(value).lower()
        if low in (True, False):
            return low
        if low not in _YES | _NO:
            raise wrong
        return low in _YES
    if not isinstance(value, str) or not value.strip():
        raise wrong
    low = value.strip().lower()
    if low not in CHOICES.get(name, (low,)):
        raise SettingsError(f"{wrong}; valid: {', '.join(CHOICES[name])}")
    return low


def read_file(path: str | Path) -> dict:
    """Tables of a TOML file; none if it is missing."""
    path = Path(path)
    if not path.exists():
        return {}
    try:
        found = tomllib.loads(path.read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError, OSError) as e:
        raise SettingsError(f"{path} can't be read: {e}") from e
    for name in ("defaults", "engines"):
        if not isinstance(found.get(name, {}), dict):
            raise SettingsError(f"[{name}] in {path} must be a table")
    return found


def load(path: str | Path, flags: Mapping | None = None, env: Mapping[str, str] | None = None) -> dict:
    """Every setting, with ``engine_options`` by engine from the file."""
    env = os.environ if env is None else env
    found = read_file(path)
    env_layer = {n: v.strip() for n in DEFAULTS if n != "header" and (v := env.get(PREFIX + n.upper(), "")).strip()}
    out = dict(DEFAULTS)
    # Of file and environment only the winning value of a name is checked; flags are checked on top.
    for origin, layer in ((f"{path} or the environment", found.get("defaults", {}) | env_layer), ("the flags", flags or {})):
        out |= {n: checked(n, v, origin) for n, v in layer.items() if n in DEFAULTS and v is not None}
    return out | {"engine_options": {n: t for n, t in found.get("engines", {}).items() if isinstance(t, dict)}}
