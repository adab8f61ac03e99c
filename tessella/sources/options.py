"""Options of an extraction: command line over configuration file over defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


#: Default names and globs, and what options are called in a configuration file and on the command line.
NAMES = frozenset({"i18n", "L", "LazyProxy", "LazyFilter"})
IGNORED_ATTRIBUTES = frozenset({"set_locale", "use_locale", "use_context", "set_context"})
EXCLUDED = frozenset({"**/.venv/**", "**/venv/**", "**/.git/**", "**/__pycache__/**", "**/.pytest_cache/**"})
CALLED = {
    "names": "i18n-keys",
    "prefixes": "i18n-keys-prefix",
    "exclude": "exclude-dirs",
    "locales": "languages",
    "default_file": "default-ftl-file",
    "comment_mode": "comment-keys-mode",
    "allow_errors": "allow-parse-errors",
}


@dataclass(frozen=True)
class Options:
    names: frozenset[str] = NAMES
    prefixes: frozenset[str] = frozenset()
    ignore_attributes: frozenset[str] = IGNORED_ATTRIBUTES
    ignore_kwargs: frozenset[str] = frozenset()
    exclude: frozenset[str] = EXCLUDED
    locales: tuple[str, ...] = ("en",)
    default_file: str = "_default.ftl"
    line_endings: str = "default"
    comment_mode: str = "comment"
    marker: str = "extract:"
    allow_errors: bool = False
    dry_run: bool = False
    code_path: str = ""
    locales_path: str = ""

    def resolved(self, config: dict, given: dict) -> Options:
        """Values of `given` win over `config`; a list under <name>-append joins the set instead of replacing it."""
        out = self
        for source in (config, given):
            for f in fields(self):
                key = called(f.name)
                old = getattr(self, f.name)
                if key in source:
                    value = source[key]
                    out = replace(out, **{f.name: frozenset(value) if isinstance(old, frozenset) else tuple(value) if isinstance(old, tuple) else value})
                if f"{key}-append" in source and isinstance(old, frozenset):
                    out = replace(out, **{f.name: getattr(out, f.name) | frozenset(source[f"{key}-append"])})
        if out.line_endings not in ("default", "lf", "cr", "crlf") or out.comment_mode not in ("comment", "warn"):
            raise ValueError("line-endings or comment-mode has an unknown value")
        return out


def called(field: str) -> str:
    """What a field is called in a configuration file."""
    return CALLED.get(field, field.replace("_", "-"))


def find_config(start: str, name: str = "pyproject.toml") -> Path | None:
    """The nearest file of this name in a folder or above."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def load_config(path: Path | None, section: str = "extract") -> dict:
    """The options of [tool.<section>], a name that may have dots, checked by type; paths are relative to the file's folder."""
    if path is None:
        return {}
    with path.open("rb") as f:
        found = tomllib.load(f).get("tool", {})
    for part in section.split("."):
        found = found.get(part, {})
    for key, value in found.items():
        if not isinstance(value, (str, bool, list)) or (isinstance(value, list) and not all(isinstance(x, str) for x in value)):
            raise ValueError(f"{path}: {key} must be text, a switch or a list of texts")
    return {k: str(path.parent / v) if k in ("code-path", "locales-path") else v for k, v in found.items()}


def sample_config(section: str = "extract") -> str:
    d = Options()
    lines = [f"[tool.{section}]"]
    for f in fields(d):
        v = getattr(d, f.name)
        shown = sorted(v) if isinstance(v, frozenset) else list(v) if isinstance(v, tuple) else v
        lines.append(f"{called(f.name)} = {str(shown).lower() if isinstance(shown, bool) else repr(shown).replace(chr(39), chr(34))}")
    return "\n".join(lines) + "\n"
