"""Scan settings from a configuration text: sections of `key = value` lines."""

from __future__ import annotations

import re

from codequarry.operators.rule_table import CATEGORIES, SEVERITIES
from codequarry.operators.settings import Settings
from codequarry.sources.files import gitignore_entries


class ConfigError(ValueError):
    """A configuration that cannot be read; the message begins with the line's number."""


def _string(value: str) -> str | None:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else None


def _strings(value: str) -> list[str] | None:
    if not (value.startswith("[") and value.endswith("]")):
        return None
    items = [_string(x.strip()) for x in value[1:-1].split(",") if x.strip()]
    return None if None in items else items


def _without_comment(line: str) -> str:
    return re.match(r'(?:[^"#]|"[^"]*(?:"|$))*', line)[0].strip()


def read_config(text: str, base: Settings = Settings()) -> Settings:
    """Settings with what the text says. [paths] exclude replaces the default; unknown rules and rulesets are kept, unknown sections and paths are errors."""
    rulesets, rules, severity = dict(base.rulesets), dict(base.rules), dict(base.severity)
    exclude, include, section = base.exclude, base.include, ""
    for number, raw in enumerate(text.splitlines(), 1):

        def need(value, what: str, number: int = number):
            if value is None:
                raise ConfigError(f"line {number}: expected {what}")
            return value

        line = _without_comment(raw)
        if not line:
            continue
        if line.startswith("["):
            if not line.endswith("]"):
                raise ConfigError(f"line {number}: unterminated section header")
            section = line[1:-1].strip().lower()
            continue
        if "=" not in line:
            raise ConfigError(f"line {number}: expected `key = value`")
        key, value = (x.strip() for x in line.split("=", 1))
        if section in ("rulesets", "rules"):
            on = need({"true": True, "false": False}.get(value), "true/false")
            (rulesets if section == "rulesets" else rules)[key.lower() if section == "rulesets" else key.upper()] = on
        elif section == "severity":
            name = need(_string(value), "a string").strip().lower()
            if name not in SEVERITIES:
                raise ConfigError(f"line {number}: expected one of " + ", ".join(f'"{s}"' for s in SEVERITIES))
            severity[key.upper()] = name
        elif section == "paths" and key in ("exclude", "include"):
            listed = tuple(need(_strings(value), "array of strings"))
            exclude, include = (listed, include) if key == "exclude" else (exclude, listed)
        elif section == "paths":
            raise ConfigError(f"line {number}: unknown key `{key}` in [paths]")
        else:
            raise ConfigError(f"line {number}: " + (f"unknown section `[{section}]`" if section else "key outside of a section"))
    return Settings(base.directive, base.product, base.rule_prefix, base.prefilter, base.dead_suppressions, rulesets, rules, severity, base.only_rules, base.only_categories, exclude, include, base.maximum)


def config_template(gitignore: str = "") -> str:
    """A configuration text with every ruleset on and the default and ignored paths excluded."""
    exclude = sorted({"target", ".git", "node_modules", "dist", "build", *gitignore_entries(gitignore)})
    on = "".join(f"{c} = true\n" for c in CATEGORIES)
    listed = ", ".join(f'"{e}"' for e in exclude)
    return f'[rulesets]\n{on}\n[rules]\n# FE003 = false\n\n[severity]\n# FE040 = "critical"\n\n[paths]\nexclude = [{listed}]\ninclude = ["Cargo.toml"]\n'
