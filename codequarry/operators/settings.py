"""What a scan can be told."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """directive: the word in a comment that suppresses rules; product: the crate whose calls count as product code; rule_prefix: two letters of rule ids."""

    directive: str = "scan-ignore"
    product: str = "product"
    rule_prefix: str = "FE"
    prefilter: bool = True
    dead_suppressions: str = "pipeline"  # or "rescan"
    rulesets: dict[str, bool] = field(default_factory=dict)
    rules: dict[str, bool] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)
    only_rules: tuple[str, ...] = ()
    only_categories: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("target", ".git")
    include: tuple[str, ...] = ()
    maximum: bool = False  # every rule, whatever the toggles, without the prefilter
