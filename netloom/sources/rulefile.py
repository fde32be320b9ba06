"""Rules from a YAML file, with reload when the file changes."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from netloom.operators.rules import Rule, default_rules, parse_rules, rules_frame

log = logging.getLogger(__name__)


def load_rules(path: str) -> list[Rule]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse_rules((yaml.safe_load(f) or {}).get("rules", []))


def save_rules(path: str, rules: Sequence[Rule]) -> None:
    import yaml

    body = [
        dict(id=r.id, name=r.name, description=r.description, severity=r.severity, enabled=r.enabled, tags=list(r.tags),
             conditions=[dict(field=c.field, op=c.op, value=c.value) for c in r.conditions])
        for r in rules
    ]
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"rules": body}, f, allow_unicode=True, sort_keys=False)


def rules_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    return rules_frame(spark, load_rules(path) if path else default_rules())


class RuleFile:
    """The rules of a file. :meth:`current` reads again when the file changed; if that fails, the
    last good set stays."""

    def __init__(self, path: str):
        self.path = path
        self._stamp: float | None = None
        self._rules: list[Rule] = []
        self.reload()

    def _mtime(self) -> float | None:
        import os

        try:
            return os.path.getmtime(self.path)
        except OSError:
            return None

    def reload(self) -> bool:
        stamp = self._mtime()
        try:
            self._rules = load_rules(self.path)
        except Exception as error:  # a broken file must not stop detection
            log.error("rules not reloaded from %s: %s", self.path, error)
            return False
        self._stamp = stamp
        return True

    def current(self) -> list[Rule]:
        if self._mtime() not in (None, self._stamp):
            self.reload()
        return self._rules

    @property
    def rule_count(self) -> int:
        return len(self._rules)

    @property
    def enabled_count(self) -> int:
        return sum(r.enabled for r in self._rules)
