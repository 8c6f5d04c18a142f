"""What to do with a table, as plain data."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from .functions.rules import rule_key

Condition = tuple[str, str, Any]


@dataclass(frozen=True)
class IgnoreRule:
    conditions: tuple[Condition, ...] = ()
    operation: str = "or"

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any] | None, default: str) -> IgnoreRule:
        raw = raw or {}
        found = tuple((c["name"], c["condition"], c["value"]) for c in raw.get("columns", ()))
        return cls(found, raw.get("operation", default))


@dataclass(frozen=True)
class ColumnRule:
    column: str
    rule: str
    mask: str | None = None
    is_phi: bool = True
    ignore: IgnoreRule = field(default_factory=lambda: IgnoreRule(operation="and"))

    @property
    def key(self) -> str:
        return rule_key(self.rule)

    @property
    def patient_kind(self) -> str | None:
        """``PATIENT_<KIND>`` names the identifier kind the column holds."""
        upper = self.rule.upper()
        return upper.removeprefix("PATIENT_").lower() if upper.startswith("PATIENT_") else None


@dataclass(frozen=True)
class TableSpec:
    name: str
    rules: tuple[ColumnRule, ...] = ()
    row_id: str = "row_id"
    keys: tuple[str, ...] = ()
    ignore_rows: IgnoreRule = field(default_factory=IgnoreRule)
    reference: Mapping[str, Any] | None = None

    @property
    def phi_rules(self) -> list[ColumnRule]:
        return [r for r in self.rules if r.is_phi]

    def columns_with(self, key: str) -> list[str]:
        return [r.column for r in self.phi_rules if r.key == key]

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        raw = json.loads(text)
        rules = tuple(
            ColumnRule(
                c["column_name"],
                c.get("de_identification_rule") or "",
                c.get("mask_value"),
                bool(c.get("is_phi", False)),
                IgnoreRule.from_dict(c.get("ignore_column"), "and"),
            )
            for c in raw.get("columns_details", ())
        )
        return cls(
            raw["table_name"],
            rules,
            raw.get("row_id", "row_id"),
            tuple(raw.get("keys", ())),
            IgnoreRule.from_dict(raw.get("ignore_rows"), "or"),
            raw.get("reference_mapping"),
        )

    @classmethod
    def from_sheet(cls, rows: Iterable[Mapping[str, str]]) -> dict[str, TableSpec]:
        """One row per (TABLE_NAME, COLUMN_NAME, IS_PHI, DE_IDENTIFICATION_RULE, MASK_VALUE)."""
        found: dict[str, list[ColumnRule]] = {}
        for row in rows:
            phi = (row.get("IS_PHI") or "").strip().lower() in ("yes", "true", "1")
            rule = ColumnRule(row["COLUMN_NAME"], (row.get("DE_IDENTIFICATION_RULE") or "").strip(), row.get("MASK_VALUE") or None, phi)
            found.setdefault(row["TABLE_NAME"], []).append(rule)
        return {t: cls(t, tuple(rules)) for t, rules in found.items()}


def key_columns(text: str) -> Sequence[str]:
    """``a|b`` as a composite key."""
    return [part.strip() for part in text.split("|") if part.strip()]
