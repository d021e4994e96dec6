"""Task parameters of the batch jobs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass


def _values(raw) -> tuple[str, ...]:
    """A comma list, an iterable or nothing; empty entries carry no restriction."""
    if raw is None:
        return ()
    parts: Iterable = raw.split(",") if isinstance(raw, str) else raw
    return tuple(p for p in (str(v).strip() for v in parts) if p)


def _int(raw) -> int | None:
    return None if raw is None or raw == "" else int(raw)


@dataclass(frozen=True)
class TaskParams:
    """``None`` or an empty list means "no restriction"."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    sex: str | None = None
    keywords: tuple[str, ...] = ()
    category_ids: tuple[int, ...] = ()
    target_page_flow: tuple[int, ...] = ()

    @classmethod
    def from_dict(cls, raw: Mapping) -> TaskParams:
        """Reads the camelCase parameter names of a task description."""
        return cls(
            start_date=raw.get("startDate") or None,
            end_date=raw.get("endDate") or None,
            start_age=_int(raw.get("startAge")),
            end_age=_int(raw.get("endAge")),
            professionals=_values(raw.get("professionals")),
            cities=_values(raw.get("cities")),
            sex=raw.get("sex") or None,
            keywords=_values(raw.get("keywords")),
            category_ids=tuple(int(v) for v in _values(raw.get("categoryIds"))),
            target_page_flow=tuple(int(v) for v in _values(raw.get("targetPageFlow"))),
        )

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        return cls.from_dict(json.loads(text))
