"""One JSON document of many report sections."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from rivulet.sources.files import json_document


@dataclass
class Section:
    """Rows of a report in an order that decides which are shown; `headline` makes a text of them."""

    rows: DataFrame
    order: list[Column | str]
    most: int = 50
    headline: Callable[[list[dict]], str] | None = None


def assemble(sections: Mapping[str, Section | None], live: Mapping[str, object] | None = None) -> dict:
    """The document: a section's first rows, whether more were left out, and its headline.

    The order and the limit are one top-k in Spark; `most` rows of a section come
    to the driver. A section without data is listed as missing. What a live
    snapshot says is taken only where the reports say nothing.
    """
    out: dict[str, dict] = {}
    for name, s in sections.items():
        if s is None:
            out[name] = {"status": "missing"}
            continue
        rows = [r.asDict(recursive=True) for r in s.rows.orderBy(*s.order).limit(s.most + 1).collect()]
        if not rows:
            out[name] = {"status": "missing"}
            continue
        shown = rows[: s.most]
        out[name] = {"status": "ok", "rows": shown, "truncated": len(rows) > s.most, "headline": s.headline(shown) if s.headline else None}
    for name, value in (live or {}).items():
        if out.get(name, {"status": "missing"})["status"] == "missing":
            out[name] = {"status": "live", "rows": value}
    return out


def document(sections: Mapping[str, Section | None], live: Mapping[str, object] | None = None) -> str:
    return json_document(assemble(sections, live))
