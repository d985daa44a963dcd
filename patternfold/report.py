"""Explanations as columns, and reports of a few collected rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternfold.operators.memory import id_number

#: Rows shown in each section of a report, and items of a list in a card.
CAPS = {"patterns": 20, "anomalies": 20, "matches": 10, "predictions": 5}
FEATURES, ITEMS = 6, 10


def explain_pattern() -> Column:
    return F.format_string("Pattern %s: %s seen %d time(s) at %d place(s), confidence %.2f.", "id", "type", "frequency", F.size("occurrences"), "confidence")


def explain_match() -> Column:
    return F.format_string("Row %d matches pattern %s by %.1f%%.", "idx", "id", F.col("similarity") * 100)


def explain_anomaly() -> Column:
    head = F.format_string("Row %d is an anomaly of kind %s, score %.2f", "idx", "kind", "score")
    return F.concat(head, F.when(F.col("kind") == "statistical", F.format_string(", z=%.2f", "z")).otherwise(""), F.lit("."))


def explain_prediction() -> Column:
    return F.format_string("Next: %s (%.1f%%).", "next", F.col("probability") * 100)


@dataclass
class Result:
    """What a call of the engine found; each part is a DataFrame or None."""

    patterns: DataFrame | None = None
    anomalies: DataFrame | None = None
    predictions: DataFrame | None = None
    matches: DataFrame | None = None
    evidence: dict | None = None

    def to_dict(self, limit: int | None = None) -> dict:
        return {k: [r.asDict(True) for r in rows] for k, (_, rows) in sections(self, limit).items()}


def cap(section: str, limit: int | None) -> int:
    return CAPS[section] if limit is None else max(0, min(limit, CAPS[section]))


def _order(name: str, df: DataFrame) -> DataFrame:
    if name == "patterns":
        return df.orderBy(id_number(F.col("id")), "id")
    if name == "anomalies":
        return df.orderBy("idx", "kind")
    return df.orderBy(F.desc("similarity"), "id") if name == "matches" else df


def sections(result: Result, limit: int | None = None) -> dict[str, tuple[int, list]]:
    """Rows in all, and the rows shown, of each section."""
    out = {}
    for name in CAPS:
        df = getattr(result, name)
        out[name] = (0, []) if df is None else (df.count(), _order(name, df).limit(cap(name, limit)).collect())
    return out


def _cell(x) -> str:
    return ("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)).replace("|", "\\|").replace("\n", " ")


def _listed(items: list) -> str:
    more = len(items) - ITEMS
    return ", ".join(_cell(x) for x in items[:ITEMS]) + (f" +{more} more" if more > 0 else "")


def pattern_card(row: dict) -> str:
    """A pattern as Markdown."""
    features = sorted((row.get("features") or {}).items())
    follow = sorted(((row.get("relationships") or {}).get("followed_by") or {}).items(), key=lambda x: (-x[1], x[0]))
    lines = [
        f"### {row.get('id')} ({row.get('type')})", "",
        f"- state {row.get('state')}, frequency {row.get('frequency')}, confidence {_cell(row.get('confidence'))}",
        f"- features: {', '.join(f'{k}={_cell(v)}' for k, v in features[:FEATURES]) or 'none'}" + (f" +{len(features) - FEATURES} more" if len(features) > FEATURES else ""),
        f"- sequence: {_listed(row.get('sequence') or []) or 'none'}", f"- occurrences ({len(row.get('occurrences') or [])}): {_listed(row.get('occurrences') or []) or 'none'}",
        f"- followed by: {_listed([f'{k} ({v:.2f})' for k, v in follow]) or 'none'}",
    ]
    return "\n".join(lines) + "\n"


def render_markdown(result: Result, limit: int | None = None) -> str:
    found = sections(result, limit)
    out = ["# Pattern report", "", "Summary: " + ", ".join(f"{n} {k}" for k, (n, _) in found.items()) + ".", ""]
    for name, (n, rows) in found.items():
        out += [f"## {name.capitalize()} ({n})", ""]
        if name == "patterns":
            out += [pattern_card(r.asDict(True)) for r in rows] or ["None.", ""]
        elif rows:
            names = [c for c in rows[0].asDict() if c not in ("occurrences", "features")]
            out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(_cell(r[c]) for c in names) + " |" for r in rows), ""]
        else:
            out += ["None.", ""]
        if n > len(rows):
            out += [f"+{n - len(rows)} more", ""]
    return "\n".join(out).rstrip() + "\n"


def render_text(result: Result, limit: int | None = None) -> str:
    """The report without Markdown signs."""
    found = sections(result, limit)
    out = ["Pattern report", "", "Summary: " + ", ".join(f"{n} {k}" for k, (n, _) in found.items()) + "."]
    for name, (n, rows) in found.items():
        out += ["", f"{name.capitalize()} ({n}):"]
        out += ["  " + ", ".join(f"{k} {_listed(v) if isinstance(v, list) else _cell(v)}" for k, v in r.asDict(True).items() if not isinstance(v, dict)) for r in rows] or ["  none"]
        if n > len(rows):
            out.append(f"  +{n - len(rows)} more")
    return "\n".join(out) + "\n"


def summarise(result: Result) -> str:
    return "Result: " + ", ".join(f"{n} {k}" for k, (n, _) in sections(result, 0).items()) + "."
