"""Markdown of small result tables, and artifacts written whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from typing import Any


def percent(value: float | None) -> str:
    return "-" if value is None else f"{value:+.2f}%"


def rupiah(value: float | None) -> str:
    return "-" if value is None else "Rp" + f"{value:,.0f}".replace(",", ".")


def table(rows: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> str:
    """A Markdown table of the given columns."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("-" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines)


def funnel(rows: Sequence[Mapping[str, Any]]) -> str:
    """Statuses with counts and shares, the largest first."""
    total = sum(r["tickers"] for r in rows)
    ordered = sorted(rows, key=lambda r: -r["tickers"])
    return table([{"status": r["status"], "tickers": f"{r['tickers']:,}", "share": f"{r['tickers'] / total * 100 if total else 0:.1f}%"} for r in ordered], ("status", "tickers", "share"))


def facts(title: str, known: Mapping[str, Any]) -> str:
    """A title and a list of named facts."""
    return f"# {title}\n\n" + "\n".join(f"- {name}: {'-' if value is None else value}" for name, value in known.items())


def coverage(known: Mapping[str, Any], result: Mapping[str, Any]) -> str:
    """A profile's report: facts, funnel, reasons, universe, watermarks and rows of all tables, unusable and stale tickers."""
    tables = result["tables"]
    ends = {d: "; ".join(f"{t['table']} {t['max_date']}" for t in tables if t["dataset"] == d and t["max_date"]) or "no dates" for d in sorted({t["dataset"] for t in tables})}
    parts = [
        facts("Coverage", known),
        funnel(result["funnel"]),
        "## Reasons",
        table(sorted(result["reasons"], key=lambda r: (-r["tickers"], r["reason"])), ("reason", "tickers")),
        "## Universe",
        table(result["universe"], ("panel", "tickers")),
        "## Watermarks",
        "\n".join(f"- {d}: {text}" for d, text in ends.items()),
        "## Tables",
        table(tables, ("dataset", "table", "rows", "min_date", "max_date")),
        "## Unusable tickers",
        table(result["unusable"], ("ticker", "reasons", "n_adj", "n_close_only", "n_raw")),
    ]
    if result["stale"]:
        parts += ["## Stale tickers", table(result["stale"], ("place", "ticker", "tail_gap"))]
    return "\n\n".join(parts) + "\n"


def replay(known: Mapping[str, Any], summaries: Sequence[Mapping[str, Any]], reasons: Sequence[Mapping[str, Any]], delta: Mapping[str, int], fees: Sequence[Mapping[str, Any]], buckets: Sequence[Mapping[str, Any]]) -> str:
    """The comparison of the arms: facts, a summary column for each arm, exits with zeros, shared trades, fees, mean bucket sizes."""
    arms = [s["arm"] for s in summaries]
    form = {"win_rate_pct": percent, "mean_ret_pct": percent, "median_ret_pct": percent, "total_net": rupiah, "final_equity": rupiah}
    rows = [{"figure": k} | {s["arm"]: form.get(k, str)(s[k]) for s in summaries} for k in summaries[0] if k != "arm"] if summaries else []
    exits = [{"exit": x} | {a: next((r["trades"] for r in reasons if r["arm"] == a and r["exit_reason"] == x), 0) for a in arms} for x in sorted({r["exit_reason"] for r in reasons})]
    paid = [{"arm": f["arm"]} | {k: rupiah(f[k]) for k in ("net_flat", "net_exact", "difference")} for f in sorted(fees, key=lambda f: f["arm"])]
    parts = [
        facts("Replay", known),
        table(rows, ["figure", *arms]),
        "## Exits",
        table(exits, ["exit", *arms]),
        "## Trades of both arms",
        "\n".join(f"- {k}: {v}" for k, v in sorted(delta.items())),
        "## The same trades under both fee profiles",
        table(paid, ("arm", "net_flat", "net_exact", "difference")),
        "## Tickers of each bucket, mean of a decision date",
        table(sorted(buckets, key=lambda r: (-r["avg_tickers"], r["bucket"])), ("bucket", "avg_tickers")),
    ]
    return "\n\n".join(parts) + "\n"


def write_whole(folder: str, files: Mapping[str, bytes]) -> None:
    """Write files into a folder that appears only when all are on disk; an existing folder is left as it is."""
    if os.path.isdir(folder):
        return
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    os.makedirs(staging)
    for name, data in files.items():
        with open(os.path.join(staging, name), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
    os.rename(staging, folder)
    parent = os.open(os.path.dirname(folder) or ".", os.O_RDONLY)
    try:
        os.fsync(parent)
    finally:
        os.close(parent)
