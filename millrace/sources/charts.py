"""Small SVG charts of collected summaries."""

from __future__ import annotations

from html import escape


def _svg(width: int, height: int, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="12">{body}</svg>'


def state_bars(rows: list[dict]) -> str:
    """One bar per (signal, state), as long as its percentage."""
    line, left, full = 22, 220, 400
    body = []
    for i, r in enumerate(rows):
        y, w = 10 + i * line, full * float(r["percentage"]) / 100
        body.append(f'<text x="{left - 8}" y="{y + 13}" text-anchor="end">{escape(str(r["signal"]))} = {r["state"]}</text><rect x="{left}" y="{y}" width="{w:.2f}" height="16" fill="#3b6ea5"/><text x="{left + w + 6:.2f}" y="{y + 13}">{float(r["percentage"]):.2f} %</text>')
    return _svg(left + full + 90, 20 + line * len(rows), "".join(body))


def quantile_strips(rows: list[dict]) -> str:
    """One strip per signal from minimum to maximum, the middle half thick, the median marked."""
    line, left, full = 28, 160, 460
    body = []
    for i, r in enumerate(rows):
        lo, hi = float(r["minimum"]), float(r["maximum"])
        x = lambda v: left + (full * (float(v) - lo) / (hi - lo) if hi > lo else full / 2)  # noqa: B023, E731
        y = 20 + i * line
        body.append(
            f'<text x="{left - 8}" y="{y + 4}" text-anchor="end">{escape(str(r["signal"]))}</text><line x1="{left}" x2="{left + full}" y1="{y}" y2="{y}" stroke="#999"/>'
            f'<rect x="{x(r["q25"]):.2f}" y="{y - 6}" width="{max(1.0, x(r["q75"]) - x(r["q25"])):.2f}" height="12" fill="#3b6ea5"/><line x1="{x(r["q50"]):.2f}" x2="{x(r["q50"]):.2f}" y1="{y - 9}" y2="{y + 9}" stroke="#000" stroke-width="2"/>'
        )
    return _svg(left + full + 30, 30 + line * len(rows), "".join(body))
