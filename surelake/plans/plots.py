"""Reliability diagrams as SVG, from the few points that a report has of each signal."""

from __future__ import annotations

from xml.sax.saxutils import escape

_SIDE, _GAP, _TOP = 200, 60, 60


def _panel(left: int, title: str, points: list, facts: str) -> list[str]:
    """One signal: the diagonal of perfect calibration, and accuracy over mean confidence of its bins, larger where they have more rows."""
    x = lambda v: round(left + v * _SIDE, 1)
    y = lambda v: round(_TOP + (1 - v) * _SIDE, 1)
    out = [
        f'<rect x="{left}" y="{_TOP}" width="{_SIDE}" height="{_SIDE}" fill="none" stroke="#999"/>',
        f'<text x="{left + _SIDE / 2}" y="{_TOP - 24}" text-anchor="middle">{escape(title.replace("_", " "))}</text>',
        f'<text x="{left + _SIDE / 2}" y="{_TOP - 8}" text-anchor="middle" fill="#555">{escape(facts)}</text>',
        f'<text x="{left + _SIDE / 2}" y="{_TOP + _SIDE + 34}" text-anchor="middle">mean confidence</text>',
        *(f'<text x="{x(v)}" y="{_TOP + _SIDE + 16}" text-anchor="middle" fill="#555">{v:g}</text>' for v in (0.0, 0.5, 1.0)),
    ]
    if not points:
        return [*out, f'<text x="{x(0.5)}" y="{y(0.5)}" text-anchor="middle">no scorable rows</text>']
    most = max(p["count"] for p in points)
    places = [(x(p["mean_confidence"]), y(p["accuracy"]), round(2 + 5 * (p["count"] / most) ** 0.5, 1)) for p in points]
    return [
        *out, f'<line x1="{x(0)}" y1="{y(0)}" x2="{x(1)}" y2="{y(1)}" stroke="#999" stroke-dasharray="4 4"/>',
        f'<polyline points="{" ".join(f"{a},{b}" for a, b, _ in places)}" fill="none" stroke="#1f77b4"/>', *(f'<circle cx="{a}" cy="{b}" r="{r}" fill="#1f77b4"/>' for a, b, r in places),
    ]


def reliability_svg(title: str, panels: list[tuple[str, list, str]]) -> str:
    """A diagram for each (signal, points with mean_confidence, accuracy and count in order of their bins, facts)."""
    width, height = _GAP + len(panels) * (_SIDE + _GAP), _TOP + _SIDE + 60
    body = [line for k, (signal, points, facts) in enumerate(panels) for line in _panel(_GAP + k * (_SIDE + _GAP), signal, points, facts)]
    axis = f'<text x="18" y="{_TOP + _SIDE / 2}" text-anchor="middle" transform="rotate(-90 18 {_TOP + _SIDE / 2})">accuracy</text>'
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12"><title>{escape(title)}</title>'
    return "\n".join([head, f'<text x="{_GAP}" y="18" font-size="14">{escape(title)}</text>', axis, *body, "</svg>"]) + "\n"
