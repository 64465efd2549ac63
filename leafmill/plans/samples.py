"""Sample documents made of drawing operations: an invoice, and a report of several pages."""

from __future__ import annotations

from ..codec.draw import width_of

A4 = (595.0, 842.0)
Page = tuple[float, float, list]


def _row(ops: list, y: float, cells: list[tuple[float, str, bool]], font: str, size: float) -> None:
    """Texts of a row, each to the right of its place, or to the left of it."""
    ops.append(("font", [size], font))
    for x, text, to_left in cells:
        ops.append(("text", [x - width_of(text, font, size) if to_left else x, y], text))


def invoice_page(lines: tuple[tuple[str, int, float], ...] = (("Copper pipe 15 mm", 12, 3.4), ("Basin tap, chrome", 2, 54.25), ("Isolating valve", 6, 4.1)), number: str = "INV-0001") -> Page:
    """A page with a band, a table of lines, and its total."""
    ops: list = [("fill", [0, 770, A4[0], 72, 0.16, 0.3, 0.48], None), ("color", [1, 1, 1], None)]
    _row(ops, 798, [(40, "Invoice", False), (555, number, True)], "Helvetica-Bold", 22)
    ops.append(("color", [0, 0, 0], None))
    places = ((40, False), (360, True), (450, True), (555, True))
    _row(ops, 720, [(x, t, left) for (x, left), t in zip(places, ("Item", "Quantity", "Price", "Amount"), strict=True)], "Helvetica-Bold", 11)
    ops.append(("line", [40, 712, 555, 712, 0.8], None))
    y = 692.0
    for item, quantity, price in lines:
        cells = (item, str(quantity), f"{price:.2f}", f"{quantity * price:.2f}")
        _row(ops, y, [(x, t, left) for (x, left), t in zip(places, cells, strict=True)], "Helvetica", 11)
        y -= 20
    ops.append(("line", [360, y + 10, 555, y + 10, 0.8], None))
    _row(ops, y - 8, [(450, "Total", True), (555, f"{sum(q * p for _, q, p in lines):.2f}", True)], "Helvetica-Bold", 11)
    return (*A4, ops)


def report_pages(title: str = "Quarterly report", sections: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = (("Sales by region", (("North", 42.0), ("South", 31.5), ("East", 18.2), ("West", 27.9))), ("Returns by cause", (("Damaged", 6.1), ("Wrong item", 3.4), ("Late", 2.2))))) -> list[Page]:
    """A title page, a page with a bar chart for each section, and page numbers."""
    out: list[Page] = [(*A4, [("font", [28.0], "Times-Bold"), ("text", [(A4[0] - width_of(title, "Times-Bold", 28)) / 2, 520], title)])]
    for name, bars in sections:
        ops: list = []
        _row(ops, 780, [(40, name, False)], "Times-Bold", 18)
        most = max(v for _, v in bars)
        for i, (label, value) in enumerate(bars):
            y = 720.0 - 40 * i
            _row(ops, y + 4, [(150, label, True)], "Times-Roman", 12)
            ops.append(("fill", [160, y, 320 * value / most, 20, 0.35, 0.55, 0.75], None))
            ops.append(("rect", [160, y, 320, 20], None))
            _row(ops, y + 4, [(550, f"{value:.1f}", True)], "Times-Roman", 12)
        out.append((*A4, ops))
    for i, (_, _, ops) in enumerate(out):
        _row(ops, 30, [(555, f"{i + 1} / {len(out)}", True)], "Times-Roman", 9)
    return out
