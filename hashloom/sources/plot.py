"""A ROC as a picture: the points with a histogram along each axis, as SVG."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from hashloom.operators.roc import rate_histogram

WIDTH, HEIGHT, MARGIN, BAND = 1024, 768, 60, 100


def plot_roc(rated: DataFrame, path: str) -> int:
    """Writes the picture of a ROC with rates (a row a threshold, so as many as the grid has); the number of points drawn.

    Points with a null rate aren't drawn; an empty ROC gives empty axes.
    """
    points = rated.where("fp_rate is not null and tp_rate is not null").select("fp_rate", "tp_rate").collect()
    bars = rate_histogram(rated).collect()
    most = max([1, *(b.n for b in bars)])
    wide, high = WIDTH - 2 * MARGIN - BAND, HEIGHT - 2 * MARGIN - BAND
    top, bottom = MARGIN + BAND, HEIGHT - MARGIN
    shapes = [f'<circle cx="{MARGIN + p.fp_rate * wide:.1f}" cy="{bottom - p.tp_rate * high:.1f}" r="3"/>' for p in points]
    for b in bars:
        size = b.n / most * (BAND - 10)
        if b.axis == "fp_rate":
            shapes.append(f'<rect x="{MARGIN + b.bin / 100 * wide:.1f}" y="{top - size:.1f}" width="{wide / 100:.1f}" height="{size:.1f}"/>')
        else:
            shapes.append(f'<rect x="{MARGIN + wide:.1f}" y="{bottom - (b.bin + 1) / 100 * high:.1f}" width="{size:.1f}" height="{high / 100:.1f}"/>')
    axes = f'<path d="M{MARGIN} {top}V{bottom}H{MARGIN + wide}" fill="none" stroke="black"/><text x="{MARGIN + wide / 2:.0f}" y="{bottom + 40}">false positive rate</text><text x="10" y="{top - 10}">true positive rate</text>'
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">{axes}{"".join(shapes)}</svg>\n')
    return len(points)
