"""Figures from small results, if matplotlib is there."""

from __future__ import annotations

from pathlib import Path

from seasonspark.functions.names import SLUG

_TABLE = str.maketrans(*SLUG)


def figure_path(folder: str, stem: str, description: str) -> Path:
    """``<folder>/<stem>/<stem>__<description>.png`` with the description as a slug; folders are made."""
    path = Path(folder, stem, f"{stem}__{description.translate(_TABLE)}.png")
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def save_curve(df, x: str, y: str, path: Path, most_points: int = 100_000) -> Path:
    """Draw a relation of checked size."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    rows = df.select(x, y).orderBy(x).limit(most_points + 1).toPandas()
    if len(rows) > most_points:
        raise ValueError(f"more than {most_points} points")
    figure, axes = pyplot.subplots()
    axes.plot(rows[x], rows[y])
    axes.set(xlabel=x, ylabel=y)
    figure.savefig(path, dpi=300, bbox_inches="tight")
    pyplot.close(figure)
    return path
