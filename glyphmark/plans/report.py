"""A run's report in Markdown: rolled-up tables of a few rows, never rows per image."""

from __future__ import annotations

from pyspark.sql import DataFrame

MISSING, MAX_ROWS = "—", 10_000


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    """Columns padded to their widest cell; nothing is cut."""
    table = [headers, *rows]
    widths = [max(len(cells[i]) for cells in table) for i in range(len(headers))]
    out = [[cell.ljust(w) for cell, w in zip(cells, widths, strict=True)] for cells in table]
    out.insert(1, ["-" * w for w in widths])
    return "\n".join(f"| {' | '.join(cells)} |" for cells in out)


def cell(value) -> str:
    if value is None:
        return MISSING
    text = f"{value:.4f}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def sections(title: str, facts: dict, tables: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """A heading, the run's facts, and a section a table, sorted by its first column.  Takes only
    roll-ups: a table of more than MAX_ROWS is refused, not cut."""
    parts = [f"# {title}", "\n".join(f"- {k}: {cell(v)}" for k, v in facts.items())]
    for name, df in tables.items():
        rows = df.orderBy(df.columns[0]).limit(MAX_ROWS + 1).collect()
        if len(rows) > MAX_ROWS:
            raise ValueError(f"{name}: a report takes roll-ups of at most {MAX_ROWS} rows")
        note = f"{notes[name]}\n\n" if notes and name in notes else ""
        parts.append(f"## {name}\n\n{note}{markdown_table(df.columns, [[cell(v) for v in r] for r in rows])}")
    return "\n\n".join(parts) + "\n"
