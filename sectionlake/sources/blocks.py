"""The block stream between parsing and sectioning."""

from __future__ import annotations

from typing import NamedTuple

HEADING, PARAGRAPH, LIST, CODE, TABLE = "heading", "paragraph", "list", "code", "table"


class Block(NamedTuple):
    """One block; `raw` is its text in a section. Tables keep header, separator and rows apart."""

    kind: str
    raw: str
    level: int = 0
    text: str = ""
    lang: str = ""
    header: str = ""
    separator: str = ""
    rows: tuple[str, ...] = ()


class Document(NamedTuple):
    title: str
    blocks: list[Block]
    front_matter: dict[str, str]


def heading(level: int, text: str) -> Block:
    return Block(HEADING, f"{'#' * level} {text}", level=level, text=text)


def table(header: str, separator: str, rows) -> Block:
    rows = tuple(rows)
    return Block(TABLE, "\n".join((header, separator) + rows), header=header, separator=separator, rows=rows)


def pipe_table(cells: list[list[str]]) -> Block | None:
    """A pipe table from rows of cell texts; None for fewer than two rows that aren't blank."""
    clean = [[" ".join(c.split()).replace("|", "\\|") for c in row] for row in cells]
    clean = [row for row in clean if any(row)]
    if len(clean) < 2:
        return None
    width = max(map(len, clean))
    drawn = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in clean]
    return table(drawn[0], "|" + "---|" * width, drawn[1:])
