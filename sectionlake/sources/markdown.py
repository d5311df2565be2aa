"""Markdown and plain text as blocks."""

from __future__ import annotations

import re

from sectionlake.sources import blocks as b
from sectionlake.sources.blocks import Block, Document

#: Fixed patterns of the dialect.
FENCE = re.compile(r"\s*(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")
BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
UNDERLINE = re.compile(r"(?:(={3,})|-{3,})\s*$")
PLAIN_HEADING = re.compile(r"[A-Z0-9][^.!?]{0,58}$")


def _unix(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def prose(raw: str, first: str) -> Block:
    return Block(b.LIST if BULLET.match(first) else b.PARAGRAPH, raw)


def front_matter(lines: list[str]) -> tuple[dict[str, str], int]:
    """Keys and values between --- lines at the start, and the line where the text begins.

    Without a closing line nothing is consumed, but the keys count.
    """
    if lines[0].strip() != "---":
        return {}, 0
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    told = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon:
            told[key.strip().lower()] = value.strip().strip("'\"")
    return told, 0 if end is None else end + 1


class _Reader:
    """Rules tried in order at each line; each returns how many lines it took, or 0."""

    def __init__(self, lines: list[str], start: int):
        self.lines, self.at = lines, start
        self.out: list[Block] = []
        self.held: list[str] = []  # lines of the paragraph so far

    def read(self) -> list[Block]:
        rules = (self.fence, self.atx, self.underlined, self.table, self.blank, self.hold)
        while self.at < len(self.lines):
            line = self.lines[self.at]
            self.at += next(taken for rule in rules if (taken := rule(line)))
        self.release()
        return self.out

    def release(self) -> None:
        if raw := "\n".join(self.held).strip():
            self.out.append(prose(raw, self.held[0]))
        self.held = []

    def emit(self, block: Block, taken: int) -> int:
        self.release()
        self.out.append(block)
        return taken

    def fence(self, line: str) -> int:
        if not (m := FENCE.match(line)):
            return 0
        mark, info = m[1], m[2].split()
        for end in range(self.at + 1, len(self.lines)):
            bare = self.lines[end].strip()
            if len(bare) >= len(mark) and set(bare) == {mark[0]}:
                break
        else:
            end = len(self.lines) - 1
        return self.emit(Block(b.CODE, "\n".join(self.lines[self.at : end + 1]), lang=info[0] if info else ""), end + 1 - self.at)

    def atx(self, line: str) -> int:
        m = ATX.match(line)
        return self.emit(b.heading(len(m[1]), m[2].strip()), 1) if m else 0

    def underlined(self, line: str) -> int:
        if len(self.held) != 1 or not (m := UNDERLINE.match(line)):
            return 0
        text = self.held.pop().strip()
        return self.emit(b.heading(1 if m[1] else 2, text), 1)

    def table(self, line: str) -> int:
        below = self.lines[self.at + 1] if self.at + 1 < len(self.lines) else ""
        if "|" not in line or "|" not in below or not RULE.match(below):
            return 0
        rows = []
        for row in self.lines[self.at + 2 :]:
            if "|" not in row:
                break
            rows.append(row.rstrip())
        return self.emit(b.table(line.rstrip(), below.rstrip(), rows), 2 + len(rows))

    def blank(self, line: str) -> int:
        if line.strip():
            return 0
        self.release()
        return 1

    def hold(self, line: str) -> int:
        self.held.append(line)
        return 1


def parse_markdown(text: str, stem: str = "") -> Document:
    """Blocks of a Markdown text; the title is the front matter's, else the first top heading, else the stem."""
    lines = _unix(text).split("\n")
    told, start = front_matter(lines)
    found = _Reader(lines, start).read()
    first = next((x.text for x in found if x.kind == b.HEADING and x.level == 1), "")
    return Document(told.get("title") or first or stem, found, told)


def parse_plain(text: str, stem: str = "") -> Document:
    """Paragraphs between blank lines; a short line by itself that starts with a capital or digit is a heading."""
    found: list[Block] = []
    for chunk in re.split(r"\n\s*\n", _unix(text)):
        chunk = chunk.strip("\n")
        bare = chunk.strip()
        if not bare:
            continue
        if "\n" not in chunk and PLAIN_HEADING.match(bare) and bare[-1] != ":":
            found.append(b.heading(2, bare))
        else:
            found.append(prose(bare, chunk.split("\n", 1)[0]))
    return Document(next((x.text for x in found if x.kind == b.HEADING), "") or stem, found, {})
