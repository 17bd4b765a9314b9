"""What an extractor yields, and helpers for positions (lines and columns from 0, columns and offsets in bytes)."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Item:
    """A definition, import or reference; ``kind`` says which."""

    kind: str
    type: str
    name: str
    fqn: str
    start: int
    end: int
    scope: str = ""
    path: str = ""
    alias: str = ""
    receiver: str = ""
    extra: dict[str, str] = field(default_factory=dict)


class Positions:
    """Byte offsets, lines and columns of character offsets in one text."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        self.bytes = None
        if not self.ascii:
            at, self.bytes = 0, [0]
            for c in text:
                at += len(c.encode("utf-8", "surrogatepass"))
                self.bytes.append(at)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def byte(self, i: int) -> int:
        return i if self.ascii else self.bytes[i]

    def at(self, i: int) -> tuple[int, int]:
        line = bisect_right(self.lines, i) - 1
        return line, self.byte(i) - self.byte(self.lines[line])
