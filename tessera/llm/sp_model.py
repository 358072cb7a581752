"""A SentencePiece model file: its protobuf, read field by field, and cuts of texts that no piece spans."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = "▁"
# Types of pieces and of models in the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: varints as ints, the other wire types as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class SpModel:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool

    @classmethod
    def load(cls, path: str) -> SpModel:
        pieces, scores, types, trainer, normaliser = [], [], [], {}, {}
        with open(path, "rb") as f:
            data = f.read()
        for n, value in fields(data):
            if n == 1:
                p = dict(fields(value))
                pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                types.append(p.get(3, NORMAL))
            elif n == 2:
                trainer = dict(fields(value))
            elif n == 3:
                normaliser = dict(fields(value))
        return cls(
            pieces, scores, types, trainer.get(3, UNIGRAM), trainer.get(40, 0), bool(trainer.get(35, 0)),
            normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        )

    @property
    def plain(self) -> bool:
        """Normalising only adds the marker in front and puts it for blanks, and no piece spans a cut of segments()."""
        spans = re.compile(f"[^{SPACE}]{SPACE}|\n")
        return not self.charsmap and self.add_dummy_prefix and not self.remove_extra_whitespaces and self.escape_whitespaces and not any(map(spans.search, self.pieces))


RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def segments(text: str) -> list[str]:
    """The normalised text in parts that are tokenised each by itself: it is cut before a marker that follows another character, and on both sides of a new line."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return RUNS.findall(SPACE + text.replace(" ", SPACE))
    out = []
    for k, line in enumerate(text.split("\n")):
        head, *rest = line.split(" ")
        if k:
            out.append("\n")
        head = head if k else SPACE + head
        if head:
            out.append(head)
        out += [SPACE + w for w in rest]
    return out
