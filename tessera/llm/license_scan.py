"""License scans by template-markup matching.

A template (see license_templates) is license wording with marked regions: optional ones, which a text may leave out,
choices, of which one must stand there, and replaceable ones, where up to a given number of words may stand (names,
years). Each template is compiled once into an automaton over tokens; a place in a text is accepted when the automaton
reaches its end, so all mandatory wording must be there, word for word and in order. From one start the longest
accepted place counts; spans of one label don't overlap. A place directly after a word of denial isn't accepted.

Beside the templates, short base phrases are counted at every place where their words stand consecutively.

Nulls and edges: a null or empty text has no words, null places, no labels and score 0; texts are scanned whole at any
length; equal texts get equal values; repeated rows, null ids and further columns pass through; an empty table gives
an empty result."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, prepare
from tessera.llm.license_templates import DENIED_BY, TEMPLATES

# Base phrases and the labels that they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Score of a document with base phrases alone, and with an accepted template.
SCORE_BASE, SCORE_TEMPLATE = 0.5, 1.0

#: Bytes that belong to words (as in [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became a-z); all others become blanks.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


DENIALS = frozenset(w.encode() for w in DENIED_BY)


@dataclass(frozen=True)
class Automaton:
    """step[state][word] and step[state][None] (any word) are the next states, skips already followed; start: the states of no word read."""

    label: str
    step: tuple[dict[bytes | None, frozenset[int]], ...]
    start: frozenset[int]
    end: int
    anchor: bytes

    @functools.cached_property
    def first(self) -> frozenset[bytes]:
        return frozenset(w for s in self.start for w in self.step[s] if w is not None)

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted place from word `at` on; -1 if there is none."""
        states, found = self.start, -1
        for k in range(at, len(words)):
            states = frozenset().union(*(self.step[s].get(w, ()) for s in states for w in (words[k], None)))
            if not states:
                break
            if self.end in states:
                found = k + 1
        return found


def compile_template(label: str, markup: str) -> Automaton:
    """States are numbered as they are made; `skip` edges always lead to a later one: past an optional region or the rest of a replaceable one, into a choice and out of it."""
    moves: list[tuple[int, bytes | None, int]] = []
    skips: list[tuple[int, int]] = []
    opened: list[tuple[str, int, list[int]]] = []
    at, last, mandatory = 0, 0, []
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup.lower()):
        if token in ("<<opt>>", "<<one>>"):
            opened.append((token, at, []))
        elif token in ("<<or>>", "<<end>>"):
            if not opened or token == "<<or>>" and opened[-1][0] != "<<one>>":
                raise ValueError(f"template {label}: {token} has no region")
            kind, begin, ends = opened[-1]
            ends.append(at)
            last += 1
            if token == "<<or>>":
                skips.append((begin, last))
            else:
                opened.pop()
                skips += [(s, last) for s in ends + [begin] * (kind == "<<opt>>")]
            at = last
        else:
            m = re.fullmatch(r"<<any (\d+)>>", token)
            begin = at
            for _ in range(int(m[1]) if m else 1):
                last += 1
                moves.append((at, None if m else token.encode(), last))
                at = last
            if m:
                skips += [(s, at) for s in range(begin, at)]
            elif not opened:
                mandatory.append(token.encode())
    if opened or not mandatory:
        raise ValueError(f"template {label}: a region is open or no wording is mandatory")

    onward: dict[int, set[int]] = {}
    for s in range(last, -1, -1):
        onward[s] = {s}.union(*(onward[b] for a, b in skips if a == s))
    step: list[dict[bytes | None, frozenset[int]]] = [{} for _ in range(last + 1)]
    for a, word, b in moves:
        step[a][word] = step[a].get(word, frozenset()) | frozenset(onward[b])
    if any(None in step[s] for s in onward[0]) or at in onward[0]:
        raise ValueError(f"template {label} must begin with a word")
    return Automaton(label, tuple(step), frozenset(onward[0]), at, max(mandatory, key=len))


def compiled() -> list[Automaton]:
    return [compile_template(label, markup) for label, markup in TEMPLATES]


def find_places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase stands in words that are joined by single blanks, with one at each end."""
    out, word, counted = [], 0, 0
    at = padded.find(b" " + phrase + b" ")
    while at >= 0:
        word += padded.count(b" ", counted, at)
        counted = at
        out.append(word)
        at = padded.find(b" " + phrase + b" ", at + 1)
    return out


def widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans, the one that starts first, and of those the longest."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def scan_text(text: str | None, automata: list[Automaton]) -> dict:
    plain = (text or "").encode().translate(WORD_BYTES)
    words = plain.split()
    base: list[tuple[int, str]] = []
    if any(p.split()[0].encode() in plain for p in PHRASES):
        padded = b" " + b" ".join(words) + b" "
        base = [(k, label) for phrase, label in PHRASES.items() for k in find_places(padded, phrase.encode())]
    likely = [a for a in automata if a.anchor in plain]
    firsts = frozenset().union(*(a.first for a in likely))
    starts = [k for k, w in enumerate(words) if w in firsts and not (k and words[k - 1] in DENIALS)] if likely else []
    found: dict[str, list[tuple[int, int]]] = {}
    for a in likely:
        first, reach = a.first, 0
        for k in starts:
            if k >= reach and words[k] in first and (end := a.longest(words, k)) > k:
                found.setdefault(a.label, []).append((k, end))
                reach = end
    spans = [(k, end, label) for label, own in found.items() for k, end in widest(own)]
    places = [k for k, _ in base]
    own = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(own)),
        "labels": ",".join(sorted(own | {label for *_, label in spans})),
        "score": SCORE_TEMPLATE if spans else SCORE_BASE if base else 0.0,
        "spans": [{"first": a, "end": b, "label": label} for a, b, label in sorted(spans)],
    }


TYPES = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])),
}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with counts, places, labels, score, and the spans of words that templates accept."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled()
        for batch in batches:
            found = [scan_text(t.as_py(), automata) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in TYPES.items())], [id_col, *TYPES])

    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {SCHEMA}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
