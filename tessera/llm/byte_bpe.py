"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

Merges run in tiktoken's core over the same vocabulary: in these files the id of a merged token is its merge's rank.
That is probed when the file is read; if a probe differs, a text holds an added token's string, or the core gives up on
a text (its pattern runs out of stack on about a million blanks in a row), the tokenizers library encodes the text itself."""

from __future__ import annotations

import json
import re
import sys

import numpy as np

from tessera.llm.common import keep

#: Fixed value: the pre-token pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ("", " ", "Hello world", "it's  we're\n\n  x\ty ", "é ü 12345 naïve—“quoted” ...", "a b　c 🙂🙂 \r\n", "Ertionhe thereanly,\nnt. ÇON", "x" * 99 + "  \n")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: printable bytes stand for themselves, the others take the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.core = self._core(spec["model"]["vocab"], set(added)) if sys.byteorder == "little" else None
        if self.core and any(self.ids(p) != self._library(p) for p in PROBES):
            self.core = None

    @staticmethod
    def _core(vocab: dict[str, int], added: set[str]):
        import tiktoken

        letters = byte_alphabet()
        try:
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
            return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids, each as four little-endian bytes."""
        if self.core is None or self.added and self.added.search(text):
            return self._library(text)
        try:
            return self.core.encode_to_numpy(text, disallowed_special=()).tobytes()
        except ValueError:
            return self._library(text)


_loaded: dict[str, ByteBpe] = keep("byte_bpe")


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
