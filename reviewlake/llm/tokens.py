"""Ids of whole texts by the tokenizers library, with the work on repeated words shared.

A byte-level BPE first cuts a text into words, and a space before a character
that is no white space always starts a new word; a single line feed is a word of its
own. So the ids of a text are those of its pieces in a row, and a piece that came
before needs no second run of the library. Texts where that cut would not be
safe (runs of white space, added tokens spelled out) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Pieces that a Python worker remembers, the first that it meets; later new ones are encoded each time.
MEMO = 800_000
_LONGEST = 48  # characters of a remembered piece
_RUN = re.compile(r"\s\s")
_BARE = "\x01"  # marks a piece that no space leads
# A word of Latin letters that a run of ASCII marks (no apostrophe) may follow: the tokenizer
# takes the letters and the run for one word each, so the model alone gives the letters' ids.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]{0,8})")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding", "post_processor")))
        self.memo_size = memo
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.packed = [_packed([k]) for k in range(self.library.get_vocab_size())]
        self.marks: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {_BARE: b"", "\n": self._whole("\n")}

    def _whole(self, text: str) -> bytes:
        return _packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._whole(mark)
            if len(self.marks) < 10_000:
                self.marks[mark] = ids
        return ids

    def _word(self, spelled: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def _piece(self, key: str) -> bytes:
        """The ids of a piece that the memory does not hold."""
        if key.isascii() and key.isalpha():  # led by a space; ASCII letters spell themselves
            out = self._word(self.space + key)
        else:
            led = key[:1] != _BARE
            m = _WORD.fullmatch(key, not led)
            if m is None:
                out = self._whole(" " + key if led else key[1:])
            else:
                word, mark = m.groups()
                # the tokenizer takes all marks as one word, so only the bare word may come from the memory
                out = self.memo.get(key[:-len(mark)]) if mark else None
                if out is None:
                    out = self._word((" " + word if led else word).encode().decode("latin-1").translate(self.letters))
                if mark:
                    out += self._mark(mark)
        if len(self.memo) < self.memo_size and len(key) <= _LONGEST:
            self.memo[key] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_word or _BARE in text or _RUN.search(text) or any(a in text for a in self.added):
            return self._whole(text)
        keys = (_BARE + text.replace("\n", " \n " + _BARE)).split(" ")
        parts = list(map(self.memo.get, keys))
        if None in parts:
            parts = [self._piece(k) if p is None else p for k, p in zip(keys, parts, strict=True)]
        return b"".join(parts)


@lru_cache(maxsize=4)
def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path, memo)
