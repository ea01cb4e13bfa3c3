"""Token ids by a public tokenizer, each distinct word encoded once by a worker.

Both vocabularies break a text at a space or line feed after a character that is no white space, so the ids
of a text are the ids of its words in a row. A text with other white space, with spaces in a row or with the
string of an added token, such as <|endoftext|>, is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import worker_memo

#: Words that a worker keeps with their ids.
MEMO = 800_000

#: Stands between words that are encoded in one go; words that hold it are encoded one by one.
BAR = "|"

#: White space other than the space and line feed, what some take for it, and white space in a row.
_ODD = [*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "᠎", "​", "﻿", "  ", " \n", "\n "]


def _is_odd(text: str) -> bool:
    return any(x in text for x in _ODD)


class Encoder:
    """Encodes texts to little-endian unsigned 16-bit ids; `spaced` if a word's ids take in the space before it.

    With `plain` the string of an added token is text like any other, else it is that token, as the library has it.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.heads = {t[0] for t in self.added} | {t[0].upper() for t in self.added}
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.spaced = spaced
        self.owner = ("tokens", path, spaced, plain)
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Adds words to the memo; a comma or full stop after a letter is an id of its own."""
        memo = self.memo
        ended = [w for w in words if len(w) > 1 and w[-1] in ",." and w[-2].isalpha()]
        stems = {w[:-1] for w in ended}
        taken = set(ended)
        plain = [w for w in words if w not in taken]
        plain += [w for w in stems.difference(plain) if w not in memo]
        apart = [w for w in plain if BAR in w]
        plain = [w for w in plain if BAR not in w] if apart else plain
        bar, gap = self._whole(f" {BAR}"), " " if self.spaced else ""
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            raw = self._whole(f" {BAR} ".join([gap + part[0], *part[1:]]))
            ids = np.frombuffer(raw, "<u2")
            bars = np.flatnonzero(ids == np.frombuffer(bar, "<u2")[0]).tolist() if len(bar) == 2 else []
            if len(bars) != len(part) - 1:  # the vocabulary has no id for the mark alone
                apart += part
                continue
            for w, begin, end in zip(part, [-1, *bars], [*bars, len(ids)], strict=True):
                memo[w] = raw[2 * begin + 2 : 2 * end]
        for w in apart:
            memo[w] = self._whole(gap + w)
        marks = {c: self._whole(c) for c in ",."} if ended else {}
        for w in ended:
            memo[w] = memo[w[:-1]] + marks[w[-1]]

    def _has_added(self, text: str) -> bool:
        return any(c in text for c in self.heads) and any(t in text.lower() for t in self.added)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = []
        blank = self._whole(" ") if self.spaced else b""
        self.memo = worker_memo(self.owner)
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            split = [None if _is_odd(t) or self._has_added(t) else (t if self.spaced else t.replace("\n", " ")).split(" ") for t in part]
            if len(self.memo) > MEMO:
                self.memo.clear()
            memo = self.memo
            memo[""] = blank
            heads = [self._whole(words.pop(0)) if words and self.spaced else b"" for words in split]
            known = [list(map(memo.get, words)) if words else [] for words in split]
            # Places of words that the memo lacks; the others are not looked up again.
            gaps = [[i for i, x in enumerate(k) if x is None] for k in known]
            if new := {words[i] for words, places in zip(split, gaps, strict=True) for i in places}:
                self._learn(list(new))
            for text, words, head, k, places in zip(part, split, heads, known, gaps, strict=True):
                if words is None:
                    out.append(self._whole(text))
                else:
                    for i in places:
                        k[i] = memo[words[i]]
                    out.append(head + b"".join(k))
        self.memo = {}
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary file, with the library's defaults."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced, plain=False)
    return _encoders[path, spaced]
