"""Ids by the tokenizers library, each different word encoded once.

Both kinds of vocabulary that are used here (byte-level BPE, and BPE with word ends) split text before
they merge, and always split where ASCII white space follows other text. So a text is cut there, the
library encodes each different slice, and the ids of a text are those of its slices in turn. Texts
with white space beyond ASCII's, where the rules of run and slice could part, go to the library whole.

By default a text is encoded as the library does it: the name of a special token in a text, as <|endoftext|>, becomes that
token. With special_as_text it is ordinary text, which keeps documents from ending themselves.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: White space, by Unicode or by Python, besides tab, line feed, carriage return and blank.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_WITH_BLANKS = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


class LibraryEncoder:
    """ids(texts): of each text its ids as an array of little-endian unsigned 32-bit integers.

    keeps_blanks: slices carry the white space before them; else white space separates only. When the cache
    holds max_cached slices, the third that came last is forgotten: frequent words come early. That
    bounds memory and changes no result.
    """

    def __init__(self, path: str, keeps_blanks: bool, special_as_text: bool = False, max_cached: int = 1_100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.keeps_blanks, self.max_cached, self.cache = keeps_blanks, max_cached, {}
        # Tokens that start a word (with the mark for a blank), or that end one.
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith("\u0120") if keeps_blanks else token.endswith("</w>"))]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: list[str]) -> list[bytes]:
        """whole() of single words (letters alone, after a blank if blanks are kept), many in one line: a line's ids part at
        the tokens that start or end words."""
        out = []
        lines = [texts[i : i + 256] for i in range(0, len(texts), 256)]
        glue = "" if self.keeps_blanks else " "
        for line, found in zip(lines, self.library.encode_batch_fast([glue.join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(line):
                out += self.whole(line)
                continue
            raw = ids.tobytes()
            cuts = (4 * (at if self.keeps_blanks else at + 1)).tolist()
            cuts = [*cuts, len(raw)] if self.keeps_blanks else [0, *cuts]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def learn(self, new: list[str]) -> None:
        """Puts the ids of slices into the cache. A full stop or comma after a letter is a token of its own, so such a slice is
        put together from its parts."""
        ended, todo = [], set()
        for piece in new:
            if len(piece) > 1 and piece[-1] in ".," and piece[-2] < "\u0250" and piece[-2].lower().isalpha():
                ended.append(piece)
                todo.update(x for x in (piece[:-1], piece[-1]) if x not in self.cache)
            else:
                todo.add(piece)
        plain = [x for x in todo if (x[0] == " " and x[1:].isalpha() if self.keeps_blanks else x.isalpha())]
        rest = list(todo.difference(plain))
        for i in range(0, len(plain), 50_000):
            self.cache.update(zip(plain[i : i + 50_000], self.words(plain[i : i + 50_000]), strict=True))
        for i in range(0, len(rest), 20_000):
            self.cache.update(zip(rest[i : i + 20_000], self.whole(rest[i : i + 20_000]), strict=True))
        for piece in ended:
            self.cache[piece] = self.cache[piece[:-1]] + self.cache[piece[-1]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.max_cached:
            self.cache = dict(islice(self.cache.items(), self.max_cached * 2 // 3))
        rare = [bool(_RARE.search(t)) for t in texts]
        cut = _WITH_BLANKS.findall if self.keeps_blanks else str.split
        slices = [[] if odd else cut(t) for t, odd in zip(texts, rare, strict=True)]
        known = self.cache.get
        found = [list(map(known, own)) for own in slices]
        gaps = [(own, parts, [j for j, x in enumerate(own) if x is None]) for own, parts in zip(found, slices, strict=True)]
        if new := list({parts[j] for _, parts, at in gaps for j in at}):
            self.learn(new)
            for own, parts, at in gaps:  # only what was not known is looked up again
                for j in at:
                    own[j] = known(parts[j])
        out = [b"".join(own) for own in found]
        for i in (i for i, odd in enumerate(rare) if odd):
            out[i] = self.whole([texts[i]])[0]
        return [np.frombuffer(own, "<u4") for own in out]


@lru_cache(4)
def library(path: str, keeps_blanks: bool, special_as_text: bool = False) -> LibraryEncoder:
    return LibraryEncoder(path, keeps_blanks, special_as_text)
