"""Byte-pair token ids of whole texts."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from pathlib import Path

import tiktoken

TWO_BLANKS = re.compile(r"\s\s")
#: the vocabulary's rule for a run of blanks; where no two blanks adjoin it never differs from the plain rule that follows it
RUN_RULE = r"|\s+(?!\S)"


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary given as a file of ranks.

    Strings of ``specials`` (name to id) in a text are those ids, all others
    ordinary text.  Ids are packed as little-endian unsigned integers of
    ``width`` bytes, as few as hold them all.
    """

    def __init__(self, ranks_path: str, pattern: str, specials: dict[str, int] | None = None):
        lines = map(bytes.split, Path(ranks_path).read_bytes().splitlines())
        ranks = {base64.b64decode(word): int(rank) for word, rank in lines}
        #: the bytes of each id
        self.words = [word for word, _ in sorted(ranks.items(), key=lambda r: r[1])]
        self.specials = specials or {}
        self.whole = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.specials)
        # without the look-ahead the pattern runs as an automaton, half again as fast
        self.plain = tiktoken.Encoding("bpe", pat_str=pattern.replace(RUN_RULE, ""), mergeable_ranks=ranks, special_tokens={})
        self.code, self.width = ("H", 2) if max([*ranks.values(), *self.specials.values()]) < 1 << 16 else ("I", 4)

    def encode(self, text: str) -> bytes:
        if any(name in text for name in self.specials):
            ids = array(self.code, self.whole.encode(text, allowed_special="all"))
        else:
            encoding = self.whole if TWO_BLANKS.search(text) else self.plain
            ids = array(self.code, encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The special tokens that a tokenizer file finds in texts, with their ids."""
    return {t["content"]: t["id"] for t in json.loads(Path(tokenizer_path).read_text(encoding="utf-8")).get("added_tokens", []) if t.get("special")}
