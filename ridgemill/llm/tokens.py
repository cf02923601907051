"""Token ids of whole texts by a public byte-level BPE, as bytes.

The vocabulary is read from a path given by the caller (a rank file of the
tiktoken kind), never from the repository. Ids come as little-endian unsigned
32-bit integers.
"""

from __future__ import annotations

import array
import base64
import re

#: The separator's text and its id in this vocabulary.
SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 50256

#: Chunks whose ids a worker keeps; when there are more, it starts anew.
MEMO = 300_000

_loaded: dict[tuple[str, str], Encoder] = {}
_uneven = re.compile(r"\s\s|^\s|\s$")


class Encoder(dict):
    """Maps a chunk that follows one space to its ids.

    The vocabulary's pattern never joins what stands on both sides of a space
    between two other characters: the space opens the next token. So a text
    whose spaces are all single is cut at its spaces, and the ids of each chunk
    are found once.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = self.whole(" " + chunk)
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array.array("I", self.plain(text)).tobytes()

    def ordinary(self, text: str) -> bytes:
        """Ids of a text in which control strings are ordinary text."""
        if not text:
            return b""
        if _uneven.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))

    def special(self, text: str) -> bytes:
        """Ids of a text in which the separator's text stands for its id."""
        if SEPARATOR not in text:
            return self.ordinary(text)
        return array.array("I", [SEPARATOR_ID]).tobytes().join(map(self.ordinary, text.split(SEPARATOR)))


def encoder(ranks: str, pattern: str) -> Encoder:
    """This worker's encoder for a rank file."""
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Encoder(ranks, pattern)
    return _loaded[ranks, pattern]
