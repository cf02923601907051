"""URL filters by a bit-parallel wildcard automaton.

Rules become globs over the canonical URL, host and then path. In a glob ``*``
stands for any run without ``/`` and ``**`` for any run. All globs are packed
into one row of 64-bit words, a bit per state: reading a byte c moves every
state of every rule at once, ``D = (D << 1) & step[c] | D & loop[c]``, where
the shift carries across words and loop holds the states in front of a
wildcard. URLs of a batch advance together, one byte per step, longest first,
so those that have ended drop out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm.shared import unused

#: Bytes of URLs that advance together.
CHUNK = 1_000_000


class Automaton:
    """The packed states of several lists of globs; a list matches if one of its globs does."""

    def __init__(self, groups: list[list[str]]) -> None:
        size = sum(len(self.parse(g)[0]) + 1 for globs in groups for g in globs)
        words = size // 64 + 1
        self.step = np.zeros((256, words), dtype=np.uint64)
        self.loop = np.zeros((256, words), dtype=np.uint64)
        self.start = np.zeros(words, dtype=np.uint64)
        self.accept = np.zeros((len(groups), words), dtype=np.uint64)
        at = 0
        for group, globs in enumerate(groups):
            for glob in globs:
                letters, loops = self.parse(glob)
                self._set(self.start, at)
                for i, byte in enumerate(letters):
                    self._set(self.step[byte], at + i + 1)
                for i, kind in loops.items():
                    for byte in range(256):
                        if kind == 2 or byte != 0x2F:
                            self._set(self.loop[byte], at + i)
                self._set(self.accept[group], at + len(letters))
                at += len(letters) + 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    @staticmethod
    def parse(glob: str) -> tuple[list[int], dict[int, int]]:
        """Its literal bytes, and the kind of wildcard in front of the i-th."""
        letters, loops = [], {}
        raw = glob.encode()
        i = 0
        while i < len(raw):
            if raw[i] == 0x2A:
                run = 1
                while raw[i + run : i + run + 1] == b"*":
                    run += 1
                loops[len(letters)] = max(loops.get(len(letters), 0), min(run, 2))
                i += run
            else:
                letters.append(raw[i])
                i += 1
        return letters, loops

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text the first group that matches, or -1."""
        out = np.full(len(texts), -1, dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        begin = 0
        while begin < len(order):
            end, longest = begin, max(1, int(lengths[order[begin]]))
            end = min(len(order), begin + max(1, CHUNK // longest))
            rows = order[begin:end]
            out[rows] = self._advance([texts[i] for i in rows], lengths[rows])
            begin = end
        return out

    def _advance(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        data = np.zeros((len(texts), max(1, int(lengths[0]))), dtype=np.uint8)
        for i, text in enumerate(texts):
            data[i, : len(text)] = np.frombuffer(text, np.uint8)
        states = np.repeat(self.start[None], len(texts), axis=0)
        # texts are sorted by length, longest first: the first `live` go on
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for i, live in enumerate(alive):
            now, byte = states[:live], data[:live, i]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        found = np.full(len(texts), -1, dtype=np.int64)
        for group in range(len(self.accept) - 1, -1, -1):
            found[(states & self.accept[group]).any(axis=1)] = group
        return found


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict added (replaced where they exist).

    A rule (verdict, host, path) fits its host and all its subdomains where the
    URL's path starts with the rule's; of several the longest (host and path
    together) wins, then the earlier one. rule is its host and path, null where
    none fits; then verdict is `default`. Null URLs and URLs without ``://`` have
    an empty host and path, which no rule fits. Repeated rows are judged alike.
    All other columns pass through, whatever their names. No rows give no rows.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    ranked = [rules[i] for i in order]
    quoted = [(host, path) for _, host, path in ranked]
    if any("*" in part for pair in quoted for part in pair):
        raise ValueError("rules are literal; * would be read as a wildcard")
    # a host never holds "/", so its wildcard cannot run into the path
    automaton = Automaton([[f"{host}{path}**", f"*.{host}{path}**"] for host, path in quoted])
    shared = pages.sparkSession.sparkContext.broadcast(automaton)
    host, path = canonical(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    fits_name = unused("fits", pages)
    cut = pages.select(*kept, host.alias("host"), path.alias("path"))

    def run(batches):
        for batch in batches:
            texts = [h.encode() + p.encode() for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield batch.append_column(fits_name, pa.array(shared.value.match(texts)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    found = cut.mapInArrow(run, f"{schema}, {fits_name} long")
    names = F.array(*[F.lit(h + p) for h, p in quoted]) if ranked else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in ranked]) if ranked else F.array().cast("array<string>")
    fits = F.col(fits_name) >= 0
    place = F.greatest(F.col(fits_name), F.lit(0)).cast("int")
    return found.select(*kept, "host", "path", F.when(fits, F.get(names, place)).alias("rule"), F.coalesce(F.when(fits, F.get(verdicts, place)), F.lit(default)).alias("verdict"))
