"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8).

Each text is cut by the vocabulary's pattern; each distinct piece is encoded once per task and remembered.
A piece's bytes are mapped to Latin-1, one pass of an Aho-Corasick automaton gives the longest token from each
position, and the encoder then goes left to right with the longest token, stepping down to shorter prefixes or
back when two neighbours could not have come out of the merges next to each other. Whether two tokens may be
neighbours is decided by undoing their merges, and remembered. Each position is refused at most once, so the work is
linear in the piece's length, while the result equals applying the merges in rank order.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; lone
surrogates cannot occur in a Spark string; nothing is cut, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from signalbox.llm.spread import spread

#: Where the public vocabulary files are; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a task, and neighbour decisions; the memory is emptied beyond that.
REMEMBER = 500_000


def _byte_letters() -> dict[str, int]:
    """The printable letters in which the vocabulary file writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Exact byte-level BPE by backtracking over longest matches."""

    def __init__(self, path: str = VOCABULARY):
        import ahocorasick
        import regex

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = _byte_letters()
        latin = lambda token: "".join(chr(letters[c]) for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {latin(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        reachable = {i for t, i in ids.items() if len(t) == 1}
        for rank, (a, b) in enumerate(merges):
            left, right = ids[latin(a)], ids[latin(b)]
            token = ids[latin(a) + latin(b)]
            self.merge[left, right] = token
            if token not in self.halves:
                self.halves[token], self.rank[token] = (left, right), rank
                reachable.add(token)
        self.bytes_of = {i: t for t, i in ids.items() if i in reachable}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.shorter: dict[int, int] = {}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        if (found := self.shorter.get(token)) is None:
            text = self.bytes_of[token]
            found = next((self.id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id_of), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges could leave ``left`` and ``right`` side by side.

        Undo the younger of the two tokens' merges step by step; at each step the two that touch at the border must
        not be a pair that would have merged before the merge undone last.
        """
        if (found := self.neighbours.get((left, right))) is not None:
            return found
        found = self._meet(left, right, len(self.merge) + 1)
        if len(self.neighbours) >= REMEMBER:
            self.neighbours.clear()
        self.neighbours[left, right] = found
        return found

    def piece(self, text: str) -> list[int]:
        """The ids of one piece of the pattern."""
        data = text.encode("utf-8", "replace").decode("latin-1")
        whole = self.id_of.get(data)
        if whole is not None:
            # A whole piece that is a token need not be what the merges give, unless it is a byte or comes from them.
            if len(data) == 1 or self.compatible_inside(whole):
                return [whole]
        n = len(data)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(data):
            start = end - size + 1
            if longest[start] == 0 or size > len(self.bytes_of[longest[start] - 1]):
                longest[start] = token + 1
        usable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] - 1
        while at < n:
            end = at + len(self.bytes_of[token])
            if usable[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at] - 1
                continue
            shorter = self.prefix(token)
            while shorter < 0:
                usable[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
                shorter = self.prefix(token)
            token = shorter
        return out

    def compatible_inside(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token back: its halves are tokens that may be neighbours
        except for their own merge."""
        left, right = self.halves[token]
        return (
            self.piece_is_self(left) and self.piece_is_self(right) and self._meet(left, right, self.rank[token])
        )

    def piece_is_self(self, token: int) -> bool:
        return token not in self.halves or self.compatible_inside(token)

    def _meet(self, left: int, right: int, limit: int) -> bool:
        """Whether two tokens can touch without any merge of a rank under ``limit`` joining what meets at the border."""
        a, b, rank = left, right, self.rank
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and rank[joined] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal merges the left one happens first, so at equal rank the right token is the younger.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        if not text:
            return []
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(known) >= REMEMBER:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """(id_col, ids): the token ids of each text, one row per row of ``df``."""
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[id_col, ids])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, `{ids}` array<int>")
