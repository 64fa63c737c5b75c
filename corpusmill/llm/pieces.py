"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The pieces and scores of a given model file (never trained here) make an automaton; one pass over a text meets, at each
position, all pieces that end there, by the automaton's output links, and relaxes the best score of the
position. A character that is no piece goes to its UTF-8 bytes' pieces at ``UNKNOWN`` below the least
score. The text is the segmentation of the highest total score; of equal ones that whose last
piece is longest, and so on backwards.

White space is kept: a space becomes U+2581 and one more is put in front; a U+2581 of the text itself goes to its bytes, so
that decoding gives back every text exactly. Where no piece has a U+2581 behind another
character, no piece crosses the start of a run of them, and the runs with what follows are encoded one
by one and remembered; that changes no result.

Cases: null counts as empty, and an empty text has no ids. Repeated rows each keep theirs. Other columns are not
carried. Nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import MEMORIES, lean, own

SPACE = "▁"
UNKNOWN = 10.0
_SEGMENT = re.compile(" +[^ ]*|[^ ]+")


class Pieces:
    """The vocabulary of a model file, with its automaton."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.setup([(i, sp.id_to_piece(i), sp.get_score(i)) for i in plain], {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}, sp.unk_id())

    def setup(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], unknown_id: int) -> None:
        import ahocorasick

        self.written = {i: p.replace(SPACE, " ").encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.written.setdefault(unknown_id, " ⁇ ".encode())
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.floor = min((s for _, _, s in pieces), default=0.0) - UNKNOWN
        self.single = {p for _, p, _ in pieces if len(p) == 1}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces)
        self.automaton = ahocorasick.Automaton()
        for i, p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s, i))
        if pieces:
            self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    MOST = 150_000

    def best(self, s: str) -> list[int]:
        """Ids of the best segmentation of a text that is already written with U+2581; "\\0" stands for a U+2581 of the text itself."""
        n, low = len(s), -float("inf")
        score, back = [0.0] + [low] * n, [(0, 0)] * (n + 1)
        single, floor, done = self.single, self.floor, 0
        odd = [i for i, c in enumerate(s) if c not in single]
        waits = iter([*odd, n])
        gap = next(waits)
        for end, (size, value, i) in self.automaton.iter(s):
            while gap < end:  # characters before this one that are no piece
                if score[gap] + floor > score[gap + 1]:
                    score[gap + 1], back[gap + 1] = score[gap] + floor, (1, -1)
                gap = next(waits)
            value += score[end + 1 - size]
            if value > score[end + 1]:
                score[end + 1], back[end + 1] = value, (size, i)
        while gap < n:
            if score[gap] + floor > score[gap + 1]:
                score[gap + 1], back[gap + 1] = score[gap] + floor, (1, -1)
            gap = next(waits)
        out, at = [], n
        while at:
            size, i = back[at]
            if i < 0:
                out += [self.byte_ids.get(b, self.unknown_id) for b in reversed(s[at - 1].encode())]
            else:
                out.append(i)
            at -= size
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            return self._rare(text)
        if not self.cuts:
            return self._ids(" " + text)
        return b"".join(map(self._known, _SEGMENT.findall(" " + text)))

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.best(text.replace(" ", SPACE)), "<u4").tobytes()

    def _known(self, seg: str) -> bytes:
        got = self.young.get(seg)
        if got is None:
            got = self.old.get(seg)
            if got is None:
                got = self._ids(seg)
            if len(seg) <= 64:
                if len(self.young) > self.MOST:
                    self.old, self.young = self.young, {}
                self.young[seg] = got
        return got

    def _rare(self, text: str) -> bytes:
        """Texts that have U+2581 themselves: it goes to its bytes, what stands between is encoded."""
        out: list[int] = []
        own_bytes = [self.byte_ids.get(b, self.unknown_id) for b in SPACE.encode()]
        for i, part in enumerate(text.split(SPACE)):
            if i:
                out += own_bytes
            out += self.best((part if i else " " + part).replace(" ", SPACE))
        return np.asarray(out, "<u4").tobytes()

    def text(self, ids: bytes) -> str:
        """The text of encoded ids."""
        return b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()[1:]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    MEMORIES["pieces"] = _LOADED.clear
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary, ids_crc32, round_trip) of (doc_id, text); ``round_trip``: the ids decode to the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = loaded(path)
        for b in batches:
            ids = [p.encode(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids": ids,
                    "ids_crc32": [zlib.crc32(x) for x in ids],
                    "round_trip": [p.text(x) == (t or "") for x, t in zip(ids, b["text"])],
                }
            )

    return own(docs, "doc_id", "text").mapInPandas(lean(run, "pieces"), "doc_id long, n_tokens long, ids binary, ids_crc32 long, round_trip boolean")
