"""SentencePiece model files: reading the pieces, and exact segmentation of marked words.

The file is a protobuf; only its pieces (field 1: text, score, type), the
trainer's kind (field 2.3: 1 unigram, 2 BPE) and the normalizer's flags
(field 3) are read. A text is marked as the model says (a space becomes U+2581,
one more before the text) and cut into units that no piece crosses: runs of
marks with the characters after them, and single line ends. Units are
independent, so each distinct unit is segmented once.

Segmentation is a forward pass over the unit's end positions, for which the
vocabulary's matches are the arcs, found by an automaton whose states and moves
are made as texts ask for them:

* unigram: the best score, in the order the library tries arcs (earlier starts
  first, a later one wins only if it is strictly better);
* BPE: arcs carry no additive score. A path is the tokenizer's own exactly if
  each adjacent pair is one that merging leaves alone, so the forward state is
  the last piece, pairs that merge otherwise are forbidden, and one path remains.

A character without a piece is spelled in byte pieces, or the unknown piece
where the model has none.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct units that a task remembers before it starts anew.
MEMORY = 1_200_000
#: Moves between states (some 100 bytes each) that an automaton remembers before it finds them anew.
MOVES = 300_000
NEVER = float("-inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        out |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return out, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file's bytes. ``kind`` overrides what the file says; ``pairs`` of pieces are remembered."""

    def __init__(self, data: bytes, kind: int | None = None, pairs: int = 500_000):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.norm = kind or UNIGRAM, True, True, ""
        for f, v in _fields(data):
            if f == 1:
                p = dict(_fields(v))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif f == 2 and kind is None:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                n = dict(_fields(v))
                self.norm, self.prefix, self.squeeze = n.get(1, b"").decode(), bool(n.get(3, 1)), bool(n.get(4, 1))
        if self.norm != "identity" or self.squeeze:
            raise ValueError("only identity normalization without squeezed spaces is supported")
        if self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, UNUSED)}
        if any(re.search(f"[^{MARK}]{MARK}|\\n", p) for p in self.ids):
            raise ValueError("a piece crosses a unit's end")
        self.codes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.unknown = self.types.index(UNKNOWN)
        by_byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.bytes = [by_byte[i] for i in range(256)] if len(by_byte) == 256 else None
        normal = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.table = [p.replace(MARK, " ").encode() if t in (NORMAL, UNUSED) else bytes([int(p[3:5], 16)]) if t == BYTE else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        self.unknown_score = min(normal, default=0.0) - 10
        #: every beginning of a piece
        self.heads = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.states: dict[str, tuple] = {}
        self.moves = 0
        self.grown: dict[str, tuple | None] = {}
        self.unpaired = lru_cache(maxsize=pairs)(self._unpaired)

    def state(self, text: str) -> tuple:
        """(pieces that end ``text`` with their lengths, longest first; moves by character; text), where text begins a piece."""
        found = self.states.get(text)
        if found is None:
            ends = (text[k:] for k in range(len(text)))
            found = self.states[text] = (tuple((p, len(p)) for p in ends if p in self.ids), {}, text)
        return found

    def move(self, state: tuple, char: str) -> tuple:
        """The state after one more character: the longest end of the text so far that begins a piece."""
        text = state[2] + char
        while text and text not in self.heads:
            text = text[1:]
        if self.moves >= MOVES:
            self.moves = 0
            for s in self.states.values():
                s[1].clear()
        after = state[1][char] = self.state(text)
        self.moves += 1
        return after

    def marked(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    UNITS = re.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")

    def units(self, text: str) -> list[str]:
        """The units of a text, as they stand in it (with spaces, the first one's mark added)."""
        return self.UNITS.findall(self.marked(text))

    def keys(self, text: str) -> list[str] | None:
        """Names of the text's units where its spaces are plain: a word stands for the mark and the word, ``\\n`` and a word for the two units of a line's begin. None: call ``units``."""
        if not text:
            return []
        if not self.prefix or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or MARK in text:
            return None
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def named(key: str) -> list[str]:
        """The units that a key of ``keys`` stands for."""
        if key[:1] != "\n":
            return [MARK + key]
        return ["\n", key[1:]] if len(key) > 1 else ["\n"]

    def spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def merged(self, text: str, steps: list[tuple[float, int, str]] | None = None) -> list[str]:
        """BPE by its definition: merge the adjacent pair whose union scores best, the leftmost first. ``steps`` gets (score, place, union)."""
        ids, scores = self.ids, self.scores
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in ids:
                heapq.heappush(heap, (-scores[ids[both]], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if steps is not None:
                steps.append((scores[ids[both]], i, both))
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _unpaired(self, left: str, right: str) -> bool:
        """Whether merging the text of two pieces ends in just these two.

        Until a merge crosses their border, each piece grows as it does alone. So the
        part before the border and the part after it are followed through their
        growth, best score first, and the union of both must never be next.
        """
        a, b = self.growth(left) if left else ((), (), True), self.growth(right)
        if a is None or b is None:
            return False
        if not left:
            return True
        if not (a[2] and b[2]):
            return self.merged(left + right) == [left, right]
        ids, scores, before, after, i, j = self.ids, self.scores, a[1], b[0], 0, 0
        while True:
            part, x = before[i]
            other, y = after[j]
            both = ids.get(part + other)
            if both is not None and x < scores[both] >= y:
                return False
            if x >= y:
                if x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def growth(self, piece: str) -> tuple | None:
        """How merging makes a piece: its first parts and its last parts, each with the score of the merge that ends it, and whether scores only fall. None: it does not."""
        if piece not in self.grown:
            steps: list[tuple[float, int, str]] = []
            if self.merged(piece, steps) == [piece]:
                first = [(NEVER, 0, piece[:1]), *(s for s in steps if s[1] == 0)]
                last = [(NEVER, 0, piece[-1:]), *(s for s in steps if s[1] + len(s[2]) == len(piece))]
                ended = lambda parts: tuple((s[2], t[0]) for s, t in zip(parts, [*parts[1:], (NEVER,)], strict=True))
                falls = all(s[0] >= t[0] for s, t in zip(steps, steps[1:]))  # noqa: B905
                self.grown[piece] = (ended(first), ended(last), falls)
            else:
                self.grown[piece] = None
        return self.grown[piece]

    @staticmethod
    def coded(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else self.spelled(p)
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: runs of byte pieces are decoded together, the first mark goes."""
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Forward:
    """The forward cells of a unit, grown to its end and cut back to share a prefix.

    ``last[i]`` is the piece that ends the first i characters' path (empty: the
    character is spelled), ``score[i]`` the path's score for unigram models, and
    ``states[i]`` the automaton's state, which knows the arcs that end there. The unit
    is kept whole, so a cell costs no more in a long unit than in a short one.
    """

    def __init__(self, vocab: Vocabulary):
        self.v, self.text = vocab, ""
        self.last, self.score, self.states = [""], [0.0], [vocab.state("")]

    def run(self, unit: str, same: int) -> None:
        """The cells of ``unit``, whose first ``same`` characters have theirs: arcs are tried from the earliest start on."""
        v, last, score, states = self.v, self.last, self.score, self.states
        del last[same + 1 :], score[same + 1 :], states[same + 1 :]
        self.text = unit
        state, merging, unpaired = states[same], v.kind == BPE, v.unpaired
        for char in unit[same:]:
            state = state[1].get(char) or v.move(state, char)
            states.append(state)
            if merging:
                for piece, n in state[0]:
                    if unpaired(last[-n], piece):
                        last.append(piece)
                        break
                else:
                    last.append("")
                continue
            best, kept = None, ""
            for piece, n in state[0]:
                s = score[-n] + v.scores[v.ids[piece]]
                if best is None or s > best:
                    best, kept = s, piece
            if char not in v.ids and (best is None or score[-1] + v.unknown_score > best):
                best, kept = score[-1] + v.unknown_score, ""
            last.append(kept)
            score.append(best)

    def ids(self) -> bytes:
        """The ids of the unit's path, as little-endian 32-bit integers."""
        v, text, last, codes = self.v, self.text, self.last, self.v.codes
        out, end = [], len(text)
        while end > 0:
            piece = last[end]
            if not piece:
                end -= 1
                out.append(v.coded(v.spelled(text[end])))
            else:
                out.append(codes[piece])
                end -= len(piece)
        out.reverse()
        return b"".join(out)
