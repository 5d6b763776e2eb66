"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over a text's characters and keeps, for each place in a window of the longest piece's length, the last piece of
the best segmentation up to there. When the paths of all places from which a piece can still start meet in one boundary,
everything before it is final: its ids are committed and forgotten. So memory is bounded by how late paths meet, not by the
text. Which segmentation is best depends on the model file: for a unigram model the one with the highest sum of scores; for a
BPE model the one that merging gives, which is the one whose neighbouring pieces all stay apart when merged on their own, so
the survivor at a place is its longest piece that stays apart from the survivor where it starts.

All paths meet where no piece reaches across: before a blank that follows another character, and around characters that no
piece has. Segments between such places are remembered with their ids, which saves the pass for common words; the memory of
a worker is bounded and is emptied when it is full.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # fixed values of the model file's piece types
UNIGRAM, BPE = 1, 2  # and of its model types
UNKNOWN_PENALTY = 10.0
MEMO, MEMO_LENGTH = 400_000, 48  # segments a worker remembers in both generations, and the longest of them
PAIRS = 500_000  # pairs of pieces a worker remembers
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces. Only files that leave the text as it is (identity normaliser) are taken."""

    def __init__(self, data: bytes):
        self.kind, self.prefix, self.unknown = UNIGRAM, True, 0
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_: list[int | None] = [None] * 256
        self.surface: list[bytes] = []
        for field, value in _fields(data):
            if field == 1:
                parts = dict(_fields(value))
                piece, kind = parts[1].decode(), parts.get(3, NORMAL)
                at = len(self.surface)
                self.scores.append(struct.unpack("<f", parts.get(2, b"\0\0\0\0"))[0])
                self.surface.append(b"")
                if kind == NORMAL:
                    self.ids[piece] = at
                    self.surface[at] = piece.replace(BLANK, " ").encode()
                elif kind == BYTE:
                    self.bytes_[int(piece[3:5], 16)] = at
                    self.surface[at] = bytes([int(piece[3:5], 16)])
                elif kind == UNKNOWN:
                    self.unknown, self.surface[at] = at, " ⁇ ".encode()
                elif kind == 4:
                    raise ValueError("user-defined pieces are not supported")
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models with an identity normaliser that keeps blanks are supported")
                self.prefix = bool(rules.get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("pieces that reach across a blank are not supported")
        self.cut = self._segments()
        self.matches = ahocorasick.Automaton()  # at each place the pieces that end there, the longest first
        for piece, at in self.ids.items():
            self.matches.add_word(piece, (len(piece), at))
        if self.ids:
            self.matches.make_automaton()

    def ends(self, segment: str) -> Iterator[tuple[int, tuple[int, int]]]:
        """(place of the last character, (length, id)) of all pieces in a segment, by place, longer ones first."""
        return self.matches.iter(segment) if self.ids else iter(())

    def _segments(self) -> re.Pattern:
        """Segments of a marked text: no piece reaches from one into the next.

        Characters that no piece has are alone. Others end before a blank, and where a mark follows a letter (anything but
        an ASCII mark) unless some piece has that mark after that letter.
        """
        used = {c for p in self.ids for c in p}
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} & used
        after: dict[str, set[str]] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                if y in marks and x not in marks and x != BLANK:
                    after.setdefault(y, set()).add(x)
        alone = {chr(c) for c in range(128) if c != 32} - used
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        one, mark = group(alone), group(marks)
        letter = f"[^{BLANK}{one}{mark}]"
        start = f"(?:[{mark}]+{letter}*|{letter}+)" if mark else f"{letter}+"
        joined = "|".join(f"(?<=[{group(x)}]){re.escape(y)}" for y, x in sorted(after.items()))
        more = f"(?:(?:{joined})[{mark}]*{letter}*)*" if joined else ""
        return re.compile("|".join([f"{BLANK}*{start}{more}", f"{BLANK}+"] + [f"[{one}]"] * bool(one)))

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        found = [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found


class Memo(dict):
    """Little-endian ids of segments, in two generations of half of ``MEMO`` each: when the young one is full it becomes the old
    one, whose entries come back when they are met again. So common segments stay, and memory is bounded."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.old = coder, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = b"".join(self.coder.stream(segment))
            if len(segment) > MEMO_LENGTH:
                return ids
        if len(self) >= MEMO // 2:
            self.old = None  # before the copy: never three generations at once
            self.old = dict(self)
            self.clear()
        self[segment] = ids
        return ids


class Coder:
    def __init__(self, pieces: Pieces):
        self.pieces, self.memo, self.pairs = pieces, Memo(self), {}  # pairs: by both ids
        self.lowest = min(pieces.scores, default=0.0) - UNKNOWN_PENALTY
        self.rank = {p: pieces.scores[i] for p, i in pieces.ids.items()}
        self.names = {i: p for p, i in pieces.ids.items()}

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging: the neighbours with the highest score first, the first of them on a tie."""
        rank, parts = self.rank, list(text)
        values = [rank.get(x + y, -math.inf) for x, y in zip(parts, parts[1:], strict=False)]
        while values:
            best = max(values)
            if best == -math.inf:
                break
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = rank.get(parts[at - 1] + parts[at], -math.inf)
            if at < len(values):
                values[at] = rank.get(parts[at] + parts[at + 1], -math.inf)
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps the two pieces as they are (no ``left``: whether it makes the right one)."""
        two = [self.names[i] for i in (left, right) if i >= 0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.merged("".join(two)) == two
        return found

    def stream(self, segment: str) -> Iterator[bytes]:
        """Ids of a segment, in parts as they become final.

        ``starts`` and ``ids`` hold for each place from ``base`` on the last piece of the best path to it, id -1 for a
        character that no piece has. Places up to ``done`` are decided; ``look`` is where paths are next looked at.
        """
        pairs, scores, bpe = self.pairs, self.pieces.scores, self.pieces.kind == BPE
        base = done = 0
        longest, size = self.pieces.longest, len(segment)
        look = 8 * longest
        starts, ids, best = [0], [-1], [0.0]
        for last, (length, piece) in chain(self.pieces.ends(segment), [(size, (0, -1))]):
            if last < done and bpe:
                continue  # a place has one right piece, and it is found
            while done < last or last == done >= look:
                if done >= look:
                    met = self.meeting(starts, base, longest)
                    look = max(done + longest, met + 8 * longest)
                    if met > base:
                        yield self.packed(segment, starts, ids, base, met)
                        starts, ids, best, base = starts[met - base :], ids[met - base :], best[met - base :], met
                else:
                    starts.append(done)
                    ids.append(-1)
                    if not bpe:
                        best.append(best[-1] + self.lowest)
                    done += 1
            if last == size:
                break
            start = last + 1 - length
            if bpe:
                # the single character needs no look when the others are wrong
                if length > 1:
                    left = ids[start - base]
                    fits = pairs.get(left << 32 | piece)
                    if fits is None:
                        fits = self.apart(left, piece)
                    if not fits:
                        continue
                starts.append(start)
                ids.append(piece)
                done += 1
            else:
                if last == done:
                    starts.append(done)
                    ids.append(-1)
                    best.append(best[-1] + self.lowest)
                    done += 1
                total = best[start - base] + scores[piece]
                if total > best[-1]:
                    starts[-1], ids[-1], best[-1] = start, piece, total
        yield self.packed(segment, starts, ids, base, size)

    @staticmethod
    def meeting(starts: list[int], base: int, longest: int) -> int:
        """The last boundary on the paths of all places from which a piece may still start; the base at worst."""
        open_ = set(range(base + len(starts) - longest, base + len(starts)))
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(max(base, starts[last - base]))
        return open_.pop()

    def packed(self, segment: str, starts: list[int], ids: list[int], base: int, end: int) -> bytes:
        """Ids of the path from the base to a place."""
        out: list[int] = []
        while end > base:
            start, piece = starts[end - base], ids[end - base]
            if piece < 0:
                out += self.pieces.fallback(segment[start:end])[::-1]
            else:
                out.append(piece)
            end = start
        return struct.pack(f"<{len(out)}i", *reversed(out))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        marked = text.replace(" ", BLANK)
        if self.pieces.prefix:
            marked = BLANK + marked
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces.cut.findall(marked))), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; of bytes that are no text each becomes a replacement character."""
        text = b"".join(map(self.pieces.surface.__getitem__, ids.tolist()))
        return (text[1:] if self.pieces.prefix and text[:1] == b" " else text).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def coder(model: bytes) -> Coder:
    """The worker's coder of a model file, kept with its memory across tasks."""
    key = hash(model)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Pieces(model))
    return _coders[key]


def model_bytes(path: str = MODEL) -> bytes:
    """A model file of the driver's; it is sent along with the job (some hundred KB, whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


def coded(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_ids, and with ``decode`` the text that the ids give back.

    Null texts have null ids and text, empty texts no ids. ``decoded`` equals the text, except that the model's blank mark
    U+2581 comes back as a space, as the format has it. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shipped.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lists = [None if t is None else own.encode(t) for t in texts]
            sizes = np.array([0 if x is None else len(x) for x in lists], dtype=np.int32)
            missing = np.array([x is None for x in lists], dtype=bool)
            values = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, dtype="<i4")])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays = [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(values, pa.int32())),
                pa.array(sizes.astype(np.int64), mask=missing),
            ]
            if decode:
                arrays.append(pa.array([None if x is None else own.decode(x) for x in lists], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_ids", "decoded"][: len(arrays)])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long" + ", decoded string" * decode)
