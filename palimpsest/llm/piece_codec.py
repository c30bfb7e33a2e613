"""Exact encoding and decoding for merge-type SentencePiece models.

A sequence of pieces is the merge result if and only if every piece re-merges to
itself and every adjacent pair stays a pair when its text is merged again.  The
encoder takes the longest pieces as an Aho-Corasick automaton finds them, checks
each against the one before by replaying the merges at their border, falls back
to the next shorter piece, and steps back one piece when none fits; a bitfield
marks places that have failed, so each is left once.

No piece of such a model holds a word mark after another character, so merging
never crosses the start of a word; units between those places are encoded on
their own, with a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import pick, require_file, sliced

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units of one of the two generations of the cache.
CACHE_UNITS = 400_000
CACHE_UNIT_CHARS = 64

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


#: Signs that every common normaliser rewrites: a ligature, a full-width letter, a combining accent, capitals.
PROBE = "ﬁ Ａ e\u0301 ÀB"


class PieceCodec:
    """A BPE model of the ``sentencepiece`` format with byte fallback.

    Models that rewrite white space or other signs are refused; pieces defined by
    the user, which are cut out before merging, are not known to it.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=require_file(path))
        n = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.kind = ["byte" if sp.is_byte(i) else "none" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "text" for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == "text"}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.dummy_prefix = sp.encode_as_pieces("a")[0].startswith(MARK)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that hold a word mark inside are not supported")
        if sp.encode_as_pieces("a  b")[-2:] == [f"{MARK}b"] or sp.is_byte(sp.unk_id()):
            raise ValueError("models that rewrite white space are not supported")
        if sp.decode(sp.encode(PROBE)) != PROBE:
            raise ValueError("models with a normaliser are not supported")
        # Pieces that do not merge to themselves never occur in a result.
        self.usable = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.usable))
        self.size = {i: len(p) for p, i in self.usable.items()}
        self.halves = {p: self.last_merge(p) for p in self.usable if len(p) > 1}
        # Pieces that are merged sooner than one of their parts: borders within them are tried by merging.
        self.odd = {p for p, both in self.halves.items() if any(half not in self.ids or self.rank(half) >= self.rank(p) for half in both)}
        self.spines: tuple[dict, dict] = ({}, {})
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.shown = {i: f"{i}," for i in self.usable.values()}
        singles = "".join(re.escape(p) for p in self.usable if len(p) == 1)
        self.plain = re.compile(f"[{singles}]*")

    def merge(self, text: str, told: list[tuple[str, str]] | None = None) -> list[str]:
        """The pieces of ``text`` by merging the best-scored adjacent pair, leftmost first, until none is left; ``told`` gets the merges."""
        parts = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if (k := self.ids.get(joined)) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            if told is not None:
                told.append((parts[i], parts[j]))
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def _longest(self, text: str, at: int) -> int:
        """The id of the longest piece that starts at ``at``; -1 without any."""
        ahead = text[at : at + 24]
        size = self.automaton.longest_prefix(ahead)
        if size == 24:
            ahead = text[at : at + self.longest]
            size = self.automaton.longest_prefix(ahead)
        usable = self.usable
        while size:
            if (found := usable.get(ahead[:size])) is not None:
                return found
            size -= 1
        return -1

    def _next_shorter(self, piece: int) -> int:
        """The id of the next shorter piece that ``piece`` starts with; -1 without any."""
        found = self.shorter.get(piece)
        if found is None:
            text = self.pieces[piece]
            found = self.shorter[piece] = next((self.usable[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.usable), -1)
        return found

    def rank(self, text: str) -> float:
        """When a piece is merged: the smaller, the sooner; single characters are there from the start."""
        return -self.score[self.ids[text]] if len(text) > 1 else -1e30

    def last_merge(self, text: str) -> tuple[str, str]:
        """The two parts that are merged last to give a piece that merges to itself."""
        last: list[tuple[str, str]] = []
        self.merge(text, last)
        return last[-1]

    def _spine(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The piece, the part at its edge, that part's part, and so on, each with the rank of what it is merged into."""
        found = self.spines[side].get(piece)
        if found is None:
            text, until, found = self.pieces[piece], float("inf"), []
            while True:
                found.append((text, until))
                if len(text) == 1:
                    break
                text, until = self.halves[text][side], self.rank(text)
            self.spines[side][piece] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging both pieces' text anew gives the two pieces.

        It does unless parts that meet at the border would merge with each other
        before they merge into their own pieces (at equal rank the left pair goes first).
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            near, far = self._spine(left, 1), self._spine(right, 0)
            if self.odd and any(t in self.odd for t, _ in near + far):
                a, b = self.pieces[left], self.pieces[right]
                known = self.merge(a + b) == [a, b]
            else:
                known = True
                for u, into in near:
                    for v, onto in far:
                        joined = self.ids.get(u + v)
                        if joined is not None and -self.score[joined] < into and -self.score[joined] <= onto:
                            known = False
            self.pairs[key] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of the merge result of a text whose characters are all pieces.

        Longest matches come first, as the automaton finds them from left to
        right; from the first pair on that does not stand, places are tried one
        by one, and a bit is set for each from which no way leads on.
        """
        found = [i for _, i in self.automaton.iter_long(text)]
        known, stand = self.pairs, len(found)
        for k in range(1, len(found)):
            ok = known.get(found[k - 1] << 20 | found[k])
            if ok is None:
                ok = self._compatible(found[k - 1], found[k])
            if not ok:
                stand = k
                break
        if stand == len(found):
            return found
        out, sizes = found[:stand], self.size
        at, size = sum([sizes[i] for i in out]), len(text)
        failed = bytearray(size // 8 + 1)
        piece = found[stand]
        while True:
            while piece >= 0:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    ok = known.get(out[-1] << 20 | piece)
                    if ok is None:
                        ok = self._compatible(out[-1], piece)
                    if ok:
                        break
                piece = self._next_shorter(piece)
            if piece >= 0:
                out.append(piece)
                at = end
                if at == size:
                    return out
                piece = self._longest(text, at)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError(f"no encoding of {text!r}")
                last = out.pop()
                at -= sizes[last]
                piece = self._next_shorter(last)

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of one unit; characters that are no piece become byte pieces."""
        out: list[int] = []
        run = 0
        for i, c in enumerate(unit):
            if c not in self.usable:
                out += self._run(unit[run:i])
                out += [self.bytes[b] for b in c.encode()]
                run = i + 1
        return out + self._run(unit[run:])

    def _run(self, text: str) -> list[int]:
        if not text:
            return []
        return self.backtrack(text)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, byte pieces UTF-8, the prefix mark is left out."""
        parts: list[str] = []
        held = bytearray()
        first = self.dummy_prefix
        for i in ids:
            if self.kind[i] == "byte":
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                parts.append(_lenient(bytes(held)))
                held.clear()
            if self.kind[i] == "text":
                piece = self.pieces[i]
                parts.append(piece[1:] if first and piece.startswith(MARK) else piece)
                first = False
            elif i == self.unknown:
                parts.append(" ⁇ ")
                first = False
        if held:
            parts.append(_lenient(bytes(held)))
        return "".join(parts).replace(MARK, " ")

    def unit(self, unit: str) -> tuple[str, int, str]:
        """Decimal ids each followed by a comma, their number, and the decoded text with its marks."""
        known = self.cache.get(unit)
        if known is None:
            known = self.older.get(unit)
            if known is None:
                if len(unit) <= CACHE_UNIT_CHARS and self.plain.fullmatch(unit):
                    pieces = self.backtrack(unit)
                    known = "".join([self.shown[p] for p in pieces]), len(pieces), unit
                else:
                    ids = self.unit_ids(unit)
                    known = "".join([f"{i}," for i in ids]), len(ids), self._text(ids)
            if len(unit) <= CACHE_UNIT_CHARS:
                if len(self.cache) >= CACHE_UNITS:
                    self.older, self.cache = self.cache, {}
                self.cache[unit] = known
        return known

    def _text(self, ids: list[int]) -> str:
        return "".join(self.pieces[i] for i in ids) if all(self.kind[i] == "text" for i in ids) else self.decode([self.usable[MARK], *ids]).replace(" ", MARK)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
        held, head = "", self.dummy_prefix
        units = UNIT.findall(marked)
        for k in range(0, len(units), 8192):  # bounded, whatever the text's length
            known = self.cache.get
            some = units[k : k + 8192]
            found = [known(u) for u in some]
            if None in found:
                found = [x or self.unit(u) for x, u in zip(found, some, strict=True)]
            joined = held + "".join([x[0] for x in found])
            held = joined[-1:]
            ids.update(joined[:-1].encode())
            n += sum([x[1] for x in found])
            decoded = "".join([x[2] for x in found])
            if head:
                decoded = decoded.removeprefix(MARK)
                head = False
            back.update(decoded.replace(MARK, " ").encode())
        return n, ids.hexdigest(), back.hexdigest()

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return [i for u in UNIT.findall(marked) for i in self.unit_ids(u)]


def _lenient(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is in no valid sequence."""
    out, i = [], 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4 if data[i] >> 3 == 30 else 0
        try:
            if not size:
                raise ValueError
            out.append(data[i : i + size].decode())
            i += size
        except ValueError:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in sliced(batches, "text"):
            found = [model.digest(x or "") for x in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def piece_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: number of ids, SHA-256 of the ids and of the decoded text.

    Null text counts as empty and has no ids; equal rows are coded each on its own.
    """
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_digester(path), SCHEMA)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int> and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in sliced(batches, "text", 1_000_000):
            ids = [model.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
