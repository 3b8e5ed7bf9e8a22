"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash over its last 32 bytes meets a mask, so that a passage
shared by documents is cut alike in all of them. A chunk is encoded once for all documents that a task
meets it in (a memo bounded in bytes), and kept as its inner token ids and its two open ends: what stands before its first
safe cut and after its last one. A safe cut lies before a single space between two non-space characters.

Joining two chunks, the open ends that meet are encoded anew together with one known piece of the chunk on either
side. The new ids must begin and end with the known pieces' ids: then they agree with what is kept of both chunks. Where
they don't, the repair is widened to the text as a whole, whose encoding agrees by itself.

A chunk's own text is encoded piece by piece (a piece lies between two safe cuts), each spelling once as long as it stays
in a second memo; new spellings are encoded together in one call.

Reuse reaches as far as a task's memo: chunks that two tasks meet are encoded by both. Sharing them through a
shuffle would have to move distinct chunks, ids and whole texts, over twice the input.

Defined cases: a null text is encoded as the empty one; an empty text has no ids; very long texts are worked through
whole; ids outside the vocabulary cannot be decoded and raise; a null list of ids decodes to null; repeated rows stay
repeated; an empty table gives no rows; columns named like a result (``ids``, ``decoded``) are replaced by it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import from_text, slices

#: Mean chunk size is about 1 << CHUNK_BITS bytes, between the bounds.
CHUNK_BITS, LEAST_CHUNK, MOST_CHUNK = 10, 256, 8192
#: Bounds of what a task keeps at hand, each in two generations: spellings, characters of theirs, bytes of chunks.
SPELLINGS, SPELLED, CHUNK_BYTES = 80_000, 2 << 20, 12 << 20
#: Bytes of text that are encoded together: what the library says of a text takes about 40 times its bytes.
TEXT_BYTES = 512 << 10
#: New spellings that are encoded in one text.
TOGETHER = 2_048
MARK = "\x01"

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)).astype(np.uint32)
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = [chr(c) for c in range(1, 0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, loaded once in a process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        got = Tokenizer.from_file(path)
        got.no_truncation()
        got.no_padding()
        _LOADED[path] = got
    return _LOADED[path]


class Pieces:
    """Ids of spellings, each encoded by the library once as long as it stays at hand.

    What is at hand is kept in two generations: when the younger one is full, the older one goes, and what is asked for
    again moves to the younger. New spellings are encoded together in one text and cut apart again: ``spaced`` ones, each
    with its space before it, at the ids that begin with a space; others at a mark put between them. Spellings for
    which the cuts aren't sure are encoded one by one.
    """

    def __init__(self, path: str, spaced: bool = False, kind: str = "<u4", most: int = SPELLINGS, letters: int = SPELLED):
        tok = tokenizer(path)
        self.encode_batch = tok.encode_batch_fast
        self.kind, self.most, self.letters = np.dtype(kind), most, letters
        self.lead, self.glue = (" ", " ") if spaced else ("", f" {MARK} ")
        self.unsure = self.glue.strip() or self.glue  # a spelling with this in it could be taken for the glue
        mark = [] if spaced else tok.encode(MARK, add_special_tokens=False).ids
        self.opens = np.array([x[:1] == b" " for x in _spellings(path)]) if spaced else np.isin(np.arange(tok.get_vocab_size()), mark)
        self.dropped = len(mark)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _single(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.encode_batch([self.lead + p for p in pieces], add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype=self.kind).tobytes()

    def _together(self, pieces: list[str]) -> None:
        ids = np.array(self.encode_batch([self.lead + self.glue.join(pieces)], add_special_tokens=False)[0].ids, dtype=self.kind)
        at = np.flatnonzero(self.opens[ids])
        starts, ends = ([0, *(at + self.dropped).tolist()], [*at.tolist(), len(ids)]) if self.dropped else (at.tolist(), [*at[1:].tolist(), len(ids)])
        if len(starts) != len(pieces):
            return self._single(pieces)
        data, wide = ids.tobytes(), self.kind.itemsize
        self.known.update(zip(pieces, [data[a * wide : b * wide] for a, b in zip(starts, ends, strict=True)], strict=True))

    def learn(self, pieces: set[str]) -> None:
        """Have the ids of all these pieces at hand."""
        if len(self.known) >= self.most or self.held >= self.letters:
            self.known, self.older, self.held = {}, self.known, 0
        missing = pieces.difference(self.known)
        if self.older:
            again = missing.intersection(self.older)
            self.known.update((p, self.older[p]) for p in again)
            missing -= again
        self.held += sum(map(len, missing))
        odd = [p for p in missing if self.unsure in p or not p]
        sure = list(missing.difference(odd))
        if odd:
            self._single(odd)
        for at in range(0, len(sure), TOGETHER):
            self._together(sure[at : at + TOGETHER])

    def ids(self, pieces: list[str]) -> bytes:
        """The ids of pieces learned before, one after the other."""
        return b"".join(map(self.known.__getitem__, pieces))


def cuts(data: bytes) -> list[int]:
    """Where a text's bytes are cut into chunks (the end is the last cut); never inside a character."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for reach in (1, 2, 4, 8, 16):  # the sum of 32 bytes' values, each shifted by its age
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    first = (raw & 0xC0) != 0x80
    marks = np.flatnonzero(((h[:-1] >> np.uint32(32 - CHUNK_BITS)) == 0) & first[1:]) + 1
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST_CHUNK:
            stop = at + MOST_CHUNK
            while not first[stop]:
                stop -= 1
            out.append(stop)
            at = stop
        if m - at >= LEAST_CHUNK or m == n:
            if m > at:
                out.append(m)
            at = m
    return out


class Chunk(NamedTuple):
    """A chunk as it is kept: the ids between its outer safe cuts, its first and last piece there with their ids, and
    its open ends. Without two inner pieces it has no ids and is one open text (``head``)."""

    head: str
    ids: bytes | None = None
    first: str = ""
    first_ids: bytes = b""
    last: str = ""
    last_ids: bytes = b""
    tail: str = ""


class ChunkEncoder:
    """Encodes texts by their chunks; exact for byte-level tokenizers, which pre-split before single spaces."""

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.inner = Pieces(path, spaced=True)
        self.chunks: dict[bytes, Chunk] = {}
        self.older: dict[bytes, Chunk] = {}
        self.held = self.asked = self.reused = self.disagreed = 0

    def parts(self, data: bytes) -> list[str]:
        """A chunk's text cut at its safe cuts, without the spaces there."""
        text = data.decode("utf-8", "surrogatepass")
        single = text[0] != " " != text[-1] and "  " not in text and " \n" not in text and "\n " not in text
        return text.split(" ") if single and not any(c in text for c in _RARE_SPACE) else _SAFE.split(text)

    def _learn(self, wanted: set[bytes]) -> None:
        if self.held > CHUNK_BYTES:
            self.chunks, self.older, self.held = {}, self.chunks, 0
        new = wanted.difference(self.chunks)
        again = new.intersection(self.older)
        self.chunks.update((c, self.older[c]) for c in again)
        cut = {c: self.parts(c) for c in new - again}
        self.inner.learn({p for parts in cut.values() for p in parts[1:-1]})
        known = self.inner.known
        for c, parts in cut.items():
            if len(parts) < 4:
                self.chunks[c] = Chunk(" ".join(parts))
            else:
                self.chunks[c] = Chunk(parts[0], self.inner.ids(parts[1:-1]), parts[1], known[parts[1]], parts[-2], known[parts[-2]], parts[-1])
        self.held += sum(3 * len(c) + 700 for c in new)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. New chunks and repairs of all texts are encoded together."""
        cut: list[list[bytes]] = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            stops = cuts(data)
            cut.append([data[a:b] for a, b in zip([0, *stops], stops)])
        wanted = {c for chunks in cut for c in chunks}
        self.asked += sum(map(len, cut))
        self.reused += sum(map(len, cut)) - len(wanted.difference(self.chunks, self.older))
        self._learn(wanted)
        repairs: list[str] = []
        plans: list[list[tuple[bytes, bytes, bytes]]] = []  # of each repair: ids that it begins and ends with, ids that follow it
        for chunks in cut:
            plan, before, open_ = [], b"", ""
            for c in map(self.chunks.__getitem__, chunks):
                if c.ids is None:
                    open_ += c.head
                    continue
                repairs.append(f"{open_}{c.head} {c.first}")
                plan.append((before, c.first_ids, c.ids))
                before, open_ = c.last_ids, f" {c.last} {c.tail}"
            repairs.append(open_)
            plan.append((before, b"", b""))
            plans.append(plan)
        said = iter(self.encode(repairs, add_special_tokens=False))
        out = []
        for text, plan in zip(texts, plans, strict=True):
            whole: list[bytes] | None = []
            for before, after, then in plan:
                got = np.array(next(said).ids, dtype="<u4").tobytes()
                if whole is None or len(got) < len(before) + len(after) or not (got.startswith(before) and got.endswith(after)):
                    whole = None
                else:
                    whole += [got[len(before) : len(got) - len(after)], then]
            if whole is None:  # no agreement: the repair is the whole text
                self.disagreed += 1
                whole = [np.array(self.encode([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()]
            out.append(b"".join(whole))
        return out


def _spellings(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    key = (path, "bytes")
    if key not in _LOADED:
        tok = tokenizer(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        out = []
        for i in range(tok.get_vocab_size(with_added_tokens=True)):
            token = tok.id_to_token(i) or ""
            out.append(bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
        _LOADED[key] = out
    return _LOADED[key]


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _said(ids: list[bytes | None], path: str) -> pa.Array:
    """The texts that ids stand for; bytes that are no UTF-8 become U+FFFD, as the library has it."""
    spell = _spellings(path).__getitem__
    return pa.array([None if x is None else b"".join(map(spell, np.frombuffer(x, dtype="<u4").tolist())).decode("utf-8", "replace") for x in ids], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with a column ``ids`` (array of int) beside its own."""

    def make():
        encoder = ChunkEncoder(path)  # goes at the task's end: workers live on for other stages

        def run(texts: pa.Array) -> Iterator[pa.StructArray]:
            for part in slices(texts, TEXT_BYTES):
                yield pa.StructArray.from_arrays([_lists(encoder.ids(part.to_pylist()))], ["ids"])

        return run

    return from_text(docs, docs.columns, text, "ids array<int>", make)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with a column ``decoded`` beside its own: the text of its ids."""

    def make():
        def run(lists: pa.Array) -> Iterator[pa.StructArray]:
            held = [None if x is None else x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for x in (lists[i] if lists[i].is_valid else None for i in range(len(lists)))]
            yield pa.StructArray.from_arrays([_said(held, path)], ["decoded"])

        return run

    return from_text(tokens, tokens.columns, ids, "decoded string", make)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` and the text ``decoded`` from them, in one pass: ids don't travel to be decoded."""

    def make():
        encoder = ChunkEncoder(path)  # goes at the task's end: workers live on for other stages

        def run(texts: pa.Array) -> Iterator[pa.StructArray]:
            for part in slices(texts, TEXT_BYTES):
                ids = encoder.ids(part.to_pylist())
                yield pa.StructArray.from_arrays([_lists(ids), _said(ids, path)], ["ids", "decoded"])

        return run

    return from_text(docs, docs.columns, text, "ids array<int>, decoded string", make)


def encode_and_check(docs: DataFrame, path: str, columns: Sequence[str], text: str = "text") -> DataFrame:
    """The named columns of docs with ``ids`` and ``intact``, whether these decode to the text (null: the empty one). Neither
    texts nor what is decoded go back to Spark's side."""

    def make():
        encoder = ChunkEncoder(path)  # goes at the task's end: workers live on for other stages

        def run(texts: pa.Array) -> Iterator[pa.StructArray]:
            for part in slices(texts, TEXT_BYTES):
                ids = encoder.ids(part.to_pylist())
                intact = pc.equal(_said(ids, path), pc.fill_null(part.cast(pa.string()), ""))
                yield pa.StructArray.from_arrays([_lists(ids), intact], ["ids", "intact"])

        return run

    return from_text(docs, columns, text, "ids array<int>, intact boolean", make)
