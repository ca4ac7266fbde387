"""Packing: token ids of documents into sequences of bounded length, balanced by the cost of attention.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention stays inside a piece.  Documents are cut at
the sequence length; within a block of sequences, pieces go in descending order to the sequence of lowest cost that
still has room for them, and a piece that fits nowhere whole is cut at the room of the sequence of lowest cost.  A
block has as many tokens as its sequences have room; what is left over goes on to the next block.  The last tokens of
a task fill sequences whose lengths are powers of two, which need no padding.

Blocks are packed where their texts are read: no text or token is shuffled, a task holds one block and one slice of
texts, and a lost executor costs the reading of its own parts again.  Tokens come from the distinct words of a slice,
each encoded once.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from headway.llm.common import released, slices

#: Tokens of a sequence.
LENGTH = 4096
#: Sequences of a block, among which costs are balanced.
BLOCK = 256


@dataclass
class Piece:
    """``length`` ids of document ``doc`` from ``start`` on; ``ids`` are those of the whole document."""

    doc: object
    ids: np.ndarray
    start: int
    length: int


class Encoder:
    """Token ids of texts by a ``tokenizers`` file; words that are still known from texts before are not encoded again.

    A word here is what stands between ASCII white space, without the marks behind a last ASCII letter.  So it is a whole number of
    the tokenizer's own words, as long as these hold no white space and no letters together with such marks, and no special
    token holds white space: ``word_bpe_49k`` drops white space and tells letters, digits and marks apart.
    """

    #: Words and characters that are remembered; beyond either, all are forgotten.
    WORDS, CHARS = 600_000, 12_000_000

    def __init__(self, model: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(model), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        mark = one(",")
        self.mark = mark[0] if len(mark) == 1 else None
        #: Whether white space parts words and is dropped; else texts are encoded whole.
        self.by_words = one("a B , c,") == one("a") + one("B") + mark + one("c") + mark
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.chars = np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); many words go into one call, with a mark between that none of them holds."""
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        plain = np.array([self.mark is not None and "," not in w for w in words], bool)
        at = np.flatnonzero(plain)
        groups = [at[k : k + 512] for k in range(0, len(at), 512)] + [np.array([k]) for k in np.flatnonzero(~plain)]
        texts = [" , ".join([words[k] for k in g]) for g in groups]
        order = []
        for k in range(0, len(texts), 64):
            for g, e in zip(groups[k : k + 64], self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                if len(g) > 1:
                    marks = np.flatnonzero(got == self.mark)
                    sizes[g] = np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1
                    got = got[got != self.mark]
                else:
                    sizes[g] = len(got)
                ids.append(got)
                order.append(g)
        if not order:
            return np.empty(0, np.uint32), sizes
        flat, order = np.concatenate(ids), np.concatenate(order)
        heads = np.zeros(len(words), np.int64)
        heads[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def codes(self, words: pa.Array) -> np.ndarray:
        """The number of each of the distinct ``words``."""
        names = words.to_pylist()
        fresh = [w for w in names if w not in self.known]
        flat, sizes = self.of_words(fresh)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.chars += sum(map(len, fresh))
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, and the end's id; null is empty."""
        if len(self.known) > self.WORDS or self.chars > self.CHARS:
            self.forget()
        if not self.by_words:
            whole = [t or "" for t in texts.to_pylist()]
            return [np.array([*e.ids, self.end], np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # each distinct part is a word and the marks behind it, either of which may be empty
        cut = pc.extract_regex(distinct, r"^(?P<word>.*[A-Za-z])(?P<marks>[,.;:!?]+)$")
        halves = [pc.coalesce(pc.struct_field(cut, "word"), distinct), pc.fill_null(pc.struct_field(cut, "marks"), "")]
        numbers = []
        for half in halves:
            h = half.dictionary_encode()
            numbers.append(self.codes(h.dictionary)[h.indices.to_numpy()])
        taken = np.stack([n[codes] for n in numbers], 1).ravel()
        many = self.ends[taken + 1] - self.ends[taken]
        at = np.cumsum(many)
        ids = self.flat[np.repeat(self.ends[taken] - (at - many), many) + np.arange(many.sum())]
        upto = np.concatenate([[0], at])[2 * np.cumsum(lengths)]
        out, begin = [], 0
        for end in upto:
            out.append(np.append(ids[begin:end], np.uint32(self.end)))
            begin = end
        return out


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def balanced(pieces: list[Piece], rooms: list[int], linear: float, quadratic: float) -> tuple[list[list[Piece]], list[float], list[Piece]]:
    """(pieces of each sequence in order, its cost, pieces left over); no piece may be longer than the largest room.

    Descending pieces go to the sequence of lowest cost with room for the whole, then to that of lowest cost with any
    room, which cuts them.  All room is used when the pieces have as many tokens.
    """
    room, cost = np.array(rooms, np.int64), np.zeros(len(rooms))
    packed: list[list[Piece]] = [[] for _ in rooms]
    # by length, then as they came
    queue = [(-p.length, k, p) for k, p in enumerate(pieces)]
    heapq.heapify(queue)
    left, n = int(room.sum()), len(queue)
    while queue and left:
        _, k, p = heapq.heappop(queue)
        s = int(np.where(room >= p.length, cost, np.inf).argmin())
        if room[s] < p.length:
            s = int(np.where(room > 0, cost, np.inf).argmin())
            n += 1
            rest = p.length - int(room[s])
            heapq.heappush(queue, (-rest, n, Piece(p.doc, p.ids, p.start + int(room[s]), rest)))
            p = Piece(p.doc, p.ids, p.start, int(room[s]))
        packed[s].append(p)
        room[s] -= p.length
        cost[s] += linear * p.length + quadratic * p.length * p.length
        left -= p.length
    return packed, cost.tolist(), [p for _, _, p in sorted(queue, key=lambda q: q[1])]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    length: int = LENGTH,
    block: int = BLOCK,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, sequence_cost[, ids]``: the pieces.

    Every id of every row, its end included, lies in exactly one piece, and pieces of a sequence follow each other from offset 0.
    ``ids`` are little-endian unsigned 32-bit.  Sequences have ``length`` tokens or a power of two below it, the latter
    only at the end of a task; their ids hold the task's partition.  The same partitions give the same result.

    Null and empty texts are one end's id.  Rows with equal or null ids are documents of their own; other columns, whatever
    their names, are ignored; an empty table gives an empty result.  A text longer than a slice is encoded alone.
    The tokenizer file is read once on the driver and travels with the task.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = Encoder(model, end_id), TaskContext.get().partitionId() << 33
        pool, held, schema = [], 0, None

        def written(packed: list[list[Piece]], costs: list[float]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for seq, cost in zip(packed, costs, strict=True):
                total, offset = sum(p.length for p in seq), 0
                for p in seq:
                    raw = p.ids[p.start : p.start + p.length].astype("<u4", copy=False).tobytes()
                    rows.append((p.doc, p.start, p.length, zlib.crc32(raw), len(p.ids), number, offset, total, cost, *([raw] if with_ids else [])))
                    offset += p.length
                number += 1
            cols = list(zip(*rows, strict=True))
            kinds = [schema.field(0).type, *[pa.int64()] * 7, pa.float64(), *([pa.binary()] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in (part for whole in batches for part in slices(whole, 1)):
            schema = b.schema
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                for start in range(0, len(ids), length):
                    pool.append(Piece(doc, ids, start, min(length, len(ids) - start)))
                    held += pool[-1].length
                    if held >= block * length:
                        packed, costs, pool = balanced(pool, [length] * block, linear, quadratic)
                        held -= block * length
                        yield written(packed, costs)
        if pool:
            packed, costs, rest = balanced(pool, [length] * (held // length) + powers(held % length), linear, quadratic)
            assert not rest
            yield written(packed, costs)

    extra = ", ids binary" if with_ids else ""
    return narrow.mapInArrow(released(run), f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double{extra}")
