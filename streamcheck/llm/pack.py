"""Order-preserving packing: window cuts chosen by dynamic programming.

The tokens of a partition's documents, in order, are one long sequence.  ``cost(j)`` is the
least total of padding and cut penalties over all ways to cut the tokens before place j
into windows of at most ``width`` tokens:

    cost(j) = penalty(j) + min over j - width <= i < j of cost(i) + width - (j - i)

As width - j does not depend on i, the minimum is that of cost(i) + i over a sliding range,
which a monotone queue yields in constant amortised time.  Places are document ends (no
penalty), sentence ends (small) and every ``grid``-th token (larger), so that text without
sentences still packs.  Windows keep documents in their order and cut nothing twice.

The last window of a block of text opens the next block, so only the end of a partition
leaves a short window; it is written as sequences whose lengths are powers of two, which
need no padding.  A task holds one block of text at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from streamcheck.llm.bpe import Encoder

WIDTH = 2048
SENTENCE_PENALTY, TOKEN_PENALTY, GRID = 4, 32, 32
END_ID = 1


def cut_windows(places: np.ndarray, penalties: np.ndarray, width: int) -> list[int]:
    """Window ends of least cost; places ascend from after 0 to the last token, at most ``width`` apart."""
    at, pen = [0, *places.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(at), [0] * len(at)
    queue = deque([(0, 0)])  # (cost(i) + place of i, i), ascending in both
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - width:
            queue.popleft()
        best, back[j] = queue[0]
        cost[j] = best + width - here + pen[j]
        key = cost[j] + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def candidate_places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, sentence_penalty: int, token_penalty: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    penalty = np.full(total + 1, -1, dtype=np.int32)
    penalty[grid::grid] = token_penalty
    penalty[sentence_ends] = sentence_penalty
    penalty[doc_ends] = 0
    penalty[total], penalty[0] = 0, -1
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs the documents of one partition, block by block."""

    def __init__(self, first_sequence: int, width: int, sentence_penalty: int, token_penalty: int, grid: int):
        self.next, self.width, self.rule = first_sequence, width, (sentence_penalty, token_penalty, grid)
        self.rest = np.zeros(0, np.uint32)  # tokens of the open window, and the documents that they belong to:
        self.open_keys: list = []
        self.open_ends, self.open_start, self.open_tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, last: bool) -> list[tuple]:
        """Pieces of the windows that are closed: (key, start, length, crc, doc tokens, sequence, offset)."""
        held = len(self.rest)
        flags = np.concatenate([np.zeros(held, dtype=bool), sentence_end])
        tokens, n = np.concatenate([self.rest, ids]), np.diff(ends, prepend=0)
        keys = [*self.open_keys, *keys]
        ends = np.concatenate([self.open_ends, ends + held])
        began = np.concatenate([self.open_start, np.zeros(len(n), np.int64)])  # ids of the document in earlier windows
        size = np.concatenate([self.open_tokens, n])
        if not len(tokens):
            return []
        cuts = cut_windows(*candidate_places(len(tokens), ends, np.flatnonzero(flags) + 1, *self.rule), self.width)
        from_ = cuts[-2] if len(cuts) > 1 else 0
        if last:
            cuts[-1:] = (from_ + np.cumsum(powers_of_two(cuts[-1] - from_))).tolist()
            from_ = cuts[-1]
        else:
            cuts.pop()
        pieces = self.pieces(tokens, keys, ends, began, size, cuts)
        keep = np.flatnonzero(ends > from_)
        starts = np.concatenate([[0], ends[:-1]])
        self.rest, self.open_keys = tokens[from_:], [keys[k] for k in keep]
        self.open_ends, self.open_start, self.open_tokens = ends[keep] - from_, began[keep] + np.maximum(0, from_ - starts[keep]), size[keep]
        return pieces

    def pieces(self, tokens: np.ndarray, keys: list, ends: np.ndarray, began: np.ndarray, size: np.ndarray, cuts: list[int]) -> list[tuple]:
        if not cuts:
            return []
        windows = np.array([0, *cuts])
        stops = np.union1d(ends[ends <= cuts[-1]], windows[1:])
        starts = np.concatenate([[0], stops[:-1]])
        doc, window = np.searchsorted(ends, stops), np.searchsorted(windows, stops) - 1
        doc_start = np.concatenate([[0], ends[:-1]])[doc]
        raw = memoryview(tokens.astype("<u4").tobytes())
        rows = zip(doc.tolist(), (began[doc] + starts - doc_start).tolist(), (stops - starts).tolist(), size[doc].tolist(), (self.next + window).tolist(), (starts - windows[window]).tolist(), starts.tolist(), strict=True)
        out = [(keys[d], s, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), t, w, o) for d, s, n, t, w, o, a in rows]
        self.next += len(cuts)
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID, sentence_penalty: int = SENTENCE_PENALTY, token_penalty: int = TOKEN_PENALTY, grid: int = GRID) -> DataFrame:
    """Pack the tokens of every document, each followed by ``end_id``, into sequences of at most ``width`` tokens.

    Returns one row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.  Null text is empty and leaves the end id alone; repeated rows
    are packed each; a null id stays null; other columns are not read; no rows, no pieces.
    Sequence ids are the partition's number times 2**40 and on, so tasks need no agreement and
    a task that runs again gives the same rows.  One map over the scan: no shuffle.
    """
    encoder = Encoder(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    final = np.array([re.fullmatch(r"[.!?…。！？]+[\"')\]]*", t.removesuffix("</w>")) is not None for t in encoder.tokens])
    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, width, sentence_penalty, token_penalty, grid)

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_pydict({id_col: pa.array(columns[0], kind)} | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns[1:], strict=True)})

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for i, ids, offsets, _ in encoder.encode_column(batch.column(1)):
                n = len(offsets) - 1
                ends = offsets[1:] + np.arange(1, n + 1)  # an end id after each document
                tokens = np.insert(ids, offsets[1:], end_id).astype(np.uint32)
                rows = packer.add(batch.column(0).slice(i, n).to_pylist(), tokens, ends, final[tokens], last=False)
                if rows:
                    yield out(rows, key_type)
        rows = packer.add([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, dtype=bool), last=True)
        if rows:
            yield out(rows, key_type)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
