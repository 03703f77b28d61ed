"""BPE encoding and decoding with a contiguous rank array, many short words at a time.

The text of an Arrow batch is split at ASCII white space; each distinct word of a block is
normalised, split into pieces and encoded once, unless the process still knows it from an
earlier block (by its 64-bit hash).  A short piece is a row of two arrays: its
parts' ids and the ranks of adjacent parts.  Each round scans every row for its smallest
rank, merges there, deletes that boundary and refreshes the two neighbouring ranks; rows
whose ranks hold no merge are done.  Rows of one byte length form a matrix, so a round is
a few numpy calls for thousands of pieces.  Pieces over ``SHORT`` bytes go through a heap
with linked neighbours, so an enormous word costs n log n.

The vocabulary comes from a tokenizer file whose path is a parameter; it is read on the
driver, and its arrays (a few MB, fixed by the file) travel with the task closure.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from streamcheck.llm import textkit

SHORT = 64
ROWS = 1 << 14
BLOCK_BYTES = 8 << 20
NO_MERGE = np.int32(2**31 - 1)
# White space of the tokenizer's patterns.
SPACES = r"\t\n\x0B\x0C\r \x85\xA0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class PairTable:
    """(left id, right id) -> (rank, merged id) for arrays of pairs; open addressing."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(left) * 8 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.ranks = np.full(1 << bits, NO_MERGE, dtype=np.int32)
        self.merged = merged.astype(np.int32)
        for rank, key in enumerate(((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).tolist()):
            at = (key * int(self.MULTIPLIER) & (2**64 - 1)) >> int(self.shift)
            while self.ranks[at] != NO_MERGE and int(self.keys[at]) != key:
                at = (at + 1) & self.mask
            if self.ranks[at] == NO_MERGE:
                self.keys[at], self.ranks[at] = key, rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = ((key * self.MULTIPLIER) >> self.shift).astype(np.int64)
        found = np.where(self.keys[at] == key, self.ranks[at], NO_MERGE)
        again = np.nonzero((found == NO_MERGE) & (self.ranks[at] != NO_MERGE))
        while len(again[0]):
            at[again] = (at[again] + 1) & self.mask
            here = at[again]
            hit = self.keys[here] == key[again]
            found[again] = np.where(hit, self.ranks[here], NO_MERGE)
            more = ~hit & (self.ranks[here] != NO_MERGE)
            again = tuple(x[more] for x in again)
        return found


class Encoder:
    """The tokenizer of a file: lower-casing byte-level BPE with word ends and no decoder.

    ``path`` names a tokenizer file in the JSON format of the public ``tokenizers`` library.
    Letters and digits are those of the regex library's Unicode version; characters that
    only a newer version than the tokenizers library's knows may split otherwise.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        spec, self.name = json.loads(content), hashlib.sha256(content.encode("utf-8")).hexdigest()
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing byte-level BPE without a decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for x in spec["added_tokens"]:
            self.tokens[x["id"]] = x["content"]
            self.special[x["content"]] = x["id"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        # White space never occurs inside a word, so three of its characters mark word ends and special tokens.
        self.marks = dict(zip(self.special, "\t\r\x0b\x0c", strict=False))
        self.pattern = rf"[\n{''.join(self.marks.values())}]|{split}"

    # ---- pieces

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, counts) of pieces of equal byte length; row r has parts[r, :counts[r]]."""
        n, width = ids.shape
        out, counts, live = ids.copy(), np.ones(n, dtype=np.int64), np.arange(n)
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while width > 1 and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            go = best != NO_MERGE
            if not go.all():
                done = live[~go]
                out[done, :width], counts[done] = ids[~go], width
                ids, ranks, at, best, live = ids[go], ranks[go], at[go], best[go], live[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            ids[rows, at] = self.pairs.merged[best]
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(len(live), width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(live), width - 2)
            width -= 1
            left = rows[at > 0]
            ranks[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = rows[at < width - 1]
            ranks[right, at[right]] = self.pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])
        out[live, :width], counts[live] = ids, width
        return out, counts

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Parts of one long piece: a heap of (rank, place) over linked neighbours."""
        part, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i), part[i], part[i + 1]) for i in np.flatnonzero(first != NO_MERGE)]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            r = int(self.pairs.rank(np.array([part[i]]), np.array([part[after[i]]]))[0])
            if r != NO_MERGE:
                heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two was merged meanwhile
            part[i], part[j] = int(self.pairs.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in part if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat, offsets): the ids of each piece; pieces hold no line feed."""
        raw = np.frombuffer(("\n".join(pieces) + "\n").encode("utf-8"), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts
        counts = np.zeros(len(pieces), dtype=np.int64)
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(SHORT + 2))
        for length in range(1, SHORT + 1):
            for lo in range(int(bounds[length]), int(bounds[length + 1]), ROWS):
                rows = order[lo : min(lo + ROWS, int(bounds[length + 1]))]
                letters = raw[starts[rows][:, None] + np.arange(length)]
                ids = self.inner[letters]
                ids[:, -1] = self.final[letters[:, -1]]
                parts, counts[rows] = self.merge_rows(ids)
                groups.append((rows, parts))
        longer = {}
        for r in order[int(bounds[SHORT + 1]) :].tolist():
            letters = raw[starts[r] : ends[r]]
            ids = self.inner[letters]
            ids[-1] = self.final[letters[-1]]
            longer[r] = self.merge_long(ids)
            counts[r] = len(longer[r])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(offsets[-1]), dtype=np.uint32)
        for rows, parts in groups:
            keep = np.arange(parts.shape[1]) < counts[rows][:, None]
            flat[(offsets[rows][:, None] + np.arange(parts.shape[1]))[keep]] = parts[keep]
        for r, parts in longer.items():
            flat[offsets[r] : offsets[r] + len(parts)] = parts
        return flat, offsets

    # ---- words

    def encode_words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(flat, offsets): the ids of each word of ``joined``, in which a line feed ends each word."""
        text = joined.decode("utf-8", "replace")
        for token, mark in self.marks.items():
            text = text.replace(token, mark)
        # Lower-casing goes character by character: no special form of sigma at a word's end.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        index: dict[str, int] = {"\n": 0} | {m: i + 1 for i, m in enumerate(self.marks.values())}
        fixed = len(index)
        put = index.setdefault
        codes = np.array([put(p, len(index)) for p in regex.findall(self.pattern, text)], dtype=np.int64)
        flat, offsets = self.encode_pieces(list(index)[fixed:]) if len(index) > fixed else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        flat = np.concatenate([np.array([self.special[t] for t in self.marks], dtype=np.uint32), flat])
        offsets = np.concatenate([[0], np.arange(fixed), offsets[1:] + fixed - 1])  # the line feed has no ids, each mark has one
        counts = np.diff(offsets)[codes]
        ids = flat[ragged(offsets[codes], counts)]
        ends = np.cumsum(counts)[codes == 0] if len(codes) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
        """(i, ids, offsets, words) for blocks of documents from the i-th on; document d of the block has ids[offsets[d]:offsets[d + 1]]."""
        known = _KNOWN.setdefault(self.name, Known())
        for i, _, data, starts, ends, first, hashes in textkit.text_groups(column, most=BLOCK_BYTES):
            keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            new = known.missing(keys)
            if new.any():
                known.add(keys[new], *self.encode_words(gather(data, starts[at[new]], ends[at[new]])))
            at, counts = known.find(keys)
            flat = known.flat[ragged(at, counts)]
            at = np.cumsum(counts) - counts
            ids = flat[ragged(at[which], counts[which])]
            total = np.concatenate([[0], np.cumsum(counts[which])])
            yield i, ids, total[first], Words(flat, np.concatenate([[0], np.cumsum(counts)]), which, first)

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces, as a tokenizer without a decoder does."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


class Known:
    """Words that this process has encoded before: at most ``MOST`` and those of one block, a few tens of MB."""

    MOST = 1 << 20

    def __init__(self) -> None:
        self.keys, self.at, self.counts, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.MOST:
            self.__init__()
        if not len(self.keys):
            return np.ones(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        keys, at, counts = np.concatenate([self.keys, keys]), np.concatenate([self.at, offsets[:-1] + len(self.flat)]), np.concatenate([self.counts, np.diff(offsets)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.counts, self.flat = keys[order], at[order], counts[order], np.concatenate([self.flat, flat])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        return self.at[i], self.counts[i]


_KNOWN: dict[str, Known] = {}


class Words:
    """The distinct words of a block, for decoding each of them once."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, which: np.ndarray, first: np.ndarray):
        self.flat, self.offsets, self.which, self.first = flat, offsets, which, first

    def decoded(self, encoder: Encoder) -> Iterator[bytes]:
        """The decoded text of each document, in UTF-8."""
        names, tokens, at = self.flat.tolist(), [t.encode("utf-8") for t in encoder.tokens], self.offsets.tolist()
        names = [tokens[i] for i in names]
        words = [b" ".join(names[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        which = self.which
        if b"" in words:  # a word of which nothing is left adds no space
            which = which[np.array([len(w) > 0 for w in words], dtype=bool)[which]]
            kept = np.concatenate([[0], np.cumsum(np.array([len(w) > 0 for w in words], dtype=bool)[self.which])])
            first = kept[self.first].tolist()
        else:
            first = self.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield b" ".join([words[i] for i in which[a:b].tolist()])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The byte ranges, with a line feed after each."""
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(starts), 10, dtype=np.uint8)
    to = np.cumsum(lengths + 1) - (lengths + 1)
    out[ragged(to, lengths)] = data[ragged(starts, lengths)]
    return out.tobytes()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode the text of every row.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (of the decoded text in UTF-8), and with
    ``keep_ids`` the ids and the decoded text too.  Null counts as empty; repeated rows each
    return a row; a null id stays null; other columns are not read.  One map over the
    scan: no shuffle.
    """
    encoder = Encoder(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, offsets, words in encoder.encode_column(batch.column(1)):
                n, raw, at = len(offsets) - 1, ids.astype("<u4").view(np.uint8), (offsets * 4).tolist()
                plain = list(words.decoded(encoder))
                columns = {
                    id_col: batch.column(0).slice(i, n),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int64)))
                    columns["decoded"] = pa.array([x.decode("utf-8") for x in plain], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    more = ", ids array<bigint>, decoded string" if keep_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
