"""Token counts of every prefix of a text, by dynamic programming, under a byte-level BPE vocabulary.

Of each prefix the last token of its encoding is known: it is the one token that ends there and
stands next to the last token of the prefix before it, as the pair would be encoded so.  Hence
``count(prefix) = count(prefix without that token) + 1``: one pass gives the exact count at every
character, and questions about truncation and budgets are answered from the counts without
encoding again.  Counts are of the prefix as a text of its own; they need not rise: another
character may complete a longer token.

Texts are cut into pieces as the vocabulary's pre-tokenizer does, and a piece met before is not
worked out again.  Where a prefix would be cut into other pieces than the whole text (inside a run
of blanks, an English contraction or a special string) its count is that of its own pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamcheck.llm import textkit
from streamcheck.llm.bpe import ragged

#: What counts as white space in pieces.
SPACES = {chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
OTHER, LETTER, DIGIT, SPACE = range(4)
#: Contractions whose first two characters are no piece: the quote and the letter are two.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
BLOCK_BYTES = 4 << 20
#: Bytes of a piece, and pieces, that are worked out together.
WIDE, STEP = 64, 4096
#: Characters of pieces that a process remembers.
MOST_KNOWN = 1 << 23


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next code over 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def classes(tokenizer: Tokenizer) -> np.ndarray:
    """The class of each code point, with letters and digits as the tokenizer's own version of Unicode has them.

    Every letter and digit of this process's version is shown to the pre-tokenizer once; what it
    takes for something else is of the class ``OTHER``.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name, mate in ((LETTER, "L", "a"), (DIGIT, "N", "1")):
        known = regex.findall(rf"\p{{{name}}}", every)
        cuts = {start for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(mate + c for c in known))}
        out[[ord(c) for i, c in enumerate(known) if 2 * i + 1 not in cuts]] = kind
    out[[ord(c) for c in SPACES]] = SPACE
    return out


def piece_starts(points: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of a block begin: ``points`` and ``kinds`` of its characters, ``texts`` where its texts begin.

    Runs of one class are pieces.  Of a run of white space before something else the last character stands
    alone, and joins what follows if it is a blank; the run at a text's end is one piece.  An
    apostrophe alone between others takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    start[texts] = True
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    more = end < n
    more[more] = ~np.isin(end[more], texts)
    spaces = end[(kinds[run] == SPACE) & more]
    start[spaces - 1] = True
    start[spaces[points[spaces - 1] == 32]] = False
    quote = end[(points[run] == 39) & (end - run == 1) & more & start[run]]
    quote = quote[kinds[quote] == LETTER]
    one = quote[np.isin(points[quote], [ord(c) for c in "stmd"])]
    pairs = quote[quote + 1 < n]
    pairs = pairs[~start[pairs + 1]]
    first, second = points[pairs], points[pairs + 1]
    two = pairs[((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))]
    start[one] = start[two] = False
    start[(one + 1)[one + 1 < n]] = True
    start[(two + 2)[two + 2 < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens by their bytes, numbered by the order of merging: bytes first, then merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary without normalizer and prefix space")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take blanks with them or stand for whole words are not supported")
        self.name, self.classes = path, classes(Tokenizer.from_file(path))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        letters = byte_letters()
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        for merge in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if ranks.setdefault(a + b, len(self.left)) != len(self.left):
                raise ValueError("two merges make the same token")
            self.left.append(ranks[a])
            self.right.append(ranks[b])
        self.merged = {self.left[t] << 32 | self.right[t]: t for t in range(256, len(self.left))}
        #: Token of a byte string, -1 where it only begins tokens.
        self.reach = {w[:n]: -1 for w in ranks for n in range(1, len(w))} | ranks


class Tables:
    """A vocabulary as arrays: its trie and its merges, to follow many pieces at a time."""

    def __init__(self, v: Vocabulary):
        nodes = {b"": 0} | {w: i + 1 for i, w in enumerate(sorted(v.reach))}
        self.child = np.zeros((len(nodes), 256), np.int32)  # 0: none, as nothing leads to the root
        self.token = np.full(len(nodes), -1, np.int32)
        for w, i in nodes.items():
            if w:
                self.child[nodes[w[:-1]], w[-1]] = i
                self.token[i] = v.reach[w]
        self.left, self.right = np.array(v.left, np.int64), np.array(v.right, np.int64)
        keys = np.fromiter(v.merged, np.uint64, len(v.merged))
        values = np.fromiter(v.merged.values(), np.int64, len(v.merged))
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, 1 << 60, np.int64)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):  # each free slot takes one of those that ask for it, the others go on to the next
            free = self.keys[slot[todo]] == 2**64 - 1
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, a number over all tokens where it does not."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self.slot(keys)
        seen, out = self.keys[slot], self.values[slot]
        at = np.flatnonzero((seen != keys) & (seen != 2**64 - 1))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            seen, out[at] = self.keys[slot], self.values[slot]
            go = (seen != keys[at]) & (seen != 2**64 - 1)
            at, slot = at[go], slot[go]
        return out

    def stand_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Counter.stand_together`` of many pairs."""
        fine, at, limit = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60, np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            go = self.merge(a, b) >= limit
            end = go & (a < 256) & (b < 256)
            fine[at[end]] = True
            go &= ~end
            at, a, b = at[go], a[go], b[go]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return fine

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Row i: the counts at the bytes of piece i (all pieces of at most ``WIDE`` bytes; behind a piece's end nothing is meant)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        last, count = np.full((width + 1, len(pieces)), -1, np.int32), np.zeros((width + 1, len(pieces)), np.int32)
        for p in range(width):
            rows = np.flatnonzero(sizes > p)
            node = np.zeros(len(rows), np.int32)
            for q in range(p, width):
                node = self.child[node, raw[rows, q]]
                live = (node > 0) & (sizes[rows] > q)
                if not live.all():
                    rows, node = rows[live], node[live]
                if not len(rows):
                    break
                token = self.token[node]
                hit = np.flatnonzero((token >= 0) & (last[q + 1, rows] < 0))
                if p and len(hit):
                    hit = hit[self.stand_together(last[p, rows[hit]], token[hit])]
                last[q + 1, rows[hit]] = token[hit]
                count[q + 1, rows[hit]] = count[p, rows[hit]] + 1
        return count[1:].T


class Counter:
    """Prefix counts of texts; pieces met before are kept, ``MOST_KNOWN`` characters of them and one block's at most."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pairs, self.tables = vocabulary, {}, Tables(vocabulary)
        self.specials = regex.compile("|".join(regex.escape(s) for s in vocabulary.special)) if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.pieces: list[str] = []
        self.done, self.used = 0, 0
        self.flat, self.start, self.size, self.total = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blank, self.opens = np.zeros(0, bool), np.zeros(0, bool)

    def stand_together(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as a, b.

        Undo the merges that made the two, the later first; of equal ones the left one was first.
        A merge over the boundary that comes before one undone would have been made instead.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        left, right, merged, limit, fine = self.v.left, self.v.right, self.v.merged, 1 << 60, True
        while True:
            if merged.get(a << 32 | b, 1 << 60) < limit:
                fine = False
                break
            if a < 256 and b < 256:
                break
            if a > b:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]
        if len(self.pairs) > 1 << 21:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def piece_counts(self, piece: str) -> list[int]:
        """The count at the end of each character of one piece."""
        raw = piece.encode("utf-8")
        n, reach, fits = len(raw), self.v.reach, self.stand_together
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for p in range(n):
            before, q, c = last[p], p + 1, count[p] + 1
            while q <= n:
                t = reach.get(raw[p:q])
                if t is None:
                    break
                if t >= 0 and last[q] < 0 and (not p or fits(before, t)):
                    last[q], count[q] = t, c
                q += 1
        return count[1:] if n == len(piece) else [count[q] for q in range(1, n + 1) if q == n or raw[q] & 0xC0 != 0x80]

    def all_counts(self, pieces: list[str]) -> list[list[int]]:
        """``piece_counts`` of each: short ones of like length together, longer ones one by one."""
        raw = [p.encode("utf-8") for p in pieces]
        order = sorted((i for i, r in enumerate(raw) if len(r) <= WIDE), key=lambda i: len(raw[i]))
        out: list[list[int]] = [[]] * len(pieces)
        for k in range(0, len(order), STEP):
            some = order[k : k + STEP]
            for i, counts in zip(some, self.tables.counts([raw[i] for i in some]).tolist(), strict=True):
                n, r = len(raw[i]), raw[i]
                out[i] = counts[:n] if n == len(pieces[i]) else [counts[q - 1] for q in range(1, n + 1) if q == n or r[q] & 0xC0 != 0x80]
        for i, r in enumerate(raw):
            if len(r) > WIDE:
                out[i] = self.piece_counts(pieces[i])
            if pieces[i] in LONG_CONTRACTIONS:
                out[i][1] = 2
        return out

    def learn(self) -> None:
        """Work out the pieces that have a code but no counts yet."""
        new = self.pieces[self.done :]
        if not new:
            return
        counts = self.all_counts(new)
        sizes = np.fromiter(map(len, counts), np.int64, len(new))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, len(self.flat)), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((c for x in counts for c in x), np.int32, total)
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size, self.total = np.concatenate([self.size, sizes]), np.concatenate([self.total, np.fromiter((c[-1] for c in counts), np.int64, len(new))])
        self.blank = np.concatenate([self.blank, np.fromiter((SPACES.issuperset(p) for p in new), bool, len(new))])
        self.opens = np.concatenate([self.opens, np.fromiter((p[0] in SPACES for p in new), bool, len(new))])
        self.used, self.done = self.used + total, len(self.pieces)

    def number(self, piece: str) -> int:
        at = self.code.setdefault(piece, len(self.pieces))
        if at == len(self.pieces):
            self.pieces.append(piece)
        return at

    def codes(self, text: bytes, cuts: np.ndarray) -> np.ndarray:
        """The code of each piece; ``cuts`` has the characters where pieces begin.  New pieces get the next codes."""
        if not len(cuts):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)[cuts]
        offsets = np.append(at, len(text)).astype(np.int64)
        told = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode()
        return np.fromiter(map(self.number, told.dictionary.to_pylist()), np.int64, len(told.dictionary))[told.indices.to_numpy()]

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, offsets): the counts of text i are counts[offsets[i]:offsets[i + 1]]; special strings are ordinary text."""
        if self.used > MOST_KNOWN:
            self.forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        cuts = piece_starts(points, self.v.classes[points], begin) if len(points) else np.zeros(0, np.int64)
        codes = self.codes(joined.encode("utf-8"), cuts)
        self.learn()
        first = np.searchsorted(cuts, np.concatenate([[0], np.cumsum(sizes)]))
        lengths = np.diff(first)
        totals, sizes = self.total[codes], self.size[codes]
        before = np.concatenate([[0], np.cumsum(totals)])
        base = before[:-1] - np.repeat(before[first[:-1]], lengths)
        at = np.concatenate([[0], np.cumsum(sizes)])
        counts = (self.flat[ragged(self.start[codes], sizes)] + np.repeat(base, sizes)).astype(np.int32)
        # A prefix that ends with a run of blanks has the whole run as one piece; the text leaves its last one to what follows.
        split = np.flatnonzero(self.blank[codes[:-1]] & self.opens[codes[1:]]) + 1 if len(codes) else codes
        split = split[np.isin(split, first, invert=True)]
        if len(split):
            runs = [self.number(self.pieces[a] + self.pieces[b][0]) for a, b in zip(codes[split - 1].tolist(), codes[split].tolist(), strict=True)]
            self.learn()
            counts[at[split]] = base[split - 1] + self.total[runs]
        return counts, at[first]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``, with special strings as one token each: the text up to one is a text of its own."""
        special = [i for i, t in enumerate(texts) if self.specials and self.specials.search(t)]
        if not special:
            return self.plain(texts)
        parts, of, ends = [], [], []
        for i, text in enumerate(texts):
            at = 0
            for m in self.specials.finditer(text) if self.specials else ():
                parts.append(text[at : m.end() - 1])  # all but its last character may also be ordinary text
                ends.append(m.start() - at)
                of.append(i)
                at = m.end()
            parts.append(text[at:])
            ends.append(-1)
            of.append(i)
        flat, offsets = self.plain(parts)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        base = [0] * len(texts)
        for k, (i, end) in enumerate(zip(of, ends, strict=True)):
            own = flat[offsets[k] : offsets[k + 1]] + base[i]
            out[i].append(own)
            if end >= 0:
                base[i] = (int(own[end - 1]) if end else base[i]) + 1
                out[i].append(np.array([base[i]], np.int32))
        each = [np.concatenate(x).astype(np.int32) for x in out]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of the text in UTF-8) and ``counts``: the token count of every prefix, one for each character.

    Null counts as empty (no counts); repeated rows each return a row; a null id stays null; other
    columns are not read.  Very long texts are one row of counts, of four bytes a character.  One map
    over the scan: no shuffle.
    """
    vocabulary = Vocabulary(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(vocabulary.name) or _COUNTERS.setdefault(vocabulary.name, Counter(vocabulary))
        for batch in batches:
            _, offsets = textkit.buffers(batch.column(1))
            for i, j in textkit.doc_groups(offsets, BLOCK_BYTES):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                counts, at = counter.texts(texts)
                yield pa.RecordBatch.from_pydict({
                    id_col: batch.column(0).slice(i, j - i),
                    "n_bytes": pa.array(np.diff(offsets[i : j + 1])),
                    "counts": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(counts, pa.int32())),
                })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, counts array<int>")


def token_count(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("bigint")


def count_at(counts: Column, characters: Column) -> Column:
    """Tokens of the first ``characters`` characters, all of them where the text is shorter."""
    n = F.least(characters, F.size(counts))
    return F.when(n <= 0, F.lit(0)).otherwise(F.try_element_at(counts, n.cast("int"))).cast("bigint")


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    back = F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), True)
    cut = F.when(back > 0, F.size(counts) - back + 1).otherwise(F.lit(0))
    return F.when(token_count(counts) <= budget, F.size(counts)).otherwise(cut).cast("bigint")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and cut_chars (the longest prefix within it), from prefix counts."""
    c = F.col("counts")
    counted = prefix_counts(docs, tokenizer)
    return counted.select("doc_id", "n_bytes", token_count(c).alias("n_tokens"), (token_count(c) > limit).alias("over_limit"), longest_within(c, limit).alias("cut_chars"))
