"""Importance resampling towards a target: n-gram features, hashed buckets, and a draw by perturbed weights.

The features of a text are its runs of 1 to ``max_n`` consecutive words, hashed into buckets.  A
bucket's gain is the logarithm of how much more often the target's features fall into it than the
corpus's; a document's weight is the mean gain of its features.  Weights with Gumbel noise, which
is a hash of the id, are ranked, and the highest are a sample drawn in proportion to importance.

Features come from suffix arrays: each block of texts is one sequence of word ids, each text ended by
a mark of its own, so that no run goes over an end.  In the suffix array the places where a run of n
words repeats stand together, and neighbours whose common prefix is n words or longer are the same
run: a run is hashed once and its bucket goes back to all of its places.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamcheck.llm import textkit
from streamcheck.llm.shared import Scratch, free_names

BLOCK_BYTES = 4 << 20
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over UTF-8 bytes with A-Z lower-cased: every byte of other characters is over 0x7F.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``sequence`` in order, by prefix doubling.

    A sequence of non-negative numbers in which every tie between two suffixes ends within it (a
    mark that occurs once ends each text).  A suffix's rank is the first place that its equals so
    far take; each round only sorts those that still have equals.
    """
    order = np.argsort(sequence, kind="stable")
    values = sequence[order]
    head = np.ones(len(order), bool)
    head[1:] = values[1:] != values[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    single = head & np.append(head[1:], True)
    tied, reach = order[~single], 1
    while len(tied):
        now, beyond = rank[tied], rank[tied + reach]
        by = np.lexsort((beyond, now))
        tied, now, beyond = tied[by], now[by], beyond[by]
        group = np.ones(len(tied), bool)
        group[1:] = now[1:] != now[:-1]
        at = np.arange(len(tied))
        place = now + at - np.maximum.accumulate(np.where(group, at, 0))
        head = group.copy()
        head[1:] |= beyond[1:] != beyond[:-1]
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(head, at, 0))]
        tied = tied[~(head & np.append(head[1:], True))]
        reach *= 2
    return order


def block_buckets(texts: list[bytes], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, bucket of each feature, offsets of the texts' features) of one block."""
    found = [WORDS.findall(t.lower()) for t in texts]
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    code: dict[bytes, int] = {}
    flat = [w for words in found for w in words]
    for w in flat:
        if w not in code:
            code[w] = len(code)
    # Words are numbered after the marks that end the texts.
    ends = np.cumsum(n_words + 1) - 1
    sequence = np.empty(len(flat) + len(texts), np.int64)
    is_word = np.ones(len(sequence), bool)
    is_word[ends] = False
    sequence[ends] = np.arange(len(texts))
    sequence[is_word] = np.fromiter((code[w] for w in flat), np.int64, len(flat)) + len(texts)
    order = suffix_array(sequence)
    text_of = np.repeat(np.arange(len(texts)), n_words + 1)
    words, marks = list(code), len(texts)
    all_texts, all_buckets = [], []
    for n in range(1, max_n + 1):
        places = order[order + n <= ends[text_of[order]]]
        same = np.ones(max(len(places) - 1, 0), bool)
        for m in range(n):
            same &= sequence[places[1:] + m] == sequence[places[:-1] + m]
        head = np.append(True, ~same)[: len(places)]
        first = places[head]
        run = [b" ".join([words[c - marks] for c in sequence[p : p + n].tolist()]) for p in first.tolist()]
        hashed = np.fromiter((zlib.crc32(r) % buckets for r in run), np.int64, len(run))
        bucket = np.empty(len(sequence), np.int64)
        bucket[places] = hashed[np.cumsum(head) - 1]
        places = np.sort(places)
        all_texts.append(text_of[places])
        all_buckets.append(bucket[places])
    owner, bucket = np.concatenate(all_texts), np.concatenate(all_buckets)
    by = np.argsort(owner, kind="stable")
    return n_words, bucket[by], np.searchsorted(owner[by], np.arange(len(texts) + 1))


def ngram_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``id_col``, ``n_words`` and ``features``, the bucket of each run of 1 to ``max_n`` words, for every row.

    Null and empty texts have none.  A text longer than a block is a block of its own.  One map: no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(1))
            for i, j in textkit.doc_groups(offsets, BLOCK_BYTES):
                cuts = offsets[i : j + 1].tolist()
                n_words, bucket, at = block_buckets([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], max_n, buckets)
                yield pa.RecordBatch.from_pydict({
                    id_col: batch.column(0).slice(i, j - i),
                    "n_words": pa.array(n_words),
                    "features": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32())),
                })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_words bigint, features array<int>")


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket: combined before one small shuffle, ``buckets`` rows to the driver."""
    counts = np.zeros(buckets, np.int64)
    for bucket, n in featured.select(F.explode("features").alias("b")).groupBy("b").agg(F.count("*")).collect():
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    s_all, t_all, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + b) / ((int(s) + 1) * (t_all + b)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weigh(featured: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """``id_col``, n_words, n_features and weight: the floored mean gain of a row's features, 0 of none."""
    kind = featured.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_words": batch.column(1), "n_features": pa.array(sizes.astype(np.int64)), "weight": pa.array(np.where(sizes > 0, total // np.maximum(sizes, 1), 0))})

    return featured.mapInArrow(run, f"{id_col} {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, first: str, order: list, scratch: Scratch) -> DataFrame:
    """``rank``: 1, 2, 3, ... in ``order`` of the rows where the boolean column ``first`` holds, null elsewhere.

    Rows are dealt by ranges and sorted within them; a row's rank is its place in its range after
    those of the ranges before: no task and no window holds all rows.
    """
    at, part, before = free_names(rows, "at", "part", "before")
    dealt = rows.repartitionByRange(F.col(first).desc(), *order).sortWithinPartitions(F.col(first).desc(), *order)
    dealt = scratch.write(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(at, 33))
    sizes = sorted((p, n) for p, n in dealt.groupBy(part).agg(F.count("*")).collect())  # a row for each range
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], f"{part} bigint, {before} bigint")
    place = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(offsets), part).withColumn("rank", F.when(F.col(first), place)).drop(at, part, before)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """Every row of ``docs`` with its features' number, weight, score and, where it is drawn, its rank.

    Counts cover all texts of both tables.  Of the N rows of ``least_words`` words or more the
    floor(percent N / 100) highest scores are drawn, ties to the smaller id and null ids last; rows that
    repeat are drawn each.  A null id hashes as an empty one.  Null and empty texts have no feature and
    weight 0; of an empty target all gains are those of T = t = 0.  Other columns are not read.

    The texts are read once and their buckets written; counts, weights and ranks are made of those.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    featured = scratch.write(ngram_buckets(docs, id_col, text_col, max_n, buckets), "features")
    aims = ngram_buckets(target.select(F.lit(0).alias("_"), text_col), "_", text_col, max_n, buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(aims, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    uniform = (F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = weigh(featured, gain, id_col).select(id_col, "n_features", "weight", (F.col("weight") + noise).cast("bigint").alias("score"), (F.col("n_words") >= least_words).alias("_fit"))
    out = ranked(scored, "_fit", [F.col("score").desc(), F.col(id_col).asc_nulls_last()], scratch)
    most = out.agg(F.coalesce(F.count_if("_fit"), F.lit(0))).first()[0] * percent // 100
    return out.select(id_col, "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
