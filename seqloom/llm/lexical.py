"""Ranked lexical search by the Best Position Algorithm over impact lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import utf8
from seqloom.plans.session import drop_table, write_table

TOP = 10

#: Distinct (item, term) rows that are sent to the tasks at once; more items are asked in batches.
MOST_TERMS = 1 << 20

#: Postings of the lists that a task holds at once, about, and documents.
LIST_POSTINGS, LIST_DOCS = 1 << 21, 1 << 16

#: Positions of each list that a round of sorted access reads.
DEPTH = 32

#: Bytes of a text that are cut into terms at once.
_STRETCH = 1 << 22
_NO_ID = (1 << 63) - 1

# Letters and digits of ASCII and all longer characters make terms; capitals A-Z become small.
_TERM = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded stretch at a time."""
    at = 0
    while at < len(text):
        end = at + _STRETCH
        part = text[at:end].translate(_TERM)
        if end < len(text):
            cut = part.rfind(b" ") + 1
            while not cut:  # one term longer than the stretch
                end += _STRETCH
                part = text[at:end].translate(_TERM)
                cut = len(part) if end >= len(text) else part.rfind(b" ") + 1
            part = part[:cut]
        yield part.split()
        at += len(part)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term) of each item, once each; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            data, starts = utf8(batch.column(1))
            for i in range(batch.num_rows):
                own = set()
                for part in terms_of(data[starts[i] : starts[i + 1]].tobytes()):
                    own.update(part)
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])

    source = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "item bigint, term binary").distinct()


def _tallied(number: dict[bytes, int]):
    """(id, n, terms, tfs) of every document: all its terms counted, those that are asked listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            sizes, terms, tfs = [], [], []
            for i in range(batch.num_rows):
                n, tf = 0, Counter()
                for part in terms_of(data[starts[i] : starts[i + 1]].tobytes()):
                    n += len(part)
                    tf.update(number[t] for t in part if t in number)
                sizes.append(n)
                terms.append(list(tf))
                tfs.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["id", "n", "terms", "tfs"],
            )

    return run


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to the score of a document, in whole numbers."""
    if len(n) and 90 * docs * int(n.max()) >= 1 << 63:
        m = np.array([10 + 90 * docs * int(x) // length for x in n.tolist()], np.int64)
    else:
        m = 10 + 90 * docs * n // max(length, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Lists:
    """Impact lists of some documents: postings of each term by falling impact, and by document for direct access."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        falling = np.lexsort((doc, -impact, term))
        self.bounds = np.searchsorted(term[falling], np.arange(terms + 1))
        self.doc, self.impact = doc[falling], impact[falling]
        place = np.arange(len(doc)) - self.bounds[term[falling]]
        by_doc = np.lexsort((self.doc, term[falling]))
        self.doc_sorted, self.impact_by_doc, self.place_by_doc = self.doc[by_doc], self.impact[by_doc], place[by_doc]

    def search(self, asked: np.ndarray, top: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the ``top``, and the postings read in sorted access.

        ``best`` are ids and scores of the best found elsewhere, which the
        stopping test counts too. Each round reads DEPTH postings of each list;
        a document met for the first time is looked up in all lists, which
        also tells its positions there. The best position of a list is the last
        of those seen without a gap from its head. An unmet document lies beyond
        it in every list, so the impacts after the best positions, added up,
        bound its score: the search stops when that is strictly below the
        ``top``-th score, or nothing is left, so no tie is missed.
        """
        spans = [(self.bounds[t], self.bounds[t + 1]) for t in asked if self.bounds[t] < self.bounds[t + 1]]
        heads = [self.impact[lo:hi] for lo, hi in spans]
        seen = [np.zeros(hi - lo, bool) for lo, hi in spans]
        at = [0] * len(spans)
        met = np.zeros(0, np.int64)
        score = np.zeros(0, np.int64)
        depth = read = 0
        while True:
            bound = sum(int(h[p]) for h, p in zip(heads, at, strict=True) if p < len(h))
            whole = np.concatenate((best[1], score))
            kth = int(np.partition(whole, len(whole) - top)[len(whole) - top]) if len(whole) >= top else 0
            if not bound or bound < kth:
                return met, score, read
            new = np.unique(np.concatenate([self.doc[lo + depth : min(lo + depth + DEPTH, hi)] for lo, hi in spans]))
            read += sum(max(0, min(DEPTH, hi - lo - depth)) for lo, hi in spans)
            depth += DEPTH
            new = new[~np.isin(new, met, assume_unique=True)]
            sums = np.zeros(len(new), np.int64)
            for i, (lo, hi) in enumerate(spans):
                own = self.doc_sorted[lo:hi]
                place = np.minimum(np.searchsorted(own, new), hi - lo - 1)
                hit = own[place] == new
                sums[hit] += self.impact_by_doc[lo:hi][place[hit]]
                seen[i][self.place_by_doc[lo:hi][place[hit]]] = True
                rest = seen[i][at[i] :]
                gap = int(rest.argmin()) if len(rest) else 0
                at[i] += gap if len(rest) and not rest[gap] else len(rest)
            met = np.concatenate((met, new))
            score = np.concatenate((score, sums))


def _best(ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest positive scores, equal ones by id."""
    some = np.flatnonzero(score > 0)
    if len(some) > top:
        kth = np.partition(score[some], len(some) - top)[len(some) - top]
        some = some[score[some] >= kth]
    return some[np.lexsort((ids[some], -score[some]))[:top]]


def _searched(asked: list[tuple[int | None, np.ndarray]], weight: np.ndarray, docs: int, length: int, top: int):
    """(item, doc, score): for each item the best of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(asked)

        def flush(parts: list[tuple[np.ndarray, ...]]) -> None:
            ids, n, counts, term, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
            doc = np.repeat(np.arange(len(ids)), counts)
            lists = Lists(doc, term, impacts(weight[term], tf, n[doc], docs, length), len(weight))
            for i, (_, own) in enumerate(asked):
                met, score, _ = lists.search(own, top, found[i])
                whole, scores = np.concatenate((found[i][0], ids[met])), np.concatenate((found[i][1], score))
                keep = _best(whole, scores, top)
                found[i] = whole[keep], scores[keep]

        held: list[tuple[np.ndarray, ...]] = []
        postings = rows = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                terms, tfs = part.column(2), part.column(3)
                counts = np.diff(terms.offsets.to_numpy())
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                held.append((ids, part.column(1).to_numpy(), counts, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
                postings += int(counts.sum())
                rows += len(ids)
                if postings >= LIST_POSTINGS or rows >= LIST_DOCS:
                    flush(held)
                    held, postings, rows = [], 0, 0
        if held:
            flush(held)
        sizes = [len(f[0]) for f in found]
        item = pa.array([i for i, _ in asked], pa.int64()).take(pa.array(np.repeat(np.arange(len(asked)), sizes)))
        ids = np.concatenate([none, *(f[0] for f in found)])
        score = np.concatenate([none, *(f[1] for f in found)])
        yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=ids == _NO_ID), pa.array(score)], ["item", "doc", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``top`` documents of each item, all if fewer score above 0, equal scores by id.

    Documents are read once in their partitions for the counts of asked terms,
    and a written table keeps those; its totals and the documents of each term
    give the weights. Then each task builds impact lists of its documents, a
    bounded number of postings at a time, and asks them each item by the Best
    Position Algorithm (:meth:`Lists.search`), with what its earlier lists found
    in the stopping test. Only ``top`` rows an item and task are shuffled.

    Items are sent to the tasks in batches of about MOST_TERMS (item, term)
    rows, by their hash; the documents are read again for each batch, so what
    is broadcast stays bounded. An item alone has at most the terms of its text.

    A null text has no terms: such a document counts nowhere, such an item has
    no rows. Rows that repeat a doc_id are documents each, in one order of
    scores; a null doc_id comes after all others of its score. Rows that repeat
    an item_id are one item with the terms of all; null is an id like any other.
    Empty tables give no rows. Columns but those named are left aside.
    """
    wanted = write_table(item_terms(items, item_col, item_text_col), "lexical-items")
    batches = max(1, -(-wanted.count() // MOST_TERMS))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    answers = None
    for batch in range(batches):
        rows = wanted.where(F.pmod(F.xxhash64(F.coalesce("item", F.lit(-1))), F.lit(batches)) == batch).collect()
        number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        by_item: dict[int | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r["item"], []).append(number[bytes(r["term"])])
        asked = [(item, np.sort(np.array(own))) for item, own in sorted(by_item.items(), key=lambda x: (x[0] is None, x[0]))]
        tallied = write_table(source.mapInArrow(_tallied(number), "id bigint, n bigint, terms array<int>, tfs array<bigint>"), "lexical-tallied")
        n_docs, length = tallied.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        for term, n in tallied.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most MOST_TERMS
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = tallied.where("size(terms) > 0").mapInArrow(_searched(asked, weight, n_docs, length, top), "item bigint, doc bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "doc", "score")
        kept = write_table(kept, "lexical-answers")
        answers = kept if answers is None else answers.union(kept)
        drop_table(tallied)
    drop_table(wanted)
    return answers
