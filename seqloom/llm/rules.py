"""Rules of quality: counts of each text, and how far its histograms lie from those of the languages it may be in."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import slices, utf8
from seqloom.plans.session import drop_table, write_table

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated windows of three

#: Common words of a language; the bins of its histogram are these and all other words.
COMMON_WORDS = 32

#: A language has a reference if at least one in so many texts of MIN_WORDS declares it: so there are never more references.
SHARE_OF_LANGUAGE = 1000

#: Distances allowed: a floor, and what chance adds to it in a short text, falling with the root of its length.
CHAR_FLOOR, CHAR_CHANCE = 0.20, 2.0
WORD_FLOOR, WORD_CHANCE = 0.25, 1.2

#: Shares of a text are counted in whole units, so that sums do not depend on their order.
_UNIT = 1 << 20
_BUCKETS = 1 << 14

# Class of a byte: small letter, capital, digit, white space, mark of a sentence, symbol, other, first byte of a longer character, a later one.
_CLASSES = 8
_SPACE, _SYMBOL, _LATER = 3, 5, 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[list(b".,;:!?'\"-()")] = 4
_CLASS[list(b"#*$%&|<>")] = _SYMBOL
_CLASS[192:] = 7
_CLASS[128:192] = _LATER


class Texts(NamedTuple):
    """Texts of a slice: bytes of each class by row, and the words of all rows as numbers of distinct words."""

    classes: np.ndarray
    row: np.ndarray
    word: np.ndarray
    distinct: list[bytes]
    sizes: np.ndarray
    dup_lines: np.ndarray


def measure(data: np.ndarray, starts: np.ndarray, lines: bool = True) -> Texts:
    rows = len(starts) - 1
    part = data[starts[0] : starts[-1]]
    row = np.repeat(np.arange(rows), np.diff(starts))
    classes = np.bincount(row * (_LATER + 1) + _CLASS[part], minlength=rows * (_LATER + 1)).reshape(rows, -1)
    words: list[bytes] = []
    sizes, dups = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(rows):
        text = data[starts[i] : starts[i + 1]].tobytes()
        own = text.split()
        sizes[i] = len(own)
        words += own
        if lines and b"\n" in text:
            some = [line for line in text.split(b"\n") if line.strip()]
            dups[i] = len(some) - len(set(some))
    codes, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    return Texts(classes, np.repeat(np.arange(rows), sizes), codes, list(distinct), sizes, dups)


def repeated_words(row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row in windows of three that its text holds twice or more."""
    out = np.zeros(rows, np.int64)
    if len(word) < 3:
        return out
    many = int(word.max()) + 1
    pair = pd.factorize(word[:-2] * many + word[1:-1])[0]
    triple = pd.factorize(pair * many + word[2:])[0]
    inside = np.flatnonzero(row[:-2] == row[2:])
    cell = pd.factorize(triple[inside] * rows + row[inside])[0]
    twice = inside[np.bincount(cell)[cell] > 1] if len(cell) else inside
    covered = np.zeros(len(word), bool)
    for i in range(3):
        covered[twice + i] = True
    return np.bincount(row[covered], minlength=rows)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` to the histogram ``q``; zero for rows without counts."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / max(q.sum(), 1e-300)
    mean = np.maximum((p + q) / 2, 1e-300)
    parts = [np.where(x > 0, x * np.log2(np.maximum(x, 1e-300) / mean), 0).sum(axis=1) for x in (p, np.broadcast_to(q, p.shape))]
    return np.where(p.sum(axis=1) > 0, np.sqrt(np.clip((parts[0] + parts[1]) / 2, 0, 1)), 0)


class Reference(NamedTuple):
    """A language's mean histograms: of character classes, and of its common words and, last, all others."""

    lang: str
    chars: np.ndarray
    words: list[bytes]
    shares: np.ndarray


def _buckets(distinct: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in distinct], np.int64) % _BUCKETS


def _of_languages(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Texts, np.ndarray]]:
    """Slices of a batch of (lang, text): languages of the rows, texts, and which rows are long enough to count."""
    langs = [x or "" for x in batch.column(0).to_pylist()]
    data, starts = utf8(batch.column(1))
    for first, end in slices(starts):
        texts = measure(data, starts[first : end + 1], lines=False)
        yield langs[first:end], texts, texts.sizes >= MIN_WORDS


def _sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, value, len(keys)).astype(np.int64)


def _shares(row: np.ndarray, bin_: np.ndarray, bins: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, whole units of the row's words) of the bins that a row has words in."""
    cell, n = np.unique(row * bins + bin_, return_counts=True)
    return cell // bins, cell % bins, _UNIT * n // sizes[cell // bins]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, pos, n): texts at -1, shares of character classes at -2 and below, of buckets of words from 0 on."""
    for batch in batches:
        for langs, texts, enough in _of_languages(batch):
            names = sorted({lang for lang, good in zip(langs, enough, strict=True) if good})
            number = {lang: i for i, lang in enumerate(names)}
            of = np.array([number.get(lang, 0) for lang in langs], np.int64)
            span = _BUCKETS + _CLASSES + 1
            chars = texts.classes[:, :_CLASSES]
            chars = _UNIT * chars // np.maximum(chars.sum(axis=1, keepdims=True), 1)
            good = np.flatnonzero(enough)
            keep = enough[texts.row]
            row, bucket, share = _shares(texts.row[keep], _buckets(texts.distinct)[texts.word[keep]] if keep.any() else texts.word[keep], _BUCKETS, texts.sizes)
            key = [of[good] * span, *(of[good] * span + 1 + c for c in range(_CLASSES)), of[row] * span + _CLASSES + 1 + bucket]
            value = [np.ones(len(good), np.int64), *(chars[good, c] for c in range(_CLASSES)), share]
            key, value = _sum_by(np.concatenate(key), np.concatenate(value))
            pos = key % span
            pos = np.where(pos > _CLASSES, pos - _CLASSES - 1, -1 - pos)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(key // span)), pa.array(pos, pa.int32()), pa.array(value, pa.int64())], ["lang", "pos", "n"]
            )


def _count_words(wanted: dict[str, set[int]]):
    """(lang, word, n): shares of the words of a language that lie in its wanted buckets."""
    names = sorted(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts, enough in _of_languages(batch):
                bucket = _buckets(texts.distinct)
                many = max(len(texts.distinct), 1)
                for number in sorted({names.index(x) for x in set(langs) if x in wanted}):
                    lang = names[number]
                    mine = np.array([x == lang for x in langs]) & enough
                    good = np.isin(bucket, list(wanted[lang]))
                    keep = mine[texts.row] & good[texts.word] if len(texts.word) else np.zeros(0, bool)
                    _, word, share = _shares(texts.row[keep], texts.word[keep], many, texts.sizes)
                    word, share = _sum_by(word, share)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(word), pa.string()), pa.array([texts.distinct[w] for w in word], pa.binary()), pa.array(share, pa.int64())],
                        ["lang", "word", "n"],
                    )

    return run


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """Mean histograms of the texts of each language, over all texts of at least MIN_WORDS words that declare it.

    Common words are the COMMON_WORDS with the largest mean share, ties by the
    word. They are found exactly in two steps: shares are summed by hashed
    buckets of words first, a table of fixed size; only words of the largest
    buckets are then counted, and of more buckets until no bucket left out
    could hold a word that is as common. A null language is one like any other.
    At most SHARE_OF_LANGUAGE languages have a reference, with COMMON_WORDS
    words each, which bounds what comes to the driver.
    """
    source = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    tally = write_table(source.mapInArrow(_tally, "lang string, pos int, n bigint").groupBy("lang", "pos").agg(F.sum("n").alias("n")), "rules-tally")
    total = tally.where("pos = -1").agg(F.sum("n")).first()[0] or 0
    counts = {r["lang"]: r["n"] for r in tally.where("pos = -1").where(F.col("n") * SHARE_OF_LANGUAGE >= total).collect()}
    if not counts:
        drop_table(tally)
        return []
    mine = tally.where(F.col("lang").isin(list(counts)))
    chars = {lang: np.zeros(_CLASSES) for lang in counts}
    for lang, pos, n in mine.where("pos < -1").collect():
        chars[lang][-2 - pos] = n
    by_size = Window.partitionBy("lang").orderBy(F.desc("n"), "pos")
    take, pending, found = 4 * COMMON_WORDS, set(counts), {}
    while pending:
        ranked = mine.where("pos >= 0").where(F.col("lang").isin(list(pending))).withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= take + 1)
        wanted: dict[str, set[int]] = {lang: set() for lang in pending}
        left_out = dict.fromkeys(pending, 0)
        for lang, pos, n, rank in ranked.select("lang", "pos", "n", "rank").collect():
            if rank <= take:
                wanted[lang].add(pos)
            else:
                left_out[lang] = n
        words = source.where(F.coalesce("lang", F.lit("")).isin(list(pending))).mapInArrow(_count_words(wanted), "lang string, word binary, n bigint")
        words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        top: dict[str, list[tuple[bytes, int]]] = {lang: [] for lang in pending}
        for lang, word, n in words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= COMMON_WORDS).orderBy("lang", "rank").select("lang", "word", "n").collect():
            top[lang].append((bytes(word), n))
        for lang in sorted(pending):
            if not left_out[lang] or (len(top[lang]) == COMMON_WORDS and top[lang][-1][1] > left_out[lang]):
                found[lang] = top[lang]
                pending.discard(lang)
        take *= 4
    drop_table(tally)
    out = []
    for lang in sorted(counts):
        shares = np.array([n for _, n in found[lang]], float)
        out.append(Reference(lang, chars[lang], [w for w, _ in found[lang]], np.append(shares, max(counts[lang] * _UNIT - shares.sum(), 0))))
    return out


def judge_slice(texts: Texts, refs: list[Reference]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether some language is near enough, the number of the nearest (-1 without references), and its two distances."""
    rows = len(texts.sizes)
    chars = texts.classes[:, :_CLASSES].astype(float)
    n_chars = np.maximum(chars.sum(axis=1), 1)
    n_words = np.maximum(texts.sizes, 1)
    good, best = np.full(rows, not refs), np.full(rows, -1)
    least, far = np.full(rows, np.inf), np.zeros((2, rows))
    for number, ref in enumerate(refs):
        place = {w: i for i, w in enumerate(ref.words)}
        bins = len(ref.words) + 1
        at = np.array([place.get(w, bins - 1) for w in texts.distinct], np.int64)
        words = np.bincount(texts.row * bins + at[texts.word], minlength=rows * bins).reshape(rows, bins) if len(at) else np.zeros((rows, bins))
        by_chars, by_words = distance(chars, ref.chars), distance(words.astype(float), ref.shares)
        good |= (by_chars <= CHAR_FLOOR + CHAR_CHANCE / np.sqrt(n_chars)) & (by_words <= WORD_FLOOR + WORD_CHANCE / np.sqrt(n_words))
        nearer = by_chars + by_words < least
        best[nearer] = number
        far[0, nearer], far[1, nearer] = by_chars[nearer], by_words[nearer]
        least = np.minimum(least, by_chars + by_words)
    return good, best, far[0], far[1]


def judged(docs: DataFrame, refs: list[Reference], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row; see :func:`quality_rules`."""
    names = [r.lang for r in refs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for first, end in slices(starts):
                texts = measure(data, starts[first : end + 1])
                repeated = repeated_words(texts.row, texts.word, end - first)
                failed = (texts.sizes < MIN_WORDS) | (100 * repeated > MOST_REPEATED * texts.sizes)
                good, best, by_chars, by_words = judge_slice(texts, refs)
                chars = texts.classes[:, :_CLASSES].sum(axis=1) - texts.classes[:, _SPACE]
                counts = [texts.sizes, chars, texts.classes[:, _SYMBOL], texts.dup_lines, repeated]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array(failed),
                        pa.array(good & ~failed),
                        pa.array([names[i] if i >= 0 else None for i in best], pa.string()),
                        pa.array(by_chars),
                        pa.array(by_words),
                    ],
                    ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "char_distance", "word_distance"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    return source.mapInArrow(run, f"id bigint, {counts}, base_failed boolean, kept boolean, nearest string, char_distance double, word_distance double")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, counts, base_failed, kept, nearest, char_distance, word_distance) of every row.

    Words are runs of anything but ASCII white space. A text fails the base
    rules with under MIN_WORDS words, or with over MOST_REPEATED per cent of its
    words in windows of three that it holds twice. Of the others those stay
    whose histograms of character classes and of common words are both near
    those of one language: in Jensen-Shannon distance within a floor plus what
    chance adds in a text of that length, so short texts are guarded against.
    Every language is tried, whatever a row declares; ``nearest`` is the one
    with the least sum of distances, ties by name. References are means over the
    same rows (:func:`references`); without any all that pass the base stay.

    A null text counts as empty: no words, and it fails. Repeated rows and null
    ids are judged each; an empty table gives no rows. Columns but the three
    named are left aside. The texts are read three times and never shuffled; a
    task holds the words of a MiB of texts, or of one longer text.
    """
    return judged(docs, references(docs, text_col, lang_col), id_col, text_col)
