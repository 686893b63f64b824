"""Language of a text by Bayesian fusion of its letters, its declared language, its address and its host."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import slices, utf8
from seqloom.plans.session import join_sized, write_table

LANGUAGES = ("de", "en", "es", "fr")

#: The class of texts that no language explains better than evenly spread letters.
UNKNOWN = "und"

#: Hashed letter trigrams that the likelihoods know apart.
BUCKETS = 1 << 14

#: Trigrams overlap and repeat: the evidence of a text never weighs more than this many independent ones.
MOST_EVIDENCE = 200

#: Chance that a declared language, and that a country's address suffix, names the true one.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8

#: Rows that the level above counts for in a host's and in a suffix's prior.
PRIOR_ROWS = 20.0
UNKNOWN_PRIOR = 0.01

#: A document is accepted at this posterior.
ACCEPT = 0.5

# The main language of country suffixes.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "ch": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "ca": "en",
    "es": "es", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "fr": "fr", "mc": "fr",
}

# Code points that are no letters beyond ASCII, as first and last: signs of Latin-1, punctuation and symbols,
# punctuation of Chinese and Japanese, pictures.
SIGNS = ((0x80, 0xBF), (0x2000, 0x2FFF), (0x3000, 0x303F), (0x1F000, 0x1FFFF))

#: Texts whose trigrams are marked at once.
_ROWS = 256

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _blank_signs(part: np.ndarray, folded: np.ndarray) -> None:
    """Blank the bytes of the code points of SIGNS: their leads tell them, with the byte after where it takes two."""
    if not (part >= 0xC2).any():
        return
    after = np.concatenate((part[1:], np.zeros(1, np.uint8)))
    kinds = ((part == 0xC2, 2), ((part == 0xE2) | ((part == 0xE3) & (after == 0x80)), 3), ((part == 0xF0) & (after == 0x9F), 4))
    for lead, size in kinds:
        at = np.flatnonzero(lead)
        for i in range(size):
            folded[at + i] = 32


def _by_text(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..end; of each letter in them the bucket of its trigram, and its row. A text has blanks around it."""
    for first, end in slices(starts):
        part = data[starts[first] : starts[end]]
        if not len(part):
            continue
        row = np.repeat(np.arange(end - first), np.diff(starts[first : end + 1]))
        folded = _FOLD[part].astype(np.uint32)
        _blank_signs(part, folded)
        edge = np.flatnonzero(row[1:] != row[:-1])
        before = np.concatenate((np.full(1, 32, np.uint32), folded[:-1]))
        after = np.concatenate((folded[1:], np.full(1, 32, np.uint32)))
        before[edge + 1], after[edge] = 32, 32
        packed = (before << np.uint32(16)) | (folded << np.uint32(8)) | after
        letter = folded != 32
        bucket = (packed[letter] * np.uint32(2654435761)) >> np.uint32(18)
        yield first, end, bucket.astype(np.int64), row[letter]


def _primary(declared: Column) -> Column:
    """The language of a tag such as ``en-US``."""
    return F.lower(F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]+)", 1))


def _suffix(host: Column) -> Column:
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)).otherwise(F.lit(""))


def _host(address: Column) -> Column:
    """Host of a URL, or the address itself where it is none."""
    text = F.lower(F.coalesce(address.cast("string"), F.lit("")))
    return F.regexp_replace(F.regexp_extract(text, r"^(?:.*?://)?([^/?#]*)", 1), r":\d*$", "")


def trigram_counts(docs: DataFrame, text: Column, declared: Column, languages: tuple[str, ...]) -> np.ndarray:
    """How many texts of each declared language hold each trigram, over all rows: a table of fixed size.

    Counting texts, a text that repeats one word a thousand times weighs no more than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, bucket, row in _by_text(*utf8(batch.column(0))):
                for low in range(0, end - first, _ROWS):
                    high = min(low + _ROWS, end - first)
                    a, b = np.searchsorted(row, (low, high))
                    seen = np.zeros((high - low) * BUCKETS, bool)
                    seen[(row[a:b] - low) * BUCKETS + bucket[a:b]] = True
                    for number in np.unique(label[first + low : first + high]):
                        own = seen.reshape(-1, BUCKETS)[label[first + low : first + high] == number]
                        total[number * BUCKETS : (number + 1) * BUCKETS] += own.sum(axis=0)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    number = F.array_position(F.array(*map(F.lit, languages)), _primary(declared)) - 1
    source = docs.select(text.cast("string").alias("text"), number.cast("int").alias("label")).where("label >= 0")
    counts = np.zeros(len(languages) * BUCKETS)
    summed = source.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in summed.collect():
        counts[cell] = n
    return counts.reshape(len(languages), BUCKETS)


def host_priors(docs: DataFrame, address: Column, declared: Column, languages: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """(host, counts array, above array) by grouped aggregation, and the prior over all: host within suffix within all.

    ``counts`` are the host's rows of each declared language, ``above`` is the
    prior of its suffix. Each level is smoothed by PRIOR_ROWS rows of the level
    above. One pass counts declared languages by host with partial sums, so a
    host with a third of all rows sends one row from each task.
    """
    tag = _primary(declared)
    rows = docs.select(_host(address).alias("host"), tag.alias("tag")).where(F.col("tag").isin(*languages))
    counts = [F.count_if(F.col("tag") == x).alias(f"n{i}") for i, x in enumerate(languages)]
    hosts = write_table(rows.groupBy("host").agg(*counts).withColumn("suffix", _suffix(F.col("host"))), "language-hosts")
    columns = [f"n{i}" for i in range(len(languages))]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    every = hosts.agg(*sums).first()
    total = sum(every)
    overall = [(n + PRIOR_ROWS / len(languages)) / (total + PRIOR_ROWS) for n in every]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    size = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    within = [((F.col(c) + PRIOR_ROWS * p) / (size + PRIOR_ROWS)).alias(f"s{i}") for i, (c, p) in enumerate(zip(columns, overall, strict=True))]
    suffix_priors = write_table(suffixes.select("suffix", *within), "language-suffixes")
    above = F.array(*[F.col(f"s{i}") for i in range(len(languages))])
    own = F.array(*[F.col(c).cast("double") for c in columns])
    priors = join_sized(hosts, suffix_priors, ["suffix"], "inner").select("host", own.alias("counts"), above.alias("above"))
    return write_table(priors, "language-priors"), overall


def _without_own(counts: Column, above: Column, tag: Column, languages: tuple[str, ...]) -> Column:
    """The prior of a host of which one row, declared as ``tag``, is left out, so that no declaration speaks for itself twice."""
    own = F.array(*[F.coalesce((tag == x).cast("double"), F.lit(0.0)) for x in languages])
    others = F.zip_with(counts, own, lambda n, o: n - o)
    size = F.aggregate(others, F.lit(0.0), lambda acc, n: acc + n)
    return F.zip_with(others, above, lambda n, s: (n + PRIOR_ROWS * s) / (size + PRIOR_ROWS))


def identify(
    docs: DataFrame,
    text: Column,
    declared: Column,
    address: Column,
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """``docs`` with ``language``, ``posterior``, ``accepted`` and ``letters`` (bytes of letters) in a struct ``lid``.

    The posterior of each language, and of UNKNOWN, multiplies: the mean
    likelihood of the whole text's letter trigrams, weighed as at most
    MOST_EVIDENCE of them, against an even spread for UNKNOWN; the chance of
    the declared language; that of a country suffix of the address; and the
    host's prior from :func:`host_priors`, to which the row itself does not
    count. Likelihoods and priors are learnt from all rows whose declared
    language is one of ``languages``. Letters are A to Z and all code points
    beyond ASCII but SIGNS.

    A row is accepted if its text has letters, its language is not UNKNOWN and
    the posterior is at least ACCEPT. A null or empty text has no evidence of
    its own: it gets the language its other evidence favours and is not
    accepted. A missing or other declared language is no evidence, an unseen
    host has its prior from all rows. Ties go to the first of ``languages``.
    All columns of ``docs`` stay, whatever their names, but for one named lid.
    """
    docs = docs.drop("lid")
    counts = trigram_counts(docs, text, declared, languages)
    likelihood = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    likelihood[counts.sum(axis=1) == 0] -= 3.0  # a language without texts explains none better than UNKNOWN does
    likelihood = np.vstack((likelihood, np.full(BUCKETS, -math.log(BUCKETS)))).astype(np.float32)
    classes = (*languages, UNKNOWN)
    told = _told(classes)
    kept = docs.schema
    schema = T.StructType([*kept.fields, T.StructField("__lid", T.StructType([T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType()), T.StructField("host", T.StringType()), T.StructField("tag", T.StringType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            extra = batch.column(n_kept)
            evidence, letters = np.zeros((n, len(classes))), np.zeros(n, np.int64)
            for first, end, bucket, row in _by_text(*utf8(extra.field("text"))):
                size = np.bincount(row, minlength=end - first)
                letters[first:end] = size
                weight = np.minimum(size, MOST_EVIDENCE) / np.maximum(size, 1)
                for k in range(len(classes)):
                    evidence[first:end, k] = weight * np.bincount(row, likelihood[k][bucket], end - first)
            for row, (tag, suffix) in enumerate(zip(extra.field("tag").to_pylist(), extra.field("suffix").to_pylist(), strict=True)):
                evidence[row] += told(tag, suffix)
            nested = pa.StructArray.from_arrays(
                [pa.array(list(evidence), pa.list_(pa.float64())), pa.array(letters), extra.field("host"), extra.field("tag")],
                ["evidence", "letters", "host", "tag"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], nested], [*batch.schema.names[:n_kept], "__lid"])

    n_kept = len(kept.fields)
    host = _host(address)
    needs = F.struct(text.cast("string").alias("text"), _primary(declared).alias("tag"), _suffix(host).alias("suffix"), host.alias("host"))
    scored = docs.withColumn("__in", needs).mapInArrow(run, schema)
    priors, overall = host_priors(docs, address, declared, languages)
    priors = priors.select(F.col("host").alias("__host"), F.col("counts").alias("__counts"), F.col("above").alias("__above"))
    joined = join_sized(scored.withColumn("__host", F.col("__lid.host")), priors, ["__host"])
    own = _without_own(F.col("__counts"), F.col("__above"), F.col("__lid.tag"), languages)
    prior = F.coalesce(own, F.array(*map(F.lit, overall)))
    logs = F.concat(F.transform(prior, lambda p: F.log(p * (1 - UNKNOWN_PRIOR))), F.array(F.lit(math.log(UNKNOWN_PRIOR))))
    sums = F.zip_with("__lid.evidence", logs, lambda a, b: a + b)
    top = F.array_max("__sums")
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("__sums", top).cast("int"))
    share = 1 / F.aggregate("__sums", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    accepted = (F.col("__lid.letters") > 0) & (best != UNKNOWN) & (share >= ACCEPT)
    result = F.struct(best.alias("language"), share.alias("posterior"), accepted.alias("accepted"), F.col("__lid.letters").alias("letters"))
    return joined.withColumn("__sums", sums).withColumn("lid", result).select(*[F.col(f"`{c}`") for c in kept.names], "lid")


def _told(classes: tuple[str, ...]):
    """Log chance, under each class, of what is declared and of the suffix; remembered, for they are few."""
    known: dict[tuple, np.ndarray] = {}

    def told(tag: str | None, suffix: str | None) -> np.ndarray:
        if (tag, suffix) not in known:
            out = np.zeros(len(classes))
            for said, right in ((tag, DECLARED_RIGHT), (SUFFIX_LANGUAGE.get(suffix), SUFFIX_RIGHT)):
                if said in classes[:-1]:
                    out += math.log((1 - right) / (len(classes) - 1))
                    out[classes.index(said)] += math.log(right) - math.log((1 - right) / (len(classes) - 1))
            if len(known) > 100_000:
                known.clear()
            known[tag, suffix] = out
        return known[tag, suffix]

    return told
