"""Column functions on strings of bases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def subseq(seq: Column, start: int | Column, end: int | Column) -> Column:
    """Bases [start, end), counted from 0."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(seq, a + 1, b - a)


def base_at(seq: Column, pos: int | Column) -> Column:
    p = F.lit(pos) if isinstance(pos, int) else pos
    return F.substring(seq, p + 1, F.lit(1))


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def has_n(seq: Column) -> Column:
    return F.contains(seq, F.lit("N"))


def has_bad_base(seq: Column) -> Column:
    return seq.rlike("[^ACGTN]")


def encode_kmer(kmer: Column) -> Column:
    """2 bits a base, A0 C1 G2 T3, for up to 32 bases, those of 32 as unsigned 64-bit numbers in a bigint; null where there is another character."""
    return F.when(kmer.rlike("^[ACGT]{1,32}$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, -10).cast("bigint"))


def decode_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(F.hex(code.cast("bigint")), 16, 4), k, "0"), "0123", "ACGT")


def complement_code(code: Column, k: int) -> Column:
    """The code of the reverse complement of a k-mer's code: all bits turned, then the order of the bit pairs."""
    x = F.bitwise_not(code)
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, step).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), step))
    return F.shiftrightunsigned(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)), 64 - 2 * k)


def hamming(a: Column, b: Column, limit: int | None = None, above: int = 32) -> Column:
    """Differing places of two strings of equal length; ``above`` where they are more than ``limit``."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    n = F.aggregate(differ, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(1)))
    return n if limit is None else F.when(n > limit, above).otherwise(n)


def packed_hamming(a: Column, b: Column) -> Column:
    """Differing bases of two 2-bit codes."""
    d = a.bitwiseXOR(b)
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def phred(qual: Column, offset: int = 33) -> Column:
    """Qualities of a string as numbers."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
