"""Column functions: folding, portable hashes, clamps, weights, parsing of names and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 6 + "AC"


def fold(text: Column) -> Column:
    """Letters of a text as bases, anything else dropped."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def portable_hash(text: Column) -> Column:
    """60 bits of MD5: the same number in any engine, never negative."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lerp(a, b, t):
    return a + (b - a) * t


def added(name: str, total: Callable[[Column], Column] = F.sum) -> Column:
    """The sum of a column of doubles from 0 to 256, the same in whatever order its rows come.

    Whole 2^-20ths and what is left of them in 2^-56ths are added up as integers; a hundred
    million rows fit.
    """
    x = F.col(name) * F.lit(2.0**20)
    whole = F.floor(x)
    return (total(whole).cast("double") + total(F.floor((x - whole) * F.lit(2.0**36))).cast("double") * F.lit(2.0**-36)) * F.lit(2.0**-20)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def length_weight(n: Column) -> Column:
    """1 up to 1024 bases, 0 from 4096 on."""
    return 1 - smoothstep(1024.0, 4096.0, n.cast("double"))


def idf(bins: Column, df: Column, s: float) -> Column:
    raw = clamp(F.log2((bins + 1) / (df + 1)), 0.5 * (1 - s), 8.0)
    return 8 * F.pow(raw / 8, F.lit(1 + 0.25 * s))


def background(v: Column, df: Column) -> Column:
    return clamp(F.log2((v + 1) / (df + 1)), 0.25, 6.0)


def dispersion(head: Column, eff: Column) -> tuple[Column, Column]:
    """u and s of a community from its head mass and its effective number of taxa."""
    volume = (1 - head) * F.log1p(eff)
    return volume / (1 + volume), 1 - F.exp(-F.pow(volume, F.lit(4.0)))


def parse_u32(text: Column) -> Column:
    """The number that a text of digits names, if it is below 2^32; else null."""
    n = F.when(text.rlike("^[0-9]{1,10}$"), text.try_cast("long"))
    return F.when(n < 4294967296, n)


def accession(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "GC[AF]_[0-9]+\\.[0-9]+", 0), F.lit(""))


def versionless(acc: Column) -> Column:
    return F.regexp_replace(acc, "\\.[0-9]*", "")


def ftp_path(acc: Column) -> Column:
    """GCF_000123456.1 -> GCF/000/123/456."""
    digits = F.regexp_extract(acc, "^GC[AF]_([0-9]{9})", 1)
    return F.concat_ws("/", F.substring(acc, 1, 3), *(F.substring(digits, i, 3) for i in (1, 4, 7)))


def deepest(lineage: Column) -> Column:
    """The last entry of a `;` lineage that has more than its rank's prefix."""
    return F.try_element_at(F.filter(F.split(lineage, ";"), lambda x: F.length(x) >= 4), F.lit(-1))


def clean_tsv(text: Column) -> Column:
    return F.regexp_replace(text, "[\\t\\n\\r]", " ")


def plain_date(text: Column) -> Column:
    return F.regexp_replace(text, "[-/]", "")


def fixed_point(x: Column) -> Column:
    return F.round(x * 1048576).cast("long")


def merged_name(organism: Column, strain: Column) -> Column:
    """The organism's name with its strain, unless there is none or the name ends with it."""
    own = F.regexp_replace(F.coalesce(strain, F.lit("")), "^[a-z]+=", "")
    return F.when((own == "") | organism.endswith(own), organism).otherwise(F.concat_ws(" ", organism, own))
