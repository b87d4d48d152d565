"""Expressions over sequence strings; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the nucleotide codes.
COMPLEMENT = ("ACGTURYSWKMBVDHN", "TGCAAYRSWMKVBHDN")
# The letters that a degenerate code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "V": "ACG", "D": "AGT", "H": "ACT", "N": "ACGT"}
#: Digits of a number with base 4, as letters.
DIGITS = "AGTC"


def derived_dna(key: Column) -> Column:
    """32 letters that follow from a key."""
    return F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def complement(s: Column) -> Column:
    return F.translate(s, *COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, in order; none if the string is shorter."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def spectrum(s: Column, k: int) -> Column:
    """As kmers, but a string of length k or less is its own only member."""
    return F.when(F.length(s) <= k, F.array(s)).otherwise(kmers(s, k))


def contigs(s: Column, scheme: list[int]) -> Column:
    """Consecutive pieces of the given lengths, with their index."""
    out, at = [], 1
    for i, n in enumerate(scheme):
        out.append(F.struct(F.lit(i).alias("i"), F.substring(s, at, n).alias("contig")))
        at += n
    return F.array(*out)


def substrings(s: Column, least: int, most: int) -> Column:
    """All substrings of the lengths from most down to least, from left to right."""
    return F.flatten(F.array(*[kmers(s, k) for k in range(most, least - 1, -1)]))


def hamming(a: Column, b: Column) -> Column:
    """Number of places that differ, over the length of the shorter."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def bounded_hamming(a: Column, b: Column, most: int) -> Column:
    d = hamming(a, b)
    return F.when(d <= most, d)


def share_of(s: Column, letters: str) -> Column:
    """Share of the given letters; null for an empty string."""
    kept = F.length(F.translate(s, letters, ""))
    return F.when(F.length(s) > 0, (F.length(s) - kept) / F.length(s))


def gc_content(s: Column) -> Column:
    return share_of(s, "GCgc")


def places(s: Column, motif: Column) -> Column:
    """All 0-based starts of a motif, overlapping ones too."""
    n = F.length(s) - F.length(motif)
    return F.when((n >= 0) & (F.length(motif) > 0), F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(s, i + 1, F.length(motif)) == motif)).otherwise(F.array().cast("array<int>"))


def is_dna(s: Column) -> Column:
    return s.rlike("^[-ACGTacgt]*$")


def degeneracy(s: Column) -> Column:
    """Product of the number of letters that each code stands for."""
    size = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(len(v)).cast("double"))])
    return F.aggregate(F.filter(F.split(s, "", -1), lambda c: c != ""), F.lit(1.0), lambda a, c: a * F.coalesce(F.element_at(size, c), F.lit(1.0)))


def illegal_letters(s: Column, alphabet: str = "".join(IUPAC)) -> Column:
    """Letters outside the alphabet, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(s, "", -1), lambda c: (c != "") & ~F.lit(alphabet).contains(c))))


def constant_regions(s: Column) -> Column:
    """Distinct maximal runs of plain letters in a constraint, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(s, "[^ACGT]", "-"), "-+", -1), lambda x: x != "")))


def from_number(n: Column, length: int) -> Column:
    """The sequence of a number with base 4."""
    return F.translate(F.lpad(F.conv(n.cast("string"), 10, 4), length, "0"), "0123", DIGITS)


def tolerated_mismatches(length: Column) -> Column:
    return F.when(length <= 8, 0).when(length <= 15, 1).otherwise(F.floor((length - 1) / 5) - 1).cast("long")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def balance(structure: Column) -> Column:
    """For a dot-bracket structure: (unclosed, unopened, invalid), 1-based places."""
    none = F.array().cast("array<int>")
    chars = F.transform(F.filter(F.split(structure, "", -1), lambda c: c != ""), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c")))
    start = F.struct(none.alias("open"), none.alias("unopened"), none.alias("invalid"))

    def step(acc: Column, x: Column) -> Column:
        opens, closes = x["c"] == "(", x["c"] == ")"
        held = F.size(acc["open"]) > 0
        return F.struct(
            F.when(opens, F.concat(acc["open"], F.array(x["i"]))).when(closes & held, F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"]).alias("open"),
            F.when(closes & ~held, F.concat(acc["unopened"], F.array(x["i"]))).otherwise(acc["unopened"]).alias("unopened"),
            F.when(~x["c"].isin("(", ")", ".", "x"), F.concat(acc["invalid"], F.array(x["i"]))).otherwise(acc["invalid"]).alias("invalid"),
        )

    return F.aggregate(chars, start, step, lambda a: F.struct(a["open"].alias("unclosed"), a["unopened"].alias("unopened"), a["invalid"].alias("invalid")))


def window_shares(s: Column, width: int, letters: str = "GC", last: bool = False) -> Column:
    """Share of letters in each window of a width; the last window is left out unless last, as the published rules count."""
    n = F.length(s) - width + (1 if last else 0)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (width - F.length(F.translate(F.substring(s, i, F.lit(width)), letters, ""))) / width)).otherwise(F.array().cast("array<double>"))


def pair_sum(s: Column, table: dict[str, float], step: int = 1, width: int = 2) -> Column:
    """Sum of table values over pieces of a width, taken every step letters; pieces that the table lacks count 0."""
    values = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    n = F.length(s) - width + 1
    at = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.coalesce(F.element_at(values, F.substring(s, i, F.lit(width))), F.lit(0.0)))


# Unified nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K) of DNA, published by SantaLucia in 1998.
NEAREST_ENTHALPY = {"AA": -7.9, "TT": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "TG": -8.5, "GT": -8.4, "AC": -8.4, "CT": -7.8, "AG": -7.8, "GA": -8.2, "TC": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0, "CC": -8.0}
NEAREST_ENTROPY = {"AA": -22.2, "TT": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "TG": -22.7, "GT": -22.4, "AC": -22.4, "CT": -21.0, "AG": -21.0, "GA": -22.2, "TC": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9, "CC": -19.9}


def melting_temperature(s: Column, molar: float = 5e-8, sodium: float = 0.05) -> Column:
    """Degrees Celsius by nearest neighbours, with terminal corrections left out; null for fewer than 2 letters."""
    from math import log

    enthalpy = pair_sum(s, NEAREST_ENTHALPY)
    entropy = pair_sum(s, NEAREST_ENTROPY) + F.lit(0.368 * log(sodium)) * (F.length(s) - 1)
    return F.when(F.length(s) >= 2, enthalpy * 1000 / (entropy + F.lit(1.987 * log(molar / 4))) - 273.15)


def spacing_penalty(distance: Column, best: int = 5) -> Column:
    """0 at the best distance; a sigmoid below it and a quadratic above it."""
    d = (distance - best).cast("double")
    low = F.lit(12.2) / F.pow(1 + F.exp(F.lit(2.5) * (d + 2)), F.lit(3.0))
    high = F.lit(0.048) * d * d + F.lit(0.24) * d
    return F.when(d < 0, low).when(d > 0, high).otherwise(F.lit(0.0))


# Persistence lengths of dinucleotides (nm), stacking energies of DNA with DNA and of RNA with DNA (kcal/mol).
PERSISTENCE = {"AA": 50.4, "AC": 55.4, "AG": 51.0, "AT": 40.9, "CA": 46.7, "CC": 41.7, "CG": 56.0, "CT": 51.0, "GA": 54.4, "GC": 44.6, "GG": 41.7, "GT": 55.4, "TA": 44.7, "TC": 54.4, "TG": 46.7, "TT": 50.4}
DNA_STACKING = {"AA": -1.00, "AC": -1.44, "AG": -1.28, "AT": -0.88, "CA": -1.45, "CC": -1.42, "CG": -2.17, "CT": -1.28, "GA": -1.30, "GC": -2.24, "GG": -1.42, "GT": -1.44, "TA": -0.58, "TC": -1.30, "TG": -1.45, "TT": -1.00}
RNA_STACKING = {"AA": -0.2, "AC": -1.6, "AG": -1.5, "AT": -0.6, "CA": -1.1, "CC": -2.9, "CG": -2.7, "CT": -1.3, "GA": -0.9, "GC": -1.7, "GG": -2.1, "GT": -0.9, "TA": -0.9, "TC": -1.8, "TG": -2.1, "TT": -1.0}


def rigidity(s: Column) -> Column:
    """Persistence lengths of the pieces of two letters for each letter; null without letters."""
    return F.when(F.length(s) > 0, pair_sum(s, PERSISTENCE, step=2) / F.length(s))


def bubble_energy(s: Column) -> Column:
    """Energy of melting pieces of two letters; the published rule counts each twice."""
    return 2 * pair_sum(s, DNA_STACKING, step=2)


def hybrid_energies(s: Column, first: int = 15) -> Column:
    """(dna, rna, hybrid): energies of the first letters in pieces of two: of DNA, of RNA with DNA, and their difference."""
    head = F.substring(s, 1, first)
    dna, rna = pair_sum(head, DNA_STACKING, step=2), pair_sum(head, RNA_STACKING, step=2)
    return F.struct(dna.alias("dna"), rna.alias("rna"), (dna - rna).alias("hybrid"))
