"""Scalar expressions over match tables: sequences, protein names, scores and probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retention coefficients of residues; others count 0.
RESIDUE_COEFFICIENTS = {
    "W": 11.0, "F": 10.5, "L": 9.6, "I": 8.4, "M": 5.8, "V": 5.0, "Y": 4.0, "E": 1.1, "C": 0.8, "A": 0.5,
    "T": 0.4, "P": 0.2, "G": 0.0, "S": -0.1, "Q": -0.3, "N": -0.5, "D": -0.5, "H": -1.0, "R": -1.3, "K": -1.9,
}

# Prefixes of decoy protein names, in any case.
DECOY_PREFIXES = ("DECOY_", "REV_", "RANDOM_", "RANDOM-")
_DECOY = "(?i)^(" + "|".join(DECOY_PREFIXES) + ")"


def core_peptide(peptide: Column) -> Column:
    """What lies between the first and the last dot; the whole without two dots. Modifications stay."""
    first = F.instr(peptide, ".")
    last = F.length(peptide) - F.instr(F.reverse(peptide), ".") + 1
    return F.when((first > 0) & (last > first), F.substring(peptide, first + 1, last - first - 1)).otherwise(peptide)


def retention(peptide: Column) -> Column:
    """Sum of residue coefficients over the capitals of the core sequence, in order of the coefficient table."""
    core = core_peptide(peptide)
    n = F.length(core)
    terms = [F.lit(k) * (n - F.length(F.replace(core, F.lit(aa), F.lit("")))) for aa, k in RESIDUE_COEFFICIENTS.items() if k]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def split_proteins(proteins: Column) -> Column:
    """Names separated by tabs, spaces or semicolons; empty ones drop out."""
    return F.filter(F.split(proteins, "[\t ;]"), lambda p: p != "")


def is_decoy_protein(name: Column) -> Column:
    return name.rlike(_DECOY)


def strip_decoy(name: Column) -> Column:
    """The name without its decoy prefix, once."""
    return F.regexp_replace(name, _DECOY, "")


def pairing_key(names: Column) -> Column:
    """Sorted distinct stripped names, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(names, strip_decoy))), "|")


def lenient_int(text: Column) -> Column:
    """All digits of the text in a row, negative after a leading minus; null without digits or beyond 64 bits."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.trim(text).startswith("-"), -digits.try_cast("bigint")).otherwise(digits.try_cast("bigint"))


def lenient_double(text: Column) -> Column:
    """The number, or 0 for anything that isn't one in plain or exponent form, or isn't finite."""
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(plain.isNull() | F.isnan(plain) | (F.abs(plain) == float("inf")), F.lit(0.0)).otherwise(plain)


def label_of(text: Column) -> Column:
    """+1 for a positive number, else -1."""
    return F.when(lenient_int(text) > 0, 1).otherwise(-1)


def zscore(features: Column, means: Column, sds: Column) -> Column:
    """(x - mean) / sd of each feature, then the bias 1."""
    centred = F.zip_with(features, means, lambda x, m: x - m)
    return F.concat(F.zip_with(centred, sds, lambda x, s: x / s), F.array(F.lit(1.0)))


def linear_score(features: Column, weights: Sequence[float] | Column) -> Column:
    """Sum of products, added from first to last."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def odds_ratio(pep: Column, prior: Column | float) -> Column:
    """Posterior odds of a match over its prior odds, from its error probability."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    post, prior = clamp(1 - pep, 1e-12, 1 - 1e-12), clamp(prior, 1e-12, 1 - 1e-12)
    return clamp((post / (1 - post)) / (prior / (1 - prior)), 1e-12, 1e12)


def emission(k: Column, alpha: float, beta: float) -> Column:
    """Chance that k present proteins, or noise, show a match: noisy or."""
    return 1 - F.lit(1 - beta) * F.pow(F.lit(1 - alpha), k)


def binomial_prior(n: Column, gamma: float) -> Column:
    """Chances of 0 to n present members, each present with chance gamma; from logarithms, shifted and normalised."""
    k = F.sequence(F.lit(0), n.cast("int"))
    logs = F.transform(
        k,
        lambda i: F.aggregate(
            F.filter(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda j: j < i),
            n * F.log(F.lit(1 - gamma)),
            lambda a, j: a + F.log((n - j).cast("double")) - F.log((j + 1).cast("double")) + F.lit(1.0) * F.log(F.lit(gamma / (1 - gamma))),
        ),
    )
    return softmax(logs)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often it is used, inside functions of arrays too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise(values: Column) -> Column:
    """Shares of the sum; equal shares where the sum isn't positive and finite."""

    def shares(both: Column) -> Column:
        v, total = both["v"], both["t"]
        good = (total > 0) & (total < float("inf")) & ~F.isnan(total)
        return F.transform(v, lambda x: F.when(good, F.try_divide(x, total)).otherwise(F.lit(1.0) / F.size(v)))

    summed = lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("t"))
    return once(once(values, summed), shares)


def softmax(logs: Column) -> Column:
    most = once(logs, lambda v: F.struct(v.alias("v"), F.array_max(v).alias("m")))
    return normalise(once(most, lambda b: F.transform(b["v"], lambda x: F.exp(x - b["m"]))))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a missing value or a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide((new - old).cast("double") * 100, old.cast("double"))


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text."""
    return F.format_string(f"%.{digits}f", x)


def one_hot(value: Column, kinds: Sequence) -> Column:
    return F.array(*[F.when(value == F.lit(k), 1.0).otherwise(0.0) for k in kinds])


def charge_features(charge: Column, most: int = 7) -> Column:
    """One column for each charge from 1 on."""
    return one_hot(charge, range(1, most + 1))


def minus_log10(x: Column) -> Column:
    """-log10 with a floor under the argument."""
    return F.lit(0.0) - F.log10(F.greatest(x, F.lit(1e-300)))


def as_bytes(text: Column) -> Column:
    """Text as bytes that as_text() reads: lower-case hexadecimal digits two to a byte after a byte 1, else UTF-8 after a byte 0."""
    pairs = F.unhex(text)
    return F.when(F.lower(F.hex(pairs)) == text, F.concat(F.lit(b"\x01"), pairs)).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def as_text(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
