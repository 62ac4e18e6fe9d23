"""String similarity as Column expressions; no Python runs on the executors.

All of them compare the UTF-8 bytes of their arguments, not code points. A null argument gives null;
`score` and `is_similar` turn that into 0.0 and false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, PREFIX_WEIGHT, LONGEST_PREFIX = 0.8, 0.1, 4
#: Stands for a matched byte; above every character that a byte string can hold.
_USED = "Ā"


def byte_string(c: Column) -> Column:
    """One character for each UTF-8 byte, so that string functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def levenshtein(a: Column, b: Column, at_most: Column | None = None) -> Column:
    """Unit-cost edit distance; with `at_most`, -1 for a larger one, which is found out sooner."""
    if at_most is None:
        return F.levenshtein(byte_string(a), byte_string(b))
    return F.call_function("levenshtein", byte_string(a), byte_string(b), at_most.cast("int"))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - levenshtein(a, b) / longest)


def jaro(a: Column, b: Column, exact_single_char: bool = False) -> Column:
    """Jaro similarity with half transpositions kept.

    Two strings of one byte each never match, which is what the engine's users know; with
    `exact_single_char` equal ones give 1.
    """
    x, y = byte_string(a), byte_string(b)
    l1, l2 = F.octet_length(a), F.octet_length(b)
    reach = F.floor(F.greatest(l1, l2) / 2).cast("int") - 1

    def match(state: Column, i: Column) -> Column:
        low = F.greatest(F.lit(1), i - reach)
        char = F.substring(x, i, F.lit(1))
        at = F.position(char, F.substring(state["work"], low, F.least(i + reach, l2) - low + 1))
        place = low + at - 1
        marked = F.concat(F.substring(state["work"], F.lit(1), place - 1), F.lit(_USED), F.substring(state["work"], place + 1, l2))
        return F.struct(F.when(at > 0, marked).otherwise(state["work"]).alias("work"), F.when(at > 0, F.concat(state["seen"], char)).otherwise(state["seen"]).alias("seen"))

    def score(state: Column) -> Column:
        work, seen = state["work"], state["seen"]
        other = F.aggregate(F.sequence(F.lit(1), l2), F.lit(""), lambda s, j: F.when(F.substring(work, j, F.lit(1)) == _USED, F.concat(s, F.substring(y, j, F.lit(1)))).otherwise(s))
        m = F.length(seen)
        differ = F.size(F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda k: F.substring(seen, k, F.lit(1)) != F.substring(other, k, F.lit(1))))
        return F.when(m == 0, F.lit(0.0)).otherwise((m / l1 + m / l2 + (m - differ / F.lit(2.0)) / m) / 3)

    full = F.aggregate(F.sequence(F.lit(1), l1), F.struct(y.alias("work"), F.lit("").alias("seen")), match, score)
    single = (x == y).cast("double") if exact_single_char else F.lit(0.0)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((l1 == 0) & (l2 == 0), F.lit(1.0))
        .when((l1 == 0) | (l2 == 0), F.lit(0.0))
        .when((l1 == 1) & (l2 == 1), single)
        .otherwise(full)
    )


def common_prefix(a: Column, b: Column, most: int = LONGEST_PREFIX) -> Column:
    x, y = byte_string(a), byte_string(b)
    length = F.lit(0)
    for n in range(1, most + 1):
        alike = (F.least(F.length(x), F.length(y)) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n))
        length = F.when(alike, F.lit(n)).otherwise(length)
    return length


def jaro_winkler(a: Column, b: Column, p: float = PREFIX_WEIGHT, exact_single_char: bool = False) -> Column:
    """Jaro plus the prefix bonus, which applies however low the Jaro similarity is."""
    # through an array, so that the Jaro similarity stands in the plan once
    once = F.array(jaro(a, b, exact_single_char))
    return F.element_at(F.transform(once, lambda j: j + common_prefix(a, b) * F.lit(p) * (1 - j)), 1)


def levenshtein_ci(a: Column, b: Column) -> Column:
    return levenshtein(ascii_lower(a), ascii_lower(b))


def jaro_winkler_ci(a: Column, b: Column, p: float = PREFIX_WEIGHT) -> Column:
    return jaro_winkler(ascii_lower(a), ascii_lower(b), p)


def similarity(a: Column, b: Column, algorithm: str = "jaro_winkler") -> Column:
    """`levenshtein` is the normalised one; any other name is Jaro-Winkler."""
    return normalized_levenshtein(a, b) if algorithm == "levenshtein" else jaro_winkler(a, b)


def score(a: Column, b: Column, algorithm: str = "jaro_winkler") -> Column:
    return F.coalesce(similarity(a, b, algorithm), F.lit(0.0))


def upper_bound(a: Column, b: Column, algorithm: str = "jaro_winkler") -> Column:
    """A bound of the similarity from byte lengths alone; never below the similarity."""
    l1, l2 = F.octet_length(a), F.octet_length(b)
    short, long = F.least(l1, l2), F.greatest(l1, l2)
    if algorithm == "levenshtein":
        bound = short / long
    else:
        j = (F.lit(2.0) + short / long) / 3
        bound = j + F.lit(LONGEST_PREFIX * PREFIX_WEIGHT) * (1 - j)
    return F.when(long == 0, F.lit(1.0)).otherwise(bound)


def is_similar(a: Column, b: Column, threshold: float = THRESHOLD, algorithm: str = "jaro_winkler") -> Column:
    """similarity >= threshold, false for null. Lengths that rule it out are seen first."""
    t = F.lit(float(threshold))
    possible = upper_bound(a, b, algorithm) + F.lit(1e-9) >= t
    if algorithm == "levenshtein":
        longest = F.greatest(F.octet_length(a), F.octet_length(b))
        budget = F.greatest(F.lit(0), F.floor((1 - t) * longest + F.lit(1e-9)))
        possible = possible & (levenshtein(a, b, budget) >= 0)
    return F.coalesce(F.when(possible, similarity(a, b, algorithm) >= t).otherwise(F.lit(False) & a.isNotNull()), F.lit(False))


#: The same functions in SQL, by signature; each may use those before it.
SQL_FUNCTIONS = {
    "byte_string(s STRING) RETURNS STRING": "decode(encode(s, 'UTF-8'), 'ISO-8859-1')",
    "ascii_lower(s STRING) RETURNS STRING": f"translate(s, '{UPPER}', '{LOWER}')",
    "byte_levenshtein(a STRING, b STRING) RETURNS INT": "levenshtein(byte_string(a), byte_string(b))",
    "norm_levenshtein(a STRING, b STRING) RETURNS DOUBLE": """CASE WHEN greatest(octet_length(a), octet_length(b)) = 0 THEN 1D
        ELSE 1D - byte_levenshtein(a, b) / greatest(octet_length(a), octet_length(b)) END""",
    "jaro(a STRING, b STRING) RETURNS DOUBLE": f"""CASE
        WHEN a IS NULL OR b IS NULL THEN NULL
        WHEN octet_length(a) = 0 AND octet_length(b) = 0 THEN 1D
        WHEN octet_length(a) = 0 OR octet_length(b) = 0 OR (octet_length(a) = 1 AND octet_length(b) = 1) THEN 0D
        ELSE aggregate(
            sequence(1, octet_length(a)),
            named_struct('work', byte_string(b), 'seen', ''),
            (s, i) -> CASE
                WHEN position(substring(byte_string(a), i, 1), substring(s.work, greatest(1, i - (greatest(octet_length(a), octet_length(b)) div 2 - 1)),
                    least(i + (greatest(octet_length(a), octet_length(b)) div 2 - 1), octet_length(b)) - greatest(1, i - (greatest(octet_length(a), octet_length(b)) div 2 - 1)) + 1)) > 0
                THEN named_struct(
                    'work', overlay(s.work PLACING '{_USED}' FROM greatest(1, i - (greatest(octet_length(a), octet_length(b)) div 2 - 1)) - 1 + position(substring(byte_string(a), i, 1),
                        substring(s.work, greatest(1, i - (greatest(octet_length(a), octet_length(b)) div 2 - 1)), octet_length(b))) FOR 1),
                    'seen', concat(s.seen, substring(byte_string(a), i, 1)))
                ELSE s END,
            s -> CASE WHEN length(s.seen) = 0 THEN 0D ELSE (length(s.seen) / octet_length(a) + length(s.seen) / octet_length(b)
                + (length(s.seen) - size(filter(sequence(1, length(s.seen)), k -> substring(s.seen, k, 1) <> substring(
                    aggregate(sequence(1, octet_length(b)), '', (t, j) -> CASE WHEN substring(s.work, j, 1) = '{_USED}' THEN concat(t, substring(byte_string(b), j, 1)) ELSE t END), k, 1))) / 2D)
                / length(s.seen)) / 3 END)
        END""",
    "common_prefix(a STRING, b STRING) RETURNS INT": "size(filter(sequence(1, 4), n -> octet_length(a) >= n AND octet_length(b) >= n AND substring(byte_string(a), 1, n) = substring(byte_string(b), 1, n)))",
    "jaro_winkler(a STRING, b STRING) RETURNS DOUBLE": f"element_at(transform(array(jaro(a, b)), j -> j + common_prefix(a, b) * {PREFIX_WEIGHT}D * (1 - j)), 1)",
    "levenshtein_ci(a STRING, b STRING) RETURNS INT": "byte_levenshtein(ascii_lower(a), ascii_lower(b))",
    "jaro_winkler_ci(a STRING, b STRING) RETURNS DOUBLE": "jaro_winkler(ascii_lower(a), ascii_lower(b))",
    "fuzzy_score(a STRING, b STRING, algorithm STRING) RETURNS DOUBLE": "coalesce(CASE WHEN algorithm = 'levenshtein' THEN norm_levenshtein(a, b) ELSE jaro_winkler(a, b) END, 0D)",
    "fuzzy_like(a STRING, b STRING, threshold DOUBLE, algorithm STRING) RETURNS BOOLEAN": "a IS NOT NULL AND b IS NOT NULL AND fuzzy_score(a, b, algorithm) >= threshold",
}


def register(spark) -> None:
    """Makes the functions callable in SQL; the optimizer expands them in place."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
