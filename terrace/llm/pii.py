"""Format-preserving pseudonyms for personal values, in built-in functions only.

A value's symbols (digits, letters of either case, octets, day numbers) are permuted by an alternating Feistel network:
in even rounds the left half is shifted by a keyed stream drawn from the right half, in odd rounds the other way round,
each symbol modulo its own alphabet. The stream is SHA-256 under the key. That is a keyed permutation of the values of
one format, so equal values stay equal in every document, different values stay different, and no table of values is kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import fresh_name

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, held as two symbols below DAY_SIDE; what falls outside walks on.
FIRST_DAY, DAYS, DAY_SIDE, WALK = "1900-01-01", 73049, 271, 24

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: kind -> pattern. Their order is the order in which a place is claimed.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "date": _B + r"(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2})" + _E,
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "iban": _B + r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}" + _E,
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}" + _E,
    "card": _B + r"(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})" + _E,
    "secret": r"""(?<=["'=: ])(?=[A-Za-z0-9_\-]*\d)(?=[A-Za-z0-9_\-]*[A-Za-z])[A-Za-z0-9_\-]{24,}""" + r"(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def permute(symbols: Column, sizes: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """Feistel permutation of an array of numbers, each below its entry in ``sizes``. One symbol is shifted by a
    stream of the key alone.

    A round's seed is a nested SHA-256 of the key, the kind, the number of symbols, the round and the other half; symbol
    i is shifted by the first 60 bits of SHA-256 of seed and i.
    """
    secret = hashlib.sha256(key.encode()).hexdigest()
    n = F.size(symbols)
    half = F.floor(n / 2).cast("int")
    text = lambda *parts: F.concat_ws("|", *[p.cast("string") for p in parts])
    sha = lambda *parts: F.sha2(text(*parts), 256)

    def step(v: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(v, half + 1, n - half)).otherwise(F.slice(v, F.lit(1), half))
        inner = sha(F.lit(secret), F.lit(kind), n, r, F.array_join(other.cast("array<string>"), ","))
        mine = lambda i: F.when(left, i < half).otherwise(i >= half)
        by = lambda seed, i: F.conv(F.substring(sha(seed, i), 1, 15), 16, 10).cast("bigint")
        shift = lambda seed, x, i: F.pmod(x + F.pmod(by(seed, i), F.element_at(sizes, i + 1)), F.element_at(sizes, i + 1))
        # The seed stands in an array of its own, so it is made once a round and not once a symbol.
        moved = F.transform(F.array(sha(F.lit(secret), inner)), lambda seed: F.transform(v, lambda x, i: F.when(mine(i), shift(seed, x, i)).otherwise(x)))
        return moved[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), symbols.cast("array<bigint>"), step)


def permute_text(value: Column, key: str, kind: str, letters: bool = True) -> Column:
    """Permute the ASCII digits (and letters) of a text in place; all else stays. Digits stay digits, case stays."""
    chars = F.split(value, "")
    base = lambda c: F.when(c.between("0", "9"), 48).when(F.lit(letters) & c.between("a", "z"), 97).when(F.lit(letters) & c.between("A", "Z"), 65).otherwise(0)
    number = F.transform(chars, lambda c: F.when(base(c) > 0, F.ascii(c) - base(c)).otherwise(0).cast("bigint"))
    sizes = F.transform(chars, lambda c: F.when(base(c) == 0, 1).when(base(c) == 48, 10).otherwise(26).cast("bigint"))
    moved = permute(number, sizes, key, kind)
    return F.array_join(F.zip_with(chars, moved, lambda c, x: F.when(base(c) == 0, c).otherwise(F.chr((x + base(c)).cast("int")))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digit characters, the last one counted once."""
    n = F.size(digits)
    doubled = lambda d, i: F.when((n - 1 - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(digits, lambda c, i: doubled(F.ascii(c) - 48, i)), F.lit(0), lambda a, x: a + x)


def _mod97(value: Column) -> Column:
    """An account number's remainder: country and check digits at the end, letters as 10 to 35."""
    chars = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), step)


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))


def kind_of(value: Column) -> Column:
    """The kind of a match, after validation; null where the value is not one of ours: a card must pass Luhn, an
    account number the remainder 97, an address needs octets below 256, a date must exist."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    digits = F.split(F.regexp_replace(value, r"\D", ""), "")
    return (
        F.when(whole(PATTERNS["email"]), "email")
        .when(whole(PATTERNS["date"]) & _day(value).isNotNull(), "date")
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}") & F.forall(_octets(value), lambda x: x < 256), "ip")
        .when(whole(PATTERNS["iban"]) & (_mod97(value) == 1), "iban")
        .when(whole(PATTERNS["ssn"]), "ssn")
        .when(whole(PATTERNS["phone"]), "phone")
        .when(whole(PATTERNS["card"]) & (_luhn_sum(digits) % 10 == 0), "card")
        .when(whole(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_\-]{24,}"), "secret")
    )


def _day(value: Column) -> Column:
    iso = F.when(F.substring(value, 3, 1) == "/", F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))).otherwise(value)
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, key: str) -> Column:
    side = F.array(F.lit(DAY_SIDE).cast("bigint"), F.lit(DAY_SIDE).cast("bigint"))
    once = lambda d: F.transform(F.array(permute(F.array(F.floor(d / DAY_SIDE).cast("bigint"), F.pmod(d, F.lit(DAY_SIDE)).cast("bigint")), side, key, "date")), lambda a: a[0] * DAY_SIDE + a[1])[0]
    start = F.struct(_day(value).cast("bigint").alias("d"), F.lit(False).alias("done"))
    walk = lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(once(s["d"])), lambda d: F.struct(d.alias("d"), (d < DAYS).alias("done")))[0])
    day = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk)["d"]
    to = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    return F.when(F.substring(value, 3, 1) == "/", F.date_format(to, "dd/MM/yyyy")).otherwise(F.date_format(to, "yyyy-MM-dd"))


def _card(value: Column, key: str) -> Column:
    head = permute_text(F.substring(value, F.lit(1), F.length(value) - 1), key, "card", False)

    def check(h: Column) -> Column:
        due = _luhn_sum(F.split(F.concat(F.regexp_replace(h, r"\D", ""), F.lit("0")), ""))
        return F.concat(h, F.pmod(10 - due % 10, F.lit(10)).cast("string"))

    return F.transform(F.array(head), check)[0]


def _iban(value: Column, key: str) -> Column:
    body = F.array(permute_text(F.substring(value, 5, 40), key, "iban"))

    def check(b: Column) -> Column:
        rest = 98 - _mod97(F.concat(F.substring(value, 1, 2), F.lit("00"), b))
        return F.concat(F.substring(value, 1, 2), F.lpad(rest.cast("string"), 2, "0"), b)

    return F.transform(body, check)[0]


def _ip(value: Column, key: str) -> Column:
    sizes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda _: F.lit(256).cast("bigint"))
    return F.array_join(permute(_octets(value), sizes, key, "ip").cast("array<string>"), ".")


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])", 0)
    return F.concat(country, permute_text(F.substring(value, F.length(country) + 1, F.length(value)), key, "phone", False))


def _secret(value: Column, key: str) -> Column:
    """Hexadecimal secrets move over their 16 signs, others over digits and letters."""
    signs = "0123456789abcdef"
    chars = F.split(value, "")
    number = F.transform(chars, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87).cast("bigint"))
    sizes = F.transform(chars, lambda _: F.lit(16).cast("bigint"))
    moved = F.array_join(F.transform(permute(number, sizes, key, "hex"), lambda x: F.substring(F.lit(signs), x.cast("int") + 1, F.lit(1))), "")
    return F.when(value.rlike("^[0-9a-f]+$"), moved).otherwise(permute_text(value, key, "secret"))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    at = F.instr(value, "@")
    email = F.concat(permute_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))
    return (
        F.when(kind == "email", email)
        .when(kind == "date", _date(value, key))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "ssn", permute_text(value, key, "ssn", False))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "secret", _secret(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with every validated value in ``text`` replaced, and a column ``pii_kinds`` (array of the kinds in
    order of their places; empty without any).

    Null texts stay null, empty ones empty; values that fail validation stay as they are. All other columns stay; a
    column named ``pii_kinds`` is replaced. Every row is treated alone, so repeated rows give equal rows.
    Whoever has the key can undo the pseudonyms: it belongs in a secret store, not in the source.
    """
    body = F.col(text)
    # Only texts with a digit or an at sign can hold a value: the rest skips the long pattern.
    some = body.rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Adjacent columns of one select would each repeat the pattern; structs inside one array keep it to one pass.
    kinds = F.transform(F.array(found), lambda m: F.transform(m, lambda v: F.struct(kind_of(v).alias("k"), v.alias("v"))))[0]
    at = fresh_name(docs, "pii")
    staged = docs.withColumn(at, kinds)
    moved = F.transform(F.col(at), lambda s: pseudonym(s["v"], s["k"], key))
    gaps = F.split(body, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, moved, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    out = F.when(F.size(at) > 0, joined).otherwise(body)
    kept = F.filter(F.transform(F.col(at), lambda s: s["k"]), lambda k: k.isNotNull())
    return staged.withColumns({text: out, "pii_kinds": F.coalesce(kept, F.array().cast("array<string>"))}).drop(at)
