"""Format-preserving pseudonyms for personal data in texts.

Found and validated: card numbers (Luhn), telephone numbers, social security numbers, calendar
dates, IPv4 addresses, mail addresses, and values assigned to a password, token or key. Each
value is mapped by a keyed permutation of its own format, so a number stays a valid number of
its kind, and equal values get equal pseudonyms in every document, however they are spaced:

- The digits (or letters, bytes) of a value are one array. A Feistel network splits it in two
  halves and in each of `ROUNDS` rounds adds a keyed hash of one half to the other, modulo the
  radix. That is a permutation of all arrays of the length, whatever the hash.
- A format that does not use all arrays (area codes, dates) is walked: the network is applied
  again until the result is valid, which permutes the valid values among themselves.
- Check digits are left out of the permutation and computed anew.

Texts are split around the matches of one pattern and joined again, within the row: no shuffle,
no Python. What looks like a number of a kind but is not valid stays as it is, as does the rest
of the text. Null texts count as empty and stay null. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALKS = 40  # a step fails with a chance of 0.4 at most: 40 in a row do not happen
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

# A hyphen before or behind a number is part of it only if another digit comes there.
DATE = (
    r"(?<![\d./])(?<!\d-)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\d/]|[.-]\d)"
)
# What stands before a secret, in letters of either case.
SECRET_NAMES = "(?i:password|passwd|api_key|secret|token)"
# Letters of a mail address before its @: from the beginning of the word, however long it is.
LOCAL = r"\p{L}\p{N}._%+-"
KINDS = {
    "mail": rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{{2,}}",
    "secret": rf"(?<={SECRET_NAMES}\s?[=:]\s?\"?)[A-Za-z0-9_-]{{8,}}|(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])",
    "date": DATE,
    "ssn": r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "address": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\d])|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "card": r"(?<![\d.+])(?<!\d-)\d(?:[ -]?\d){12,18}(?!\d|-\d)",
}
# No text without a match of this holds any of the kinds: all others need a digit or an @.
MARK = f"[0-9@]|{SECRET_NAMES}|AKIA"
PIECE = 128  # letters of a secret or name that are permuted together
# Letters of a name or secret that are permuted among themselves.
CLASSES = {"0-9": "0123456789", "a-z": "abcdefghijklmnopqrstuvwxyz", "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
# All kinds, tried in this order. Group 1 is the match, group 2 is filled where it is a secret:
# whether a value is one shows in what stands before it.
ANY = "(" + "|".join(f"({p})" if kind == "secret" else f"(?:{p})" for kind, p in KINDS.items()) + ")"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda d: d.cast("int"))


def permute(values: Column, radix: int, key: str, kind: str | Column) -> Column:
    """A keyed permutation of int arrays of equal length with entries below `radix` (64 at most per half)."""

    def mask(round_: Column, half: Column, i: Column) -> Column:
        # Two hash digits per entry, from one hash per 32 entries.
        seed = F.concat_ws("/", F.lit(key), F.lit(kind), round_.cast("string"), (i / 32).cast("int").cast("string"), F.array_join(half.cast("array<string>"), ","))
        return F.conv(F.substring(F.sha2(seed, 256), 2 * (i % 32) + 1, 2), 16, 10).cast("int")

    def step(halves: Column, round_: Column) -> Column:
        mixed = F.transform(halves["left"], lambda v, i: F.pmod(v + mask(round_, halves["right"], i), F.lit(radix)))
        return F.struct(halves["right"].alias("left"), mixed.alias("right"))

    def network(v: Column) -> Column:
        middle = F.floor(F.size(v) / 2).cast("int")
        start = F.struct(F.slice(v, F.lit(1), middle).alias("left"), F.slice(v, middle + 1, F.size(v)).alias("right"))
        rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
        return F.aggregate(rounds, start, step, lambda s: F.concat(s["left"], s["right"]))

    return _let(values, network)


def walk(values: Column, radix: int, key: str, kind: str, valid) -> Column:
    """The permutation of the valid arrays: the network, repeated until its result is valid."""

    def step(at: Column, _: Column) -> Column:
        go_on = ~at["done"]
        result = F.when(go_on, permute(at["v"], radix, key, kind)).otherwise(at["v"])
        return _let(result, lambda v: F.struct(v.alias("v"), (at["done"] | valid(v)).alias("done")))

    start = F.struct(values.alias("v"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, step, lambda at: F.when(at["done"], at["v"]))


def _refill(template: Column, pattern: str, values: Column) -> Column:
    """`template` with its characters of `pattern` replaced by `values` in order."""

    def put(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(template, F.lit(1), i), f"[^{pattern}]", ""))
        return F.when(c.rlike(f"^[{pattern}]$"), F.get(values, before)).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), put), "")


def _luhn(payload: Column) -> Column:
    """The check digit that belongs behind the digits of `payload`."""

    def add(total: Column, i: Column) -> Column:
        d = F.get(payload, i)
        from_right = F.pmod(F.size(payload) - i, F.lit(2))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(from_right == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.size(payload) - 1), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("int")


def _card(value: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        payload = F.slice(d, F.lit(1), F.size(d) - 1)
        fresh = F.concat(F.slice(payload, 1, 1), permute(F.slice(payload, F.lit(2), F.size(payload)), 10, key, "card"))
        renewed = _let(fresh, lambda p: F.concat(p, F.array(_luhn(p))).cast("array<string>"))
        return F.when(_luhn(payload) == F.element_at(d, -1), _refill(value, "0-9", renewed)).otherwise(value)

    return _let(_digits(value), change)


def _phone(value: Column, key: str) -> Column:
    """The country code stays; in national numbers of North America area and exchange stay valid."""
    code = F.regexp_extract(value, r"^(\+\d{1,3}?(?=[ (-])|\+1(?=\d{10}$)|)", 1)
    national = F.substring(value, F.length(code) + 1, F.length(value))
    northern = code.isin("+1", "")

    def change(d: Column) -> Column:
        is_valid = lambda v: (F.get(v, F.lit(0)) > 1) & (F.get(v, F.lit(3)) > 1)
        american = northern & (F.size(d) == 10) & is_valid(d)
        fresh = F.when(american, walk(d, 10, key, "phone", is_valid)).otherwise(permute(d, 10, key, "phone"))
        return F.concat(code, _refill(national, "0-9", fresh.cast("array<string>")))

    return _let(_digits(national), change)


def _ssn(value: Column, key: str) -> Column:
    def valid(v: Column) -> Column:
        part = lambda a, n: F.array_join(F.slice(v, a, n).cast("array<string>"), "")
        return ~part(1, 3).isin("000", "666") & (F.get(v, F.lit(0)) < 9) & (part(4, 2) != "00") & (part(6, 4) != "0000")

    def change(d: Column) -> Column:
        fresh = walk(d, 10, key, "ssn", valid).cast("array<string>")
        return F.when(valid(d), _refill(value, "0-9", fresh)).otherwise(value)

    return _let(_digits(value), change)


def _address(value: Column, key: str) -> Column:
    def change(octets: Column) -> Column:
        fresh = F.array_join(permute(octets, 256, key, "address").cast("array<string>"), ".")
        return F.when(F.exists(octets, lambda o: o > 255), value).otherwise(fresh)

    return _let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), change)


def _date(value: Column, key: str) -> Column:
    forms = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d\.", "dd.MM.yyyy"), (r"^\d\d/", "MM/dd/yyyy"))
    first = F.to_date(F.lit(FIRST_DAY))
    number = lambda v: F.array_join(v.cast("array<string>"), "").cast("int")
    result = value
    for form, layout in forms:
        day = F.datediff(F.try_to_timestamp(value, F.lit(layout)).cast("date"), first)
        digits = F.transform(F.split(F.lpad(day.cast("string"), 5, "0"), ""), lambda d: d.cast("int"))
        fresh = F.date_format(F.date_add(first, number(walk(digits, 10, key, "date", lambda v: number(v) < DAYS))), layout)
        result = F.when(value.rlike(form), F.when(day.between(0, DAYS - 1), fresh).otherwise(value)).otherwise(result)
    return result


def _letters(value: Column, pattern: str, letters: str, key: str, kind: str | Column) -> Column:
    """`value` with the characters of one class permuted among themselves."""
    own = F.regexp_replace(value, f"[^{pattern}]", "")
    spots = F.transform(F.split(own, ""), lambda c: F.instr(F.lit(letters), c) - 1)
    fresh = F.transform(permute(spots, len(letters), key, kind), lambda n: F.substring(F.lit(letters), n + 1, F.lit(1)))
    return F.when(own == "", value).otherwise(_let(fresh, lambda f: _refill(value, pattern, f)))


def _once(value: Column, pattern: str, letters: str, key: str, kind: str | Column) -> Column:
    return _let(value, lambda v: _letters(v, pattern, letters, key, kind))


def _name(value: Column, key: str, kind: str | Column) -> Column:
    """Digits among digits, small letters among small letters, capitals among capitals."""
    for pattern, letters in CLASSES.items():
        value = _once(value, pattern, letters, key, kind)
    return value


def _in_pieces(value: Column, key: str, kind: str) -> Column:
    """Long values go in pieces of like length, each with a permutation of its own place."""

    def pieces(length: Column) -> Column:
        size = F.ceil(length / F.ceil(length / PIECE)).cast("string")
        return F.regexp_extract_all(value, F.concat(F.lit(".{1,"), size, F.lit("}")), F.lit(0))

    def renamed(piece: Column, i: Column) -> Column:
        return _name(piece, key, F.concat(F.lit(kind), F.when(i > 0, i.cast("string")).otherwise("")))

    return F.array_join(F.transform(_let(F.length(value), pieces), renamed), "")


def _secret(value: Column, key: str) -> Column:
    return _in_pieces(value, key, "secret")


def _mail(value: Column, key: str) -> Column:
    own = _let(F.substring_index(value, "@", 1), lambda local: _in_pieces(local, key, "mail"))
    return F.concat(own, F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    """The kind of a match that is no secret."""
    result = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        if kind != "secret":
            result = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(result)
    return result


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "mail", _mail(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "address", _address(value, key))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "card", _card(value, key))
        .otherwise(_secret(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """`docs` with pseudonyms in `column`, and `found`: (kind, new, changed) per match in reading order."""
    text = F.col(column)

    def judged(value: Column, secret: Column) -> Column:
        kind = F.when(secret != "", F.lit("secret")).otherwise(kind_of(value))
        renamed = _let(kind, lambda k: F.struct(k.alias("kind"), pseudonym(value, k, key).alias("new")))
        return _let(
            renamed, lambda r: F.struct(r["kind"].alias("kind"), r["new"].alias("new"), (r["new"] != value).alias("changed"))
        )

    def all_judged(matches: Column) -> Column:
        secrets = F.regexp_extract_all(text, F.lit(ANY), F.lit(2))
        return F.when(F.size(matches) > 0, F.zip_with(matches, secrets, judged))

    # The one cheap look spares texts that cannot hold any kind the long pattern.
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(1))
    marked = docs.withColumn("__new", F.when(text.rlike(MARK), _let(matches, all_judged)))
    between = F.split(text, ANY)
    joined = F.array_join(
        F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("__new"), i)["new"], F.lit("")))), ""
    )
    found = F.coalesce("__new", F.array().cast("array<struct<kind:string,new:string,changed:boolean>>"))
    return (
        marked.withColumn(column, F.when(F.col("__new").isNotNull(), joined).otherwise(text))
        .withColumn("found", found)
        .drop("__new")
    )
