r"""Personal data: format-preserving Feistel pseudonyms, with DataFrame functions alone.

Validated values are permuted under a key within their own format, so equal values get equal pseudonyms in
every document and different ones stay different:

* card numbers (issuer prefix and Luhn digit; in one piece, in fours or in groups of 4, 6 and 5): the first four
  digits stay, the others but the last are permuted, the last is computed again;
* phone numbers, ``+`` with a country code and 8 to 15 digits in all, or ten digits as ``(ddd) ddd-dddd``,
  ``ddd-ddd-dddd`` or ``ddd.ddd.dddd``: the country code stays (without a separator after it one digit, 1 or 7, or
  else two), all other digits are permuted.  Numbers without ``+`` in other groups aren't found;
* social security numbers ``ddd-dd-dddd`` (no area 000, 666 or 9xx): the area's three digits stay, the six others
  are permuted;
* IPv4 addresses (four octets up to 255): the two halves;
* dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy where the second number is no month; day and month in
  one or two digits; real days from 1900-01-01 on, 73,170 of them): the day's number, among days of the same form;
* mail addresses, with 1 to 64 characters before the ``@``, as the mail standards allow: letters and digits of the
  local part, each within its class, case and script kept; only letters that are alone in their class, like the
  sharp s, stay.  The domain, of any script, stays.

The permutation of a string is an alternating Feistel network over its two halves: each round adds digits of a
keyed hash of one half to the other, character by character, modulo the size of the character's class; a number
is permuted likewise in two parts.  Whoever has the key can invert it (``inverse=True``).  One pass over each
text finds all kinds, so a pseudonym is never taken for another value; nothing is shuffled.

Defined results: a null text stays null; anything that fails validation stays as it is; repeated rows each get
their row; an empty table gives an empty table.  A search takes time in proportion to the text, also where letters
and digits go on without a space for megabytes; a run of over 64 such characters before an ``@`` is no address.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Used where no key is given: for tests and reproducible runs, not for release.
DEFAULT_KEY = "furrow"

# The formats, in the order in which they are tried at a place.
FORMATS = (
    # one try for each run of local characters, or from the end of the value before; no group repeats
    ("email", r"(?:\G|(?<![\p{L}0-9._%+-]))[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-][\p{L}0-9.-]{0,253}\.\p{L}{2,}+"),
    (
        "phone",
        r"\+1 ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
        r"|(?<![\p{L}0-9+])\+(?=[1-9](?:[ .()-]{0,2}[0-9]){7})[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,6}(?![0-9])"
        r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
        r"|(?<![0-9.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])",
    ),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[.\-/][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
)
#: Any of them, each as a group of its own.
PATTERN = "|".join(f"({p})" for _, p in FORMATS)
#: A text without any of these holds no value.
HINT = r"@|\+[1-9]|\([0-9]{3}\) ?[0-9]{3}-|[0-9]{4}|[0-9]\.[0-9]{1,3}\.|[0-9]{2}-[0-9]{2}"
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
#: Character classes: first code point and size.
CLASSES = ((48, 10), (97, 26), (65, 26), (224, 23), (248, 8), (192, 23), (216, 7))
_FIRST_DAY, _DAY_PARTS = "1900-01-01", (270, 271)
#: Turns of a walk to a day of the same form; 22 % of the days are of the rarest one.
_WALK = 256


def _letter_classes() -> list[tuple[int, int, int]]:
    """(first code point, size, step) of runs of letters of one kind and case beyond Latin-1.

    Upper and lower case may take turns.  Unicode 3.2 knows no letter that a newer version doesn't.
    """
    out = []
    category = unicodedata.ucd_3_2_0.category
    for kind in ("Lu", "Ll", "Lt", "Lm", "Lo"):
        codes = [c for c in range(256, 0x30000) if category(chr(c)) == kind]
        at = 0
        while at < len(codes) - 1:
            step, end = codes[at + 1] - codes[at], at + 1
            if step > 2:
                at += 1
                continue
            while end + 1 < len(codes) and codes[end + 1] - codes[end] == step:
                end += 1
            out.append((codes[at], end + 1 - at, step))
            at = end + 1
    return out


_LETTERS = _letter_classes()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _noise(key: str, what: Column, turn: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), turn.cast("string"), what), 256)


def _number(digest: Column, at: Column | int, size: int) -> Column:
    return F.conv(F.substring(digest, at, size) if isinstance(at, int) else digest.substr(at, F.lit(size)), 16, 10).cast("long")


def _turns(inverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])


def _other_letter(char: Column, code: Column, by: Column) -> Column:
    """A letter beyond Latin-1, shifted within its run; other characters as they are."""
    first, size, step = (F.split(F.lit(",".join(str(run[i]) for run in _LETTERS)), ",").cast("array<int>") for i in range(3))
    holds = lambda k: (code >= first[k]) & (code < first[k] + size[k] * step[k]) & (F.pmod(code - first[k], step[k]) == 0)
    run = F.filter(F.sequence(F.lit(0), F.lit(len(_LETTERS) - 1)), holds)
    place = lambda k: first[k] + step[k] * F.pmod((code - first[k]) / step[k] + by, size[k]).cast("int")
    shifted = F.transform(run, lambda k: F.decode(F.unhex(F.lpad(F.hex(place(k)), 8, "0")), "UTF-32"))
    return F.when(code < 256, char).otherwise(F.coalesce(F.get(shifted, F.lit(0)), char))


def _shifted(char: Column, by: Column, letters: bool) -> Column:
    code = F.ascii(char)
    out = _other_letter(char, code, by) if letters else char
    for first, size in CLASSES:
        out = F.when((code >= first) & (code < first + size), F.chr(F.lit(first) + F.pmod(code - first + by, F.lit(size)))).otherwise(out)
    return out


def _added(half: Column, digest: Column, sign: int, letters: bool) -> Column:
    """The half with each character shifted by its own digits of the hash."""
    n = F.length(half)
    by = lambda d, j: sign * _number(F.sha2(F.concat(d, (j / 8).cast("int").cast("string")), 256), 1 + 8 * F.pmod(j, F.lit(8)), 7)
    shifted = _let(digest, lambda d: F.transform(F.sequence(F.lit(1), n), lambda j: _shifted(half.substr(j, F.lit(1)), by(d, j), letters)))
    return F.when(n > 0, F.array_join(shifted, "")).otherwise(F.lit(""))


def permuted_text(text: Column, key: str, inverse: bool = False, letters: bool = False) -> Column:
    """A keyed permutation of all strings of one format: same length, same class of character at each place.

    Letters beyond Latin-1 are permuted only if asked.
    """
    middle = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), middle).alias("l"), text.substr(middle + 1, F.length(text) - middle).alias("r"))
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        digest = _noise(key, F.when(even, s["r"]).otherwise(s["l"]), i)
        other = F.when(even, s["l"]).otherwise(s["r"])
        changed = _added(other, digest, sign, letters)
        return F.struct(F.when(even, changed).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(changed).alias("r"))

    return F.aggregate(_turns(inverse), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, inverse: bool = False) -> Column:
    """A keyed permutation of pairs of numbers below the sizes."""
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        noise = sign * _number(_noise(key, F.when(even, s["b"]).otherwise(s["a"]).cast("string"), i), 1, 12)
        return F.struct(F.when(even, F.pmod(s["a"] + noise, F.lit(sizes[0]))).otherwise(s["a"]).cast("long").alias("a"), F.when(even, s["b"]).otherwise(F.pmod(s["b"] + noise, F.lit(sizes[1]))).cast("long").alias("b"))

    return F.aggregate(_turns(inverse), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _placed(form: Column, digits: Column) -> Column:
    """The digits in the places of the form's digits."""
    seen = lambda j: F.length(F.regexp_replace(form.substr(F.lit(1), j), "[^0-9]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda j: F.when(form.substr(j, F.lit(1)).rlike("[0-9]"), digits.substr(seen(j), F.lit(1))).otherwise(form.substr(j, F.lit(1)))), "")


def _luhn(digits: Column, skip: int) -> Column:
    """The sum of the Luhn rule, over digits whose last but ``skip`` is doubled first."""
    n = F.length(digits)
    one = lambda j: digits.substr(j, F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda j: F.when(F.pmod(n - j + skip, F.lit(2)) == 1, one(j) * 2 - F.when(one(j) > 4, 9).otherwise(0)).otherwise(one(j)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str, inverse: bool) -> Column:
    digits = _digits(value)
    sound = digits.rlike(CARD_PREFIX) & (F.pmod(_luhn(digits, 0), F.lit(10)) == 0)
    # the first digits stay, so that a pseudonym has an issuer's prefix and can be told again
    head, tail = digits.substr(F.lit(1), F.lit(4)), digits.substr(F.lit(5), F.length(digits) - 5)
    check = lambda body: F.pmod(10 - F.pmod(_luhn(body, 1), F.lit(10)), F.lit(10)).cast("string")
    whole = _let(F.concat(head, permuted_text(tail, key + "|card", inverse)), lambda body: F.concat(body, check(body)))
    return F.when(sound, _let(whole, lambda d: _placed(value, d))).otherwise(value)


def _ip(value: Column, key: str, inverse: bool) -> Column:
    octet = lambda i: F.split(value, r"\.")[i].cast("int")
    sound = (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & ~value.rlike(r"(^|\.)0[0-9]")
    out = permuted_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (65536, 65536), key + "|ip", inverse)
    text = F.transform(F.array(out), lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(s["a"], 8), s["a"].bitwiseAND(255), F.shiftright(s["b"], 8), s["b"].bitwiseAND(255))]))[0]
    return F.when(sound, text).otherwise(value)


def _date(value: Column, key: str, inverse: bool) -> Column:
    epoch, days = F.lit(_FIRST_DAY).cast("date"), _DAY_PARTS[0] * _DAY_PARTS[1]

    def number(year: Column, month: Column, day: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), epoch)

    def moved(start: Column, sure: Column, fits: Callable[[Column], Column]) -> Column:
        """The permuted day; permuted again until it fits the form, so that days of a form are permuted among themselves."""
        once = lambda n: permuted_pair(F.floor(n / _DAY_PARTS[1]), F.pmod(n, F.lit(_DAY_PARTS[1])), _DAY_PARTS, key + "|date", inverse)
        state = lambda n: F.struct(n.alias("n"), (sure | fits(F.date_add(epoch, n.cast("int")))).alias("done"))
        turn = lambda s, _: F.when(s["done"], s).otherwise(_let(once(s["n"]), lambda p: state(p["a"] * _DAY_PARTS[1] + p["b"])))
        turns = F.sequence(F.lit(1), F.when(sure, 1).otherwise(_WALK))
        return F.aggregate(turns, F.struct(start.cast("long").alias("n"), F.lit(False).alias("done")), turn, lambda s: F.date_add(epoch, s["n"].cast("int")))

    def of(start: Column, sure: Column, fits: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
        return F.when((start >= 0) & (start < days), _let(moved(start, sure, fits), text)).otherwise(value)

    part = F.split(value, "[./-]")
    a, b, year, mark = part[0], part[1], part[2], F.regexp_extract(value, "[./]", 0)
    two_a, two_b = F.length(a) == 2, F.length(b) == 2
    put = lambda x, y, d: F.concat(F.lpad(x.cast("string"), F.length(a), "0"), mark, F.lpad(y.cast("string"), F.length(b), "0"), mark, F.year(d).cast("string"))
    iso = of(number(a, b, year), F.lit(True), lambda d: F.lit(True), lambda d: F.date_format(d, "yyyy-MM-dd"))
    day_first, month_first = number(year, b, a), number(year, a, b)
    dmy = of(day_first, two_a & two_b, lambda d: (two_a | (F.dayofmonth(d) < 10)) & (two_b | (F.month(d) < 10)), lambda d: put(F.dayofmonth(d), F.month(d), d))
    # a day after the twelfth can't be read as a month, so the form can be told again
    mdy = of(month_first, F.lit(False), lambda d: (F.dayofmonth(d) > 12) & (two_a | (F.month(d) < 10)), lambda d: put(F.month(d), F.dayofmonth(d), d))
    return F.when(value.rlike("^[0-9]{4}-"), iso).when(value.contains("/") & day_first.isNull() & b.cast("int").between(13, 31), mdy).otherwise(dmy)


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    sound = ~value.rlike("^(000|666|9)|-00-|-0000$")
    # the area stays, so that a pseudonym is sound too; group and serial are permuted without zeros
    group, serial = value.substr(5, 2).cast("int") - 1, value.substr(8, 4).cast("int") - 1
    out = permuted_pair(group, serial, (99, 9999), key + "|ssn", inverse)
    text = F.transform(F.array(out), lambda s: F.concat(value.substr(1, 4), F.lpad((s["a"] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["b"] + 1).cast("string"), 4, "0")))[0]
    return F.when(sound, text).otherwise(value)


def _phone(value: Column, key: str, inverse: bool) -> Column:
    group = F.regexp_extract(value, r"^\+([0-9]+)(?![0-9])", 1)
    # the country code stays: the first group, or without a separator the usual number of digits
    kept = F.when(~value.startswith("+"), 0).when(F.length(group) < 4, F.length(group)).when(value.rlike(r"^\+[17]"), 1).otherwise(2)

    def changed(d: Column) -> Column:
        return F.concat(d.substr(F.lit(1), kept), permuted_text(d.substr(kept + 1, F.length(d) - kept), key + "|phone", inverse))

    digits = _digits(value)
    return F.when(F.length(digits) > 15, value).otherwise(_let(_let(digits, changed), lambda d: _placed(value, d)))


def _email(value: Column, key: str, inverse: bool) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted_text(value.substr(F.lit(1), at - 1), key + "|email", inverse, letters=True), value.substr(at, F.length(value)))


_WAYS = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def _kind(value: Column) -> Column:
    out = F.when(value.contains("@"), "email").when(value.startswith("+") | value.rlike(r"^(\([0-9]{3}\) ?[0-9]{3}-|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}$"), "phone").when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
    return out.when(value.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})$"), "date").when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").otherwise("card")


def pseudonym(value: Column, key: str = DEFAULT_KEY, inverse: bool = False) -> Column:
    """The pseudonym of one value that has one of the formats."""
    out = value
    kind = _kind(value)
    for name, way in _WAYS.items():
        out = F.when(kind == name, way(value, key, inverse)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEFAULT_KEY, inverse: bool = False) -> DataFrame:
    """(doc_id, text, n_email, n_phone, n_ip, n_date, n_ssn, n_card): every text with pseudonyms, and how many of each kind changed."""
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    holds = text.rlike(HINT) & text.rlike(PATTERN)
    hits = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda h: F.struct(_kind(h).alias("kind"), h.alias("old"), pseudonym(h, key, inverse).alias("new")))
    parts = F.struct(F.split("text", PATTERN, -1).alias("gaps"), hits.alias("hits"))
    found = base.withColumn("parts", F.when(holds, parts))
    whole = F.array_join(F.zip_with("parts.gaps", "parts.hits", lambda g, h: F.concat(g, F.coalesce(h["new"], F.lit("")))), "")
    count = lambda kind: F.coalesce(F.size(F.filter("parts.hits", lambda h: (h["kind"] == kind) & (h["old"] != h["new"]))), F.lit(0)).cast("long")
    counts = [F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in _WAYS]
    return found.select("doc_id", F.when(F.col("parts").isNull(), text).otherwise(whole).alias("text"), *counts)
