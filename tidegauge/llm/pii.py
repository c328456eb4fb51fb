"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds e-mail addresses (with letters of any script), IBANs, IPv4 and IPv6 addresses, social security numbers, dates
(also before a time, as in 1999-12-31T10:00), phone numbers (domestic ones after a word such as tel, phone or fax), card numbers,
access keys with a well-known beginning, and hexadecimal keys that are given as the value of a token, key, secret, password or bearer.
It steps over UUIDs, and over four numbers with dots after a word such as v or version.
What passes its kind's check (Luhn's for cards, a real date, octets up to 255, 7 to 15 digits for phones, ...) is replaced by a keyed permutation of itself within its format: an alternating Feistel network of ROUNDS rounds, whose round
function is SHA-256 over key, kind, width, round and the other half. Halves are numbers in mixed radix (10 for digits,
26 for letters, 16 for hexadecimal), so digits stay digits, letters keep their case, and separators stay in place. Equal
values get equal pseudonyms in all documents, however they are separated; different values get different ones. A card number
keeps passing Luhn's check, an IBAN gets new check digits, a date stays a date of its era (about 200 years, 1900 to 2099 is
one). Of an address the name and the domain, but for its last label, are permuted apart, so that addresses of one domain stay linked;
letters beyond ASCII are permuted within the ranges of LETTERS, those of other scripts and combining marks stay. An IPv6 address is
written with all its groups; its network and the rest are permuted apart, so that addresses of one network stay linked.

The key may be a column: of key_file(), the plan and the event log show where it is read, not what it is; a string is a literal in both.

Each row is rewritten by itself: no shuffle, no state. Defined results: a null text stays null, an empty one empty;
values that fail their check stay, so commit ids do, and order numbers but for the tenth of them that passes Luhn's check by chance; dates are those of the years 1 to 9999; repeated rows come out alike; all other columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import private

ROUNDS = 8
#: Characters that are permuted together; longer values are permuted in such runs.
RUN = 24
#: Dates: eras of 270 x 270 days, one of which starts here. The first and the last era of the calendar are cut, to 135 x 277 and 32 x 1327 days.
FIRST_DAY, SIDE = "1900-01-01", 270
CUT_ERAS = {-10: (135, 277), 40: (32, 1327)}

# The formats, in the order in which they are tried.
_L, _R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
CARD = "[0-9](?:[ -]?[0-9]){11,18}"
FORMATS = {
    "uuid": _L + r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}" + _R,
    "email": r"(?<![A-Za-z0-9._%+\-\p{L}\p{M}])[A-Za-z0-9._%+\-\p{L}\p{M}]++@[A-Za-z0-9\-\p{L}\p{M}]++(?:\.[A-Za-z0-9\-\p{L}\p{M}]++)+",
    "iban": _L + r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2} ?[a-z0-9]{4}(?: ?[0-9]{4}){1,6}(?: ?[0-9]{1,3})?)" + _R,
    "access": _L + r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})" + _R,
    "key": r"(?=[0-9a-fA-F]{32})(?<=(?i:token|key|secret|password|passwd|pwd|auth|bearer|credential)s?[\"' ]{0,3}[=:]{1,2}[ ]{0,3}[\"']?|(?i:bearer)[ ]{1,3})(?:[0-9a-fA-F]{32,128})" + _R,
    "ip6": r"(?<![A-Za-z0-9:.])(?=[0-9a-fA-F]{1,4}:)(?=[a-fA-F:]{0,39}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5}::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})(?![A-Za-z0-9:]|\.[0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?=[0-9])(?<!\b(?i:v|ver|version|release|rev|revision|build|firmware)[ .:]{1,2})[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "date": _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _R + ")",
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})" + _R,
    "local": r"(?<![A-Za-z0-9+])(?=[0-9(])(?<=\b(?i:tel|telephone|telefon|phone|fon|mobile|mobil|cell|fax|call|dial|contact)s?(?: (?i:me|us|number|no|nr|at|is))?(?: (?i:on|at|is))?[.:=#]{0,2} {0,2})\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,4}){1,4}" + _R,
    "number": _L + CARD + _R,
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
#: What a found value looks like by itself, without what must stand before it.
SHAPES = FORMATS | {
    "key": "[0-9a-fA-F]{32,128}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "local": r"(?=(?:[^0-9]*[0-9]){7,11}[^0-9]*$)\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,4}){1,4}",
}
# Ranges of letters beyond ASCII, as their first code point, how many are permuted among each other, and how many such runs follow.
LETTERS = (
    (0xC0, 23, 1), (0xD8, 7, 1), (0xDF, 24, 1), (0xF8, 8, 1),  # Latin, capital and small
    (0x100, 32, 4), (0x3B1, 25, 1), (0x410, 32, 2), (0x4E00, 32, 656), (0xAC00, 32, 349),  # further Latin, Greek, Cyrillic, Han, Hangul
)
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _radix(c: Column, hexadecimal: bool, beyond: bool) -> Column:
    """1 for characters that stay, the negative number of letters for those beyond ASCII."""
    if hexadecimal:
        return F.when(c.rlike("^[0-9a-fA-F]$"), 16).otherwise(1)
    known = F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26)
    if beyond:
        for first, n, runs in LETTERS:
            known = known.when(F.ascii(c).between(first, first + n * runs - 1), -n)
    return known.otherwise(1)


def _first(c: Column) -> Column:
    """The first code point of the run that a letter beyond ASCII belongs to."""
    found = F.when(F.lit(False), 0)
    for first, n, runs in LETTERS:
        start = F.ascii(c) - F.pmod(F.ascii(c) - first, F.lit(n)) if runs > 1 else F.lit(first)
        found = found.when(F.ascii(c).between(first, first + n * runs - 1), start)
    return found.otherwise(0)


def _value(c: Column, radix: Column) -> Column:
    return F.when(radix < 0, (F.ascii(c) - _first(c)).cast("long")).otherwise(_ascii_value(c, radix))


def _ascii_value(c: Column, radix: Column) -> Column:
    low = F.lower(c)
    return F.when(radix == 10, F.instr(F.lit(ALPHABETS[10]), low)).when(radix == 16, F.instr(F.lit(ALPHABETS[16]), low)).when(
        radix == 26, F.instr(F.lit(ALPHABETS[26]), low)
    ).otherwise(1).cast("long") - 1


def _letter(value: Column, radix: Column, like: Column) -> Column:
    far = F.decode(F.unhex(F.lpad(F.hex(_first(like) + value), 4, "0")), "UTF-16BE")
    return F.when(like.rlike("^[0-9A-Za-z]$"), _ascii_letter(value, radix, like)).otherwise(far)


def _ascii_letter(value: Column, radix: Column, like: Column) -> Column:
    at = (value + 1).cast("int")
    low = F.when(radix == 10, F.substring(F.lit(ALPHABETS[10]), at, 1)).when(radix == 16, F.substring(F.lit(ALPHABETS[16]), at, 1)).otherwise(
        F.substring(F.lit(ALPHABETS[26]), at, 1)
    )
    return F.when(like.rlike("^[A-Z]$"), F.upper(low)).otherwise(low)


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, secret: Column, rounds: int = ROUNDS) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (left_mod, right_mod)."""

    def mix(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", secret, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda a, i: F.when(
            i % 2 == 0, F.struct(F.pmod(a["l"] + F.pmod(mix(i, a["r"]), left_mod), left_mod).alias("l"), a["r"].alias("r"))
        ).otherwise(F.struct(a["l"].alias("l"), F.pmod(a["r"] + F.pmod(mix(i, a["l"]), right_mod), right_mod).alias("r"))),
    )


def _half(cells: Column) -> Column:
    """struct(v, m): the number that the cells (v, m, c) write in mixed radix, and how many there are."""
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m"))
    return F.aggregate(
        cells, zero, lambda a, x: F.struct((a["v"] * x["m"] + x["v"]).alias("v"), (a["m"] * x["m"]).alias("m"))
    )


def _write(cells: Column, value: Column, letter: Callable[[Column, Column, Column], Column]) -> Column:
    """The characters of the number, in the cells' radixes and cases."""
    start = F.struct(value.alias("v"), F.lit("").alias("s"))
    return F.aggregate(
        F.reverse(cells),
        start,
        lambda a, x: F.struct(
            F.call_function("div", a["v"], x["m"]).alias("v"),
            F.concat(letter(F.pmod(a["v"], x["m"]), x["m"], x["c"]), a["s"]).alias("s"),
        ),
        lambda a: a["s"],
    )


def permuted(s: Column, secret: Column, hexadecimal: bool = False, beyond: bool = False) -> Column:
    """The string with its digits and letters, also those `beyond` ASCII, permuted; all other characters stay in place."""
    radix = lambda c: _radix(c, hexadecimal, beyond)
    letter = _letter if beyond else _ascii_letter

    def run(cells: Column, at: Column) -> Column:
        cut = F.floor(F.size(cells) / 2).cast("int")
        halves = F.struct(F.slice(cells, F.lit(1), cut).alias("a"), F.slice(cells, cut + 1, F.size(cells) - cut).alias("b"))

        def turn(h: Column) -> Column:
            numbers = F.struct(_half(h["a"]).alias("x"), _half(h["b"]).alias("y"))
            tweak = F.concat_ws("|", secret, F.size(cells).cast("string"), at.cast("string"))
            return let(
                numbers,
                lambda n: let(
                    feistel(n["x"]["v"], n["y"]["v"], n["x"]["m"], n["y"]["m"], tweak),
                    lambda f: F.concat(_write(h["a"], f["l"], letter), _write(h["b"], f["r"], letter)),
                ),
            )

        return let(halves, turn)

    def rebuilt(chars: Column) -> Column:
        cells = F.transform(
            F.filter(chars, lambda c: radix(c) != 1),
            lambda c: let(radix(c), lambda r: F.struct((_value if beyond else _ascii_value)(c, r).alias("v"), F.abs(r).cast("long").alias("m"), c.alias("c"))),
        )

        def parts(all_cells: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_cells) / RUN).cast("int") - 1, F.lit(0)))
            return F.array_join(F.transform(starts, lambda i: run(F.slice(all_cells, i * RUN + 1, RUN), i)), "")

        def put(new: Column) -> Column:
            return F.aggregate(
                chars,
                F.struct(F.lit(1).alias("k"), F.lit("").alias("s")),
                lambda a, c: F.when(
                    radix(c) != 1,
                    F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.substring(new, a["k"], F.lit(1))).alias("s")),
                ).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s"))),
                lambda a: a["s"],
            )

        return let(let(cells, parts), put)

    return let(_chars(s), rebuilt)


def luhn(digits: Column) -> Column:
    """Luhn's sum modulo 10 of a string of digits (the last of them is the check digit)."""
    return F.aggregate(
        F.transform(
            F.reverse(_chars(digits)),
            lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, v: a + v,
    ) % 10


def _number(m: Column, secret: Column) -> Column:
    """All digits but the last are permuted; the last is Luhn's check digit. What fails Luhn's check stays."""

    def checked(new: Column) -> Column:
        last = F.pmod(-luhn(F.concat(F.regexp_replace(new, "[^0-9]", ""), F.lit("0"))), F.lit(10))
        return F.concat(new, last.cast("int").cast("string"))

    valid = luhn(F.regexp_replace(m, "[^0-9]", "")) == 0
    return F.when(valid, let(permuted(m.substr(F.lit(1), F.length(m) - 1), secret), checked)).otherwise(m)


def _iban(m: Column, secret: Column, number: Column) -> Column:
    """Country and grouping stay, the account is permuted, the check digits follow; unless the check fails. A card number may follow what only looks like a beginning."""

    def mod97(compact: Column) -> Column:
        return F.aggregate(
            _chars(F.concat(compact.substr(F.lit(5), F.length(compact) - 4), F.substring(compact, 1, 4))),
            F.lit(0),
            lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.instr(F.lit(ALPHABETS[26]), F.lower(c)) + 9) % 97),
        )

    plain = lambda x: F.regexp_replace(x, " ", "")

    def checked(rest: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = F.lit(98) - mod97(plain(F.concat(country, F.lit("00"), rest)))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)

    rest = m.substr(F.lit(6), F.length(m) - 5)
    card = F.when(m.rlike(f"^.{{4}} (?:{CARD})$"), F.concat(F.substring(m, 1, 5), _number(rest, number))).otherwise(m)
    return F.when(mod97(plain(m)) == 1, let(permuted(m.substr(F.lit(5), F.length(m) - 4), secret), checked)).otherwise(card)


def _ip(m: Column, secret: Column) -> Column:
    def turn(p: Column) -> Column:
        f = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), secret)
        return let(
            f,
            lambda x: F.concat_ws(
                ".",
                F.shiftright(x["l"], 8).cast("string"), F.pmod(x["l"], F.lit(256)).cast("string"),
                F.shiftright(x["r"], 8).cast("string"), F.pmod(x["r"], F.lit(256)).cast("string"),
            ),
        )

    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    return F.when(F.forall(F.split(m, r"\."), lambda o: o.cast("int") < 256), let(octets, turn)).otherwise(m)


def _ip6(m: Column, secret: Column) -> Column:
    """The network, which is the first four groups, is permuted apart from the rest; however it is written, an address is the same."""
    sides = F.transform(F.split(F.lower(m), "::"), lambda x: F.split(x, ":"))
    left, right = sides[0], F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    valid = F.when(F.size(sides) == 2, missing > 0).otherwise(missing == 0)

    def turn(groups: Column) -> Column:
        def half(start: int, kind: str) -> Column:
            high, low = (groups[i] * 65536 + groups[i + 1] for i in (start, start + 2))
            found = feistel(high, low, F.lit(1 << 32), F.lit(1 << 32), F.concat(secret, F.lit(kind)))
            return let(
                found,
                lambda f: F.transform(
                    F.array(F.shiftright(f["l"], 16), F.pmod(f["l"], F.lit(65536)), F.shiftright(f["r"], 16), F.pmod(f["r"], F.lit(65536))), lambda g: F.lower(F.hex(g))
                ),
            )

        return F.array_join(F.concat(half(0, "|net"), half(4, "|host")), ":")

    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    made = let(F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")), turn)
    return F.when(valid, F.when(m.rlike("[A-F]"), F.upper(made)).otherwise(made)).otherwise(m)


def _ssn(m: Column, secret: Column) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001: 898 x 99 and 9999 of them."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def text(f: Column) -> Column:
        at = F.floor(f["l"] / 99) + 1
        return F.concat_ws(
            "-",
            F.lpad((at + F.when(at >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.pmod(f["l"], F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((f["r"] + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, let(feistel(index, serial - 1, F.lit(898 * 99), F.lit(9999), secret), text)).otherwise(m)


# How dates are written, and the layouts of each, in the order in which they are tried.
LAYOUTS = (
    ("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"),
    (r"^[0-9]{2}\.[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{1,2}\.", "d.M.yyyy"),
    ("^[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), ("^[0-9]{2}/[0-9]{2}/[0-9]{4}", "MM/dd/yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/", "d/M/yyyy"), ("^[0-9]{1,2}/[0-9]{1,2}/", "M/d/yyyy"),
)


def _date(m: Column, secret: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def read(shape: str, layout: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), first)
        return F.when(m.rlike(shape), let(day, lambda d: F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(layout).alias("layout")))))

    def turned(x: Column) -> Column:
        day, era = x["day"], F.floor(x["day"] / (SIDE * SIDE))
        start = F.greatest(era * (SIDE * SIDE), F.datediff(F.lit("0001-01-01").cast("date"), first))
        left, right = (F.coalesce(*(F.when(era == e, sizes[i]) for e, sizes in CUT_ERAS.items()), F.lit(SIDE)) for i in range(2))
        field = F.struct(start.alias("start"), left.alias("left"), right.alias("right"), F.concat_ws("|", secret, era.cast("string")).alias("secret"))

        def permute(e: Column) -> Column:
            at = feistel(F.floor((day - e["start"]) / e["right"]), F.pmod(day - e["start"], e["right"]), e["left"], e["right"], e["secret"])
            return let(at, lambda f: F.call_function("date_format", F.date_add(first, (e["start"] + f["l"] * e["right"] + f["r"]).cast("int")), x["layout"]))

        return let(field, permute)

    return let(F.coalesce(*(read(*x) for x in LAYOUTS)), lambda x: F.when(x.isNotNull(), turned(x)).otherwise(m))


def _phone(m: Column, secret: Column) -> Column:
    """The country's code stays; 7 to 15 digits are a phone number."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    valid = F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15)
    return F.when(valid, F.concat(country, permuted(m.substr(F.length(country) + 1, F.length(m)), secret))).otherwise(m)


def _email(m: Column, name: Column, domain: Column) -> Column:
    at = F.instr(m, "@")
    last = F.regexp_extract(m, r"\.[^.]*$", 0)
    host = m.substr(at + 1, F.length(m) - at - F.length(last))
    return F.concat(permuted(m.substr(F.lit(1), at - 1), name, beyond=True), F.lit("@"), permuted(host, domain, beyond=True), last)


def _access(m: Column, secret: Column) -> Column:
    """The beginning, which tells what it opens, stays."""
    start = F.regexp_extract(m, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    return F.concat(start, permuted(m.substr(F.length(start) + 1, F.length(m)), secret))


def _pseudonym(m: Column, key: Column) -> Column:
    secret = lambda kind: F.concat(key, F.lit(f"|{kind}"))
    made = {
        "uuid": m,
        "email": _email(m, secret("email"), secret("domain")),
        "iban": _iban(m, secret("iban"), secret("number")),
        "access": _access(m, secret("access")),
        "key": let(permuted(m, secret("key"), hexadecimal=True), lambda k: F.when(m.rlike("[A-F]"), F.upper(k)).otherwise(k)),
        "ip6": _ip6(m, secret("ip6")),
        "ip": _ip(m, secret("ip")),
        "date": _date(m, secret("date")),
        "ssn": _ssn(m, secret("ssn")),
        "phone": _phone(m, secret("phone")),
        "local": permuted(m, secret("local")),
        "number": _number(m, secret("number")),
    }
    out = m
    for kind in reversed(SHAPES):
        out = F.when(m.rlike(f"^(?:{SHAPES[kind]})$"), made[kind]).otherwise(out)
    return out


def pseudonymised(text: Column, key: Column) -> Column:
    """struct(text, n): the text with pseudonyms, and how many values were replaced."""

    def rewrite(found: Column) -> Column:
        new = F.transform(found, lambda m: _pseudonym(m, key))
        return let(
            new,
            lambda n: F.struct(
                F.array_join(F.zip_with(F.split(text, PATTERN, -1), n, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"),
                F.aggregate(F.zip_with(found, n, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, b: a + b).alias("n"),
            ),
        )

    same = F.struct(text.alias("text"), F.lit(0).alias("n"))
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    changed = let(found, lambda f: F.when(F.size(f) > 0, rewrite(f)).otherwise(same))
    return F.when(text.rlike("[0-9@]|sk-|gh[pousr]_|AKIA|ASIA"), changed).otherwise(same)


@functools.lru_cache(maxsize=8)
def _expression(_jvm: int, text_col: str, key_col: str) -> Column:
    """The expression, which takes seconds to build."""
    return pseudonymised(F.col(f"`{text_col}`"), F.col(f"`{key_col}`"))


def key_file(spark: SparkSession, path: str) -> Column:
    """The key that a file of one line holds."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s+$", "")).scalar()


def pseudonymise(docs: DataFrame, key: str | Column, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with pseudonyms in their text and, if asked for, the number of replaced values."""
    if count_col in docs.columns:
        raise ValueError(f"the input already has a column {count_col}")
    new, secret = private(docs, "pii", "key")
    out = docs.withColumn(secret, F.lit(key) if isinstance(key, str) else key)  # a column of its own, for a subquery may not stand within a function's body
    out = out.withColumn(new, _expression(id(SparkContext._gateway), text_col, secret))
    cols = [F.col(f"{new}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col(f"{new}.n").alias(count_col)] if count_col else []))
