"""Is the host of an address valid: IPv4 numbers, IPv6 groups, labels in Bootstring form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that vanish when a name is looked up.
IGNORED = r"[\x{AD}\x{34F}\x{180B}-\x{180F}\x{200B}\x{2060}\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"
FORBIDDEN = r"[\x00-\x20<>^|%\x7F#/:?@\[\\\]]"
#: Fixed values of Bootstring for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once: inside a lambda a repeated expression is evaluated every time."""
    return F.transform(F.array(value), use)[0]


def _number(part: Column) -> Column:
    """An IPv4 part: decimal, octal after 0, hexadecimal after 0x; NULL for none, 2**40 for one too large."""
    hexa = F.regexp_replace(F.substr(part, F.lit(3)), "^0+", "")
    octal = F.regexp_replace(part, "^0+", "")
    large = F.lit(1 << 40)
    number = lambda digits, base: F.when(F.length(digits) > 11, large).otherwise(F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint"))
    return (
        F.when(part.rlike("^0[xX][0-9A-Fa-f]*$"), number(hexa, 16))
        .when(part.rlike("^0[0-7]*$"), number(octal, 8))
        .when(part.rlike("^[1-9][0-9]*$"), F.when(F.length(part) > 11, large).otherwise(part.try_cast("bigint")))
    )


def valid_ipv4(host: Column) -> Column:
    """One to four numbers; all but the last fit a byte, the last fills the rest. One dot may end them."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)

    def fit(numbers: Column) -> Column:
        size = F.size(numbers)
        front = F.slice(numbers, F.lit(1), F.greatest(size - 1, F.lit(0)))
        room = F.when(size == 1, F.lit(1 << 32)).when(size == 2, 1 << 24).when(size == 3, 1 << 16).otherwise(256)
        return (size <= 4) & F.forall(numbers, lambda n: n.isNotNull()) & F.forall(front, lambda n: n < 256) & (F.element_at(numbers, -1) < room)

    return F.coalesce(let(F.transform(parts, _number), fit), F.lit(False))


def valid_ipv6(host: Column) -> Column:
    """Eight groups of up to four hexadecimal digits; two colons stand for missing ones, four decimal bytes for the last two."""
    inner = F.substr(host, F.lit(2), F.length(host) - 2)
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?<=:){byte}(?:\.{byte}){{3}}$"
    plain = F.regexp_replace(inner, tail, "0:0")
    halves = F.split(plain, "::", -1)
    groups = F.flatten(F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))))
    whole = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    enough = F.when(F.size(halves) == 1, F.size(groups) == 8).otherwise((F.size(halves) == 2) & (F.size(groups) <= 7))
    return F.coalesce(host.rlike(r"^\[.*\]$") & whole & enough, F.lit(False))


def _adapted(delta: Column, size: Column, first: Column) -> Column:
    halved = F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2)).cast("bigint")
    start = F.struct((halved + F.floor(halved / size).cast("bigint")).alias("d"), F.lit(0).cast("bigint").alias("k"))
    limit = (BASE - T_MIN) * T_MAX // 2
    # Numbers here stay under 2**32, so a few divisions by 35 are all there can be.
    step = lambda s, _: F.when(s["d"] > limit, F.struct(F.floor(s["d"] / (BASE - T_MIN)).cast("bigint").alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step)
    return let(end, lambda e: e["k"] + F.floor((BASE - T_MIN + 1) * e["d"] / (e["d"] + SKEW)).cast("bigint"))


def decoded_label(label: Column) -> Column:
    """The code points of a label after `xn--`, in order; NULL where it is no Bootstring."""
    body = F.lower(F.substr(label, F.lit(5)))
    basic = F.regexp_extract(body, "^(.*)-", 1)
    digits = F.split(F.regexp_replace(body, "^.*-", ""), "")
    begin = F.transform(F.filter(F.split(basic, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    big = lambda n: F.lit(n).cast("bigint")
    names = ("out", "n", "i", "old", "w", "k", "bias", "ok")
    start = F.struct(*[c.alias(n) for n, c in zip(names, (begin, big(FIRST), big(0), big(0), big(1), big(BASE), big(BIAS), F.lit(True)), strict=True)])

    def step(s: Column, c: Column) -> Column:
        digit = F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), F.ascii(c) - 48 + 26).cast("bigint")
        i = s["i"] + digit * s["w"]
        t = F.when(s["k"] <= s["bias"], T_MIN).when(s["k"] >= s["bias"] + T_MAX, T_MAX).otherwise(s["k"] - s["bias"])
        size = F.size(s["out"]) + 1
        place = (i % size).cast("int")
        n = s["n"] + F.floor(i / size).cast("bigint")
        put = F.concat(F.slice(s["out"], F.lit(1), place), F.array(n), F.slice(s["out"], place + 1, F.lit(64)))
        ended = (put, n, (place + 1).cast("bigint"), (place + 1).cast("bigint"), big(1), big(BASE), _adapted(i - s["old"], size, s["old"] == 0), F.lit(True))
        going = (s["out"], s["n"], i, s["old"], s["w"] * (BASE - t), s["k"] + BASE, s["bias"], F.lit(True))
        made = lambda values: F.struct(*[v.alias(x) for x, v in zip(names, values, strict=True)])
        stopped = made((*[s[x] for x in names[:-1]], F.lit(False)))
        fits = s["ok"] & digit.isNotNull() & (F.size(s["out"]) < 63) & (i < (1 << 32)) & (s["w"] < (1 << 32))
        return F.when(~F.coalesce(fits, F.lit(False)), stopped).when(digit < t, made(ended)).otherwise(made(going))

    end = F.aggregate(F.filter(digits, lambda c: c != ""), start, step)
    # A number that stops half way, and nothing but ASCII, are no Bootstring.
    return let(end, lambda e: F.when(e["ok"] & (e["w"] == 1) & (e["k"] == BASE) & F.exists(e["out"], lambda n: n > 127), e["out"]))


def valid_label(label: Column) -> Column:
    """A label in Bootstring form decodes to letters, marks and digits in lower case; others are not looked into."""
    points = decoded_label(label)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    known = F.forall(points, lambda n: (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & F.when(n == 45, True).otherwise(char(n).rlike(r"^[\p{L}\p{M}\p{Nd}\x{B7}\x{30FB}&&[^\p{Lu}]]$")))
    return F.when(label.rlike("(?i)^xn--"), F.coalesce(known, F.lit(False))).otherwise(True)


def valid_host(host: Column) -> Column:
    """Whether an address with this host can be read: no forbidden character, valid numbers, valid labels."""

    def named(name: Column) -> Column:
        bare = F.regexp_replace(name, r"\.$", "")
        numeric = bare.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)$")
        return (
            F.when(name.rlike(f"^$|{FORBIDDEN}"), False)
            .when(numeric, valid_ipv4(name))
            .when(name.rlike("(?i)(?:^|[.])xn--"), F.forall(F.split(bare, r"\.", -1), valid_label))
            .otherwise(True)
        )

    return let(host, lambda h: F.when(h.startswith("["), valid_ipv6(h)).otherwise(let(F.regexp_replace(h, IGNORED, ""), named)))
