"""Column functions on text: codecs, classifiers and the match-rewriting primitive."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.functions import patterns as P
from siltscreen.functions.hosts import let, valid_host


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def rewritten(text: Column, pattern: str, replacements: Column) -> Column:
    """`text` with its i-th match of `pattern` replaced by the i-th array element."""
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(
        gaps, replacements, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))
    )
    return F.array_join(pieces, "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def rewrite_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match `m` of `pattern` in `text` by `fn(m)`."""
    return rewritten(text, pattern, F.transform(matches(text, pattern), fn))


# --- Unicode -------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc_input(text: Column) -> Column:
    """The text when NFKC could change it, else NULL, so that clean rows never reach Python."""
    return F.when(text.rlike(P.NOT_NFKC_STABLE), text)


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(nfkc_input(text)), text)


# --- codecs and the instruction test -------------------------------------------


def _valid_utf8(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def base64_bytes(run: Column) -> Column:
    """Lenient base64: padding ignored, a lone last sextet dropped."""

    def decoded(digits: Column) -> Column:
        usable = F.length(digits) - F.when(F.length(digits) % 4 == 1, 1).otherwise(0)
        return F.unbase64(F.substring(digits, F.lit(1), usable))

    return let(F.when(run.endswith("="), F.rtrim(run, F.lit("="))).otherwise(run), decoded)


def decode_base64(run: Column) -> Column:
    """The bytes as text; bad UTF-8 becomes U+FFFD."""
    return _valid_utf8(base64_bytes(run))


def hex_bytes(run: Column) -> Column:
    """Hex digits only, taken in pairs from the front; an odd last digit is dropped."""

    def pairs(digits: Column) -> Column:
        return F.unhex(F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % 2))

    # Where something else stands between the digits the first is NULL.
    return F.coalesce(pairs(run), let(F.regexp_replace(run, "[^0-9a-fA-F]++", ""), pairs))


def decode_hex(run: Column) -> Column:
    return _valid_utf8(hex_bytes(run))


def instruction_like(text: Column) -> Column:
    return F.coalesce(text.rlike(P.INSTRUCTION), F.lit(False))


def base64_is_payload(run: Column, max_run: float | None = None) -> Column:
    """Decodes to an instruction; a run of more than `max_run` characters counts as none."""
    found = instruction_like(decode_base64(run))
    return found if max_run is None else F.when(F.length(run) > F.lit(max_run), False).otherwise(found)


def hex_is_payload(run: Column) -> Column:
    return instruction_like(decode_hex(run))


# --- links ---------------------------------------------------------------------


def _percent_decoded(part: Column) -> Column:
    """Escapes decoded; a percent sign that begins none stays as it is."""
    safe = F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), part)
    return F.when(part.contains("%"), decoded).otherwise(part)


def _url_decoded(part: Column) -> Column:
    """The same for a query, where a plus sign stands for a space."""
    return _percent_decoded(F.replace(part, F.lit("+"), F.lit("%20")))


def _is_absolute(url: Column) -> Column:
    """Has a scheme and, for the web schemes, a valid host and a port of at most 65535."""
    authority = F.regexp_extract(url, r"(?i)^(?:https?|ftp|wss?):[/\\]*+([^/\\?#]*+)", 1)
    place = F.regexp_replace(authority, "^.*@", "")
    host = _percent_decoded(F.regexp_replace(place, r":[^:\]]*\z", ""))
    port = F.regexp_extract(place, r":([^:\]]*)\z", 1)
    valid = port.rlike(r"^0*+(?:|[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])\z")
    return url.rlike("^[A-Za-z][A-Za-z0-9+.-]*+:") & (
        ~url.rlike("(?i)^(?:https?|ftp|wss?):") | (valid_host(host) & valid)
    )


def suspicious_url(written: Column) -> Column:
    """Query values that look like smuggled data, tell-tale parameter names, or sheer length.

    A browser drops tabs and line ends anywhere in an address, and control characters and spaces around
    it, before it reads the address; the length is that of the address as written.
    """

    def tell_tale(parts: Column) -> Column:
        name = _url_decoded(F.element_at(parts, 1))
        value = _url_decoded(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        told = lambda v: (F.length(v) > P.EXFIL_MAX_VALUE) | v.rlike(P.EXFIL_VALUE)
        return let(value, told) | name.isin(P.EXFIL_PARAMS)

    def read(url: Column) -> Column:
        query = F.regexp_extract(url, r"^[^?#]*+\?([^#]*+)", 1)
        pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
        # The cheap tests first: few addresses have anything to tell.
        return F.when(F.exists(pairs, lambda pair: let(F.split(pair, "=", 2), tell_tale)) | (F.length(written) > P.EXFIL_MAX_URL), _is_absolute(url)).otherwise(False)

    bare = F.regexp_replace(F.regexp_replace(written, r"^[\x00-\x20]++|[\x00-\x20]++\z", ""), r"[\t\n\r]", "")
    url = F.when(written.rlike(r"[\x00-\x20]"), bare).otherwise(written)
    return F.coalesce(let(url, read), F.lit(False))


def trim_ws(text: Column) -> Column:
    return F.when(text.rlike(f"[{P.WS}]"), F.regexp_replace(text, f"^[{P.WS}]++|[{P.WS}]++$", "")).otherwise(text)


def image_alt(image: Column) -> Column:
    return F.regexp_extract(image, P.MD_IMAGE, 1)


def image_url(image: Column) -> Column:
    return trim_ws(F.regexp_extract(image, P.MD_IMAGE, 2))


# --- colours and inline styles --------------------------------------------------


def _lookup(rows: str) -> Column:
    """A constant map from `key<TAB>value` lines."""
    return F.str_to_map(F.lit(rows), F.lit("\n"), F.lit("\t"))


def _channel(value: Column) -> Column:
    digits = F.lower(F.hex(value.try_cast("bigint")))
    return F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)


def normalize_color(value: Column) -> Column:
    """Any supported colour notation -> `#rrggbb`; NULL when the notation is unknown."""
    v = F.lower(trim_ws(value))
    names = _lookup("\n".join(f"{n}\t{c}" for n, c in P.NAMED_COLORS.items()))
    hex3 = F.regexp_replace(v, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    rgb = [_channel(F.regexp_extract(v, P.RGB, i)) for i in (1, 2, 3)]
    return F.coalesce(
        F.try_element_at(names, v),
        F.when(v.rlike("^#[0-9a-f]{3}$"), hex3),
        F.when(v.rlike("^#[0-9a-f]{6}$"), v),
        F.when(v.rlike(P.RGB), F.concat(F.lit("#"), *rgb)),
    )


def style_is_hidden(style: Column) -> Column:
    return F.coalesce(style.rlike(_all_parts([(s,) for s in P.HIDDEN_STYLES])), F.lit(False))


def style_is_off_screen(style: Column) -> Column:
    return F.coalesce(style.rlike(_all_parts(P.OFF_SCREEN_STYLES)), F.lit(False))


def style_is_same_color(style: Column) -> Column:
    fg = normalize_color(F.regexp_extract(style, P.FOREGROUND, 1))
    bg = normalize_color(F.regexp_extract(style, P.BACKGROUND, 1))
    return F.coalesce(fg == bg, F.lit(False))


def _all_parts(conjunctions: list[tuple[str, ...]]) -> str:
    """A pattern that holds when every part of at least one conjunction occurs somewhere."""
    looks = ["".join(f"(?=.*{re.escape(part)})" for part in parts) for parts in conjunctions]
    return "(?s)^(?:" + "|".join(looks) + ")"


# --- HTML entities and attributes -----------------------------------------------


def _frequent_names() -> str:
    names = {n: chr(cp) for n, cp in html.entities.name2codepoint.items()} | {"apos": "'"}
    return "\n".join(f"{n}\t{c}" for n, c in names.items())


def _other_names() -> str:
    """The rest of HTML5's names; a map is searched from its start, so the frequent ones have their own."""
    names = {n.rstrip(";"): c for n, c in html.entities.html5.items() if c not in "\n\t"}
    return "\n".join(f"{n}\t{c}" for n, c in sorted(names.items()) if n not in html.entities.name2codepoint)


def _named(name: Column) -> Column:
    """The characters of a name, NULL for an unknown one."""
    return F.coalesce(
        F.try_element_at(_lookup(_frequent_names()), name),
        F.try_element_at(_lookup(_other_names()), name),
        F.when(name == "NewLine", F.lit("\n")).when(name == "Tab", F.lit("\t")),
    )


def _cp1252_names() -> str:
    """Numeric references 128-159 mean Windows-1252, as in every browser."""
    rows = ((b, bytes([b]).decode("cp1252", "ignore")) for b in range(128, 160))
    return "\n".join(f"{b}\t{c}" for b, c in rows if c)


def _entity(ref: Column, in_text: bool) -> Column:
    body = F.rtrim(F.substr(ref, F.lit(2)), F.lit(";"))
    # Any number of leading zeros; numbers of more digits than a code point has are invalid.
    hex_digits = F.regexp_replace(body, "^#[xX]0*+", "")
    digits = F.regexp_replace(body, "^#0*+", "")
    code = F.when(
        body.rlike("^#[xX]"),
        F.when(F.length(hex_digits) > 8, F.lit(0x110000)).otherwise(F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("bigint")),
    ).when(
        body.startswith("#"),
        F.when(F.length(digits) > 10, F.lit(0x110000)).otherwise(F.concat(F.lit("0"), digits).try_cast("bigint")),
    )
    remapped = F.try_element_at(_lookup(_cp1252_names()), code.cast("string"))
    invalid = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    # U+FEFF alone would be read as a byte order mark and vanish.
    char = F.when(code == 0xFEFF, F.lit("\ufeff")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    )
    # An unknown name may begin with one of the oldest, which need no semicolon; the longest counts.
    old = F.regexp_extract(ref, f"^&({P.OLD_ENTITY})", 1)
    begun = F.when((old != "") & F.lit(in_text), F.concat(_named(old), F.substr(ref, F.length(old) + 2)))
    return F.when(
        body.startswith("#"),
        F.when(invalid, F.lit("�")).otherwise(F.coalesce(remapped, char)),
    ).otherwise(F.coalesce(_named(body), begun, ref))


def decode_entities(text: Column, pattern: str = P.TEXT_ENTITY) -> Column:
    """References of a text, or of an attribute's value with P.ATTRIBUTE_ENTITY."""
    in_text = pattern == P.TEXT_ENTITY
    decoded = rewrite_matches(text, pattern, lambda ref: _entity(ref, in_text))
    return F.when(text.contains("&"), decoded).otherwise(text)


def attributes(open_tag: Column) -> Column:
    """The attributes of a start tag as an array of `(name, value)`, entities decoded."""

    def parse(raw: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, f"^[^{P.HTML_WS}=]++", 0))
        value = F.regexp_extract(raw, f"(?s)^[^=]++=[{P.HTML_WS}]*+([\"']?)(.*?)\\1?$", 2)
        return F.struct(name.alias("name"), decode_entities(value, P.ATTRIBUTE_ENTITY).alias("value"))

    return F.transform(matches(F.regexp_replace(open_tag, P.TAG_NAME, ""), P.ATTRIBUTE), parse)


def attribute(attrs: Column, name: str) -> Column:
    """Value of the first attribute called `name`; '' if it has none, NULL if it is absent."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]
