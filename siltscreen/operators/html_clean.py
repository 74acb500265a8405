"""What to remove from a page, in nine ordered phases, and the eight HTML counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import elements
from siltscreen.functions import text as fn
from siltscreen.operators.html_tokens import ATTRIBUTED, ROW_KEY, tag_in, token_rows, with_elements
from siltscreen.schema import HTML_COUNTERS


def flag_elements(tokens: DataFrame) -> DataFrame:
    """Add `attrs, style, hidden, off_screen, same_color` (flags are false off start tags)."""
    head, style = F.col("head"), fn.attribute(F.col("attrs"), "style")
    # Attributes are parsed only for start tags that can matter.
    matters = head.rlike("(?i)style|hidden") | (head.isNotNull() & tag_in(ATTRIBUTED))
    tokens = tokens.withColumn("attrs", F.when(matters, fn.attributes(head)))
    return tokens.withColumn("style", style).withColumns(
        {
            "hidden": fn.style_is_hidden(F.col("style"))
            | fn.attribute(F.col("attrs"), "hidden").isNotNull(),
            "off_screen": fn.style_is_off_screen(F.col("style")),
            "same_color": fn.style_is_same_color(F.col("style")),
        }
    )


def alive(kind: Column, tag: Column, inside: Column) -> Column:
    """False for every token that some phase removes: in a removed element, gone whole, or a comment in an element."""
    gone = inside.bitwiseAND(elements.REMOVED | elements.STRIPPED) != 0
    return ~(gone | F.coalesce((kind == "comment") & (inside != 0), F.lit(False)))


def counted(kind: Column, tag: Column, bits: Column, inside: Column, again: Column) -> dict[str, Column]:
    """The eight counters of one token.

    A match inside a subtree that an earlier phase removed is not counted; one inside a
    subtree of its own phase is.  `again` adds elements that were opened anew at the token.
    """
    has = lambda bit: bits.bitwiseAND(bit) != 0
    outside = lambda mask: inside.bitwiseAND(mask) == 0
    anew = lambda k: F.call_function("shiftright", again, F.lit(elements.COUNT_BITS * k)).bitwiseAND(F.lit((1 << elements.COUNT_BITS) - 1).cast("bigint"))
    first = elements.HIDDEN | elements.OFF_SCREEN | elements.SAME_COLOR
    element = kind.isin("open", "void", "raw", "rawtext")
    found = {
        "hidden_elements": has(elements.HIDDEN),
        "html_comments": (kind == "comment") & (inside != 0) & outside(elements.REMOVED),
        "script_tags": element & (tag == "script") & outside(first),
        "style_tags": element & (tag == "style") & outside(first),
        "noscript_tags": element & has(elements.NOSCRIPT) & outside(first),
        "meta_tags": element & tag.isin("meta", "link") & outside(elements.REMOVED),
        "off_screen_elements": has(elements.OFF_SCREEN) & outside(elements.HIDDEN),
        "same_color_text": has(elements.SAME_COLOR) & outside(elements.HIDDEN | elements.OFF_SCREEN),
    }
    ones = {name: F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0).cast("bigint") for name, hit in found.items()}
    for k, name in enumerate(("hidden_elements", "off_screen_elements", "same_color_text")):
        ones[name] = ones[name] + F.coalesce(anew(k), F.lit(0))
    return ones


def token_counters() -> dict[str, Column]:
    return counted(*(F.col(c) for c in ("kind", "tag", "bits", "inside", "again")))


def page_counters(tokens: str = "_tokens") -> Column:
    """The eight counters of a page as one struct, from its array of tokens."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in HTML_COUNTERS])

    def add(total: Column, t: Column) -> Column:
        own = t["_tokens"]
        # Most tokens are text outside everything that counts: one test tells.
        counts = (own["kind"] == "comment") | (own["bits"] != 0) | (t["again"] != 0)
        ones = counted(own["kind"], own["tag"], own["bits"], t["inside"], t["again"])
        return F.when(counts, F.struct(*[(total[c] + ones[c]).alias(c) for c in HTML_COUNTERS])).otherwise(total)

    return F.coalesce(F.aggregate(tokens, zero, add), zero)


def _counted_pages(pages: DataFrame, html: str, reopens: bool, more: dict[str, Column]) -> DataFrame:
    others = [c for c in pages.columns if c not in (html, ROW_KEY)]
    size = F.octet_length("_html").cast("bigint").alias("input_size")
    cut = with_elements(pages.select(F.struct(*others, F.lit(0).alias("_none")).alias("_page"), F.col(html).alias("_html")), "_html", reopens)
    done = cut.select("_page", size, page_counters().alias("_counters"), *[c.alias(n) for n, c in more.items()])
    return done.select(*[F.col("_page").getField(c).alias(c) for c in others], "input_size", "_counters.*", *more)


def html_stats(pages: DataFrame, html: str = "html", reopens: bool = False) -> DataFrame:
    """The eight counters per page, beside the page's other columns; narrow, the same plan for batch and stream."""
    return _counted_pages(pages, html, reopens, {})


def html_clean(pages: DataFrame, html: str = "html", reopens: bool = False) -> DataFrame:
    """The page as markup with everything dangerous cut out, plus the eight counters; narrow."""
    kept = F.filter("_tokens", lambda t: alive(t["_tokens"]["kind"], t["_tokens"]["tag"], t["inside"]))
    return _counted_pages(pages, html, reopens, {"clean_html": F.array_join(F.transform(kept, lambda t: t["_tokens"]["tok"]), "")})


def page_structure(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = (), reopens: bool = False) -> DataFrame:
    """One row per token with the elements around it, and `alive`."""
    return token_rows(pages, html, carry, reopens).withColumn("alive", alive(F.col("kind"), F.col("tag"), F.col("inside")))
