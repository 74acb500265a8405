"""A page as tokens, and what every token stands in.

A page arrives as one row and stays one: `with_elements` adds its tokens as one array, with the elements
around each, and counters, removal and rendering are expressions on that array.  Nothing of it needs an
exchange.  `dealt` spreads whole pages over tasks by a hash of their key, since a table of few large
splits would leave cores idle; `html_tokens` gives one row a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import elements
from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn

PAGE = ["_route", "_row"]
# Optional input column: a hash of the row's place in its file (see `sources.tables`).
ROW_KEY = "_row_key"


def tag_in(tags: list[str]) -> Column:
    names = ", ".join(f"'{t}'" for t in tags)
    return F.expr(f"tag IN ({names})")


def dealt(pages: DataFrame, key: list[str], partitions: int | None = None) -> DataFrame:
    """Whole pages spread by a hash of `key`, numbered by `_row`.

    A fixed number of partitions: tokenising costs far more than the shuffled bytes suggest, so AQE must
    not merge them.  Pass `partitions`, or size `spark.sql.shuffle.partitions` to the corpus.
    """
    spread = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = pages.withColumn("_route", F.xxhash64(*key)).repartition(spread, "_route")
    return routed.withColumn("_row", F.monotonically_increasing_id())


def html_tokens(
    pages: DataFrame,
    html: str = "html",
    key: list[str] | None = None,
    carry: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """One row per token: `pos, tok, kind, tag, head`; page columns ride on the first token.

    `key` names columns that spread the pages.  It need not be unique for right results, only
    for balance; the default is `_row_key` where the input has it, which also spreads many
    copies of one page, else the columns beside the html, else the html.  All of these are
    deterministic, so a recomputed map task sends every page where it went before (a MAP column
    has no hash and is left out).  The
    columns in `carry` are repeated on every token.
    """
    others = [c for c in pages.columns if c not in (html, ROW_KEY)]
    place = [ROW_KEY] if ROW_KEY in pages.columns else []
    hashable = [c for c in others if "map<" not in pages.schema[c].dataType.simpleString()]
    pages = dealt(pages, key or place or hashable or [html], partitions)
    size = F.octet_length(html).cast("bigint").alias("input_size")
    tokens = pages.select(
        *PAGE,
        *carry,
        F.struct(*others, size).alias("_page"),
        F.posexplode_outer(fn.matches(F.col(html), P.TOKEN)).alias("pos", "tok"),
    )
    pos = F.coalesce("pos", F.lit(0))
    return classify(
        tokens.select(*PAGE, *carry, F.when(pos == 0, F.col("_page")).alias("_page"), pos.alias("pos"), "tok")
    )


def tag_of(tok: Column) -> Column:
    """The name of a start or end tag in lower case, else NULL; the first characters decide."""
    second, third = F.substring(tok, 2, 1), F.substring(tok, 3, 1)

    def letter(c: Column) -> Column:
        return c.between("a", "z") | c.between("A", "Z")

    is_tag = (tok.startswith("<") & letter(second)) | (tok.startswith("</") & letter(third))
    return F.when(is_tag, F.lower(F.regexp_extract(tok, P.TAG_NAME, 1)))


def head_of(tok: Column, tag: Column) -> Column:
    """The start tag alone; '' when the page ends inside it, NULL for everything else."""
    whole = tag.isin(P.RAW_ELEMENTS + P.TEXT_ELEMENTS)
    head = F.when(whole, F.regexp_extract(tok, P.OPEN_TAG, 0)).otherwise(F.when(tok.endswith(">"), tok).otherwise(""))
    return F.when(tag.isNotNull() & (F.substring(tok, 2, 1) != "/"), head)


def kind_of(tok: Column, tag: Column, head: Column) -> Column:
    """text, comment, decl, open, close, void, raw (script, style), rawtext (title, ...)."""
    started = head.isNotNull()
    return (
        F.when(tok.isNull() | ~tok.startswith("<") | (tok == "<"), "text")
        .when(head == "", "decl")
        .when(started & tag.isin(P.RAW_ELEMENTS), "raw")
        .when(started & tag.isin(P.TEXT_ELEMENTS), "rawtext")
        .when(started & tag.isin(P.VOID_TAGS), "void")
        .when(started, "open")
        .when(tag.isNotNull(), "close")
        .when(
            tok.startswith("<!--")
            | tok.startswith("<![CDATA[")
            | (tok.startswith("</") & (F.substring(tok, 3, 1) != ">")),
            "comment",
        )
        .otherwise("decl")
    )


def classify(tokens: DataFrame) -> DataFrame:
    tok, tag, head = F.col("tok"), F.col("tag"), F.col("head")
    tokens = tokens.withColumn("tag", tag_of(tok))
    tokens = tokens.withColumn("head", head_of(tok, tag))
    return tokens.withColumn("kind", kind_of(tok, tag, head))


# Start tags whose attributes are read when a page is rendered.
ATTRIBUTED = ["a", "img", "code", "ol"]
#: What the elements around a token tell about it, beside the removing phases: bits of `inside`.
INLINE = {
    "bold": (32, ["b", "strong"]),
    "em": (64, ["em", "i"]),
    "code": (128, ["code"]),
    "pre": (256, ["pre"]),
    "heading": (512, P.HEADINGS),
    "item": (1024, ["li"]),
    "link": (2048, ["a"]),
}


def bits_of(token: Column) -> Column:
    """The flags of a start tag as bits: removing phases, elements that go whole, inline state."""
    tag, style = token["tag"], token["style"]
    started = token["head"] != ""
    bits = [
        (elements.HIDDEN, fn.style_is_hidden(style) | token["bare"]),
        (elements.OFF_SCREEN, fn.style_is_off_screen(style)),
        (elements.SAME_COLOR, fn.style_is_same_color(style)),
        (elements.NOSCRIPT, tag == "noscript"),
        (elements.STRIPPED, tag.isin("script", "style", "meta", "link")),
    ]
    styled = sum((F.when(hit, bit).otherwise(0) for bit, hit in bits[:3]), F.lit(0))
    total = F.when(style.isNotNull() | token["bare"], styled).otherwise(0)
    for bit, hit in bits[3:]:
        total = total + F.when(hit, bit).otherwise(0)
    named = F.lit(0)
    for name, (bit, tags) in INLINE.items():
        hit = tag.isin(tags) & (fn.attribute(token["attrs"], "href") != "") if name == "link" else tag.isin(tags)
        named = F.when(hit, bit).otherwise(named)
    return F.when(started, total + named).otherwise(0)


#: What the replay is told of a token by its first character.
MARKS = {"open": "+", "void": "*", "raw": "=", "rawtext": "=", "close": "-", "comment": "!", "decl": "?"}


def with_elements(pages: DataFrame, html: str = "html", reopens: bool = False) -> DataFrame:
    """`pages` and `_tokens`: an array of `tok, kind, tag, attrs, bits`, and of what `functions.elements` finds:

    `end` (last token of an element), `inside` (bits of the elements around, own ones included), `again`
    (counts of elements opened anew), `nth` and `up` (number among its parent's elements, the parent),
    `place` (the table it moves before, or itself), `last` (1 for the last element of a list item), `run` (number of the stretch between blocks), `heading` (its level), `path`
    (quotes and list items around, and whether another block is in them) and `marks` (inline elements
    around that markdown writes).  Narrow.  NULL html has a NULL array.

    `reopens`: formatting elements that a block's end closes are opened anew after it, as a browser does.
    """

    def each(column: str, step) -> Column:
        return F.transform(F.col(column), step)

    def more(token: Column, **made: Column) -> Column:
        return F.struct(*[token[c].alias(c) for c in kept], *[v.alias(k) for k, v in made.items()])

    # One step an attribute: a lambda evaluates what it mentions as often as it mentions it.
    df = pages.withColumn("_tokens", F.transform(fn.matches(F.col(html), P.TOKEN), lambda t: F.struct(t.alias("tok"), tag_of(t).alias("tag"))))
    kept = ["tok", "tag"]
    df = df.withColumn("_tokens", each("_tokens", lambda t: more(t, head=head_of(t["tok"], t["tag"]))))
    kept = ["tok", "tag", "head"]
    wanted = lambda t: (t["head"] != "") & (t["tag"].isin(ATTRIBUTED) | t["head"].rlike("(?i)style|hidden"))
    df = df.withColumn("_tokens", each("_tokens", lambda t: more(t, kind=kind_of(t["tok"], t["tag"], t["head"]), attrs=F.when(wanted(t), fn.attributes(t["head"])))))
    kept = ["tok", "tag", "head", "kind", "attrs"]
    bare = lambda t: F.coalesce(F.exists(t["attrs"], lambda a: a["name"] == "hidden"), F.lit(False))
    df = df.withColumn("_tokens", each("_tokens", lambda t: more(t, style=fn.attribute(t["attrs"], "style"), bare=bare(t))))
    shown = lambda t: F.when(t["tag"].isin(ATTRIBUTED), t["attrs"])
    df = df.withColumn(
        "_tokens",
        each("_tokens", lambda t: F.struct(t["tok"].alias("tok"), t["tag"].alias("tag"), t["kind"].alias("kind"), shown(t).alias("attrs"), F.coalesce(bits_of(t), F.lit(0)).alias("bits"), t["head"].endswith("/>").alias("whole"))),
    )

    def name(t: Column) -> Column:
        mark = F.lit("")
        for kind, sign in MARKS.items():
            mark = F.when(t["kind"] == kind, sign).otherwise(mark)
        mark = F.when((t["kind"] == "open") & t["whole"], "/").otherwise(mark)
        return F.when(t["kind"] == "text", F.when(t["tok"].rlike(f"[^{P.HTML_WS}]"), "").otherwise(" ")).otherwise(F.concat(mark, F.coalesce(t["tag"], F.lit(""))))

    df = df.withColumn("_replay", (elements.replay_reopening if reopens else elements.replay)(each("_tokens", name), each("_tokens", lambda t: t["bits"])))
    found = [F.col(f"_replay.{n}").alias(n) for n in elements.NUMBERS]
    return df.withColumn("_tokens", F.when(F.col("_tokens").isNotNull(), F.arrays_zip("_tokens", *found))).drop("_replay")


def list_item(token: Column, parent: Column) -> Column:
    """A list item's marker, its list, and whether the list ends the item around it."""
    start = fn.attribute(parent["_tokens"]["attrs"], "start")
    number = F.when(F.coalesce(start, F.lit("")) != "", F.coalesce(start.try_cast("int"), F.lit(1))).otherwise(1) + token["nth"]
    marker = F.when(parent["_tokens"]["tag"] == "ol", F.concat(number.cast("string"), F.lit(".  "))).otherwise("-   ")
    return F.struct(marker.alias("marker"), token["up"].alias("list"), (parent["last"] == 1).alias("tight"))


def token_rows(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = (), reopens: bool = False) -> DataFrame:
    """One row per token with the columns of `with_elements`, beside the columns in `carry`; narrow."""
    cut = with_elements(pages.select(*carry, F.col(html).alias("_html")), "_html", reopens)
    rows = cut.select(*carry, F.posexplode("_tokens").alias("pos", "_t"))
    return rows.select(*carry, "pos", *[F.col(f"_t._tokens.{c}").alias(c) for c in ("tok", "tag", "kind", "attrs", "bits")], *[F.col(f"_t.{n}").alias(n) for n in elements.NUMBERS])
