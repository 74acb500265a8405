"""Pages -> markdown, on the array of a page's tokens.

The tokens that show are grouped into runs (the inline content between two block boundaries), each run is
rendered on its own, and the runs are joined.  All of it is expressions on arrays of one row: no exchange,
no sort, the same plan for batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn
from siltscreen.operators.html_clean import alive, page_counters
from siltscreen.operators.html_tokens import INLINE, ROW_KEY, dealt, list_item, with_elements
from siltscreen.schema import HTML_COUNTERS


def escape(text: Column, starts_block_text: Column) -> Column:
    """Backslash-escape what markdown would read as markup."""
    inline = F.regexp_replace(text, r"([\\*`\[\]_])", r"\\$1")
    leading = F.regexp_replace(inline, r"^(-|\+ |=+|#{1,6} |~~~|>)", r"\\$1")
    leading = F.regexp_replace(leading, r"^([0-9]+)\. ", r"$1\\. ")
    return F.when(starts_block_text, leading).otherwise(inline)


def _inside(token: Column, name: str) -> Column:
    return token["inside"].bitwiseAND(INLINE[name][0]) != 0


def _title(attrs: Column) -> Column:
    title = fn.attribute(attrs, "title")
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("")


def _words(path: Column) -> Column:
    return F.filter(F.split(path, " "), lambda x: x != "")


def shown_tokens(tokens: Column) -> Column:
    """The tokens that rendering needs, in order: `at, pos, run`, state, and `raw` words or the markup of an element."""

    def slim(t: Column, i: Column) -> Column:
        own = t["_tokens"]
        kind, tag = own["kind"], own["tag"]
        opens, before = kind == "open", F.get(tokens, i - 1)["_tokens"]["kind"]
        written = kind.isin("text", "rawtext")
        empty_link = opens & (tag == "a") & (own["bits"].bitwiseAND(INLINE["link"][0]) != 0) & (t["end"] == i + 1)
        role = (
            F.when(written, "words")
            .when(empty_link, "link")
            .when((kind == "void") & (tag == "br"), "break")
            .when((kind == "void") & (tag == "hr"), "rule")
            .when((kind == "void") & (tag == "img"), "image")
            .when(opens & (tag == "code") & _inside(t, "pre"), "fence")
        )
        return F.struct(
            F.when(t["place"] == i, i * 2).otherwise(t["place"] * 2 - 1).alias("at"),
            i.alias("pos"),
            t["run"].alias("run"),
            t["heading"].alias("heading"),
            role.alias("role"),
            F.when(alive(kind, tag, t["inside"]), role).isNotNull().alias("shows"),
            kind.alias("kind"),
            tag.alias("tag"),
            F.when(written, own["tok"]).alias("tok"),
            F.when(role.isin("image", "fence"), own["attrs"]).alias("attrs"),
            t["inside"].alias("inside"),
            t["path"].alias("path"),
            t["marks"].alias("marks"),
            F.coalesce(before != "text", F.lit(True)).alias("starts"),
        )

    return F.filter(F.transform(tokens, slim), lambda t: t["shows"])


def with_words(t: Column) -> Column:
    """The text of a token as it is written, before marks: entities decoded, white space folded but in pre and code."""
    whole = f"(?is)^<[a-z]{P._IN_TAG}>(.*?)(?:</(?:{'|'.join(P.TEXT_ELEMENTS)})[^>]*+>)?$"
    inner = F.when(t["kind"] == "rawtext", F.regexp_extract(t["tok"], whole, 1)).otherwise(t["tok"])
    decoded = (t["kind"] == "text") | t["tag"].isin(P.ENTITY_ELEMENTS)
    return F.when(t["role"] == "words", F.when(decoded, fn.decode_entities(inner)).otherwise(inner))


def fragment(t: Column) -> Column:
    """What a token adds to its run."""
    words, in_code = t["words"], _inside(t, "code")
    # Spaces of inline code stay; they are hidden from the folding of spaces that follows.
    spaced = F.replace(F.regexp_replace(words, "\r\n?|\n", " "), F.lit(" "), F.lit(P.HARD_SPACE))
    coded = F.when(F.trim(words, F.lit(" \t\r\n")) == "", F.lit(" ")).otherwise(spaced)
    plain = F.regexp_replace(words, "[ \t\r\n]+", " ")
    src = fn.attribute(t["attrs"], "src")
    alt = F.coalesce(F.regexp_replace(fn.attribute(t["attrs"], "alt"), r"([\\*`\[\]_])", r"\\$1"), F.lit(""))
    image = F.concat(F.lit("!["), alt, F.lit("]("), F.regexp_replace(src, r"([()])", r"\\$1"), _title(t["attrs"]), F.lit(")"))
    return (
        F.when((t["role"] == "words") & in_code, F.when(_inside(t, "pre"), words).otherwise(coded))
        .when(t["role"] == "words", escape(F.when(_inside(t, "pre"), words).otherwise(plain), t["starts"]))
        .when(t["role"] == "break", F.lit("\n"))
        .when((t["role"] == "image") & (src != ""), image)
        .when(t["role"] == "link", F.lit(""))
    )


def piece(t: Column) -> Column:
    """A token of a run: its text cut from the spaces around it, and the marks it stands in."""
    raw = t["fragment"]
    blank = F.coalesce(F.trim(raw, F.lit(" \n")) == "", F.lit(False))
    in_code = _inside(t, "code") & ~_inside(t, "pre") & ~blank
    coded = F.trim(raw, F.lit(" "))
    # The shortest mark that the code does not hold itself, set apart where the code begins or ends with one.
    used = F.transform(fn.matches(coded, "`+"), F.length)
    free = F.repeat(F.lit("`"), F.element_at(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used), 1))
    hard = F.lit(P.HARD_SPACE)
    apart = coded.startswith("`") | coded.endswith("`") | (coded.startswith(hard) & coded.endswith(hard) & (F.trim(coded, hard) != ""))
    pad = F.when(apart, hard).otherwise("")
    return F.struct(
        t["run"].alias("run"),
        raw.alias("raw"),
        coded.alias("body"),
        raw.startswith(" ").alias("before"),
        raw.endswith(" ").alias("after"),
        _words(t["marks"]).alias("marks"),
        (blank & (raw != "")).alias("blank"),
        F.when(in_code, F.concat(free, pad)).alias("opener"),
        F.when(in_code, F.concat(pad, free)).alias("closer"),
    )


def first_tokens(shown: Column) -> Column:
    """The places among the shown tokens where a run begins."""
    size = F.size(shown)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(shown, i)["run"] != F.get(shown, i - 1)["run"]))


def shared_marks(pieces: Column) -> Column:
    """The marks of each piece of a run; blank pieces have those that both sides share, and none at an edge."""

    def shared(p: Column, i: Column) -> Column:
        beside = lambda k: F.coalesce(F.get(pieces, i + k)["marks"], F.array().cast("array<string>"))
        return F.when(p["blank"], F.array_intersect(beside(-1), beside(1))).otherwise(p["marks"])

    return F.transform(pieces, shared)


def inline_text(pieces: Column, marks: Column, hrefs: Column) -> Column:
    """The pieces of a run with marks around them; marks nest as their elements do, shared ones stay open."""
    none = F.array().cast("array<string>")

    def closing(cur: Column, i: Column) -> Column:
        ends = F.array_except(F.get(marks, i), F.coalesce(F.get(marks, i + 1), none))
        href = lambda m: F.get(hrefs, F.substring_index(F.substr(m, F.lit(2)), ".", 1).cast("int"))
        text = lambda m: (
            F.when(m.startswith("a"), F.concat(F.lit("]("), href(m), F.lit(")")))
            .when(m.startswith("c"), F.coalesce(cur["closer"], F.lit("`")))
            .when(m.startswith("b"), "**")
            .otherwise("_")
        )
        return F.array_join(F.transform(F.reverse(ends), text), "")

    def opening(cur: Column, i: Column) -> Column:
        begins = F.array_except(F.get(marks, i), F.coalesce(F.get(marks, i - 1), none))
        text = lambda m: F.when(m.startswith("a"), "[").when(m.startswith("c"), F.coalesce(cur["opener"], F.lit("`"))).when(m.startswith("b"), "**").otherwise("_")
        return F.array_join(F.transform(begins, text), "")

    def render(cur: Column, i: Column) -> Column:
        gap = F.when(cur["before"] | F.coalesce(F.get(pieces, i - 1)["after"], F.lit(False)), " ").otherwise("")
        return F.concat(gap, opening(cur, i), cur["body"], closing(cur, i))

    inline = F.regexp_replace(F.array_join(F.transform(pieces, render), ""), " *\n *", "\n")
    inline = F.trim(F.regexp_replace(inline, " {2,}", " "), F.lit(" \n"))
    return F.replace(inline, F.lit(P.HARD_SPACE), F.lit(" "))


def run_text(run: Column) -> Column:
    """A run's text with its block's marks: rule, fenced code, preformatted text, heading or paragraph."""
    inline, verbatim, in_pre = run["inline"], run["verbatim"], run["pre"]
    # Longer than any run of marks that begins a line of the code.
    longest = F.array_max(F.transform(fn.matches(verbatim, "(?m)^`{3,}"), F.length))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest + 1, F.lit(3))))
    fenced = F.concat(mark, run["fence"], F.lit("\n"), F.rtrim(verbatim, F.lit("\n")), F.lit("\n"), mark)
    return (
        F.when(run["is_rule"], F.lit("---"))
        .when(in_pre & run["fence"].isNotNull(), fenced)
        .when(in_pre, F.regexp_replace(verbatim, "^\n+|\n+$", ""))
        .when(inline == "", "")
        .when(run["heading"] > 0, F.concat(F.repeat(F.lit("#"), run["heading"]), F.lit(" "), F.replace(inline, F.lit("\n"), F.lit(" "))))
        .otherwise(F.replace(inline, F.lit("\n"), F.lit("  \n")))
    )


def html_to_markdown(pages: DataFrame, html: str = "html", key: list[str] | None = None, reopens: bool = False) -> DataFrame:
    """One row per page: its other columns, `input_size`, the eight counters and `content`.

    A run stands in boxes, quotes and list items, in their order.  A line begins with what its boxes say: "> "
    for a quote, an item's marker on its first line and as many spaces after that.  Between two runs stand
    line ends in the boxes that both are in: one between the items of a list, two where an item ends in a
    block, one before a list that ends its item, else two.

    Pages are spread over tasks by `key`, by default the row's place in its file where the input has it.
    """
    others = [c for c in pages.columns if c not in (html, ROW_KEY)]
    place = [ROW_KEY] if ROW_KEY in pages.columns else []
    hashable = [c for c in others if "map<" not in pages.schema[c].dataType.simpleString()]
    size = F.octet_length("_html").cast("bigint").alias("input_size")
    spread = dealt(pages, key or place or hashable or [html])
    df = with_elements(spread.select(F.struct(*others, F.lit(0).alias("_none")).alias("_page"), F.col(html).alias("_html")), "_html", reopens)
    df = df.select("_page", size, "_tokens", page_counters().alias("_counters"))

    # One column a step: a lambda evaluates what it mentions as often as it mentions it.
    tokens = F.col("_tokens")
    is_link = lambda t: (t["_tokens"]["tag"] == "a") & (t["_tokens"]["bits"].bitwiseAND(INLINE["link"][0]) != 0)
    href = lambda t: F.concat(F.regexp_replace(fn.attribute(t["_tokens"]["attrs"], "href"), r"([()])", r"\\$1"), _title(t["_tokens"]["attrs"]))
    is_item = lambda t: (t["_tokens"]["tag"] == "li") & (t["_tokens"]["kind"] == "open")
    listed = lambda t: F.when(is_item(t), list_item(t, F.get(tokens, t["up"])))
    made = {
        "_hrefs": F.transform(tokens, lambda t: F.when(is_link(t), href(t))),
        "_items": F.transform(tokens, listed),
        "_shown": shown_tokens(tokens),
    }
    # Out of a one-element `inline`: what a lambda looks up must be a column, not be worked out anew each time.
    df = df.select("_page", "input_size", "_counters", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    grown = lambda t, **more: F.struct(*[t[c].alias(c) for c in kept], *[v.alias(k) for k, v in more.items()])
    shown, kept = F.col("_shown"), ["at", "pos", "run", "heading", "role", "kind", "tag", "attrs", "inside", "path", "marks", "starts"]
    df = df.withColumn("_shown", F.transform(shown, lambda t: grown(t, words=with_words(t))))
    kept = ["at", "pos", "run", "heading", "role", "attrs", "inside", "path", "marks"]
    df = df.withColumn("_shown", F.transform(shown, lambda t: grown(t, fragment=fragment(t))))
    kept = ["at", "pos", "run", "heading", "role", "inside", "path"]
    language = lambda t: F.when(t["role"] == "fence", F.regexp_extract(F.coalesce(fn.attribute(t["attrs"], "class"), F.lit("")), r"language-(\S+)", 1))
    df = df.withColumn("_shown", F.transform(shown, lambda t: grown(t, fence=language(t), piece=F.when(t["fragment"].isNotNull(), piece(t)))))
    # Only text that left a table is out of order.
    moved = F.exists(shown, lambda t: t["at"] % 2 != 0)
    df = df.withColumn("_shown", F.when(moved, F.array_sort(shown)).otherwise(shown))
    df = df.select("_page", "input_size", "_counters", "_hrefs", "_items", F.inline(F.array(F.struct(shown.alias("_shown"), first_tokens(shown).alias("_firsts")))))
    cut = lambda first, k: F.slice(shown, first + 1, F.coalesce(F.get("_firsts", k + 1), F.size(shown)) - first)
    df = df.withColumn("_runs", F.transform("_firsts", cut)).drop("_shown", "_firsts")

    def joint(run: Column) -> Column:
        leaf = lambda t: t["piece"].isNotNull() | (t["role"] == "rule")
        leaves = F.filter(run, leaf)
        most = lambda field: F.array_max(F.transform(leaves, field))
        return F.struct(
            F.filter(F.transform(run, lambda t: t["piece"]), lambda p: p.isNotNull()).alias("pieces"),
            most(lambda t: t["path"]).alias("path"),
            most(lambda t: t["heading"]).alias("heading"),
            F.exists(leaves, lambda t: t["piece"].isNotNull() & _inside(t, "pre")).alias("pre"),
            F.exists(run, lambda t: t["role"] == "rule").alias("is_rule"),
            F.array_max(F.transform(run, lambda t: t["fence"])).alias("fence"),
        )

    df = df.withColumn("_runs", F.transform("_runs", joint))
    kept = ["pieces", "path", "heading", "pre", "is_rule", "fence"]
    df = df.withColumn("_runs", F.transform("_runs", lambda r: grown(r, marks=shared_marks(r["pieces"]))))

    def texts(run: Column) -> Column:
        plain = F.array_join(F.transform(run["pieces"], lambda p: p["raw"]), "")
        return F.struct(
            *[run[c].alias(c) for c in ("path", "heading", "pre", "is_rule", "fence")],
            F.when(~run["pre"], inline_text(run["pieces"], run["marks"], F.col("_hrefs"))).alias("inline"),
            F.when(run["pre"], plain).alias("verbatim"),
        )

    df = df.withColumn("_runs", F.transform("_runs", texts))
    written = F.transform("_runs", lambda r: F.struct(run_text(r).alias("text"), _words(r["path"]).alias("path"), r["is_rule"].alias("is_rule")))
    folded = df.withColumn("_runs", F.filter(written, lambda r: r["text"] != ""))

    def box(name: Column) -> Column:
        item = F.when(name.startswith("l"), F.get("_items", F.substr(name, F.lit(2)).cast("int")))
        marker = F.when(name.startswith("l"), F.coalesce(item["marker"], F.lit("-   "))).otherwise("> ")
        rest = F.when(name.startswith("l"), F.repeat(F.lit(" "), F.length(marker))).otherwise("> ")
        return F.struct(name.alias("id"), marker.alias("begin"), rest.alias("rest"), item["list"].alias("list"), F.coalesce(item["tight"], F.lit(False)).alias("tight"))

    def boxed(run: Column) -> Column:
        block = F.array_contains(F.slice(run["path"], -1, 1), "p")
        names = F.filter(run["path"], lambda x: x != "p")
        return F.struct(run["text"].alias("text"), F.transform(names, box).alias("boxes"), (block | run["is_rule"]).alias("block"))

    folded = folded.select("_page", "input_size", "_counters", F.inline(F.array(F.struct(F.transform("_runs", boxed).alias("_runs")))))
    all_runs = F.col("_runs")
    ids = lambda run: F.transform(run["boxes"], lambda b: b["id"])
    joined = lambda boxes, field: F.array_join(F.transform(boxes, lambda b: b[field]), "")
    upto = lambda boxes, n: F.slice(boxes, F.lit(1), n)
    beyond = lambda boxes, n: F.slice(boxes, n + 1, F.greatest(F.size(boxes) - n, F.lit(0)))

    def tail(run: Column, n: Column) -> Column:
        """What follows a run's text up to the end of its boxes beyond the n-th: a blank line for each item that ends in a block."""
        boxes, size = run["boxes"], F.size(run["boxes"])

        def blank(j: Column) -> Column:
            inner, own = F.get(boxes, j), F.get(boxes, j - 1)
            ends_in_block = F.when(j == size, run["block"]).when(inner["list"].isNotNull(), ~inner["tight"]).otherwise(True)
            rest = joined(F.slice(boxes, n + 1, j - n), "rest")
            return F.when(own["list"].isNotNull() & ends_in_block, F.concat(F.lit("\n"), rest)).otherwise("")

        levels = F.when(size > n, F.sequence(size, n + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(levels, blank), "")

    def line(run: Column, i: Column) -> Column:
        prev = F.get(all_runs, i - 1)
        both = F.coalesce(F.size(F.array_intersect(ids(run), ids(prev))), F.lit(0))
        a, b = F.get(prev["boxes"], both), F.get(run["boxes"], both)
        siblings = F.coalesce(a["list"] == b["list"], F.lit(False))
        after = F.when(a.isNull(), F.when(prev["block"], 2).otherwise(0)).when(a["list"].isNotNull(), F.when(a["tight"], 0).otherwise(2)).otherwise(2)
        before = F.when(b.isNull(), F.when(run["block"], 2).otherwise(0)).when(b["list"].isNotNull(), F.when(b["tight"], 1).otherwise(2)).otherwise(2)
        ends = F.greatest(after, before)
        ends = F.when(siblings, 1).when(ends == 0, F.when(a.isNull(), 2).otherwise(1)).otherwise(ends)
        shared = upto(run["boxes"], both)
        gap = F.replace(F.concat(tail(prev, both), F.repeat(F.lit("\n"), ends)), F.lit("\n"), F.concat(F.lit("\n"), joined(shared, "rest")))
        begin = joined(beyond(run["boxes"], both), "begin")
        hanging = F.concat(F.lit("\n"), joined(run["boxes"], "rest"))
        return F.concat(F.when(i == 0, "").otherwise(gap), begin, F.replace(run["text"], F.lit("\n"), hanging))

    content = F.when(F.col("input_size").isNotNull(), F.array_join(F.transform(all_runs, line), ""))
    return folded.select(*[F.col("_page").getField(c).alias(c) for c in others], "input_size", "_counters.*", content.alias("content"))
