"""Regular expressions, word lists and lookup tables (fixed values).

Patterns are written for ``java.util.regex``.  Loops over groups are possessive:
the greedy form recurses once per repetition and overflows the stack on long runs.
"""

import html.entities
import string

# Whitespace as the source dialect defines ``\s`` (wider than Java's ASCII ``\s``).
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Whitespace inside HTML markup.
HTML_WS = r" \t\n\f\r"



def _singles(chars: str) -> str:
    """A class listing single characters: Java turns it into one bit set, ranges into a chain.

    Over 25 MB of documents on one core the scan for 40 base64 characters takes 1.2 s this way, 2.0 s with ranges.
    """
    return "[" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]"


_LATIN1 = [chr(c) for c in range(256)]
# --- invisible characters ------------------------------------------------------
_ZERO_WIDTH = r"\x{200B}-\x{200F}\x{2060}\x{2063}\x{FEFF}\x{AD}"
_CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F"
_BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
_TAGS = r"\x{E0001}-\x{E007F}"
_VARIATION = r"\x{FE00}-\x{FE0F}"

INVISIBLE = {
    "zero_width_chars": f"[{_ZERO_WIDTH}]",
    "control_chars": f"[{_CONTROL}]",
    "bidi_overrides": f"[{_BIDI}]",
    "unicode_tags": f"[{_TAGS}]",
    "variation_selectors": f"[{_VARIATION}]",
}
# The class before "&&" is a cheap test that ordinary Latin text fails at once.
_VISIBLE = "".join(c for c in _LATIN1 if c in "\t\n\r" or (c >= " " and c != "\xad"))
ANY_INVISIBLE = (
    f"[[^{_singles(_VISIBLE)}]&&[{_ZERO_WIDTH}{_CONTROL}{_BIDI}{_TAGS}{_VARIATION}]]"
)

# Characters that NFKC leaves alone wherever they stand: each one is its own NFKC form,
# has combining class 0 and never composes with the character before it.
NFKC_STABLE_RANGES = [
    (0x0000, 0x009F),
    (0x00A1, 0x00A7),
    (0x00A9, 0x00A9),
    (0x00AB, 0x00AE),
    (0x00B0, 0x00B1),
    (0x00B6, 0x00B7),
    (0x00BB, 0x00BB),
    (0x00BF, 0x0131),
    (0x0134, 0x013E),
    (0x0141, 0x0148),
    (0x014A, 0x017E),
    (0x0391, 0x03A1),
    (0x03A3, 0x03CE),
    (0x0400, 0x0482),
    (0x048A, 0x052F),
    (0x05D0, 0x05EA),
    (0x0621, 0x064A),
    (0x2010, 0x2010),
    (0x2012, 0x2016),
    (0x2018, 0x2023),
    (0x3001, 0x3029),
    (0x3041, 0x3096),
    (0x30A1, 0x30FE),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3),
]
# Tested in three stages, so that ASCII and accented Latin letters are rejected early.
_STABLE_LATIN1 = "".join(
    c for c in _LATIN1 if any(a <= ord(c) <= b for a, b in NFKC_STABLE_RANGES)
)
NOT_NFKC_STABLE = (
    f"[[^{_singles(_STABLE_LATIN1)}]&&[^\\x{{100}}-\\x{{131}}]&&[^"
    + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in NFKC_STABLE_RANGES)
    + "]]"
)

# --- encoded payloads ----------------------------------------------------------
ENCODED_REPLACEMENT = "[encoded-removed]"
DATA_URI_REPLACEMENT = "[data-uri-removed]"
DATA_URI = r"(?i)data:text/[^;]*+;base64,[a-z0-9+/=]++"
_BASE64_CHARS = string.ascii_letters + string.digits + "+/"
_BASE64, _NOT_BASE64 = _singles(_BASE64_CHARS), "[^" + _singles(_BASE64_CHARS)[1:]
BASE64_RUN = f"(?<!{_BASE64}){_BASE64}{{40,}}+={{0,2}}+"
# The same test in one pass over the text: shorter runs are skipped whole (0.7 s for those 25 MB).
BASE64_GATE = f"^(?:{_BASE64}{{0,39}}+{_NOT_BASE64}++)*+{_BASE64}{{40}}"
_HEX_PAIR = _singles(string.hexdigits) + "{2}[" + WS + r",;]?+"
# A look at the first character spares most places the begin of a loop.
HEX_RUN = "(?=" + _singles(string.hexdigits + "\\") + r")(?:0[xX]|\\[xX])?(?:" + _HEX_PAIR + "){20,}+"
# The prefix is optional, so a text without twenty pairs in a row has no hex run.
HEX_GATE = _HEX_PAIR + "(?:" + _HEX_PAIR + "){19}"

_ANY_UNIT = r"[\x{0}-\x{FFFF}&&[^\n\r\x{2028}\x{2029}]]"
# Words that make decoded text look like an instruction; each must start a word.
INSTRUCTION_WORDS = [
    "ignore",
    "forget",
    "disregard",
    "override",
    "you are now",
    "new instruction",
    "system prompt",
    "execute",
    f"eval[{WS}]*+\\(",
    f"import[{WS}]*+\\(",
    f"require[{WS}]*+\\(",
    f"api{_ANY_UNIT}?key",
    "password",
    "secret",
    f"curl[{WS}]",
    f"wget[{WS}]",
    f"rm[{WS}]++-",
    f"sudo[{WS}]",
]
# First letters as one bit set: most places are passed by without trying a word.
_FIRST = _singles("".join(sorted({c for w in INSTRUCTION_WORDS for c in w[0].lower() + w[0].upper()})))
INSTRUCTION = f"(?={_FIRST})(?i)(?<![a-z0-9_])(?:" + "|".join(INSTRUCTION_WORDS) + ")"

# --- exfiltration links --------------------------------------------------------
MD_IMAGE = r"!\[([^\]]*+)\]\(([^)]++)\)"
EXFIL_PARAMS = ["exfil", "data", "payload", "stolen", "leak", "extract", "dump"]
EXFIL_MAX_VALUE = 100
EXFIL_MAX_URL = 500
EXFIL_VALUE = r"^[A-Za-z0-9+/]{20,}+={0,2}\z"

# --- delimiters, removed one after the other -----------------------------------
DELIMITERS = [
    r"(?i)<\|im_start\|>",
    r"(?i)<\|im_end\|>",
    r"(?i)<\|system\|>",
    r"(?i)<\|user\|>",
    r"(?i)<\|assistant\|>",
    r"(?i)<\|endoftext\|>",
    r"(?i)<\|pad\|>",
    r"(?i)\\?\[INST\\?\]",
    r"(?i)\\?\[\\?/INST\\?\]",
    r"(?i)<<SYS>>",
    r"(?i)<<\\?/SYS>>",
    r"\n\nHuman:",
    r"\n\nAssistant:",
]
# True for every text that holds at least one of them.
ANY_DELIMITER = (
    r"[<\[\n](?:"
    r"\|(?i:im_start|im_end|system|user|assistant|endoftext|pad)\|>"
    r"|\\?/?(?i:INST)\\?\]"
    r"|<\\?/?(?i:SYS)>>"
    r"|\n(?:Human|Assistant):)"
)

# --- routing -------------------------------------------------------------------
HTML_EXTENSIONS = [".html", ".htm", ".xhtml", ".svg"]
HTML_CONTENT = f"(?i)^[{WS}]*+<(?:!DOCTYPE|html)(?![A-Za-z0-9_])"
MAX_FILE_BYTES = 50 * 1024 * 1024
BINARY_SAMPLE_CHARS = 8192

# --- inline styles -------------------------------------------------------------
HIDDEN_STYLES = [
    "display:none",
    "display: none",
    "visibility:hidden",
    "visibility: hidden",
    "opacity:0",
    "opacity: 0",
]
# Each entry lists substrings that must all occur.
OFF_SCREEN_STYLES = [
    ("text-indent", "-999"),
    ("position:absolute", "left:-"),
    ("position: absolute", "left: -"),
    ("position:absolute", "top:-"),
    ("position: absolute", "top: -"),
    ("position:fixed", "left:-"),
    ("position: fixed", "left: -"),
    ("position:fixed", "top:-"),
    ("position: fixed", "top: -"),
    ("clip:rect(0",),
    ("clip: rect(0",),
    ("clip-path:inset(100",),
    ("clip-path: inset(100",),
    ("font-size:0",),
    ("font-size: 0",),
]
NAMED_COLORS = {
    "white": "#ffffff",
    "black": "#000000",
    "red": "#ff0000",
    "green": "#008000",
    "blue": "#0000ff",
    "yellow": "#ffff00",
    "cyan": "#00ffff",
    "magenta": "#ff00ff",
    "gray": "#808080",
    "grey": "#808080",
    "silver": "#c0c0c0",
    "maroon": "#800000",
    "olive": "#808000",
    "lime": "#00ff00",
    "aqua": "#00ffff",
    "teal": "#008080",
    "navy": "#000080",
    "fuchsia": "#ff00ff",
    "purple": "#800080",
    "orange": "#ffa500",
}
FOREGROUND = f"(?i)(?:^|;)[{WS}]*color[{WS}]*:[{WS}]*([^;!]+)"
BACKGROUND = f"(?i)(?:^|;)[{WS}]*background(?:-color)?[{WS}]*:[{WS}]*([^;!]+)"
RGB = f"^rgba?\\([{WS}]*([0-9]+)[{WS}]*,[{WS}]*([0-9]+)[{WS}]*,[{WS}]*([0-9]+)"

# --- HTML markup ---------------------------------------------------------------
# Inside a tag: quoted values are atomic, so they may hold ">".
_IN_TAG = (
    f'(?:=[{HTML_WS}]*+"[^"]*+(?:"|\\z)|=[{HTML_WS}]*+\'[^\']*+(?:\'|\\z)|[^>=]++|=)*+'
)
RAW_ELEMENTS = ["script", "style"]
TEXT_ELEMENTS = ["title", "textarea", "xmp", "iframe", "noembed", "noframes"]
# Those of them whose text has character references.
ENTITY_ELEMENTS = ["title", "textarea"]


def _whole_element(tag: str) -> str:
    return f"<{tag}(?:[{HTML_WS}/]{_IN_TAG})?>.*?(?:</{tag}(?:[{HTML_WS}][^>]*+)?>|\\z)"


TOKEN = (
    r"(?is)[^<]++"
    r"|<!--(?:-?>|.*?(?:-->|\z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\z)"
    + "".join("|" + _whole_element(t) for t in RAW_ELEMENTS + TEXT_ELEMENTS)
    + f"|</?[a-z]{_IN_TAG}>?"
    + r"|</[^a-z>][^>]*+>?"
    + r"|<[!?/][^>]*+>?"
    + r"|<"
)
TAG_NAME = f"^</?([A-Za-z][^{HTML_WS}/>]*+)"
OPEN_TAG = f"(?is)^<[a-z]{_IN_TAG}>"
ATTRIBUTE = (
    f"(?s)[^{HTML_WS}/>=][^{HTML_WS}/>=]*+"
    f"(?:[{HTML_WS}]*+=[{HTML_WS}]*+(?:\"[^\"]*+\"?|'[^']*+'?|[^{HTML_WS}>\"'][^{HTML_WS}>]*+))?+"
)
# In text the oldest names also count without their semicolon; in attributes they do not.
ENTITY_NAMES_WITHOUT_SEMICOLON = sorted(
    (n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)
)
ENTITY = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;)"
OLD_ENTITY = "(?:" + "|".join(ENTITY_NAMES_WITHOUT_SEMICOLON) + ")"
TEXT_ENTITY = ENTITY[:-1] + "|" + OLD_ENTITY + ")"
ATTRIBUTE_ENTITY = ENTITY[:-1] + "|" + OLD_ENTITY + "(?![A-Za-z0-9=]))"

# Inside these a start tag that ends with "/>" is a whole element.
FOREIGN_TAGS = ["svg", "math"]
# Stands for a space of inline code while a run is put together; no character of any text.
HARD_SPACE = "\ufdd0"
VOID_TAGS = [
    "area", "base", "basefont", "br", "col", "command", "embed", "frame", "hr", "img",
    "input", "isindex", "keygen", "link", "meta", "param", "source", "track", "wbr",
]
BLOCK_TAGS = [
    "address", "article", "aside", "audio", "blockquote", "body", "canvas", "center",
    "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "isindex", "li", "main", "menu", "nav", "noframes", "noscript", "ol", "output", "p",
    "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Start tags that end an open paragraph.
CLOSES_P = [
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "listing",
    "main", "menu", "nav", "ol", "p", "plaintext", "pre", "search", "section", "summary", "table", "ul", "xmp",
]
# Elements that end tags of other elements do not reach across.
SCOPE_TAGS = ["applet", "caption", "html", "marquee", "object", "table", "td", "template", "th"]
# Elements whose begin and end set formatting apart.
MARKER_TAGS = ["applet", "caption", "marquee", "object", "td", "template", "th"]
FORMATTING_TAGS = ["a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"]
SPECIAL_TAGS = [
    "address", "applet", "area", "article", "aside", "base", "basefont", "bgsound", "blockquote", "body", "br", "button",
    "caption", "center", "col", "colgroup", "dd", "details", "dir", "div", "dl", "dt", "embed", "fieldset", "figcaption",
    "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "iframe", "img", "input", "keygen", "li", "link", "listing", "main", "marquee", "menu", "meta", "nav", "noembed",
    "noframes", "noscript", "object", "ol", "p", "param", "plaintext", "pre", "script", "search", "section", "select",
    "source", "style", "summary", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr",
    "track", "ul", "wbr", "xmp",
]
# Parts of a table, and what each may stand in.
TABLE_PARENTS = {
    "caption": ["table"],
    "colgroup": ["table"],
    "col": ["colgroup", "table"],
    "thead": ["table"],
    "tbody": ["table"],
    "tfoot": ["table"],
    "tr": ["thead", "tbody", "tfoot", "table"],
    "td": ["tr", "thead", "tbody", "tfoot", "table"],
    "th": ["tr", "thead", "tbody", "tfoot", "table"],
}
# Elements whose end tag may be left out: family -> (members, start tags that end them,
# open children that the same start tags end as well).
OPTIONAL_END = {
    "p": (
        ["p"],
        [
            "p", "h1", "h2", "h3", "h4", "h5", "h6", "address", "article", "aside",
            "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "section",
            "table", "ul",
        ],
        [],
    ),
    "li": (["li"], ["li"], []),
    "dl": (["dt", "dd"], ["dt", "dd"], []),
    "cell": (["td", "th"], ["td", "th", "tr", "tbody", "thead", "tfoot"], []),
    "row": (["tr"], ["tr", "tbody", "thead", "tfoot"], ["td", "th"]),
    "part": (["thead", "tbody", "tfoot"], ["thead", "tbody", "tfoot"], ["tr", "td", "th"]),
    "option": (["option"], ["option", "optgroup"], []),
    "optgroup": (["optgroup"], ["optgroup"], ["option"]),
}
