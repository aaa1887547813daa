"""Regular expressions written once, compiled to two dialects.

The texts are full of accented letters, so Python-style Unicode classes matter
("éè" is a word, not a symbol line).  Patterns here spell the classes out
explicitly so that Java (Spark) and RE2 (the DuckDB oracle) read them alike:

* ``S``  -- whitespace as ``str.isspace`` sees it: tab..CR, 0x1C-0x1F, NEL, all of Z*
* ``W``  -- word characters: letters, numbers, underscore
* ``D``  -- decimal digits

Only the flag prefix differs between dialects: Java gets ``(?d)`` so that ``.``,
``^`` and ``$`` treat only ``\\n`` as a line end (RE2 already does), and ``u`` with
``i`` for Unicode case folding (RE2 folds Unicode by default).
"""

from __future__ import annotations

from dataclasses import dataclass

S_CLASS = r"\t-\r\x1c-\x1f\x85\p{Z}"
S = f"[{S_CLASS}]"
W_CLASS = r"\p{L}\p{N}_"
W = f"[{W_CLASS}]"
D = r"\p{Nd}"
NOT_W_OR_S = f"[^{W_CLASS}{S_CLASS}]"


@dataclass(frozen=True)
class Rx:
    """A portable pattern plus flags drawn from ``s`` (dotall), ``i``, ``m``."""

    body: str
    flags: str = ""

    @property
    def java(self) -> str:
        # Unicode case folding costs a table lookup per character; it only changes
        # results for letters with non-ASCII case partners (i, k, s).
        unicode_case = "i" in self.flags and any(ch in self.body for ch in "iksIKS")
        f = "d" + self.flags + ("u" if unicode_case else "")
        return f"(?{f}){self.body}"

    @property
    def re2(self) -> str:
        return f"(?{self.flags}){self.body}" if self.flags else self.body


# ---------------------------------------------------------------------------
# Shared pieces of the cleaning chains
# ---------------------------------------------------------------------------
ANY_TAG = Rx(r"<[^>]+>")
THREE_NEWLINES = Rx(rf"\n{S}*\n{S}*\n")
TWO_NEWLINES = Rx(rf"\n{S}*\n")
SPACE_RUN = Rx(r"[ \t]+")
SYMBOL_LINE = Rx(rf"^{S}*{NOT_W_OR_S}*{S}*$", "m")
# The characters str.isspace() accepts (equal to the S class), for trim()
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
                    + "\u2028\u2029\u202f\u205f\u3000")

# iXBRL clean
IX_OPEN = Rx(r"<ix:[^>]*>")
IX_CLOSE = Rx(r"</ix:[^>]*>")
STYLE_BLOCK = Rx(r"<style[^>]*>.*?</style>", "s")
STYLE_ATTR = Rx(r'style="[^"]*"')
BR_TAG = Rx(rf"<br{S}*/?>")
P_OPEN = Rx(r"<p[^>]*>")
P_CLOSE = Rx(r"</p>")
DIV_OPEN = Rx(r"<div[^>]*>")
DIV_CLOSE = Rx(r"</div>")

# Section clean
CLASS_ATTR = Rx(r'class="[^"]*"')
ID_ATTR = Rx(r'id="[^"]*"')
BR_TAG_I = Rx(rf"<br{S}*/?>", "i")
P_TAG_I = Rx(r"</?p[^>]*>", "i")
DIV_TAG_I = Rx(r"</?div[^>]*>", "i")
SPAN_TAG_I = Rx(r"</?span[^>]*>", "i")
SCRIPT_BLOCK_I = Rx(r"<script[^>]*>.*?</script>", "si")
JS_VAR = Rx(rf"var{S}+{W}+{S}*=.*?;", "s")
JS_FUNCTION = Rx(rf"function{S}+{W}+.*?}}", "s")
COMMENT = Rx(r"<!--.*?-->", "s")
# compat=False forms of the two script patterns: a statement on one line, a function
# header with a brace body holding no further braces (neither can run into prose)
JS_VAR_SAFE = Rx(rf"var{S}+{W}+{S}*=[^;\n]*;")
JS_FUNCTION_SAFE = Rx(rf"function{S}+{W}+{S}*\([^)\n]*\){S}*\{{[^{{}}]*\}}")
NEWLINE_SPACE = Rx(r"\n ")
# Line filter of T11
# digits-only, long technical id or long hex line: whole-line tests as one pass
TECHNICAL_LINE = Rx(rf"^(?:{D}+|[A-Z0-9\-_]{{20,}}|[a-f0-9]{{32,}})$")

# Regex fallback of the DOM clean
XMLNS_ATTR = Rx(r'xmlns:[^=]*="[^"]*"')

# Sections (T5-T7)
DOCUMENT_BLOCK = Rx(r"<DOCUMENT>.*?</DOCUMENT>", "si")
TYPE_VALUE = Rx(r"<TYPE>([^<\n]+)", "i")
TEXT_BODY = Rx(r"<TEXT>(.*?)</TEXT>", "si")

# SGML parse
HEADER_BLOCK = Rx(r"<SEC-HEADER>(.*?)</SEC-HEADER>", "s")
FIRST_DOCUMENT_BODY = Rx(r"<DOCUMENT>(.*?)</DOCUMENT>", "s")

# Header fields by regex (T2) and from the file name
COMPANY_FIELD = Rx(rf"COMPANY CONFORMED NAME:{S}*(.+)")
ACCESSION_FIELD = Rx(rf"ACCESSION NUMBER:{S}*({D}{{10}}-{D}{{2}}-{D}{{6}})")
FILED_FIELD = Rx(rf"FILED AS OF DATE:{S}*({D}{{8}})")
TYPE_FIELD = Rx(rf"CONFORMED SUBMISSION TYPE:{S}*(.+)")
ACCESSION_IN_NAME = Rx(rf"({D}{{10}}-{D}{{2}}-{D}{{6}})")
DATE_IN_NAME = Rx(rf"({D}{{4}}-{D}{{2}}-{D}{{2}})")

# Truncated-report flag
EXHIBIT_MARKERS = Rx(r"Part IV|Item 15|Exhibit|SIGNATURES", "i")
MAIN_MARKERS = Rx(rf"Item 1\.{S}*Business|Item 1A\.{S}*Risk|Item 2\.{S}*Properties", "i")

# Chapter titles
PART_OR_ITEM = Rx(rf"^(Part [IVX]+|Item {D}+[A-Z]?\.)", "i")
ITEM_TITLE = Rx(rf"^Item {D}+[A-Z]?\.[^0-9]", "i")
TWO_CAPITALISED = Rx(r"^[A-Z][a-z]+ [A-Z][a-z]+")
PART_NUMBER = Rx(r"^Part ([IVX]+)", "i")
ITEM_NUMBER = Rx(rf"^Item ({D}+[A-Z]?)\.", "i")
# PART_OR_ITEM, ITEM_TITLE (implied by PART_OR_ITEM) and TWO_CAPITALISED as one pass
CHAPTER_TITLE_JAVA = rf"(?d)^(?:(?iu:Part [IVX]+|Item {D}+[A-Z]?\.)|[A-Z][a-z]+ [A-Z][a-z]+)"
CHAPTER_TITLE_RE2 = rf"^(?:(?i:Part [IVX]+|Item {D}+[A-Z]?\.)|[A-Z][a-z]+ [A-Z][a-z]+)"

# HTML to text (T12), index pages (S4): markup that is not text
# All non-text markup in one leftmost-first pass, as a tokenizer meets it: "<b<!x>" is one tag; a start tag needs a letter
# after "<", a quoted attribute value may hold ">", while any "</...>" goes (end tag or bogus comment).  A script, style or
# comment that is never closed runs to the end, so no "<" is searched from twice.  Java takes the inside of a tag possessively:
# a loop instead of a recursion, whatever the number of attributes; RE2 has no such form and needs none.
_INSIDE = rf"""(?:[^>=]+|={S}*"[^"]*"|={S}*'[^']*'|=)*"""
_INSIDE_JAVA = rf"""(?:[^>=]++|={S}*+"[^"]*+"|={S}*+'[^']*+'|=)*+"""


def _markup(inside: str, end: str, name: str) -> str:
    # group 1 is what stands behind "<" of a tag: its name, with "/" before it for an end tag
    raw = "|".join(rf"(?i:{n}(?:{S}{inside})?>(?s:.*?)(?:</{n}{S}*>|{end}))" for n in ("script", "style"))
    return rf"<(?:{raw}|!--(?s:.*?)(?:-->|{end})|[!?][^>]*>|({name}){inside}>|/[^>]*>)"


_NAME = f"/?[A-Za-z][^{S_CLASS}/>=]*"
HTML_MARKUP = Rx(_markup(_INSIDE, r"\z", _NAME))
HTML_MARKUP_JAVA = "(?d)" + _markup(_INSIDE_JAVA, r"\z", _NAME + "+")
# attributes of a tag in order: name, and what stands behind "="
ATTRIBUTE_JAVA = rf"""(?s)(?<=[{S_CLASS}/"'])([^{S_CLASS}/>=][^{S_CLASS}/=>]*+)(?:{S}*+=+{S}*+("[^"]*+"|'[^']*+'|(?!["'])[^>{S_CLASS}]*+))?"""
# str.splitlines() boundaries, plus the double-space phrase split
LINE_OR_PHRASE_BREAK = Rx(r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]|  ")
# Regex fallback of T12
WS_RUN = Rx(rf"{S}+")
NOT_WHITELISTED = Rx(rf"[^{W_CLASS}{S_CLASS}.,;:!?\-()\[\]{{}}\"'/\\]")

# Upper-case test of a whole line (str.isupper)
# str.isupper(): some upper-case letter and no lower/title-case one (one pass)
ALL_UPPER = Rx(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$", "s")

# Format markers (P10), matched as plain substrings
# --- fixed values that must equal the reference -------------------------------
IXBRL_MARKERS = ["ix:nonNumeric", "ix:numeric", "ix:hidden", "xmlns:ix=", "ix:format", "ix:contextRef"]
SGML_MARKERS = ["<SEC-DOCUMENT>", "<SEC-HEADER>", "<ACCEPTANCE-DATETIME>", "ACCESSION NUMBER:"]
# Section types dropped before cleaning (P14), compared upper-cased
EXCLUDED_TYPES = ["XML", "GRAPHIC", "EXCEL", "JSON", "ZIP",
                  "EX-101.SCH", "EX-101.CAL", "EX-101.DEF", "EX-101.LAB", "EX-101.PRE"]
# Section types ranked as main content (P15); the order is not a sort key
MAIN_TYPES = ["10-K", "10-Q", "8-K", "EX-21.1", "EX-23.1", "EX-31.1", "EX-31.2", "EX-32.1", "EX-32.2"]
# Lines the chapter-title mark-up (T16) always treats as titles
LISTED_TITLES = [
    "Overview", "Competition", "Risk Management", "Regulation",
    "Corporate Responsibility", "Human Capital Resources",
    "Intellectual Property", "Available Information",
    "Information about our Executive Officers", "Executive Summary",
    "Key Operating Measures", "Macroeconomic, Industry and Regulatory Trends",
    "Non-GAAP Financial Measures", "Consolidated Results of Operations",
    "Segment Results of Operations", "Investments", "Policy and Contract Liabilities",
    "Liquidity and Capital Resources", "Impact of Recent Accounting Pronouncements",
    "Critical Accounting Estimates", "Reference to Financial Statements and Schedules",
    "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure",
    "Controls and Procedures", "Other Information",
    "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "Directors, Executive Officers and Corporate Governance", "Executive Compensation",
    "Security Ownership of Certain Beneficial Owners and Management and Related Shareholder Matters",
    "Certain Relationships and Related Transactions, and Director Independence",
    "Principal Accountant Fees and Services",
]
# Line prefixes the section clean (T11) drops
DROPPED_LINE_PREFIXES = ["// Edgar", "var ", "function ", "/*", "*/"]
# Entities decoded by the Column path of T12; '&amp;' must stay last
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"),
    ("&amp;", "&"),
]
# Defaults used when a field is missing
UNKNOWN_COMPANY = "Unknown Company"
UNKNOWN = "Unknown"
DEFAULT_REGEX_DOC_TYPE = "10-K"
SUBSTANTIAL_CHARS = 200
HEADER_MIN_CHARS = 10
RENDER_SIZE_GATE_BYTES = 10 * 1024 * 1024
# ------------------------------------------------------------------------------
