"""Text functions: Column in, Column out.

Patterns are Java's, with Unicode classes (?U) and line feeds as the only line ends (?d), which is how
the inventory defines them. Each stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

#: Deleted in this order when boilerplate is stripped: pattern and flags besides m (s: dot matches line feeds, i: any case).
BOILERPLATE: list[tuple[str, str]] = [
    (r"^[=]{3,}\s*\n(?:[^\n]*\n)*?[=]{3,}\s*$", ""),
    (r"^(?:Title|Author|Date|Department|Tags|Classification|Document ID)\s*:.*$", "i"),
    (r"^Page \d+.*$", ""),
    (r"^Generated:.*$", ""),
    (r"^Last Modified:.*$", ""),
    (r"^©.*$", ""),
    (r"^\s*(?:Subject|From|To|Date|MIME-Version|Content-Type):.*?(?=\n\s*\n|\n\s*-{3,})", "s"),
    (r"^\s*Hi everyone,?\s*$", ""),
    (r"^\s*(?:Best|Regards|Cheers|Thanks),?\s*$", ""),
    (r"\n\s*--\s*\n.*\z", "s"),
    (r"This email and any attachments are confidential.*\z", "si"),
    (r"\[TOC\]\s*\n(?:\s*\d+\..*\n)+", ""),
    (r"^.*(?:DRAFT|Do Not Distribute).*$", "i"),
    (r"^Document version.*$", "i"),
    (r"^For (?:more information|related articles),?\s*(?:contact|visit):.*$", ""),
    (r"^\[\d+\]\s+.*$", ""),
    (r"^\s*(?:Internal wiki|See also):?\s*https?://\S+\s*$", ""),
    (r"^\s*(?:Prepared|Reviewed) by\s*:.*$", "i"),
    (r"^\s*Last updated\s*:.*$", "i"),
    (r"^\s*[-=]{3,}\s*$", ""),
    (r"^(?:NOTE|TODO|FIXME|HACK):.*$", ""),
    (r"^.*Following up on.*(?:write-up|knowledge base).*$", ""),
    (r"^.*Let me know if you have questions.*$", ""),
    (r"^\s*(?:Principal|Senior|Lead|Staff)\s+\w+.*$", ""),
    (r"^.*(?:deep-dive|tech talk|meeting|session).*(?:Friday|Monday|next week).*$", "i"),
]

#: Typographic characters and what stands for them.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", " ": " "}

METADATA_KEYS = ["Title", "Author", "Date", "Department", "Tags", "Subject", "From", "Prepared by", "Reviewed by", "Last updated"]
FIGURE = r"\b(?:Figure|Fig\.)\s*\d+[A-Za-z]?\b"
HEADING = r"^\s*(?:#{1,6}\s+.+|\d+(?:\.\d+)*+\.?\s+[A-Z].+)$"
CROSS_REFERENCES = [("document_id", r"\bDOC-\d{2,}\b"), ("section", r"\bSection\s+\d+(?:\.\d+){0,3}\b"), ("standard", r"\bRFC\s+\d{3,5}\b")]
KEYWORD = r"\b[a-zA-Z][a-zA-Z0-9_-]{2,}\b"
#: The namespace of version-5 UUIDs for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

QUALITY_BASE, QUALITY_BONUS, QUALITY_LENGTH, QUALITY_DIGIT = 0.4, 0.2, 120, 0.01

# ---------------------------------------------------------------- white space


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def words(c: Column) -> Column:
    """The parts between runs of white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


# ---------------------------------------------------------------- cleaning


#: Forms with the same matches of those patterns that would take a stack frame a line, or look at the rest of a line or text again for each of its parts.
STEADY = {
    r"^[=]{3,}\s*\n(?:[^\n]*\n)*?[=]{3,}\s*$": r"^={3,}(?>\s*\n)[\s\S]*?^={3,}\s*$",
    r"\[TOC\]\s*\n(?:\s*\d+\..*\n)+": r"\[TOC\]\s*\n(?:\s*\d+\..*\n)++",
    r"\n\s*--\s*\n.*\z": r"(?:\G|(?<!\n))\n\s*+--\s*\n.*\z",
    r"^.*Following up on.*(?:write-up|knowledge base).*$": r"^(?>.*?Following up on).*(?:write-up|knowledge base).*$",
    r"^.*(?:deep-dive|tech talk|meeting|session).*(?:Friday|Monday|next week).*$": r"^(?>.*?(?:deep-dive|tech talk|meeting|session)).*(?:Friday|Monday|next week).*$",
}
#: Texts without any of these hold no match of the pattern, and are passed by. Only for patterns that tell cases apart.
NEEDED = {
    r"^[=]{3,}\s*\n(?:[^\n]*\n)*?[=]{3,}\s*$": ["==="],
    r"^Page \d+.*$": ["Page "],
    r"^\s*Hi everyone,?\s*$": ["Hi everyone"],
    r"^\s*(?:Best|Regards|Cheers|Thanks),?\s*$": ["Best", "Regards", "Cheers", "Thanks"],
    r"\n\s*--\s*\n.*\z": ["--"],
    r"\[TOC\]\s*\n(?:\s*\d+\..*\n)+": ["[TOC]"],
    r"^\[\d+\]\s+.*$": ["["],
    r"^\s*(?:Internal wiki|See also):?\s*https?://\S+\s*$": ["Internal wiki", "See also"],
    r"^\s*[-=]{3,}\s*$": ["--", "-=", "=-", "=="],
    r"^.*Following up on.*(?:write-up|knowledge base).*$": ["Following up on"],
    r"^.*Let me know if you have questions.*$": ["Let me know if you have questions"],
    r"^\s*(?:Principal|Senior|Lead|Staff)\s+\w+.*$": ["Principal", "Senior", "Lead", "Staff"],
}
#: The same for patterns of any case, as patterns that are sought without what stands around them.
NEEDED_MATCH = {
    r"^.*(?:DRAFT|Do Not Distribute).*$": r"DRAFT|Do Not Distribute",
    r"^.*(?:deep-dive|tech talk|meeting|session).*(?:Friday|Monday|next week).*$": r"Friday|Monday|next week",
}
#: What ends a block of mail headers.
HEADERS_END = r"\n\s*\n|\n\s*-{3,}"


def _steady(pattern: str) -> str:
    if pattern.startswith(r"^\s*"):  # a match that may begin in the second of two empty lines begins in the first one
        return r"^(?:\G|(?<!\n\n))\s*+" + pattern.removeprefix(r"^\s*")
    return STEADY.get(pattern, pattern)


def strip_boilerplate(c: Column) -> Column:
    """Without the blocks and lines of BOILERPLATE, in time and stack that don't depend on how many lines a block has."""
    for pattern, flags in BOILERPLATE:
        cut = lambda t, p=f"(?dmU{flags}){_steady(pattern)}": F.regexp_replace(t, p, "")
        if HEADERS_END in pattern:  # behind the last end there is no whole block
            upto = lambda t: F.length(F.regexp_extract(t, rf"(?dU)\A[\s\S]*(?:{HEADERS_END})", 0))
            c = let(c, lambda t, cut=cut: F.when(t.contains(":"), let(upto(t), lambda n: F.concat(cut(t.substr(F.lit(1), n)), t.substr(n + 1, F.length(t))))).otherwise(t))
        elif pattern in NEEDED:
            c = let(c, lambda t, cut=cut, p=pattern: F.when(reduce(lambda a, b: a | b, [t.contains(x) for x in NEEDED[p]]), cut(t)).otherwise(t))
        elif pattern in NEEDED_MATCH:
            c = let(c, lambda t, cut=cut, p=f"(?dmU{flags}){NEEDED_MATCH[pattern]}": F.when(t.rlike(p), cut(t)).otherwise(t))
        else:
            c = cut(c)
    return c


def plain_typography(c: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), TYPOGRAPHY.items(), c)


def clean_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"(?dm)[ ]+$", ""))


def strip_section_markers(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?dmU)^\s*#{1,6}\s+", "")
    c = F.regexp_replace(c, r"(?dmU)^\s*={2,}\s*(.*?)\s*={2,}\s*$", "$1")
    marked = r"(?dU)^\s*\d+(?:\.\d+)*+\.?\s+([A-Z][A-Z &/]+)$"
    return F.array_join(F.transform(lines(c), lambda x: F.when(x.rlike(marked), F.initcap(F.regexp_extract(x, marked, 1))).otherwise(x)), "\n")


def strip_trailing_short_lines(c: Column, most: int = 4) -> Column:
    """Without the last lines while they have at most `most` words, aren't blank and end no sentence."""
    keeps = lambda x: (F.size(words(x)) > most) | (strip(x) == "") | strip(x).rlike(r"[.?!]\z")
    last = lambda every: F.aggregate(F.transform(every, lambda x, i: F.when(keeps(x), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    upto = lambda every, n: F.when(n == 0, "").otherwise(F.array_join(F.slice(every, F.lit(1), F.greatest(n, F.lit(1))), "\n"))
    return let(lines(F.regexp_replace(c, r"(?U)\s+\z", "")), lambda every: let(last(every), lambda n: upto(every, n)))


def markdown_headings(c: Column) -> Column:
    """`== x ==` and numbered headings as Markdown headings."""
    wiki = r"(?U)^\s*(={2,})\s*(.*?)\s*={2,}\s*$"
    # words of letters and & / ( ) -; of white space, only a blank may stand before something else than a letter
    numbered = r"(?U)^\s*(\d+(?:\.\d+)*+)\.?\s+([A-Z][A-Za-z &/()\-](?:[A-Za-z &/()\-]|[^\S ](?=\s*[A-Za-z]))*+)$"

    def one(x: Column) -> Column:
        title = strip(F.regexp_extract(x, numbered, 2))
        depth = F.length(F.regexp_replace(F.regexp_extract(x, numbered, 1), "[^.]", "")) + 2
        return (
            F.when(x.rlike(wiki), F.concat(F.expr("repeat('#', 6)").substr(F.lit(1), F.least(F.length(F.regexp_extract(x, wiki, 1)), F.lit(6))), F.lit(" "), strip(F.regexp_extract(x, wiki, 2))))
            .when(x.rlike(numbered), F.concat(F.lit("######").substr(F.lit(1), F.least(depth, F.lit(6))), F.lit(" "), F.when(title == F.upper(title), F.initcap(title)).otherwise(title)))
            .otherwise(x)
        )

    return F.array_join(F.transform(lines(c), one), "\n")


def clean_document(c: Column) -> Column:
    """All cleaning stages but canonical composition, in their order."""
    c = clean_whitespace(plain_typography(strip_boilerplate(c)))
    return clean_whitespace(strip_trailing_short_lines(markdown_headings(c)))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def figure_notes(text: Column, notes: Column) -> Column:
    """The text with a list of figure notes at its end, if there are any."""
    block = F.concat(text, F.lit("\n\n## Figure Notes\n"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n"))
    return F.when(F.size(notes) > 0, block).otherwise(text)


def metadata_value(c: Column, *keys: str) -> Column:
    """The last value that is given to any of the keys in lines `key: value`, or null."""
    found = F.regexp_extract_all(c, F.lit(rf"(?dmUi)^\s*(?:{'|'.join(keys)})\s*:\s*(.+)$"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


# ---------------------------------------------------------------- parsing


def html_to_markdown(c: Column) -> Column:
    """Headings as Markdown, all other tags removed, their text kept."""
    for level in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "#" * level + " $1")
    return strip(F.regexp_replace(c, r"<[^>]+>", ""))


def rst_to_markdown(c: Column) -> Column:
    """A line above a rule of =, - or ~ becomes a heading of level 1, 2 or 3; the rule goes."""
    rule = r"(?U)^\s*[=\-~]{3,}\s*$"

    def convert(every: Column) -> Column:
        has_rule = lambda i: F.coalesce(F.get(every, i + 1).rlike(rule), F.lit(False)) & (strip(F.get(every, i)) != "")

        def step(state: Column, i: Column) -> Column:
            line = F.get(every, i)
            mark = strip(F.get(every, i + 1)).substr(1, 1)
            hashes = F.when(mark == "=", "# ").when(mark == "-", "## ").otherwise("### ")
            heads = ~state["skip"] & has_rule(i)
            out = F.when(state["skip"], state["out"]).otherwise(F.concat(state["out"], F.array(F.when(heads, F.concat(hashes, strip(line))).otherwise(line))))
            return F.struct(out.alias("out"), heads.alias("skip"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
        return F.array_join(F.aggregate(F.sequence(F.lit(0), F.size(every) - 1), start, step)["out"], "\n")

    return let(lines(c), convert)


def headings(c: Column) -> Column:
    """The texts of lines that begin with #."""
    starts = F.filter(F.transform(lines(c), strip), lambda x: x.startswith("#"))
    return F.filter(F.transform(starts, lambda x: strip(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")


def figures(c: Column, most: int = 32) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit("(?Ui)" + FIGURE), F.lit(0)), 1, most)


def detected_headings(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("(?dmU)" + HEADING), F.lit(0)), strip)


def image_references(c: Column) -> Column:
    """(alt, src) of Markdown images."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)]+)\)")
    alts, sources = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.arrays_zip(alts.alias("alt"), sources.alias("src"))


def sentences(c: Column) -> Column:
    """Cut after . ! ? before white space, and at blank lines; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+|\n\n+"), strip), lambda s: s != "")


# ---------------------------------------------------------------- scores and names


def quality_score(c: Column) -> Column:
    digits = F.regexp_count(c, F.lit(r"(?U)\d"))
    bonus = F.when(F.length(c) >= QUALITY_LENGTH, QUALITY_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(QUALITY_BASE) + bonus + F.least(F.lit(QUALITY_BONUS), digits * QUALITY_DIGIT))


def normal_hash(c: Column) -> Column:
    """SHA-256 of the text, trimmed and with single spaces; case counts."""
    return F.sha2(strip(collapse(c)), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(h.substr(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return uuid5(F.concat_ws(":", source, index.cast("string"), F.sha2(text, 256)))


def summary(c: Column, most: int = 240) -> Column:
    """The first characters, cut at the last space."""
    head = strip(collapse(c))
    return F.when(F.length(head) <= most, head).otherwise(F.regexp_replace(head.substr(1, most), " [^ ]*$", ""))


def estimated_tokens(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int")))


def cap(c: Column, most: int) -> Column:
    """Single spaces, and at most so many characters, of which the last three are dots if any were cut."""
    c = strip(collapse(c))
    return F.when(F.length(c) > most, F.concat(c.substr(1, most - 3), F.lit("..."))).otherwise(c)


def safe_key(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "[/:]", "_"), F.lit(".."), F.lit("__"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\:*?"<>|]', "_")


def highlight(text: Column, part: Column) -> Column:
    """HTML-escaped text with the part marked."""

    def plain(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    mark = F.concat(F.lit("<mark>"), plain(part), F.lit("</mark>"))
    return F.when(F.length(part) > 0, F.replace(plain(text), plain(part), mark)).otherwise(plain(text))
