"""Text expressions for page extraction; regular expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# The named entities that pages use; &amp; comes last.
_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&rdquo;", "”"), ("&ldquo;", "“"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&amp;", "&"),
)
_NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _decoded(text: Column) -> Column:
    """Numeric character references as characters; those beyond Unicode stay."""
    parts = F.split(text, rf"(?={_NUMERIC})")

    def one(part: Column) -> Column:
        mark = F.regexp_extract(part, rf"^({_NUMERIC})", 1)
        is_hex = F.substr(mark, F.lit(3), F.lit(1)).isin("x", "X")
        digits = F.regexp_replace(mark, r"[&#;xX]", "")
        code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = (mark != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # UTF-32 is a character's number as four bytes.
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substr(part, F.length(mark) + 1))).otherwise(part)

    return F.when(text.contains("&#"), F.concat_ws("", F.transform(parts, one))).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text of a piece of HTML, tags as blanks, blanks collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), r"(?s)<[^>]*>", " ")
    text = _decoded(text)
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def capture(text: Column, pattern: str) -> Column:
    """First group of the first match, or NULL."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def no_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def elements(html: Column, tag: str, opening: str | None = None) -> Column:
    """All elements of a tag, as HTML, in the order of their beginnings; those
    inside others of the tag stand for themselves too.

    An element ends where as many end tags as beginnings have come; one that is
    never closed runs to the end. End tags without a beginning count for
    nothing. `opening` is a pattern that the beginning must match.
    """
    starts, ends = rf"(?i)^<{tag}(?=[\s/>])", rf"(?i)^</{tag}\s*>"
    parts = F.split(html, rf"(?i)(?=<{tag}[\s/>]|</{tag}\s*>)")

    def deeper(depths: Column, part: Column) -> Column:
        step = F.when(F.rlike(part, F.lit(starts)), 1).when(F.rlike(part, F.lit(ends)), -1).otherwise(0)
        now = F.coalesce(F.get(depths, F.size(depths) - 1), F.lit(0)) + step
        return F.array_append(depths, F.greatest(now, F.lit(0)))

    def all_of(ps: Column, ds: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            # The first place after the beginning that is less deep is its end.
            count = F.array_position(F.slice(ds, i + 2, F.size(ds)), (F.get(ds, i) - 1).cast("int")).cast("int")
            closed = F.concat(
                F.concat_ws("", F.slice(ps, i + 1, count)),
                F.regexp_extract(F.get(ps, i + count), rf"(?i)^(</{tag}\s*>)", 1),
            )
            whole = F.when(count > 0, closed).otherwise(F.concat_ws("", F.slice(ps, i + 1, F.size(ps))))
            return F.when(F.rlike(p, F.lit(opening or starts)), whole)

        return F.filter(F.transform(ps, one), lambda e: e.isNotNull())

    none = F.array().cast("array<int>")
    nested = _let(parts, lambda ps: _let(F.aggregate(ps, none, deeper), lambda ds: all_of(ps, ds)))
    # Where every beginning has an end before the next one, nothing nests, and one pattern finds the same.
    flat = F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}[\s/>].*?</{tag}\s*>)"), F.lit(1))
    count = F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s/>]"))

    def chosen(found: Column) -> Column:
        asked = F.filter(found, lambda e: F.rlike(e, F.lit(opening))) if opening else found
        return F.when(F.size(found) == count, asked).otherwise(nested)

    return _let(flat, chosen)


def elements_of_class(html: Column, tag: str, css_class: str) -> Column:
    """Elements of a tag and class, also inside others of the tag; what stands in
    comments, scripts and styles is none."""
    opening = rf"(?is)^<{tag}\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?[\"'][^>]*>"
    return elements(F.regexp_replace(html, _HIDDEN, " "), tag, opening)


def contains_all(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & F.contains(text, F.lit(part))
    return out
