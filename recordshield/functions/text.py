"""Masking inside free text, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .clean import as_col, let
from .dates import parse_date, rewrite_matches, shift_dates_in_text

#: What a word is made of, in any script.
WORD = r"\p{L}\p{M}\p{N}_"
# left and right edge of a value inside a text: no word character next to it, and no mail host behind it
LEFT_EDGE = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"
WORD_BREAK = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
RIGHT_EDGE = rf"{WORD_END}(?![{WORD}]*@)"
#: Letters of any script match in any case.
ANY_CASE = "(?iu)"


def fold(text: Column) -> Column:
    """A form in which letters that ``ANY_CASE`` holds equal are equal: back and forth once, as some letters share one capital only."""
    # the empty text keeps the optimizer from taking the way back and forth for one step
    apart = lambda x: F.concat(x, F.lit(""))
    return F.lower(apart(F.upper(apart(F.lower(F.replace(text, F.lit("İ"), F.lit("i")))))))


def java_replacement(mask: str) -> str:
    """A mask as a literal replacement string: ``\\`` and ``$`` have a meaning there."""
    return mask.replace("\\", "\\\\").replace("$", "\\$")


def quote_pattern(value: Column) -> Column:
    """A column value as a literal inside a pattern."""
    return F.regexp_replace(value, r"([^A-Za-z0-9 ])", r"\\$1")


def values_pattern(values: Column) -> Column:
    """One whole-word, any-case pattern for an array of values, tried in array order.

    A quote or slash before a value and a quote behind it go with it.
    """
    head, tail = F.lit(LEFT_EDGE + r"(?:['\"/])?(?:"), F.lit(r")(?:['\"])?" + RIGHT_EDGE)
    brief, end = F.lit(rf"['\"]?{WORD_BREAK}(?:"), F.lit(rf"){WORD_BREAK}['\"]?")

    def pattern(bare: Column) -> Column:
        long = let(F.filter(bare, lambda v: F.length(v) >= 3), lambda vs: F.when(F.size(vs) > 0, F.concat(head, _alternatives(vs), tail)))
        short = let(F.filter(bare, lambda v: F.length(v) < 3), lambda vs: F.when(F.size(vs) > 0, F.concat(brief, _listed(vs), end)))
        return F.concat(F.lit(ANY_CASE), F.array_join(F.array_compact(F.array(long, short)), "|"))

    return let(F.transform(values, lambda v: F.trim(v)), pattern)


def _literal(value: Column) -> Column:
    """As ``quote_pattern``, for long arrays: no pattern is run over the value."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _listed(values: Column) -> Column:
    return F.array_join(F.transform(values, _literal), "|")


def _alternatives(values: Column, letters: int = 2) -> Column:
    """Many values are listed behind their first letters, in their order, so that only those of the same letters are tried at a place.

    Where two first letters are one in another case, all values are listed in their order.
    """
    if not letters:
        return _listed(values)

    def behind(head: Column) -> Column:
        rests = F.transform(F.filter(values, lambda v: F.startswith(v, head)), lambda v: F.substr(v, F.lit(2)))
        return F.concat(_literal(head), F.lit("(?:"), let(rests, lambda r: _alternatives(r, letters - 1)), F.lit(")"))

    def listed(heads: Column) -> Column:
        apart = F.size(F.array_distinct(F.transform(heads, fold))) == F.size(heads)
        return F.when(apart, F.array_join(F.transform(heads, behind), "|")).otherwise(_listed(values))

    heads = F.array_distinct(F.transform(values, lambda v: F.substring(v, 1, 1)))
    return F.when(F.size(values) > 4, let(heads, listed)).otherwise(_listed(values))


def compiled_terms(terms: str | Column) -> Column:
    """``array<struct<value,mask>>``, longest value first, as struct<pattern,terms,only>: one pattern over all values, whatever their masks, and their folded forms
    or, where all have one mask, that mask as a replacement string."""

    def compiled(present: Column) -> Column:
        pattern = values_pattern(present["value"])
        folded = F.transform(present, lambda t: F.struct(fold(F.trim(t["value"])).alias("form"), t["mask"].alias("mask")))

        def parts(only: Column) -> Column:
            # forms are only looked up where there are several masks
            return F.when(F.size(present) > 0, F.struct(pattern.alias("pattern"), F.when(only.isNull(), folded).alias("terms"), only.alias("only")))

        def single(masks: Column) -> Column:
            return F.when(F.size(masks) == 1, F.regexp_replace(F.get(masks, F.lit(0)), r"([\\$])", r"\\$1"))

        return let(let(F.array_distinct(present["mask"]), single), parts)

    return let(F.filter(as_col(terms), lambda t: t["value"].isNotNull() & (F.trim(t["value"]) != "")), compiled)


def _mask_of(found: Column, terms: Column) -> Column:
    """The mask of the longest value that the match is, with or without the quotes around it."""
    bare = F.regexp_replace(found, r"^['\"/]", "")
    quoted = F.array(found, bare, F.regexp_replace(found, r"['\"]$", ""), F.regexp_replace(bare, r"['\"]$", ""))
    # without a sign at either end all four are one
    forms = F.transform(F.when(found.rlike(r"^['\"/]|['\"]$"), quoted).otherwise(F.array(found)), fold)

    def first_of(same: Column) -> Column:
        hits = F.filter(terms, lambda t: F.array_contains(same, t["form"]))
        # every match is some value; should letter case hide which one, it is masked all the same
        return F.coalesce(F.get(hits, F.lit(0))["mask"], F.get(terms, F.lit(0))["mask"])

    return let(forms, first_of)


def mask_compiled(text: str | Column, compiled: str | Column) -> Column:
    """One pass over the text: at each place the longest value wins, and no mask is looked at again."""
    c = as_col(compiled)
    masked = rewrite_matches(text, c["pattern"], lambda found: _mask_of(found, c["terms"]))
    # with one mask it does not matter which value a match is
    return F.when(c.isNull(), as_col(text)).when(c["only"].isNotNull(), F.regexp_replace(as_col(text), c["pattern"], c["only"])).otherwise(masked)


def mask_values(text: str | Column, terms: str | Column) -> Column:
    """Replace the values of an ``array<struct<value,mask>>``, longest first, in a text in one pass."""
    return let(compiled_terms(terms), lambda c: mask_compiled(text, c))


def mask_regexes(text: str | Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """A list of (patterns, mask), each scanned once, in the given order."""
    out = as_col(text)
    for found, mask in rules:
        out = F.regexp_replace(out, P.any_of(list(found)), java_replacement(mask))
    return out


CONTACT_RULES = [([P.EMAIL], P.MASKS["email_id"]), (P.PHONES, P.MASKS["phone"]), ([P.SSN], P.MASKS["ssn"])]


def if_found(text: str | Column, needed: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for texts that hold the needed piece, the text itself for all others."""
    return let(as_col(text), lambda t: F.when(t.rlike(needed), change(t)).otherwise(t))


def mask_address(text: str | Column) -> Column:
    """House, street, city and state masked, three digits of the postal code kept."""

    def masked(t: Column) -> Column:
        return if_found(t, "(?i)" + P.STATE_AND_ZIP, lambda u: F.regexp_replace(u, P.ADDRESS, P.ADDRESS_MASK))

    return if_found(text, P.NEEDED["address"], masked)


def mask_po_box(text: str | Column) -> Column:
    return F.regexp_replace(as_col(text), P.PO_BOX, "((POBox))")


def replace_words(text: str | Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Fixed old -> new words; an old word must not follow a word character nor be part of a mail address."""
    out = as_col(text)
    for old, new in pairs:
        if old and new:
            quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in old)
            out = F.regexp_replace(out, rf"{ANY_CASE}{LEFT_EDGE}{quoted}(?![{WORD}]*@)", java_replacement(new))
    return out


def generic_mask(
    text: str | Column,
    days: str | Column | int | None = None,
    facilities: Sequence[str] = (),
    replacements: Sequence[tuple[str, str]] = (),
    custom: dict[str, Callable[[Column, str, str], Column]] | None = None,
) -> Column:
    """The rules that need no knowledge of the person, in their fixed order.

    ``custom`` may replace the handling of a kind by its own ``(text, pattern, mask) -> Column``.
    """
    out = F.trim(F.regexp_replace(replace_words(F.coalesce(as_col(text), F.lit("")), replacements), r"\s+", " "))
    custom = custom or {}

    def step(out: Column, kind: str, found: list[str]) -> Column:
        pattern = P.any_of(found)
        if kind in custom:
            return custom[kind](out, pattern, P.MASKS[kind])
        if kind not in P.NEEDED:
            return F.regexp_replace(out, pattern, java_replacement(P.MASKS[kind]))
        return if_found(out, P.NEEDED[kind], lambda t: F.regexp_replace(t, pattern, java_replacement(P.MASKS[kind])))

    out = step(out, "ip", [P.IPV4])
    out = step(out, "email", [P.EMAIL])
    out = step(out, "url", P.URLS)
    out = step(out, "phone", [P.PHONE])
    if days is not None:
        out = shift_dates_in_text(out, days, pad="   ")
    out = step(out, "driver_license", P.DRIVER_LICENSES)
    out = mask_address(out)
    if facilities:
        out = step(out, "facility", [r"\b(?:" + "|".join(facilities) + r")\b"])
    return out


def combined_names(parts: Sequence[str | Column]) -> Column:
    """All ordered joins without a separator of the given name parts, longest first; shorter than three letters left out."""
    bare = [F.trim(F.coalesce(as_col(p).cast("string"), F.lit(""))) for p in parts]
    joined = []
    for n in range(len(bare), 0, -1):
        for chosen in permutations(bare, n):
            whole = F.concat(*chosen) if n > 1 else chosen[0]
            present = chosen[0] != ""
            for part in chosen[1:]:
                present = present & (part != "")
            joined.append(F.when(present & (F.length(whole) > 2), F.lower(whole)))
    names = F.array_distinct(F.array_compact(F.array(*joined)))
    return F.array_sort(names, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def mask_combined_names(text: str | Column, parts: Sequence[str | Column], mask: str) -> Column:
    names = F.transform(combined_names(parts), lambda n: F.concat(F.lit(WORD_BREAK), quote_pattern(n), F.lit(WORD_BREAK)))
    pattern = F.concat(F.lit(ANY_CASE), F.array_join(names, "|"))
    return F.when(F.size(names) > 0, F.regexp_replace(as_col(text), pattern, F.lit(java_replacement(mask)))).otherwise(as_col(text))


def own_id_to_surrogate(text: str | Column, own_id: str | Column, surrogate: str | Column) -> Column:
    """The row's own identifier inside its text, not within a longer run of digits."""
    own = as_col(own_id).cast("string")
    pattern = F.concat(F.lit(r"(?<!\d)"), quote_pattern(own), F.lit(r"(?!\d)"))
    return F.coalesce(F.regexp_replace(as_col(text), pattern, as_col(surrogate).cast("string")), as_col(text))


def mask_spaced_values(text: str | Column, values: Sequence[tuple[str | Column, str, int]]) -> Column:
    """Values that stand between blanks: (value, mask, least length)."""
    out = as_col(text)
    for value, mask, least in values:
        bare = F.trim(as_col(value).cast("string"))
        usable = bare.isNotNull() & ~F.lower(bare).isin("", "none", "null") & (F.length(bare) >= least)
        out = F.when(usable, F.replace(out, F.concat(F.lit(" "), bare, F.lit(" ")), F.lit(f" {mask} "))).otherwise(out)
    return out


# --- markup -----------------------------------------------------------------------------------------------------------

# comment, CDATA, instruction, declaration, closing tag, opening tag, text, stray sign: together they cover any text
TOKEN = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z](?:[^>\[]++|\[.*?\])*+>|</[^<>]*+>"
    r"|<[\p{L}_](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
)
#: Elements of HTML that have no closing tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def _local(name: Column) -> Column:
    return F.regexp_replace(name, "^.*:", "")


def _markup_steps(tokens: Column) -> Column:
    """Every token as struct<i,kind,name,held>: place, kind, full tag name, and what it adds to the text of its element."""

    def kind(t: Column, name: Column) -> Column:
        tag = F.when(t.startswith("<!--") | t.startswith("<?"), "aside").when(t.startswith("<![CDATA["), "text").when(t.startswith("<!"), "declared")
        tag = tag.when(t.startswith("</"), "close").when(name == "", "stray").when(t.endswith("/>"), "empty").otherwise("open")
        return F.when(~t.startswith("<"), "text").otherwise(tag)

    def step(t: Column, i: Column) -> Column:
        name = F.regexp_extract(t, r"^</?([\p{L}_][^\s/>]*)", 1)
        inside = F.replace(F.replace(F.substring(t, F.lit(10), F.length(t) - 12), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        held = F.when(t.startswith("<![CDATA["), inside).otherwise(t)
        return let(name, lambda n: F.struct(i.alias("i"), kind(t, n).alias("kind"), n.alias("name"), held.alias("held")))

    return F.transform(tokens, step)


def _well_formed(steps: Column) -> Column:
    """Whether the tags pair up below one root, with no stray sign and no text outside it."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("ok"), F.lit(0).alias("roots"))

    def merge(acc: Column, x: Column) -> Column:
        stack, kind, outside = acc["stack"], x["kind"], F.size(acc["stack"]) == 0
        pairs = F.coalesce(F.get(stack, F.size(stack) - 1) == x["name"], F.lit(False))
        begins = outside & kind.isin("open", "empty")
        bad = (kind == "stray") | ((kind == "close") & ~pairs) | (outside & (kind == "text") & x["held"].rlike(r"\S"))
        moved = F.when(kind == "open", F.concat(stack, F.array(x["name"]))).when((kind == "close") & pairs, F.slice(stack, F.lit(1), F.size(stack) - 1))
        return F.struct(moved.otherwise(stack).alias("stack"), (acc["ok"] & ~bad).alias("ok"), (acc["roots"] + begins.cast("int")).alias("roots"))

    return F.aggregate(steps, start, merge, lambda acc: acc["ok"] & (F.size(acc["stack"]) == 0) & (acc["roots"] == 1))


def _markup_edits(steps: Column, exact: Column, named: Callable[[Column], Column], masked: Callable[[Column], Column]) -> Column:
    """A scan over the tokens with the stack of open tags: array<struct<a,b,tag,value>>, the tokens a to b that are the text of an element.

    The text of an element is all up to its first child, whether plain, in CDATA or around comments; found where ``named(tag)`` holds. Of an element of
    which ``masked(tag)`` holds, all other text and comments are found too, without a tag, as they are to go. Where the markup is not well-formed (``exact`` is
    false), a closing tag closes the last one of its name and all within, HTML's tags without an end are empty, and what is cut off ends with the text.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(-1).alias("first"), F.lit("").alias("value"),
        F.array().cast("array<struct<a:int,b:int,tag:string,value:string>>").alias("edits"),
    )

    def edit(a: Column, b: Column, tag: Column, value: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), tag.alias("tag"), value.alias("value"))

    def last(stack: Column) -> Column:
        return _local(F.get(stack, F.size(stack) - 1))

    def merge(acc: Column, x: Column) -> Column:
        stack, kind, depth = acc["stack"], x["kind"], F.size(acc["stack"])
        opens = (kind == "open") & (exact | ~F.lower(x["name"]).isin(VOID_TAGS))
        closes = kind == "close"
        event = kind.isin("open", "empty", "close")
        collecting = acc["first"] >= 0
        back = F.array_position(F.reverse(stack), x["name"]).cast("int")
        holds = exact | closes | acc["value"].rlike(r"\S")
        goes = ~collecting & (depth > 0) & ((kind == "aside") | ((kind == "text") & x["held"].rlike(r"\S")))
        found = F.when(event & collecting & holds, edit(acc["first"] + 1, x["i"] - 1, last(stack), acc["value"]))
        found = found.when(goes & masked(last(stack)), edit(x["i"], x["i"], F.lit(None).cast("string"), F.lit("")))
        return F.struct(
            F.when(opens, F.concat(stack, F.array(x["name"]))).when(closes & (back > 0), F.slice(stack, F.lit(1), depth - back)).otherwise(stack).alias("stack"),
            F.when(opens & named(_local(x["name"])), x["i"]).when(event, F.lit(-1)).otherwise(acc["first"]).alias("first"),
            F.when(event, F.lit("")).when(collecting & (kind == "text"), F.concat(acc["value"], x["held"])).otherwise(acc["value"]).alias("value"),
            let(found, lambda e: F.when(e.isNotNull(), F.concat(acc["edits"], F.array(e))).otherwise(acc["edits"])).alias("edits"),
        )

    def result(acc: Column) -> Column:
        cut = edit(acc["first"] + 1, F.size(steps) - 1, last(acc["stack"]), acc["value"])
        return F.when(acc["first"] >= 0, F.concat(acc["edits"], F.array(cut))).otherwise(acc["edits"])

    return F.aggregate(steps, start, merge, result)


def _edited(tokens: Column, edits: Column) -> Column:
    """The tokens joined again, with the edits, which are in order and do not overlap."""

    def joined(e: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(e, k - 1)["b"]).otherwise(F.lit(-1))
        parts = F.transform(e, lambda x, k: F.concat(F.slice(tokens, before(k) + 2, x["a"] - before(k) - 1), F.array(x["new"])))
        last = before(F.size(e))
        return F.array_join(F.concat(F.flatten(parts), F.slice(tokens, last + 2, F.size(tokens) - last - 1)), "")

    return let(edits, joined)


def rewrite_elements(
    text: str | Column,
    names: Sequence[str],
    masked: Callable[[Column], Column],
    change: Callable[[Column, Column], Column],
    broken: str = "tags",
    then: Callable[[Column], Column] = lambda out: out,
    also: str = "",
) -> Column:
    """The text of the named elements (any name space and case) replaced by ``change(local name, text)``; null leaves it as it is.

    Well-formed markup is followed exactly. Markup that is not well-formed (HTML, fragments, cut messages) is followed as far as its tags pair up, so
    that nothing named stays readable; with ``broken="keep"`` it is left as it is. ``then`` works on the result, in texts left as they are on none
    of it; texts without a named element are read only if they hold the pattern ``also``, which has to stand in all that ``then`` would change there.
    """
    low = [n.lower() for n in names]
    named = lambda name: F.lower(name).isin(low)
    worth = rf"{ANY_CASE}<(?:[^\s/<>:]+:)?{_names(names)}[\s/>]"

    def read(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda tokens: let(_markup_steps(tokens), lambda steps: followed(t, tokens, steps)))

    def followed(t: Column, tokens: Column, steps: Column) -> Column:
        def made(edits: Column) -> Column:
            new = F.transform(edits, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.when(e["tag"].isNull(), "").otherwise(change(e["tag"], e["value"])).alias("new")))
            return _edited(tokens, F.filter(new, lambda e: e["new"].isNotNull()))

        if broken == "keep":
            # only well-formed markup is followed, so that one reading serves the test, the edits and what comes then
            out = F.when(t.rlike(worth), made(_markup_edits(steps, F.lit(True), named, masked))).otherwise(t)
            return F.when(_well_formed(steps), then(out)).otherwise(t)
        return let(_well_formed(steps), lambda exact: made(_markup_edits(steps, exact, named, masked)))

    if broken == "keep":
        return if_found(text, rf"{worth}|{also}" if also else worth, read)
    return then(if_found(text, worth, read))


def _names(names: Sequence[str]) -> str:
    return "(?:" + "|".join(names) + ")"


def _mask_elements(
    text: Column, tags: dict[str, str], any_case: bool, broken: str, names: Sequence[str] = (), special: Callable[[Column, Column], Column] | None = None
) -> Column:
    """Text of the named tags and ``special`` of further ``names``, then their ``value`` attribute and attributes of that name in any tag and case."""
    key = F.lower if any_case else (lambda c: c)
    by_name = F.create_map(*[F.lit(x) for t, m in tags.items() for x in (t.lower() if any_case else t, m)])
    by_attribute = F.create_map(*[F.lit(x) for t, m in {t.lower(): m for t, m in tags.items()}.items() for x in (t, m)])
    flag = "(?iu)" if any_case else ""
    opening = rf"{flag}<(?:\w+:)?{_names(list(tags))}\s[^>]*\bvalue=(?:\"[^\"]*\"|'[^']*')"
    attribute = rf"(?iu)(?<=\s){_names(list(tags))}=(?:\"[^\"]*\"|'[^']*')(?=[^<>]*>)"

    def value(m: Column) -> Column:
        name = F.regexp_extract(m, r"^<(?:\w+:)?(\w+)", 1)
        return F.concat(F.regexp_extract(m, r"(?s)^(.*\bvalue=)", 1), F.lit('"'), by_name[key(name)], F.lit('"'))

    def named(m: Column) -> Column:
        return F.concat(F.regexp_extract(m, r"^([^=]*=)", 1), F.lit('"'), by_attribute[F.lower(F.regexp_extract(m, r"^([^=]*)=", 1))], F.lit('"'))

    def change(name: Column, content: Column) -> Column:
        mask = by_name[key(name)]
        return F.coalesce(mask, special(name, content)) if special is not None else mask

    def attributes(out: Column) -> Column:
        return rewrite_matches(rewrite_matches(out, opening, value), attribute, named)

    return rewrite_elements(text, [*tags, *names], lambda name: by_name[key(name)].isNotNull(), change, broken, attributes, attribute)


def mask_tags(text: str | Column, tags: dict[str, str], any_case: bool = False, broken: str = "tags") -> Column:
    """Text of the named tags, their ``value`` attribute, and attributes of that name in any tag and case."""
    return let(as_col(text), lambda whole: _mask_elements(whole, tags, any_case, broken))


def mask_markup(
    text: str | Column,
    tags: dict[str, str] = P.XML_TAG_MASKS,
    dob_tags: Sequence[str] = P.XML_DOB_TAGS,
    zip_tags: Sequence[str] = P.XML_ZIP_TAGS,
    any_case: bool = False,
    broken: str = "tags",
) -> Column:
    """Birth-date tags to the year, postal-code tags to three digits, named tags masked. Only text that starts as markup.

    A birth date that cannot be read stays as it is, CDATA and all; so does a postal code without five digits.
    """
    born, coded = [t.lower() for t in dob_tags], [t.lower() for t in zip_tags]

    def special(name: Column, content: Column) -> Column:
        year = F.date_format(parse_date(F.trim(content)), "yyyy")
        digits = F.regexp_replace(content, r"(\d{3})\d{2}", "$1")
        return F.when(F.lower(name).isin(born), year).when(F.lower(name).isin(coded) & (digits != content), digits)

    def masked(whole: Column) -> Column:
        out = _mask_elements(whole, tags, any_case, broken, [*dob_tags, *zip_tags], special)
        return F.when(F.ltrim(whole).startswith("<"), out).otherwise(whole)

    return let(as_col(text), masked)
