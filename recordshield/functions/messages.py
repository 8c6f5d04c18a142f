"""Fields out of HL7 and XML message columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, let


def hl7_segment(message: str | Column, segment: str) -> Column:
    """Fields of the first segment of that name, as an array; null when there is none."""
    lines = F.split(as_col(message), r"[\r\n]+")
    first = F.get(F.filter(lines, lambda line: line.startswith(segment + "|")), F.lit(0))
    return F.split(first, r"\|")


def hl7_field(message: str | Column, segment: str, number: int) -> Column:
    """Field by its 1-based position, the segment name being field 1."""
    return F.trim(F.get(hl7_segment(message, segment), F.lit(number - 1)))


# fixed values: the separators of a message without a header, in the order field, component, repetition, escape, sub-component
SEPARATORS = "|^~\\&"


def message_separators(message: str | Column) -> Column:
    """The five separators of a message as one text, as its header declares them; what a short header leaves out is as usual."""
    declared = F.regexp_extract(as_col(message), r"(?:^|[\r\n])MSH([^\r\n\w\s][^\r\n\w\s]{0,4})", 1)
    # the header's second field ends at the next field separator
    end = F.instr(F.substring(declared, 2, 4), F.substring(declared, 1, 1))
    own = F.when(end > 0, F.substr(declared, F.lit(1), end)).otherwise(declared)
    return F.concat(own, F.substr(F.lit(SEPARATORS), F.length(own) + 1))


def _cut(text: Column, separator: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)


def _plain(text: Column, marks: Column) -> Column:
    """Escapes resolved in one pass: separators, hexadecimal bytes, line breaks; codes without a meaning here stay as they are."""
    escape = F.substring(marks, 4, 1)
    # fixed values: codes of the separators by their place
    named = {"F": 1, "S": 2, "R": 3, "E": 4, "T": 5}

    def resolved(parts: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            out = F.when(i % 2 == 0, x).when(i == F.size(parts) - 1, F.concat(escape, x))
            for code, place in named.items():
                out = out.when(x == code, F.substring(marks, place, 1))
            out = out.when(x == ".br", F.lit("\n")).when(x.rlike("^X([0-9A-Fa-f]{2})+$"), F.decode(F.unhex(F.substr(x, F.lit(2))), "UTF-8"))
            return out.otherwise(F.concat(escape, x, escape))

        return F.array_join(F.transform(parts, part), "")

    return F.when(F.instr(text, escape) > 0, let(_cut(text, escape), resolved)).otherwise(text)


def message_tree(message: str | Column) -> Column:
    """A whole message as a nested value: array of (name, fields), a field being repetitions of components of sub-components.

    Fields count without the segment's name; those of the header begin with the field separator and the other separators, uncut. Segments end
    at CR, LF or both, empty lines are none; null stays null; an empty message has no segments; an empty field is one empty sub-component.
    """

    def parsed(marks: Column) -> Column:
        field, component, repetition, below = [F.substring(marks, i, 1) for i in (1, 2, 3, 5)]

        def value(text: Column) -> Column:
            return F.transform(
                _cut(text, repetition),
                lambda r: F.transform(_cut(r, component), lambda c: F.transform(_cut(c, below), lambda s: _plain(s, marks))),
            )

        def whole(text: Column) -> Column:
            return F.array(F.array(F.array(text)))

        def segment(line: Column) -> Column:
            return let(
                _cut(line, field),
                lambda parts: F.when(
                    F.get(parts, F.lit(0)) == "MSH",
                    F.concat(
                        F.array(whole(field), whole(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))),
                        F.transform(F.slice(parts, F.lit(3), F.size(parts)), value),
                    ),
                ).otherwise(F.transform(F.slice(parts, F.lit(2), F.size(parts)), value)),
            )

        lines = F.filter(F.split(as_col(message), r"[\r\n]+"), lambda x: x != "")
        return F.transform(lines, lambda x: F.struct(F.get(_cut(x, field), F.lit(0)).alias("name"), segment(x).alias("fields")))

    return F.when(as_col(message).isNotNull(), let(message_separators(message), parsed))


def tree_value(
    tree: str | Column, segment: str, field: int, repetition: int = 1, component: int = 1, below: int = 1, occurrence: int = 1
) -> Column:
    """One value of a :func:`message_tree`, every place counted from 1; null where the message does not go so far."""
    out = F.get(F.filter(as_col(tree), lambda s: s["name"] == segment), F.lit(occurrence - 1))["fields"]
    for place in (field, repetition, component, below):
        out = F.get(out, F.lit(place - 1))
    return out


def hl7_person(message: str | Column) -> dict[str, Column]:
    """Id (0 when it is missing, no number or too large for an INT), first two name parts, date of birth of the PID segment."""
    fields = F.split(F.nullif(F.regexp_extract(as_col(message), r"PID\|[^\r\n]*", 0), F.lit("")), r"\|")
    person = F.regexp_extract(F.get(fields, F.lit(2)), r"^\s*([+-]?\d+)\s*$", 1).try_cast("int")
    name = F.array_join(F.slice(F.split(F.get(fields, F.lit(5)), r"\^"), 1, 2), " ")
    born = F.regexp_extract(F.get(fields, F.lit(7)), r"^(\d{8})$", 1)
    iso = F.regexp_replace(born, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return {"person_id": F.coalesce(person, F.lit(0)), "name": name, "dob": iso.try_cast("date")}


def xml_value(text: str | Column, tag: str) -> Column:
    """Trimmed text of the first tag of that name, any name space and case, up to its first child; CDATA opened, comments skipped; null when absent."""
    held = F.regexp_extract(as_col(text), rf"(?is)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?(?<!/)>((?:[^<]++|<!--.*?-->|<!\[CDATA\[.*?\]\]>)*+)", 1)
    bare = F.regexp_replace(F.regexp_replace(held, r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.nullif(F.trim(bare), F.lit(""))


def xml_attribute(text: str | Column, name: str, tag: str | None = None) -> Column:
    scope = rf"<(?:\w+:)?{tag}\b[^>]*?" if tag else r"<[^>]*?"
    value = F.regexp_extract(as_col(text), rf"(?is){scope}\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.nullif(F.trim(value), F.lit(""))


def xml_identifier(text: str | Column, names: list[str], owner_tags: list[str]) -> Column:
    """First hit of: a tag of one of the names, an attribute of one of them, ``id`` on an owner tag, loose ``name: value``."""
    tries = [xml_value(text, n) for n in names]
    tries += [xml_attribute(text, n) for n in names]
    tries += [xml_attribute(text, "id", t) for t in owner_tags]
    tries += [F.nullif(F.regexp_extract(as_col(text), rf"(?i)\b{n}\b\s*[:=]\s*[\"']?(\w+)", 1), F.lit("")) for n in names]
    return F.coalesce(*tries)
