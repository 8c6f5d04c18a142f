"""Masking inside text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.dates import shift_dates_in_text
from ..operators import notes as N
from ..operators.joins import PatientKey, map_patient, resolve_identity
from ..operators.mapping import pii_rows
from ..plans.notes import NotesOptions, mask_notes, mask_row_notes
from ..session import once, store
from .base import NOTES_SQL, PATIENTS_SQL, notes, patients, query, table, text_table

NOTES = f"WITH pmap AS ({PATIENTS_SQL}), notes AS ({NOTES_SQL})"


def owned_notes(spark, sf, known_only=True):
    mapped = map_patient(notes(spark, sf), patients(spark, sf), [PatientKey("custkey", "custkey")])
    owned = resolve_identity(mapped, ["custkey"], 34)
    return owned.where("sur_patient_id IS NOT NULL") if known_only else owned


def pii(spark, sf):
    roles = {"c_name": "name", "c_mktsegment": "segment"}
    return pii_rows(table(spark, sf, "customer"), roles, patients(spark, sf), "c_custkey", "custkey")


NAME_MASK = {"name": "((NAME))"}


@query(
    "x1_mask_patient_values",
    f"""
{NOTES}
SELECT note_id, CASE WHEN sur_patient_id IS NULL THEN note ELSE regexp_replace(note, 'Customer#[0-9]+', '((NAME))') END AS note
FROM notes LEFT JOIN pmap USING (custkey)
""",
)
def x1(spark, sf):
    owned = owned_notes(spark, sf, known_only=False)
    return N.mask_patient_values(owned, "note_id", "note", N.pii_terms(pii(spark, sf), NAME_MASK)).select("note_id", "note")


@query(
    "x1_mask_patient_values_many_terms",
    f"""
{NOTES}
SELECT note_id, regexp_replace(regexp_replace(regexp_replace(note, 'Customer#[0-9]+', '((NAME))'), '716-555-[0-9]+', '((PHONE))'), 'order [0-9]+', '((ORDER))') AS note
FROM notes JOIN pmap USING (custkey)
""",
)
def x1_many(spark, sf):
    """Every person with more values than the limit: each order number of a person is a value of that person."""
    owned = owned_notes(spark, sf)
    found = {"phone": r"716-555-\d+", "order": r"order \d+"}
    values = pii(spark, sf).unionByName(_in_notes(owned, found), allowMissingColumns=True)
    terms = N.pii_terms(values, {"name": "((NAME))", "phone": "((PHONE))", "order": "((ORDER))"})
    return N.mask_patient_values(owned, "note_id", "note", terms, limit=2).select("note_id", "note")


def _in_notes(owned, found):
    """The first match of each pattern in a note as a value of the note's person; all patterns in one pass over the notes."""
    return owned.select("sur_patient_id", *[F.regexp_extract("note", pattern, 0).alias(role) for role, pattern in found.items()])


#: Letters whose capital is one letter in every library, as the SQL folds with its own function.
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyzäöüéèêçñóíáú", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ"
_BEYOND = "[A-Za-z]*[äöüéèêçñóíáúÄÖÜÉÈÊÇÑÓÍÁÚ][A-Za-zäöüéèêçñóíáúÄÖÜÉÈÊÇÑÓÍÁÚ]{3,}"
_NEEDED = "[äöüéèêçñóíáúÄÖÜÉÈÊÇÑÓÍÁÚ]"


@query(
    "x1_letters_of_any_case",
    rf"""
WITH d AS (SELECT doc_id, translate(regexp_replace(text, '[''"/@]', ' ', 'g'), '{_SMALL}', '{_LARGE}') AS note,
  list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[''"/@]', ' ', 'g'), '{_BEYOND}'), lambda x: lower(x)))[1:1] AS one,
  list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[''"/@]', ' ', 'g'), '{_BEYOND}'), lambda x: lower(x))) AS every FROM documents)
SELECT doc_id, way, array_to_string(list_transform(regexp_extract_all(note, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'),
  lambda x: CASE WHEN list_contains(every, lower(x)) THEN '((NAME))' ELSE x END), '') AS note
FROM d, (VALUES ('list'), ('lookup')) v(way)
""",
)
def x1_any_case(spark, sf):
    """Each text in capitals, its words with letters beyond ASCII as values in small ones; both ways of bringing values to notes."""
    plain = F.regexp_replace("text", "['\"/@]", " ")
    # where they had to be dealt out, that is done once for the values and both ways
    docs = once(text_table(spark, sf, "documents").select("doc_id", plain.alias("text")), "texts")
    # texts of plain letters hold none of them
    beyond = docs.where(F.col("text").rlike(_NEEDED))
    values = beyond.select(F.col("doc_id").alias("sur_patient_id"), F.explode(F.regexp_extract_all("text", F.lit(f"({_BEYOND})"), F.lit(1))).alias("word"))
    # both ways read them
    terms = store(N.pii_terms(values.select("sur_patient_id", F.lower("word").alias("name")), NAME_MASK), "words")
    notes = docs.select("doc_id", F.col("doc_id").alias("sur_patient_id"), F.translate("text", _SMALL, _LARGE).alias("note"))

    def way(name, limit):
        done = N.mask_patient_values(notes, "doc_id", "note", terms, limit=limit)
        return done.select("doc_id", F.lit(name).alias("way"), "note")

    return way("list", 1_000_000).unionByName(way("lookup", 0))


@query(
    "x1_two_masks",
    f"""
{NOTES}
SELECT note_id, regexp_replace(regexp_replace(regexp_replace(note, 'Customer#[0-9]+', '((NAME))'), '716-555-[0-9]+', '((PHONE))'), 'order [0-9]+', '((ORDER))') AS note
FROM notes JOIN pmap USING (custkey)
""",
)
def x1_two_masks(spark, sf):
    """Values inside other values under other masks, and a value that is the word of a mask: the longest wins, masks stay as they are."""
    owned = owned_notes(spark, sf)
    found = {"phone": r"716-555-\d+", "order": r"order \d+", "word": "order", "role": "Customer", "part": "716"}
    values = pii(spark, sf).unionByName(_in_notes(owned, found), allowMissingColumns=True)
    values = values.withColumn("mask", F.lit("name"))
    masks = {"word": "((A))", "role": "((B))", "part": "((C))", "mask": "((D))", "name": "((NAME))", "order": "((ORDER))", "phone": "((PHONE))"}
    terms = N.pii_terms(values, masks)
    return N.mask_patient_values(owned, "note_id", "note", terms, limit=6).select("note_id", "note")


@query(
    "x2_mask_near_values",
    f"{NOTES} SELECT note_id, regexp_replace(note, 'Customer#[0-9]+', '((NAME))') AS note FROM notes JOIN pmap USING (custkey)",
)
def x2(spark, sf):
    misspelt = F.regexp_replace("note", "Customer#", "Custmer ")
    owned = owned_notes(spark, sf).withColumn("note", F.when(F.year("noted_at") < 1998, misspelt).otherwise(F.col("note")))
    return N.mask_near_values(owned, "note_id", "note", N.pii_terms(pii(spark, sf), NAME_MASK)).select("note_id", "note")


@query(
    "x3_birth_date_to_year",
    f"""
{NOTES}, births AS (SELECT DISTINCT o_custkey AS custkey, CAST(o_orderdate AS DATE) AS dob FROM orders WHERE o_orderstatus = 'F')
SELECT note_id, CASE WHEN b.dob IS NULL THEN note ELSE regexp_replace(note, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', strftime(dob, '%Y')) END AS note
FROM notes n JOIN pmap USING (custkey) LEFT JOIN births b ON n.custkey = b.custkey AND CAST(noted_at AS DATE) = b.dob
""",
)
def x3(spark, sf):
    people = patients(spark, sf)
    born = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    births = born.join(people, born["o_custkey"] == people["custkey"]).select("sur_patient_id", F.col("o_orderdate").alias("dob"))
    return N.mask_birth_dates(owned_notes(spark, sf), "note", births).select("note_id", "note")


@query(
    "x4_combined_names",
    """
SELECT c_custkey, 'met ((NAME)) or ((NAME)), not ' || c_mktsegment || 'S of ((NAME)).' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
)
def x4(spark, sf):
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"])
    text = F.concat(
        F.lit("met "),
        F.lower(F.concat("c_mktsegment", "n_name")),
        F.lit(" or "),
        F.concat("n_name", "c_mktsegment"),
        F.lit(", not "),
        F.col("c_mktsegment"),
        F.lit("S of "),
        F.col("n_name"),
        F.lit("."),
    )
    return rows.select("c_custkey", X.mask_combined_names(text, ["c_mktsegment", "n_name"], "((NAME))").alias("note"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(patterns: list[str]) -> str:
    return _re2(P.any_of(patterns))


CONTACT_SQL = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{_any([P.EMAIL])}', '((EMAIL_ID))', 'g'), "
    f"'{_any(P.PHONES)}', '((PHONE_NUMBER))', 'g'), '{_any([P.SSN])}', '((SSN))', 'g')"
)


@query("x5_contact_patterns", f"SELECT doc_id, {CONTACT_SQL} AS text FROM documents")
def x5(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", X.mask_regexes("text", X.CONTACT_RULES).alias("text"))


# no look-around in RE2: the neighbours of a phone number are taken along and put back, twice for shared neighbours
_PHONE_SQL = r"(^|[^0-9])(?:(?:\+1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4})($|[^0-9])"
_ADDRESS_SQL = (
    r"(?i)\d+[A-Za-z]{0,3}[\s,]*[A-Za-z0-9\s.,''-]+[,\s]+[A-Za-z\s]+?[,\s]+(?:" + "|".join(P.US_STATES) + r")[\s,]*(\d{3})\d{2}(?:-\d{4})?"
)


def _generic_sql(column: str) -> str:
    out = f"trim(regexp_replace(coalesce({column}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
    for kind, found in (("ip", [P.IPV4]), ("email", [P.EMAIL]), ("url", P.URLS)):
        out = f"regexp_replace({out}, '{_any(found)}', '{P.MASKS[kind]}', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{_PHONE_SQL}', '\\1{P.MASKS['phone']}\\2', 'g')"
    out = f"regexp_replace({out}, '{_any(P.DRIVER_LICENSES)}', '{P.MASKS['driver_license']}', 'g')"
    return f"regexp_replace({out}, '{_ADDRESS_SQL}', '((HouseNumber)) ((StreetName)), ((City)), ((State)) \\1', 'g')"


@query("x6_generic_mask_documents", f"SELECT doc_id, {_generic_sql('text')} AS text FROM documents")
def x6(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", X.generic_mask("text").alias("text"))


@query("x6_generic_mask_pages", f"SELECT page_id, {_generic_sql('html')} AS html FROM pages")
def x6_pages(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", X.generic_mask("html").alias("html"))


@query("x6_generic_mask_conversations", f"SELECT conv_id, turn, {_generic_sql('text')} AS text FROM conversations")
def x6_conversations(spark, sf):
    return text_table(spark, sf, "conversations").select("conv_id", "turn", X.generic_mask("text").alias("text"))


@query(
    "x7_shift_dates_in_text",
    f"""
{NOTES}
SELECT note_id, replace(note, strftime(noted_at, '%Y-%m-%d'), strftime(noted_at + to_days(day_offset), '%Y-%m-%d'))
  || ' Again on ' || strftime(noted_at + to_days(day_offset), '%Y-%m-%d') || ', then ' || strftime(noted_at + to_days(day_offset), '%Y-%m-%d')
  || ' and ' || strftime(noted_at + to_days(day_offset), '%Y-%m-%d %H:%M:%S') || '; no 2021-13-40.' AS note
FROM notes JOIN pmap USING (custkey)
""",
)
def x7(spark, sf):
    d = "noted_at"
    text = F.concat(
        F.col("note"),
        F.lit(" Again on "),
        F.date_format(d, "M/d/yyyy"),
        F.lit(", then "),
        F.date_format(d, "MMMM d, yyyy"),
        F.lit(" and "),
        F.col(d).cast("string"),
        F.lit("; no 2021-13-40."),
    )
    return owned_notes(spark, sf).select("note_id", shift_dates_in_text(text, "day_offset").alias("note"))


@query(
    "x8_address_mask",
    """
SELECT c_custkey, 'Home: ((HouseNumber)) ((StreetName)), ((City)), ((State)) ' || substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 1, 3) || '; mail to ((POBox)).' AS note FROM customer
""",
)
def x8(spark, sf):
    cust = table(spark, sf, "customer")
    states = F.array(*[F.lit(s) for s in P.US_STATES])
    text = F.concat(
        F.lit("Home: "),
        (F.col("c_custkey") + 1).cast("string"),
        F.lit(" Main Street, Spring Hill, "),
        F.get(states, (F.col("c_custkey") % len(P.US_STATES)).cast("int")),
        F.lit(" "),
        F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"),
        F.when(F.col("c_acctbal") > 0, F.lit("-1234")).otherwise(F.lit("")),
        F.lit("; mail to P.O. Box "),
        F.col("c_custkey").cast("string"),
        F.lit("."),
    )
    return cust.select("c_custkey", X.mask_po_box(X.mask_address(text)).alias("note"))


@query(
    "x9_fixed_replacements",
    "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])the', '\\1((ART))', 'g'), '(?i)(^|[^A-Za-z0-9_])of', '\\1((PREP))', 'g') AS text FROM documents",
)
def x9(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", X.replace_words("text", [("the", "((ART))"), ("of", "((PREP))")]).alias("text"))


_OWN = "'(^|[^0-9])' || note_id || '($|[^0-9])'"


@query(
    "x10_own_id_to_surrogate",
    f"""
{NOTES}
SELECT note_id, regexp_replace(regexp_replace(note, {_OWN}, '\\1' || (90000001 + note_id) || '\\2', 'g'), {_OWN}, '\\1' || (90000001 + note_id) || '\\2', 'g') AS note FROM notes
""",
)
def x10(spark, sf):
    return notes(spark, sf).select("note_id", X.own_id_to_surrogate("note", "note_id", F.col("note_id") + 90000001).alias("note"))


_TAGS = {"title": "((TITLE))", "lang": "((LANG))"}


def _tag_sql(column: str, tags: dict[str, str]) -> str:
    out = column
    for tag, mask in tags.items():
        whole = rf"(?s)(<(?:\w+:)?{tag}(?:\s[^>]*)?>)[^<]*(</)"
        out = f"regexp_replace({out}, '{whole}', '\\1{mask}\\2', 'g')"
        out = f"regexp_replace({out}, '(?i)(<[^>]*\\s{tag}=)(?:\"[^\"]*\"|''[^'']*'')', '\\1\"{mask}\"', 'g')"
    return out


@query("x11_markup_pages", f"SELECT page_id, {_tag_sql('html', _TAGS)} AS html FROM pages")
def x11(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", X.mask_markup("html", _TAGS).alias("html"))


def _record(dob, name, zip_code, extra):
    return F.concat(
        F.lit('<?xml version="1.0"?><record><DOB>'), dob, F.lit('</DOB><FirstName value="'), name, F.lit('">'), name,
        F.lit("</FirstName><h:zipCode>"), zip_code, F.lit("</h:zipCode><other>"), extra, F.lit("</other></record>"),
    )


@query(
    "x11_markup_records",
    """
SELECT o_orderkey, '<?xml version="1.0"?><record><DOB>' || strftime(o_orderdate, '%Y') || '</DOB><FirstName value="((FirstName))">((FirstName))</FirstName><h:zipCode>'
  || substr(lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0'), 1, 3) || '</h:zipCode><other>' || o_orderpriority || '</other></record>' AS message FROM orders
""",
)
def x11_records(spark, sf):
    zips = F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")
    message = _record(F.date_format("o_orderdate", "MM/dd/yyyy"), F.col("o_custkey").cast("string"), zips, F.col("o_orderpriority"))
    return text_table(spark, sf, "orders").select("o_orderkey", X.mask_markup(message).alias("message"))


_NESTED_MASKS = {"FirstName": "((FirstName))", "address": "((ADDRESS))", "City": "((City))", "SSN": "((SSN))"}


@query(
    "x11_nested_markup",
    """
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS c, o_orderdate AS d FROM orders)
SELECT o_orderkey AS id,
  CASE WHEN p = '1-URGENT' THEN '<r><FirstName>' || c || '<!-- open -->'
       WHEN p = '2-HIGH' THEN '<r><dob>not known<!-- ' || c || ' --></dob><City a="1">((City))<City>((City))</City><i/></City></r>'
       WHEN s = 'F' THEN '<?xml version="1.0"?><n:r xmlns:n="u"><n:FirstName>((FirstName))</n:FirstName><dob>' || year(d) || '</dob><note>' || p || '</note></n:r>'
       WHEN s = 'O' THEN '<r><address type="a>b">((ADDRESS))<br/><b>' || c || '</b></address><zip>123 &amp; 456</zip><SSN>((SSN))</SSN></r>'
       ELSE '<r><!-- <City>' || c || '</City> --><City>((City))</City><other><![CDATA[<City>' || c || '</City>]]></other></r>' END AS message FROM o
UNION ALL SELECT page_id, '<r><SSN>((SSN))</SSN><body>' || 'kept</body></r>' FROM pages
""",
)
def x11_nested(spark, sf):
    o = text_table(spark, sf, "orders")
    c, p, s = F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")
    day, note = F.date_format("o_orderdate", "MM/dd/yyyy"), p

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    cut = text("<r><FirstName>", c, "<!-- open -->")
    unread = text("<r><dob>not known<!-- ", c, ' --></dob><City a="1">', c, "<City><![CDATA[", c, "]]></City> and ", c, "<i/> ", c, "</City></r>")
    data = text('<?xml version="1.0"?><n:r xmlns:n="u"><n:FirstName><!-- ', c, " --><![CDATA[", c, " <x> & ]]> ", c, "</n:FirstName><dob> <![CDATA[", day)
    data = text(data, "]]></dob><note>", note, "</note></n:r>")
    mixed = text('<r><address type="a>b">', c, "<br/>", c, "<b>", c, "</b>", c, "</address><zip><![CDATA[12345 & 45678]]></zip><SSN>", c, "<!-- ", c, " --></SSN></r>")
    inert = text("<r><!-- <City>", c, "</City> --><City>", c, "</City><other><![CDATA[<City>", c, "</City>]]></other></r>")
    message = F.when(p == "1-URGENT", cut).when(p == "2-HIGH", unread).when(s == "F", data).when(s == "O", mixed).otherwise(inert)
    pages = text_table(spark, sf, "pages")
    page = text("<r><SSN><![CDATA[", F.col("html"), "]]></SSN><body>kept</body></r>")
    both = o.select(F.col("o_orderkey").alias("id"), message.alias("message")).unionByName(pages.select(F.col("page_id").alias("id"), page.alias("message")))
    return both.select("id", X.mask_markup("message", _NESTED_MASKS, broken="keep").alias("message"))


@query("x12_tag_mask_by_config", f"SELECT page_id, {_tag_sql('html', {'a': '((LINK))', 'li': '((ITEM))'})} AS html FROM pages")
def x12(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", X.mask_tags("html", {"a": "((LINK))", "li": "((ITEM))"}).alias("html"))


@query(
    "x13_spaced_values",
    """
SELECT c_custkey, 'plan ((PLAN)) card ' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN '((CARD))' ELSE CAST(c_custkey AS VARCHAR) END || ' (' || c_mktsegment || ')' AS note FROM customer
""",
)
def x13(spark, sf):
    text = F.concat(
        F.lit("plan "), "c_mktsegment", F.lit(" card "), F.col("c_custkey").cast("string"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")")
    )
    masked = X.mask_spaced_values(text, [("c_mktsegment", "((PLAN))", 0), ("c_custkey", "((CARD))", 3)])
    return table(spark, sf, "customer").select("c_custkey", masked.alias("note"))


def _dictionary(spark, sf):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"([{X.WORD}]{{8,}})"), F.lit(1)))
    return table(spark, sf, "benchmark").select(words.alias("value")).distinct().withColumn("mask", F.lit("((TERM))"))


@query(
    "x14_dictionary_mask",
    rf"""
WITH dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([{X.WORD}]{{8,}})', 1)) AS w FROM benchmark),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([{X.WORD}]+)', 1)) AS w FROM documents)
SELECT d.doc_id, count(dict.w) AS masked FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN dict ON words.w = dict.w GROUP BY 1
""",
)
def x14(spark, sf):
    masked = N.mask_dictionary(text_table(spark, sf, "documents"), "doc_id", "text", _dictionary(spark, sf))
    count = F.size(F.split("text", r"\(\(TERM\)\)", -1)) - 1
    return masked.select("doc_id", count.cast("bigint").alias("masked"))


FACILITIES = ["Northgate", "Lake View"]


@query(
    "x15_row_notes_generic_first",
    f"""
{NOTES}
SELECT note_id, 'at ((FacilityLocation)) ((NAME))' || regexp_replace(regexp_replace(regexp_replace(note, 'Customer#[0-9]+', ''), '716-555-[0-9]+', '((PHONE_NUMBER))'), 'u[0-9]+@mail.example.org', '((EMAIL))') AS note FROM notes
""",
)
def x15(spark, sf):
    named = notes(spark, sf).withColumns(
        {"first": F.lit("Ann"), "last": F.lit("Lee"), "day_offset": F.lit(10)}
    )
    text = F.concat(F.lit("at Lake View AnnLee"), F.regexp_replace("note", r"Customer#\d+", ""))
    options = NotesOptions(facilities=FACILITIES)
    return mask_row_notes(named.withColumn("note", text), "note", ["generic", "pii"], ["first", "last"], "((NAME))", options).select("note_id", "note")


@query(
    "x16_row_pii_mask",
    f"""
{NOTES}
SELECT note_id, regexp_replace(regexp_replace(regexp_replace(note, 'Customer#[0-9]+', '((NAME))'), '716-555-[0-9]+', '((PHONE_NUMBER))'), 'u[0-9]+@mail.example.org', '((EMAIL_ID))')
  || ' plan' AS note FROM notes
""",
)
def x16(spark, sf):
    named = notes(spark, sf).select(
        "note_id", F.concat("note", F.lit(" scheme")).alias("note"), F.regexp_extract("note", r"^\S+", 0).alias("name"), F.lit("").alias("middle")
    )
    options = NotesOptions(replacements=[("scheme", "plan")])
    return mask_row_notes(named, "note", ["pii"], ["name", "middle"], "((NAME))", options).select("note_id", "note")


@query(
    "x17_entities_from_patterns",
    f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{_any([P.EMAIL])}', '<EMAIL>', 'g'), '{_any([P.IPV4])}', '<IP>', 'g') AS text FROM documents
""",
)
def x17(spark, sf):
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    found = N.find_entities(docs, "doc_id", "text", {"EMAIL": P.any_of([P.EMAIL]), "IP": P.any_of([P.IPV4]), "YEAR": r"\b(?:19|20)\d\d\b"})
    return N.anonymise_entities(docs, "doc_id", "text", found, 31, ignored=["YEAR"])


@query(
    "x17_entities_persons_and_dates",
    f"""
{NOTES}
SELECT note_id, regexp_replace(replace(note, strftime(noted_at, '%Y-%m-%d'),
  CASE WHEN year(noted_at) = 1998 THEN '1998' ELSE strftime(noted_at + to_days(day_offset), '%Y-%m-%d') END), 'Customer#[0-9]+', '<PERSON>') AS note
FROM notes JOIN pmap USING (custkey)
""",
)
def x17_persons(spark, sf):
    docs = owned_notes(spark, sf).select(
        "note_id", "note", "day_offset", F.regexp_extract("note", r"^\S+", 0).alias("name"),
        F.when(F.year("noted_at") == 1998, F.col("noted_at")).alias("dob"),
    )
    found = N.find_entities(docs, "note_id", "note", {"PERSON": r"Customer#\d+|mail", "DATE": P.NOTE_DATE})
    masked = N.anonymise_entities(docs, "note_id", "note", found, "day_offset", name="name", dob="dob")
    return masked.select("note_id", "note")


@query(
    "x18_note_steps",
    f"""
{NOTES}
SELECT note_id, regexp_replace(regexp_replace(regexp_replace(replace(note, strftime(noted_at, '%Y-%m-%d'), '   ' || strftime(noted_at + to_days(day_offset), '%Y-%m-%d') || '   '),
  'Customer#[0-9]+', '((NAME))'), '716-555-[0-9]+', '((PHONE_NUMBER))'), 'u[0-9]+@mail.example.org', '((EMAIL_ID))') AS note
FROM notes JOIN pmap USING (custkey)
""",
)
def x18(spark, sf):
    options = NotesOptions(pii=pii(spark, sf), masks={"name": "((NAME))"}, combine=(("segment", "name"), "((NAME))"))
    owned = owned_notes(spark, sf).withColumn("note", F.concat(F.lit("  "), F.regexp_replace("note", " call ", "\n\tcall ")))
    return mask_notes(owned, "note_id", "note", options).select("note_id", "note")
