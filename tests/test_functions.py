"""Literal cases of column functions."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from recordshield.operators import quality
from recordshield.functions import checks, clean, dates, messages, rules, text
from recordshield.functions.likeness import indel_ratio, partial_ratio


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize("given", ["Ann", None])
def test_mask_covers_nulls(spark, given):
    assert value(spark, rules.apply_rule("MASK", lit(given), rules.RuleContext(mask="NAME"))) == "<<NAME>>"


@pytest.mark.parametrize(
    "given, want",
    [
        ("2021-03-04", "2021-03-14 00:00:00"),
        ("2021-03-04 10:11:12.5", "2021-03-14 10:11:12"),
        ("10:15:00", "10:15:00"),
        ("9:15 PM", "9:15 PM"),
        ("no date", None),
        ("2020-02-31", None),
        ("03/04/1980", "1980-03-14 00:00:00"),
        ("13/04/1980", "1980-04-23 00:00:00"),
        ("3-4-21", "2021-03-14 00:00:00"),
        ("3/4/85", "1985-03-14 00:00:00"),
        ("Jan 5, 2020", "2020-01-15 00:00:00"),
        ("5 March 2020", "2020-03-15 00:00:00"),
        ("20200131", "2020-02-10 00:00:00"),
        ("01312020", "2020-02-10 00:00:00"),
        ("20200131123000", "2020-02-10 12:30:00"),
        ("2020", None),
        (None, None),
    ],
)
def test_date_text_moves(spark, given, want):
    assert value(spark, dates.shift_column(lit(given), 10, True)) == want


def test_shift_there_and_back(spark):
    stamp = F.lit(datetime(2020, 2, 28, 5)).cast("timestamp_ntz")
    assert value(spark, dates.add_days(dates.add_days(stamp, 29), -29)) == datetime(2020, 2, 28, 5)


@pytest.mark.parametrize("given, want", [("03/04/1980", 1980), ("None", None), ("", None), ("1999", None)])
def test_birth_year(spark, given, want):
    assert value(spark, dates.birth_year(lit(given))) == want


@pytest.mark.parametrize(
    "given, want", [("12345-6789", "123"), ("123", "123"), ("12", "12"), ("AB123", "AB1"), ("None", None), (None, None)]
)
def test_zip(spark, given, want):
    assert value(spark, rules.apply_rule("ZIP_CODE", lit(given), rules.RuleContext())) == want


@pytest.mark.parametrize("given, want", [("202", "202"), ("202.0", "202"), (" 7 ", "7"), ("A1", "A1"), ("2.5", "2.5"), (None, None)])
def test_normalise_id(spark, given, want):
    assert value(spark, clean.normalise_id(lit(given))) == want


@pytest.mark.parametrize("given, want", [("202.00", 202), ("A1", None), ("2.5", None), ("99999999999999999999", None)])
def test_coerce_key(spark, given, want):
    assert value(spark, clean.coerce_key(lit(given))) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("seen 2021-03-04.", "seen 2021-03-14."),
        ("a 1/2/2020 b Feb 3, 2020", "a 2020-01-12 b 2020-02-13"),
        ("at 2020-01-02 03:04:05!", "at 2020-01-12 03:04:05!"),
        ("bad 02/30/2020", "bad 02/30/2020"),
        ("id 20200131", "id 20200131"),
        ("", ""),
        (None, None),
    ],
)
def test_dates_in_text(spark, given, want):
    assert value(spark, dates.shift_dates_in_text(lit(given), 10)) == want


def test_birth_date_in_text(spark):
    out = dates.dob_to_year_in_text(lit("born 03/04/1980, seen 1980-03-05"), F.lit("1980-03-04"))
    assert value(spark, out) == "born 1980, seen 1980-03-05"


def test_split_date_keeps_gaps(spark):
    moved = dates.shift_split_date(F.lit(None).cast("int"), F.lit(2), F.lit(2020), F.lit(5))
    row = spark.range(1).select(*[c.alias(n) for n, c in moved.items()]).first()
    assert (row["day"], row["month"], row["year"]) == (None, 2, 2020)


def terms(*pairs):
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("mask")) for v, m in pairs])


@pytest.mark.parametrize(
    "given, pairs, want",
    [
        ("Ann met Annabel", [("Ann", "((NAME))")], "((NAME)) met Annabel"),
        ("ANN, 'Ann' and ann@mail.org", [("Ann", "((NAME))")], "((NAME)), ((NAME)) and ann@mail.org"),
        ("Al is not Alan", [("Al", "((N))")], "((N)) is not Alan"),
        ("cost $50 (a.b)", [("$50", "$1\\x"), ("a.b", "M")], "cost $1\\x (M)"),
        ("Ann Lee and Lee", [("Ann Lee", "((FULL))"), ("Lee", "((LAST))")], "((FULL)) and ((LAST))"),
        ("Zoë and Zoëlle", [("Zoë", "((N))")], "((N)) and Zoëlle"),
        ("nothing", [("  ", "X")], "nothing"),
        (None, [("Ann", "X")], None),
    ],
)
def test_mask_values(spark, given, pairs, want):
    assert value(spark, text.mask_values(lit(given), terms(*pairs))) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("write a.b@c.org now", "write ((EMAIL)) now"),
        ("host 10.0.0.255 up", "host ((IPADDRESS)) up"),
        ("see https://x.org/a?b=1 or www.y.com", "see ((URL)) or ((URL))"),
        ("call (716) 555-0123, +1 716.555.0199", "call ((PHONE_NUMBER)), ((PHONE_NUMBER))"),
        ("order 1234567890123456", "order 1234567890123456"),
        ("license No: D1234567 ok", "((DRIVERSLICENSE)) ok"),
        ("at 12 Main Street, Spring Hill, NY 12345-6789 since", "at ((HouseNumber)) ((StreetName)), ((City)), ((State)) 123 since"),
        ("room 12 and 12345", "room 12 and 12345"),
        (None, ""),
    ],
)
def test_generic_mask(spark, given, want):
    assert value(spark, text.generic_mask(lit(given))) == want


def test_generic_mask_dates_and_custom(spark):
    out = text.generic_mask(lit("on 2021-03-04 from 1.2.3.4"), days=10, custom={"ip": lambda t, p, m: F.regexp_replace(t, p, "IP")})
    assert value(spark, out) == "on    2021-03-14    from IP"


def test_address_search_stays_quick(spark):
    """A long text full of numbers and state words, but without an address, must not backtrack for ever."""
    body = " ".join(f"{i} near in or me {i}" for i in range(3000)) + " 12345"
    assert value(spark, F.length(text.mask_address(F.lit(body)))) == len(body)


def test_replace_words(spark):
    assert value(spark, text.replace_words(lit("Old cold old@x.org"), [("old", "new")])) == "new cold old@x.org"


def test_combined_names(spark):
    names = value(spark, text.combined_names([F.lit("Ann"), F.lit(None).cast("string"), F.lit("Lee")]))
    assert names == ["annlee", "leeann", "ann", "lee"]


def test_markup(spark):
    message = '<r><DOB>03/04/1980</DOB><n:City value="Rome">Rome</n:City><zip>12345</zip><x FirstName=\'Ann\'/></r>'
    want = '<r><DOB>1980</DOB><n:City value="((City))">((City))</n:City><zip>123</zip><x FirstName="((FirstName))"/></r>'
    assert value(spark, text.mask_markup(lit(message))) == want
    assert value(spark, text.mask_markup(lit("no <City>Rome</City>"))) == "no <City>Rome</City>"


NESTED = [
    # as written, well-formed markup masked, and what the lenient way makes of broken markup
    ("<SSN><![CDATA[123-45-6789]]></SSN>", "<SSN>((SSN))</SSN>", None),
    ("<address>12 Main<br/>Springfield</address>", "<address>((ADDRESS))<br/></address>", None),
    ("<FirstName>Ann<!-- x --></FirstName>", "<FirstName>((FirstName))</FirstName>", None),
    ("<dob><![CDATA[1980-02-03]]></dob>", "<dob>1980</dob>", None),
    ("<r><dob>unknown <!-- 1980 --></dob></r>", "<r><dob>unknown <!-- 1980 --></dob></r>", None),
    ("<City>a<City>b</City>c</City>", "<City>((City))<City>((City))</City></City>", None),
    ("<Address>\n <Street>1 Way</Street>\n</Address>", "<Address>((ADDRESS))<Street>1 Way</Street>\n</Address>", None),
    ("<r><zip><![CDATA[12345 & 6]]></zip><zip>none</zip></r>", "<r><zip>123 &amp; 6</zip><zip>none</zip></r>", None),
    ("<a:LastName xmlns:a='u' value='Lee'/>", "<a:LastName xmlns:a='u' value=\"((LastName))\"/>", None),
    ("<r a='x>y'><?p <City>?><City/><City></City></r>", "<r a='x>y'><?p <City>?><City/><City>((City))</City></r>", None),
    ("<r><City>x</r>", "<r><City>x</r>", "<r><City>((City))</r>"),
    ("<r><City>x", "<r><City>x", "<r><City>((City))"),
    ("<r><City>x</Cit", "<r><City>x</Cit", "<r><City>((City))"),
    ("<p><FirstName>Ann<br>Lee</FirstName><q>z", "<p><FirstName>Ann<br>Lee</FirstName><q>z", "<p><FirstName>((FirstName))<br></FirstName><q>z"),
    ("<City>x</City><City>y</City>", "<City>x</City><City>y</City>", "<City>((City))</City><City>((City))</City>"),
    ("<r>a < b <City>Rome</City></r>", "<r>a < b <City>Rome</City></r>", "<r>a < b <City>((City))</City></r>"),
    ("", "", None),
    (None, None, None),
]


def test_markup_is_followed_by_its_tags(spark):
    rows = spark.createDataFrame([(n, r[0]) for n, r in enumerate(NESTED)], "n int, t string")
    got = rows.select("n", text.mask_markup("t", broken="keep").alias("kept"), text.mask_markup("t").alias("masked")).orderBy("n").collect()
    assert [(r["kept"], r["masked"]) for r in got] == [(exact, lenient or exact) for _, exact, lenient in NESTED]


def test_markup_that_is_kept_when_broken_is_read_once(spark, monkeypatch):
    read, steps = [], text._markup_steps
    monkeypatch.setattr(text, "_markup_steps", lambda tokens: read.append(1) or steps(tokens))
    assert value(spark, text.mask_markup(lit("<r><City>x</City></r>"), broken="keep")) == "<r><City>((City))</City></r>"
    assert len(read) == 1


def test_markup_of_many_tags(spark):
    many = "<r>" + "".join(f"<e{n}><City>x{n}</City>y</e{n}>" for n in range(3000)) + "</r>"
    want = "<r>" + "".join(f"<e{n}><City>((City))</City>y</e{n}>" for n in range(3000)) + "</r>"
    assert value(spark, text.mask_markup(lit(many))) == want


def test_own_id(spark):
    assert value(spark, text.own_id_to_surrogate(lit("id 12, 120, x12."), F.lit(12), F.lit(900))) == "id 900, 120, x900."


def test_hl7(spark):
    message = lit("MSH|a\rPID|1|77|X||Lee^Ann^M||19800304|\r")
    person = messages.hl7_person(message)
    row = spark.range(1).select(*[c.alias(n) for n, c in person.items()]).first()
    assert row.asDict() == {"person_id": 77, "name": "Lee Ann", "dob": date(1980, 3, 4)}
    assert value(spark, messages.hl7_field(lit("PID|1|77|X"), "PID", 3)) == "77"


def test_xml_value(spark):
    assert value(spark, messages.xml_value(lit("<a:Id x='1'><![CDATA[ 5 ]]></a:Id>"), "id")) == "5"
    assert value(spark, messages.xml_value(lit("<b>5</b>"), "id")) is None
    assert value(spark, messages.xml_value(lit("<id>outer<id>in</id></id>"), "id")) == "outer"
    assert value(spark, messages.xml_value(lit("<id/><n:Id><!-- 4 --><![CDATA[ 7]]>8<x/>9</n:Id>"), "id")) == "78"


def test_checks(spark):
    good = checks.all_hold(checks.CHECKS["STATIC_OFFSET"](F.lit(date(2020, 2, 4)), F.lit(date(2020, 1, 1))))
    assert value(spark, good) is True
    assert value(spark, checks.all_hold(checks.CHECKS["STATIC_OFFSET"](F.lit(None).cast("date"), F.lit(date(2020, 1, 1))))) is False
    assert value(spark, checks.all_hold(checks.CHECKS["ZIP_CODE"](lit(None)))) is True


def test_own_rule_can_be_added(spark):
    rules.register_rule("SHOUT", "string")(lambda c, ctx: F.upper(c))
    assert value(spark, rules.apply_rule("shout", lit("a"), rules.RuleContext())) == "A"
    with pytest.raises(KeyError):
        rules.apply_rule("NO_SUCH", lit("a"), rules.RuleContext())


def test_ratios():
    assert indel_ratio("abc", "abc") == 100
    assert round(indel_ratio("johnson", "jonson"), 3) == round(200 * 6 / 13, 3)
    assert indel_ratio("abc", "xyz") == 0
    assert partial_ratio("ann", "joanna smith") == 100


TIMED = {
    "01/02/2020 10:30:00": "2020-01-02 10:30:00", "1/2/2020 3:04 PM": "2020-01-02 15:04:00", "01/02/2020 12:05 am": "2020-01-02 00:05:00",
    "2020-01-02T10:30:00Z": "2020-01-02 10:30:00", "Jan 2, 2020 10:30": "2020-01-02 10:30:00", "2020-01-02 10:30:00 PM": "2020-01-02 22:30:00",
    "2 January 2020, 10:30:15.5": "2020-01-02 10:30:15", "01/02/20 10:30": "2020-01-02 10:30:00", "2020-01-02 10:30:00.123456789 +02:00": "2020-01-02 10:30:00",
    "13-2-2020 00:00": "2020-02-13 00:00:00", "20200102 10:30": "2020-01-02 10:30:00", "01/02/2020 25:00": None, "01/02/2020 10:61": None, "10:30": None,
    "room 12 10:30": None, "01/02/2020 13:00 PM": None, "2020-01-02": "2020-01-02 00:00:00",
}


def test_dates_with_times(spark):
    from recordshield.functions.dates import parse_date

    df = spark.createDataFrame([(t,) for t in TIMED], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", F.substring(parse_date("t").cast("string"), 1, 19).alias("d")).collect()}
    assert got == TIMED


def test_letters_of_any_script_match_in_any_case(spark):
    """Whatever the pattern holds equal folds to one form, for every letter that has another case."""
    pairs = set()
    for n in range(0x80, 0x1E944):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        pairs |= {(c, x) for x in (c.lower(), c.upper(), c.swapcase()) if x != c and len(x) == 1}
    pairs |= {("İ", "i"), ("ı", "i"), ("ſ", "s"), ("K", "k"), ("ẞ", "ß"), ("ς", "σ"), ("Σ", "ς")}
    rows = spark.createDataFrame([(f"q{a}q", f"Q{b}Q") for a, b in sorted(pairs)], "a string, b string")
    terms = F.array(F.struct(F.col("a").alias("value"), F.lit("#").alias("mask")))
    seen = rows.select("a", "b", text.mask_values("b", terms).alias("m"), (text.fold(F.col("a")) == text.fold(F.col("b"))).alias("same")).collect()
    assert len(seen) > 2000
    assert not [r for r in seen if r["m"] == "#" and not r["same"]]
    assert {r["a"]: r["m"] for r in seen if r["b"] in ("QÜQ", "QÉQ", "QÖQ", "QЯQ", "QΣQ")} and all(r["m"] == "#" for r in seen if r["b"] in ("QÜQ", "QÉQ", "QÖQ", "QЯQ"))


def test_values_with_letters_beyond_ascii(spark):
    terms = F.array(*[F.struct(F.lit(v).alias("value"), F.lit("((NAME))").alias("mask")) for v in ("Müller", "José", "Özil", "Li")])
    assert value(spark, text.mask_values(lit("MÜLLER, JOSÉ and özil met LI; Müllerin, éLi stay"), terms)) == "((NAME)), ((NAME)) and ((NAME)) met ((NAME)); Müllerin, éLi stay"
    assert value(spark, quality.leaked_values(lit("MÜLLER left"), terms)) == ["Müller"]
    assert value(spark, text.replace_words(lit("ÉCOLE x"), [("école", "school")])) == "school x"
    assert value(spark, text.mask_combined_names(lit("JOSÉÖZIL"), [lit("José"), lit("Özil")], "#")) == "#"
    assert value(spark, quality.occurrences(lit("École éCOLE x"), "école")) == 2


# --- message trees ----------------------------------------------------------------------------------------------------


def test_message_tree(spark):
    texts = {
        "usual": "MSH|^~\\&|A|B\rPID|1||7^^^X&Y~8|a\\F\\b\\E\\F\\E\\c|\\Z9\\|tail\\x\r\n\r\nPID|2",
        "own": "MSH#*+!%#A\nPID#x|y#1+2*3%4",
        "short": "MSH|^|A\rPID|1~2^3&4",
        "headless": "PID|1^2",
        "empty": "",
        "null": None,
    }
    df = spark.createDataFrame(list(texts.items()), "n string, m string")
    got = {r["n"]: r["t"] for r in df.select("n", messages.message_tree("m").alias("t")).collect()}
    usual = got["usual"]
    assert [s["name"] for s in usual] == ["MSH", "PID", "PID"]
    assert [f[0][0][0] for f in usual[0]["fields"]] == ["|", "^~\\&", "A", "B"]
    assert usual[1]["fields"] == [
        [[["1"]]], [[[""]]], [[["7"], [""], [""], ["X", "Y"]], [["8"]]], [[["a|b\\F\\c"]]], [[["\\Z9\\"]]], [[["tail\\x"]]],
    ]
    assert got["own"][1]["fields"] == [[[["x|y"]]], [[["1"]], [["2"], ["3", "4"]]]]
    assert got["short"][1]["fields"] == [[[["1"]], [["2"], ["3", "4"]]]]
    assert got["headless"][0]["fields"] == [[[["1"], ["2"]]]]
    assert got["empty"] == [] and got["null"] is None


def test_values_behind_their_first_letters_match_as_a_plain_list(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("aakkKKſsSİiıßẞé.$\\EQ-1") for _ in range(n))
    data = []
    for k in range(150):
        letters = word(3) if k % 3 else ""
        values = sorted({(rnd.choice(letters) if letters else "") + word(rnd.randrange(3, 6)) for _ in range(14)}, key=len, reverse=True)
        data.append((values, " ".join(rnd.choice([word(3), rnd.choice(values), rnd.choice(values).swapcase() + rnd.choice(["", "@", "'", "a"])]) for _ in range(40))))
    rows = spark.createDataFrame(data, "v array<string>, t string")
    quoted = F.array_join(F.transform("v", text.quote_pattern), "|")
    plain = F.concat(F.lit(text.ANY_CASE + text.LEFT_EDGE + r"(?:['\"/])?(?:"), quoted, F.lit(r")(?:['\"])?" + text.RIGHT_EDGE))
    seen = rows.select(F.regexp_replace("t", text.values_pattern(F.col("v")), "#").alias("got"), F.regexp_replace("t", plain, "#").alias("want"), text.values_pattern(F.col("v")).alias("p")).collect()
    assert [r["got"] for r in seen] == [r["want"] for r in seen] and sum("#" in r["got"] for r in seen) > 140
    assert sum(r["p"].count("(?:") > 2 for r in seen) > 50
