"""Masking of free text by tables: the person's own values, a dictionary, or found entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import let
from ..functions.dates import add_days, parse_date, rewrite_dates
from ..functions.likeness import name_likeness, near_terms
from ..functions.text import ANY_CASE, WORD, WORD_BREAK, compiled_terms, fold, mask_compiled, mask_values
from ..session import is_scan, once, store
from ..sources.scan import row_tasks

HITS = T.ArrayType(
    T.StructType([T.StructField("place", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("mask", T.StringType())])
)


def pii_terms(pii: DataFrame, masks: dict[str, str], patient: str = "sur_patient_id", least: int = 1) -> DataFrame:
    """(patient, value, mask), one row per distinct value of a person. Nulls and null words are no values."""
    present = {c: m for c, m in masks.items() if c in pii.columns}
    # masks by their rank: numbers are aggregated by hash, texts would be sorted
    ranked = sorted(set(present.values()))
    pairs = F.array(*[F.struct(F.trim(F.col(c)).alias("value"), F.lit(ranked.index(m)).alias("rank")) for c, m in present.items()])
    long = pii.select(patient, F.explode(pairs).alias("t")).select(patient, "t.value", "t.rank")
    real = F.col("value").isNotNull() & ~F.lower("value").isin("", "none", "null", "nan") & (F.length("value") >= least)
    found = long.where(real).groupBy(patient, "value").agg(F.min("rank").alias("rank"))
    return found.select(patient, "value", F.get(F.array(*[F.lit(m) for m in ranked]), F.col("rank")).alias("mask"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(rf"([{WORD}]+)"), F.lit(1))


def _grams(text: Column, most: int) -> Column:
    """Runs of 1..most words, one for each place."""

    def of_size(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
            F.array().cast("array<string>")
        )

    def runs(words: Column) -> Column:
        return F.concat(words, *[of_size(words, n) for n in range(2, most + 1)])

    return let(_words(text), runs)


def _head(value: Column, most: int) -> Column:
    """The key a value is looked up by: its first words; a value without any, its first character."""
    return let(_words(value), lambda words: _key(value, words, most))


def _key(value: Column, words: Column, most: int) -> Column:
    first = F.array_join(F.slice(words, 1, most), " ")
    return F.xxhash64(F.when(F.size(words) > 0, first).otherwise(F.concat(F.lit("\0"), F.substring(F.trim(value), 1, 1))))


def _signs(text: Column) -> Column:
    """Distinct characters that are neither white space nor part of a word."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([^{WORD}\s])"), F.lit(1)))


def _longest_first(terms: Column) -> Column:
    return F.array_sort(
        terms,
        lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"]))
        .when(a["value"] < b["value"], -1)
        .when(a["value"] > b["value"], 1)
        .otherwise(0),
    )


#: Bits of the tables that tell which runs of words cannot be the first words of any term, and which persons have no values: half a megabyte.
LOOKUP_BITS = 1 << 22
#: The same where keys are many: two megabytes, however many they are.
MANY_BITS = 1 << 24


def _bits_for(keys: int) -> int:
    return LOOKUP_BITS if 8 * keys <= LOOKUP_BITS else MANY_BITS


def _lookup_table(keys: DataFrame, bits: int = LOOKUP_BITS) -> Column:
    """The hashes of a column ``__gram`` as bits of an array of numbers that reaches the scan as one literal."""
    place = _place(F.col("__gram"), bits).alias("__place")
    filled = keys.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, CAST(__gram & 63 AS INT))")).alias("__bits"))
    every = keys.sparkSession.range(0, bits >> 6, 1, 1).select(F.col("id").cast("int").alias("__place")).join(filled, "__place", "left")
    ordered = F.array_sort(F.collect_list(F.struct("__place", F.coalesce("__bits", F.lit(0).cast("bigint")).alias("__bits"))))
    return every.agg(F.transform(ordered, lambda b: b["__bits"])).scalar()


def _place(gram: Column, bits: int) -> Column:
    return F.shiftright(gram, 6).bitwiseAND(F.lit((bits >> 6) - 1).cast("bigint")).cast("int")


def _may_be(gram: Column, table: Column, bits: int = LOOKUP_BITS) -> Column:
    """Whether the bit of a hash is set; hashes of terms always are."""
    return F.getbit(F.get(table, _place(gram, bits)), gram.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def terms_in_text(notes: DataFrame, note_id: str, text: str, terms: DataFrame, by: Sequence[str] = (), most: int = 3) -> DataFrame:
    """(note_id, terms): the values of a term table whose first words occur in the note.

    Runs of words of a note are joined with the first words of the terms, as 64-bit hashes (two runs of one hash only add a
    value that is then not found), so neither side is held whole anywhere, and a note's list holds only what its own text
    calls for. A word that stands in every note is a hot key of a plain equi-join, which the adaptive skew join splits.
    """
    hits = _hits(notes, note_id, text, terms, by, most)
    return hits.groupBy(note_id).agg(_longest_first(F.collect_set(F.struct("value", "mask"))).alias("terms"))


def _hits(notes: DataFrame, note_id: str, text: str, terms: DataFrame, by: Sequence[str], most: int = 3) -> DataFrame:
    """``terms_in_text`` with a row for each value of a note."""
    # written once: the lengths, the table of bits and the join all read it
    head = let(_words(F.col("value")), lambda words: F.struct(_key(F.col("value"), words, most).alias("__gram"), F.size(words).alias("__words")))
    heads = store(terms.select(*by, "value", "mask", head.alias("__head")).select(*by, "value", "mask", "__head.__gram", "__head.__words"), "terms")
    size, least, longest = heads.agg(F.count(F.lit(1)), F.min("__words"), F.max("__words")).first()
    # no longer runs than some term has words
    keys = F.transform(_grams(F.col(text), max(1, min(most, longest or 1))), lambda g: F.xxhash64(g))
    if least == 0:
        # values without any word character are looked up by their first sign
        keys = F.concat(keys, F.transform(_signs(F.col(text)), lambda c: F.xxhash64(F.concat(F.lit("\0"), c))))
    # only runs that may be the first words of a term leave the scan
    bits = _bits_for(size)
    grams = notes.select(note_id, *by, F.explode(F.array_distinct(keys)).alias("__gram"))
    grams = grams.where(_may_be(F.col("__gram"), _lookup_table(heads, bits), bits))
    return grams.join(heads.drop("__words"), [*by, "__gram"])


def attach_terms(notes: DataFrame, note_id: str, text: str, terms: DataFrame, patient: str = "sur_patient_id") -> DataFrame:
    """Notes with the whole masking list of their person as ``terms``, longest value first."""
    return notes.join(_bundles(terms, patient).drop("compiled"), patient, "left")


def _bundles(terms: DataFrame, patient: str) -> DataFrame:
    """One list per person; its pattern is built here, once per person and not once per note."""
    listed = terms.groupBy(patient).agg(_longest_first(F.collect_list(F.struct("value", "mask"))).alias("terms"))
    return listed.withColumn("compiled", compiled_terms("terms"))


def mask_patient_values(
    notes: DataFrame, note_id: str, text: str, terms: DataFrame, patient: str = "sur_patient_id", limit: int = 200
) -> DataFrame:
    """Every value of the person masked in the person's notes: one pass, the longest value first.

    A person with up to ``limit`` values brings them as one list. For people with more, only the values whose words occur in the
    note are brought; the others could not match, so the text is the same either way and ``limit`` only chooses the plan.
    """
    # the counts, the lists and the look-up all read them
    terms = once(terms.select(patient, "value", "mask"), "values")
    counts = terms.where(F.col(patient).isNotNull()).groupBy(patient).count()
    few, many = counts.agg(F.count_if(F.col("count") <= limit), F.count_if(F.col("count") > limit)).first()
    if not many:
        some, others = _with_values(notes, text, terms, patient, few)
        done = _masked(notes, some.join(_bundles(terms, patient), patient, "left"), text)
        return done if others is None else done.unionByName(others)
    # likewise; nothing of the way the notes were made is done again for the light, the look-up and the heavy ones
    notes = once(notes, "notes")
    tasks = row_tasks(notes)
    if not few:
        some, others = _with_values(notes, text, terms, patient, many, F.col(note_id).isNotNull())
        done = _looked_up(some, note_id, text, terms, patient, tasks)
        return done if others is None else done.unionByName(others)
    heavy = counts.where(F.col("count") > limit).select(patient)
    light = notes.join(heavy, patient, "left_anti")
    light = light.join(_bundles(terms.join(heavy, patient, "left_anti"), patient), patient, "left")
    heavy_notes = notes.join(heavy, patient, "left_semi")
    found = terms_in_text(heavy_notes, note_id, text, terms.join(heavy, patient, "left_semi"), [patient])
    found = found.withColumn("compiled", compiled_terms("terms"))
    return _masked(notes, light, text, tasks).unionByName(_masked(notes, heavy_notes.join(found, note_id, "left"), text, tasks))


def _with_values(
    notes: DataFrame, text: str, terms: DataFrame, patient: str, persons: int, also: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The notes whose person may have values, and all others, whose text stays where it is.

    Bits of the persons' hashes tell them apart in the scan; a person without values whose bit is set merely travels with the first ones.
    Notes that are no scan are not made twice for it.
    """
    if not is_scan(notes) or notes.schema[patient].dataType != terms.schema[patient].dataType:
        return notes, None
    bits = _bits_for(persons)
    person = F.xxhash64(patient)
    has = F.col(patient).isNotNull() & _may_be(person, _lookup_table(terms.select(person.alias("__gram")), bits), bits)
    has = has if also is None else has & also
    return notes.where(has), notes.where(~has).withColumn(text, F.col(text).cast("string"))


def _looked_up(notes: DataFrame, note_id: str, text: str, terms: DataFrame, patient: str, tasks: int) -> DataFrame:
    """Notes whose persons have values by the look-up alone. The text is dealt out once, by the note, and meets there what was found in it."""
    hits = _hits(notes, note_id, text, terms, [patient]).select(note_id, F.struct("value", "mask").alias("__hit"))
    persons = terms.select(patient).distinct()
    # whose note it is: a note of a person without values stays as it is, whatever was found in another one of its id
    owners = notes.select(note_id, patient).join(persons, patient, "left_semi").select(note_id, F.col(patient).alias("__owner"))
    # at least as many tasks as any other exchange, for long texts
    tasks = max(tasks, int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = hits.unionByName(owners, allowMissingColumns=True).repartition(tasks, note_id).groupBy(note_id)
    found = found.agg(_longest_first(F.collect_set("__hit")).alias("terms"), F.collect_set("__owner").alias("__owners"))
    own = F.when(F.array_contains("__owners", F.col(patient)), F.col("terms"))
    joined = notes.repartition(tasks, note_id).join(found, note_id, "left")
    return _masked(notes, joined.withColumn("compiled", compiled_terms(own)), text)


def _masked(notes: DataFrame, attached: DataFrame, text: str, tasks: int = 0) -> DataFrame:
    """With a number of tasks, rows are dealt out anew: joined rows are few bytes but long work, and tasks cut by bytes would grow with the table."""
    dealt = attached.repartition(tasks) if tasks else attached
    return dealt.withColumn(text, mask_compiled(text, "compiled")).select(*notes.columns)


def mask_dictionary(notes: DataFrame, note_id: str, text: str, dictionary: DataFrame, most: int | None = None) -> DataFrame:
    """Every term of a dictionary table (value, mask) masked in every note, whoever it belongs to.

    ``most`` is the number of words by which terms are looked up; left out, it is the longest term's, three at most.
    """
    if most is None:
        longest = dictionary.agg(F.max(F.size(_words(F.col("value"))))).first()[0] or 1
        most = max(1, min(3, longest))
    found = terms_in_text(notes, note_id, text, dictionary, (), most)
    return notes.join(found, note_id, "left").withColumn(text, mask_values(text, "terms")).select(*notes.columns)


def mask_birth_dates(notes: DataFrame, text: str, births: DataFrame, patient: str = "sur_patient_id") -> DataFrame:
    """Dates in a note that are a birth date of its person are cut to the year. ``births`` is (patient, dob)."""
    # distinct days: the calendar bounds the list
    dobs = births.where(F.col("dob").isNotNull()).groupBy(patient).agg(F.collect_set(F.col("dob").cast("date")).alias("__dobs"))

    def year_only(d: Column) -> Column:
        day = parse_date(d).cast("date")
        return F.when(F.array_contains("__dobs", day), F.date_format(day, "yyyy"))

    joined = notes.join(dobs, patient, "left")
    return joined.withColumn(text, F.when(F.col("__dobs").isNull(), F.col(text)).otherwise(rewrite_dates(text, year_only))).drop("__dobs")


# --- near matches -----------------------------------------------------------------------------------------------------


def mask_near_values(
    notes: DataFrame,
    note_id: str,
    text: str,
    terms: DataFrame,
    patient: str = "sur_patient_id",
    threshold: float = 80.0,
    chunk: int = 200,
) -> DataFrame:
    """Exact values are masked first, then runs of one to three words that are nearly a value of the person (three letters
    or more): single words before pairs before triples, each in the order of the text.

    A person's values are cut into chunks by hash; a note meets each chunk of its own person once. Only rows with a hit go
    on to the regrouping, and the text itself is masked by native expressions.
    """
    terms = store(terms.select(patient, "value", "mask"), "values")
    notes = store(mask_patient_values(notes, note_id, text, terms, patient), "masked")
    tasks = row_tasks(notes)
    usable = terms.where(F.length("value") >= 3)
    norm = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[‘’`]", "'"), "[–—]", "-"), r"\s+", " "))
    usable = usable.select(patient, norm.alias("value"), "mask")
    sizes = usable.groupBy(patient).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("__chunks"))
    bundles = (
        usable.join(sizes, patient)
        .withColumn("__chunk", F.pmod(F.xxhash64("value"), F.col("__chunks")))
        .groupBy(patient, "__chunk")
        .agg(F.collect_list(F.struct("value", "mask")).alias("__terms"))
        .select(patient, F.col("__terms.value").alias("__values"), F.col("__terms.mask").alias("__masks"))
    )
    near = F.pandas_udf(near_terms(threshold), HITS)
    words = F.array_join(_words(F.col(text)), " ")
    pairs = notes.select(note_id, patient, words.alias("__words")).join(bundles, patient).repartition(tasks)
    hits = pairs.select(note_id, F.explode(near("__words", "__values", "__masks")).alias("t"))
    found = hits.groupBy(note_id).agg(F.sort_array(F.collect_set("t")).alias("terms"))
    return notes.join(found, note_id, "left").withColumn(text, _mask_words(text, "terms")).select(*notes.columns)


def _mask_words(text: str, terms: str) -> Column:
    """Found runs of words, each between word boundaries, any separator between the words of a run."""
    return F.when(
        F.coalesce(F.size(terms), F.lit(0)) > 0,
        F.aggregate(
            terms,
            F.col(text),
            lambda acc, t: F.regexp_replace(
                acc,
                F.concat(F.lit(ANY_CASE + WORD_BREAK), F.replace(t["value"], F.lit(" "), F.lit(rf"[^{WORD}]+")), F.lit(WORD_BREAK)),
                F.regexp_replace(t["mask"], r"([\\$])", r"\\$1"),
            ),
        ),
    ).otherwise(F.col(text))


# --- entities ---------------------------------------------------------------------------------------------------------


def find_entities(df: DataFrame, doc_id: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """Pattern hits as an entity table (doc_id, kind, start, end, word); ``start`` counts from 0."""

    def hits(kind: str, pattern: str) -> DataFrame:
        # offsets: lengths of the gaps and hits before
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        gaps = F.split(F.col(text), pattern, -1)
        steps = F.aggregate(
            F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("word")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,word:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(F.length(x["word"]), F.lit(0))).alias("at"),
                F.when(
                    x["word"].isNotNull(),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["word"].alias("word")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        rows = df.where(F.col(text).rlike(pattern)).select(doc_id, F.explode(steps["out"]).alias("e"))
        word, start = F.col("e.word"), F.col("e.start")
        return rows.select(doc_id, F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(word)).alias("end"), word.alias("word"))

    return reduce(lambda a, b: a.unionByName(b), [hits(k, p) for k, p in kinds.items()])


def anonymise_entities(
    docs: DataFrame,
    doc_id: str,
    text: str,
    entities: DataFrame,
    days: str | int,
    ignored: Sequence[str] = (),
    person_kinds: Sequence[str] = ("PERSON", "PATIENT"),
    date_kinds: Sequence[str] = ("DATE", "DATE_TIME"),
    name: str | None = None,
    dob: str | None = None,
    threshold: float = 75.0,
) -> DataFrame:
    """Found entities replaced by ``<KIND>``: unwanted kinds dropped, persons kept only when they are like the patient's
    name, dates moved by the offset (the date of birth cut to its year). Where spans overlap, the one that starts first wins.
    """
    wanted = entities.where(~F.col("kind").isin(list(ignored))) if ignored else entities
    if name:
        wanted = wanted.join(docs.select(doc_id, F.col(name).alias("__name")), doc_id)
        person = F.col("kind").isin(list(person_kinds))
        others = wanted.where(~person)
        likeness = F.pandas_udf(name_likeness, T.DoubleType())
        alike = wanted.where(person).where(likeness("word", "__name") > threshold)
        wanted = others.unionByName(alike).drop("__name")
    # the spans of one document are bounded by its own text
    spans = wanted.groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg_end"), "end", "kind", "word"))).alias("__spans")
    )
    joined = docs.join(spans, doc_id, "left")
    offset = F.lit(days) if isinstance(days, int) else F.col(days)

    def shown(s: Column) -> Column:
        stamp = parse_date(s["word"])
        moved = F.date_format(add_days(stamp, offset), "yyyy-MM-dd")
        if dob:
            moved = F.when(stamp.cast("date") == F.col(dob).cast("date"), F.date_format(stamp, "yyyy")).otherwise(moved)
        return F.when(s["kind"].isin(list(date_kinds)), F.coalesce(moved, s["word"])).otherwise(
            F.concat(F.lit("<"), s["kind"], F.lit(">"))
        )

    body = F.col(text)
    folded = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), shown(s)).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))),
    )
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), body).otherwise(folded)).select(*docs.columns)
