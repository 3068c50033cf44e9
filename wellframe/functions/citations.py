"""Citations of an answer, and whether its numbers are in the sources that it cites, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.functions.let import let
from wellframe.operators.stages import dealt

# Units that are looked for in answers, and the spelling that they are compared in.
UNITS = {
    "m3/h": "m3/h", "l/min": "l/min", "kn.m": "kn.m", "m3": "m3", "m³": "m3", "kn": "kn", "bar": "bar", "sg": "sg", "mm": "mm", "cm": "cm",
    "m": "m", "ft": "ft", "psi": "psi", "ppg": "ppg", "metres": "m", "metre": "m", "meters": "m", "meter": "m", "hours": "h", "hour": "h",
    "hrs": "h", "hr": "h", "h": "h", "min": "min", "days": "days", "day": "days", "%": "%", "°c": "degc", "degc": "degc",
}
#: What follows a point or comma directly is no number of its own.
_TOKEN = r"[.,]\d[\d.,]*|\d(?:[\d.,]*\d)?|[\p{L}°%][\p{L}\p{N}°%³/.]*|[^\s]"


def quantities(text: Column) -> Column:
    """array<struct<value, unit>> of the distinct numbers with a unit of UNITS; a comma sets off thousands or decimals."""
    return let(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), _read)


def _read(t: Column) -> Column:
    """The distinct quantities among tokens."""
    longest = F.array(*[F.lit(u) for u in sorted(UNITS, key=lambda u: (-len(u), u))])
    spelling = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def read(token: Column, i: Column) -> Column:
        plain = F.when(token.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(token, F.lit(","), F.lit(""))).when(token.rlike(r"^\d+([.,]\d+)?$"), F.replace(token, F.lit(","), F.lit(".")))
        after = F.try_element_at(t, i + 2)
        # The longest unit that the next token begins with and that ends there or before another sign.
        fits = F.filter(longest, lambda u: F.startswith(after, u) & ~F.substring(after, F.length(u) + 1, F.lit(1)).rlike("[a-z0-9]"))
        found = F.struct(F.round(plain.try_cast("double"), 4).alias("value"), F.try_element_at(spelling, F.try_element_at(fits, F.lit(1))).alias("unit"))
        return F.when(F.substring(token, 1, 1).between("0", "9"), found)

    return F.array_distinct(F.filter(F.transform(t, read), lambda q: q.value.isNotNull() & q.unit.isNotNull()))


def _brackets(text: Column) -> Column:
    """Every bracketed part, with its numbers: null where it is no list of numbers."""
    inner = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))

    def numbers(part: Column) -> Column:
        items = F.transform(F.split(part, ","), lambda x: F.trim(x))
        return F.when(F.forall(items, lambda x: x.rlike("^[0-9]{1,9}$")), F.transform(items, lambda x: x.try_cast("int")))

    return F.transform(inner, lambda p: F.struct(F.concat(F.lit("["), p, F.lit("]")).alias("text"), numbers(p).alias("numbers")))


def cited(text: Column) -> Column:
    """The numbers of all citations like [1] or [1, 3], in order."""
    return F.flatten(F.transform(F.filter(_brackets(text), lambda b: b.numbers.isNotNull()), lambda b: b.numbers))


def cleaned(answer: Column, valid: Column) -> Column:
    """The answer with only those citations that are ``valid`` (array of ints): [1, 9] becomes [1]; gaps that this leaves close."""
    between = F.split(answer, r"\[[^\[\]]*\]", -1)
    own = F.transform(_brackets(answer), lambda b: F.when(b.numbers.isNull(), b.text).otherwise(F.array_join(F.transform(F.filter(b.numbers, lambda n: F.array_contains(valid, n)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), own.alias("b")), lambda x: F.array(x.a, F.coalesce(x.b, F.lit(""))))), "")
    return F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "[ \t]+(?=[.,;])", "")


def sentences(line: Column) -> Column:
    """A line cut after full stops, exclamation and question marks and the white space behind them, but not before a citation."""
    return F.split(F.regexp_replace(F.trim(line), r"([.!?])\s+(?!\[[0-9])", "$1\u0001"), "\u0001")


def checked(answers: DataFrame, sources: DataFrame, key: str, answer: str, n: str, text: str) -> DataFrame:
    """key, answer, removed, unsupported, uncited for each answer.

    A sentence goes if one of its quantities is in none of the sources that it cites, or, if it cites none, in none that
    the answer cites.  ``unsupported`` names these quantities, ``uncited`` the sentences that cite no source; sources: key, n, text.
    Texts of sources are read once, in as many tasks as the session has, as are the answers.
    """
    texts = dealt(sources.select(F.col(key).alias("_k"), F.col(n).cast("int").alias("n"), F.col(text).alias("text")), ["_k"])
    known = texts.select("_k", F.struct("n", quantities(F.col("text")).alias("q")).alias("s"))
    known = known.groupBy("_k").agg(F.map_from_entries(F.collect_list("s")).alias("_known"))
    rows = answers.select(F.col(key), F.col(answer).alias("_a")).join(known, F.col(key).eqNullSafe(F.col("_k")), "left")
    rows = dealt(rows, [key]).withColumn("_known", F.coalesce("_known", F.create_map().cast("map<int,array<struct<value:double,unit:string>>>")))
    real = lambda c: F.filter(cited(c), lambda i: F.map_contains_key(F.col("_known"), i))
    rows = rows.withColumn("_all", real(F.col("_a")))

    def judged(s: Column) -> Column:
        own = real(s)
        of = F.when(F.size(own) > 0, own).otherwise(F.col("_all"))
        allowed = F.flatten(F.transform(of, lambda i: F.try_element_at(F.col("_known"), i)))
        return F.struct(s.alias("text"), F.array_except(quantities(s), allowed).alias("lacks"), (F.size(own) == 0).alias("bare"))

    lines = F.filter(F.split("_a", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("_s", F.transform(lines, lambda x: F.transform(sentences(x), judged)))
    kept = F.filter(F.transform(F.col("_s"), lambda x: F.array_join(F.transform(F.filter(x, lambda s: F.size(s.lacks) == 0), lambda s: s.text), " ")), lambda x: x != "")
    every = F.flatten("_s")
    return rows.select(
        key,
        F.array_join(kept, "\n").alias(answer),
        F.exists(every, lambda s: F.size(s.lacks) > 0).alias("removed"),
        F.flatten(F.transform(every, lambda s: s.lacks)).alias("unsupported"),
        F.transform(F.filter(every, lambda s: s.bare), lambda s: s.text).alias("uncited"),
    )
