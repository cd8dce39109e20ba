"""Checks of answers against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import collapse, ngrams
from skarn.sources.shared import written

NUMBER = r"\d+(?:\.\d+)?"
# Units, and how they are written. A space stands for any white space; "³" and "²" may be written as digits.
UNITS = {
    "cfm": ("cubic feet per minute", "cubic foot per minute", "cubic feet/min", "ft³ per minute", "ft³/min", "ft3 per minute", "ft3/min", "cfm"),
    "m3/s": ("cubic metre per second", "cubic metres per second", "cubic meter per second", "cubic meters per second", "m³ per second", "m³/s", "m3 per second", "m3/s"),
    "ft2": ("square feet", "square foot", "sq. ft.", "sq. ft", "sq ft.", "sq ft", "ft²", "ft2"),
    "m2": ("square metre", "square metres", "square meter", "square meters", "m²", "m2"),
    "fahrenheit": ("°F", "° F", "degree Fahrenheit", "degrees Fahrenheit", "degree F", "degrees F"),
    "celsius": ("°C", "° C", "degree Celsius", "degrees Celsius", "degree C", "degrees C"),
    "mm": ("millimetre", "millimetres", "millimeter", "millimeters", "mm"),
    "cm": ("centimetre", "centimetres", "centimeter", "centimeters", "cm"),
    "inch": ("inch", "inches", "in", "″", '"'),
    "foot": ("feet", "foot", "ft", "′"),
    "metre": ("metre", "metres", "meter", "meters", "m"),
    "percent": ("percent", "%"),
    "pascal": ("pascal", "pascals", "Pa"),
    "psi": ("psi", "pound per square inch", "pounds per square inch"),
    "kg": ("kilogram", "kilograms", "kg"),
    "second": ("second", "seconds", "s"),
    "minute": ("minute", "minutes", "min"),
    "hour": ("hour", "hours", "hr"),
}


def _spelled(word: str) -> str:
    """A spelling as a pattern: any white space for a space, and no letter or digit behind one that ends in a letter."""
    marks = word.replace(".", "[.]").replace(" ", r"\s+").replace("/", r"\s*/\s*")
    return marks + (r"(?![A-Za-z0-9])" if word[-1].isalnum() else "")


# Each spelling in lower case, without white space around "/"; the first unit of equals has it.
_NAMES = {w.lower(): unit for unit, words in reversed(UNITS.items()) for w in words}
_VALUE = r"[+-]?\d+(?:,\d{3})*(?:\.\d+)?(?:\s+\d+/\d+|/\d+)?"
# The longest spelling goes first, so "ft3/min" is not read as "ft".
QUANTITY = rf"(?i)(?<![\w.])({_VALUE})\s*(?:-\s*)?({'|'.join(_spelled(w) for w in sorted((w for words in UNITS.values() for w in words), key=len, reverse=True))})"


def quoted(quotes: DataFrame, sources: DataFrame, quote_id: str, source_id: str, least: int = 12) -> DataFrame:
    """(quote_id, source_id) where a source contains a quote of at least `least` characters.

    Substring search has no key of its own. But a source that contains a quote has the quote's inner words whole and
    side by side, so pairs meet on the one of the quote's inner word pairs that the fewest sources have, and only then is
    the whole quote compared. A quote with a single inner word meets on that word. Shorter quotes meet on their first
    `least` characters, looked for at every place of the sources that hold one of them.
    """
    words, long = F.split("quote", " "), quotes.where(F.length("quote") >= least)
    inner = long.withColumn("__in", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    many = inner.where("size(__in) >= 2").select(quote_id, "quote", F.explode(F.array_distinct(ngrams(F.col("__in"), 2))).alias("__key"))
    one = inner.where("size(__in) = 1").select(quote_id, "quote", F.get("__in", F.lit(0)).alias("__key"))
    asked = many.unionByName(one)
    source_words = F.split("source", " ")
    keys = asked.select("__key").distinct()
    spread = sources.select(source_id, F.explode(F.array_distinct(F.concat(ngrams(source_words, 2), source_words))).alias("__key")).join(keys, "__key", "left_semi")
    spread = written(spread, "quoted")
    uses = spread.groupBy("__key").agg(F.count(F.lit(1)).alias("__uses"))
    # A key that no source has settles it: min_by leaves nulls out, so they count as 0 uses.
    rarest = asked.join(uses, "__key", "left").groupBy(quote_id).agg(F.min_by(F.struct("__key", "quote"), F.struct(F.coalesce("__uses", F.lit(0).cast("long")), "__key")).alias("__x")).select(quote_id, "__x.*")
    met = written(rarest.join(spread, "__key").select(quote_id, "quote", source_id), "met")
    found = met.join(sources, source_id).where(F.contains("source", "quote")).select(quote_id, source_id)
    short = inner.where("size(__in) = 0").select(quote_id, "quote", F.left("quote", F.lit(least)).alias("__key"))
    if short.isEmpty():
        return found
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("source") - (least - 1), F.lit(1))), lambda i: F.substr("source", i, F.lit(least)))
    near = sources.select(source_id, "source", F.explode(F.array_distinct(places)).alias("__key")).join(short, "__key").where(F.contains("source", "quote"))
    return found.unionByName(near.select(quote_id, source_id).distinct())


def citations(answers: DataFrame) -> DataFrame:
    """id, cited, unknown, forbidden, has_citation of answers (id, answer, allowed)."""
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(E\d+)\]"), 1))
    return answers.select("id", F.array_join(cited, ",").alias("cited"), F.array_join(F.array_except(cited, "allowed"), ",").alias("unknown"), F.col("answer").rlike(r"\[Section[^\]]*\]").alias("forbidden"), (F.size(cited) > 0).alias("has_citation"))


def impact(answers: DataFrame, removed: list[str]) -> DataFrame:
    """What is left of each answer's citations (id, cited) when references are removed."""
    left = F.size(F.array_except("cited", F.array(*[F.lit(r) for r in removed])))
    return answers.select("id", F.when(left == 0, "uncovered").when(left < F.size("cited"), "partial").otherwise("unchanged").alias("impact"))


def claims(claims: DataFrame, evidence: DataFrame, least: int = 12) -> DataFrame:
    """id, valid of claims (id, claim, cited, quote): each is quoted from what it cites, numbers included."""
    at = claims.select("*", F.explode_outer("cited").alias("evidence_id")).join(evidence, "evidence_id", "left")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), 0)
    found = at.groupBy("id").agg(F.max(F.coalesce(F.contains(collapse(F.col("source")), collapse(F.col("quote"))), F.lit(False))).alias("found"), F.min(F.col("source").isNotNull()).alias("known"))
    own = (F.length("claim").between(1, 3000)) & (F.length("quote") >= least) & (F.size(F.array_except(numbers("claim"), numbers("quote"))) == 0)
    return claims.join(found, "id").select("id", (own & F.col("found") & F.col("known")).alias("valid"))


def quantities(texts: DataFrame) -> DataFrame:
    """id, n, num, den, unit: values bound to units, as reduced fractions; units are named, never converted.

    Rows are dealt anew first: short rows make small files, and a task that read one would have them all.
    """
    found = texts.repartition("id").select("id", F.posexplode(F.regexp_extract_all("text", F.lit(QUANTITY), 0)).alias("n", "m"))
    # No unit begins with what can be in a value, so the longest value at the match's start is the match's own.
    cut = found.withColumn("v", F.regexp_extract("m", f"^(?:{_VALUE})", 0))
    unit = F.regexp_replace(F.lower(F.substr("m", F.length("v") + 1)), r"^\s*(?:-\s*)?", "")
    spelled = F.regexp_replace(F.regexp_replace(unit, r"\s*/\s*", "/"), r"\s+", " ")
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    named = cut.select("id", "n", F.col("v").startswith("-").alias("minus"), F.regexp_replace("v", "[+,-]", "").alias("v"), F.element_at(names, spelled).alias("unit"))
    # A cast that fails costs a Java exception, so what was not found is null before it is cast.
    number = lambda c: F.nullif(c, F.lit("")).try_cast("long")
    whole, decimals = F.regexp_extract("v", r"^(\d+)(?:\.\d+)?(?:\s|$)", 1), F.regexp_extract("v", r"^\d+\.(\d+)", 1)
    top, under = F.regexp_extract("v", r"(\d+)/\d+$", 1), F.regexp_extract("v", r"/(\d+)$", 1)
    # Columns of their own: an expression would be computed at each of its uses.
    parts = named.select("id", "n", "unit", "minus", F.coalesce(number(whole), F.lit(0)).alias("whole"), decimals.alias("decimals"), number(top).alias("top"), number(under).alias("under"))
    scale = F.pow(F.lit(10), F.length("decimals")).cast("long")
    num = F.when(F.col("under").isNotNull(), F.col("whole") * F.col("under") + F.col("top")).otherwise(F.col("whole") * scale + F.coalesce(number(F.col("decimals")), F.lit(0)))
    raw = parts.where("under is null or under != 0").select("id", "n", "unit", (F.when(F.col("minus"), -1).otherwise(1) * num).alias("num"), F.coalesce("under", scale).alias("den"))
    # The greatest common divisor by Euclid's steps: five for each digit of the smaller number suffice (Lamé), and one to swap.
    steps = F.sequence(F.lit(1), 5 * F.length(F.col("den").cast("string")) + 1)
    euclid = F.aggregate(steps, F.struct(F.abs("num").alias("a"), F.col("den").alias("b")), lambda s, i: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))))["a"]
    gcd = F.when(F.col("den") == 1, F.lit(1).cast("long")).otherwise(euclid)
    return raw.withColumn("g", F.greatest(gcd, F.lit(1).cast("long"))).select(F.col("id").cast("int").alias("id"), "n", (F.col("num") / F.col("g")).cast("int").alias("num"), (F.col("den") / F.col("g")).cast("int").alias("den"), "unit")
