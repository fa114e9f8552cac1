"""Generated calendars, cycles and sign tables. Fixed value lists are plain; all dates come from sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten stems, twelve branches and five elements.
STEMS = ["Jia", "Yi", "Bing", "Ding", "Wu", "Ji", "Geng", "Xin", "Ren", "Gui"]
BRANCHES = ["Zi", "Chou", "Yin", "Mao", "Chen", "Si", "Wu", "Wei", "Shen", "You", "Xu", "Hai"]
ELEMENTS = ["Wood", "Fire", "Earth", "Metal", "Water"]
# The twenty-eight mansions, the element of each branch, the category of each element, and the relations of branches.
MANSIONS = [
    "Horn", "Neck", "Root", "Room", "Heart", "Tail", "Winnowing Basket", "Dipper", "Ox", "Girl", "Emptiness", "Rooftop", "Encampment", "Wall",
    "Stride", "Mound", "Stomach", "Hairy Head", "Net", "Turtle Beak", "Three Stars", "Well", "Ghost", "Willow", "Star", "Extended Net", "Wings", "Chariot",
]
BRANCH_ELEMENTS = ["Water", "Earth", "Wood", "Wood", "Earth", "Fire", "Fire", "Earth", "Metal", "Metal", "Earth", "Water"]
CATEGORIES = {"Wood": "friends", "Fire": "expression", "Earth": "wealth", "Metal": "authority", "Water": "learning"}
RELATIONS = {
    "clash": [("Zi", "Wu"), ("Chou", "Wei"), ("Yin", "Shen"), ("Mao", "You"), ("Chen", "Xu"), ("Si", "Hai")],
    "combine": [("Zi", "Chou"), ("Yin", "Hai"), ("Mao", "Xu"), ("Chen", "You"), ("Si", "Shen"), ("Wu", "Wei")],
    "harm": [("Zi", "Wei"), ("Chou", "Wu"), ("Yin", "Si"), ("Mao", "Chen"), ("Shen", "Hai"), ("You", "Xu")],
    "break": [("Zi", "You"), ("Chou", "Chen"), ("Yin", "Hai"), ("Mao", "Wu"), ("Si", "Shen"), ("Wei", "Xu")],
    "punishment": [("Zi", "Mao"), ("Yin", "Si"), ("Si", "Shen"), ("Yin", "Shen"), ("Chou", "Xu"), ("Xu", "Wei"), ("Chou", "Wei"), ("Chen", "Chen"), ("Wu", "Wu"), ("You", "You"), ("Hai", "Hai")],
}


def cycle(labels: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (F.pmod(index, F.lit(len(labels))) + 1).cast("int"))


def sexagenary(index: Column) -> Column:
    return F.concat(cycle(STEMS, index), cycle(BRANCHES, index))


def year_label(year: Column) -> Column:
    """Anchored to 1984."""
    return sexagenary(year - 1984)


def day_label(day: Column) -> Column:
    """Anchored to 1984-02-02."""
    return sexagenary(F.datediff(day, F.lit("1984-02-02").cast("date")))


def month_label(year: Column, month: Column) -> Column:
    """Months run from the third branch on."""
    return F.concat(cycle(STEMS, year * 2 + month), cycle(BRANCHES, month + 1))


def hour_branch(hour: Column) -> Column:
    """Two hours to a branch; 23 belongs to the first."""
    return cycle(BRANCHES, F.floor((hour + 1) / 2))


def mansion(day: Column) -> Column:
    """One of twenty-eight, anchored to 1984-02-02."""
    return cycle(MANSIONS, F.datediff(day, F.lit("1984-02-02").cast("date")))


def hour_label(day: Column, hour: Column) -> Column:
    """Stem from the day's stem and the hour's branch."""
    at = F.floor((F.pmod(hour, F.lit(24)) + 1) / 2) % 12
    return F.concat(cycle(STEMS, F.datediff(day, F.lit("1984-02-02").cast("date")) * 2 + at), hour_branch(hour))


def relation_table(spark: SparkSession) -> DataFrame:
    """relation, a, b: each unordered pair once, in the branches' order."""
    order = BRANCHES.index
    rows = [(r, *sorted(p, key=order)) for r, pairs in RELATIONS.items() for p in pairs]
    return spark.createDataFrame(rows, "relation string, a string, b string")


def relations(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with each relation that their two branches have, in either order; pairs without one drop out. A written table."""
    at = lambda c: F.array_position(F.array(*[F.lit(b) for b in BRANCHES]), F.col(c))
    swap = at(left) > at(right)
    keyed = pairs.withColumns({"a": F.when(swap, F.col(right)).otherwise(F.col(left)), "b": F.when(swap, F.col(left)).otherwise(F.col(right))})
    return keyed.join(F.broadcast(relation_table(pairs.sparkSession)), ["a", "b"]).drop("a", "b")


def branch_element(index: Column) -> Column:
    return cycle(BRANCH_ELEMENTS, index)


def focus_element(annual: Column, natal: Column, useful: Column) -> Column:
    """The useful element if the year has it; else the one the year has most, then the natal chart (a map) least, then the
    first."""
    def of(i: int, e: str) -> Column:
        n = F.size(F.filter(annual, lambda x: x == e))
        return F.struct(n.alias("n"), (-F.coalesce(F.try_element_at(natal, F.lit(e)), F.lit(0))).alias("m"), F.lit(-i).alias("i"), F.lit(e).alias("e"))

    score = F.array(*[of(i, e) for i, e in enumerate(ELEMENTS)])
    return F.when(F.array_contains(annual, useful), useful).otherwise(F.array_max(score)["e"])


def category(element: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, c in CATEGORIES.items():
        out = F.when(element == e, F.lit(c)).otherwise(out)
    return out


def intensity(annual: Column, dominant: Column, useful: Column) -> Column:
    """Rules in order: the dominant element twice, the useful one, the dominant one, none of them."""
    twice = F.size(F.filter(annual, lambda x: x == dominant)) == 2
    return F.when(twice, "high-volatility").when(F.array_contains(annual, useful), "constructive").when(F.array_contains(annual, dominant), "active").otherwise("moderate")


def useful_state(focus: Column, annual: Column, useful: Column, dominant: Column) -> Column:
    twice = F.size(F.filter(annual, lambda x: x == dominant)) == 2
    return F.when(twice, "dominant_element_reinforced").when(focus == useful, "useful_element_activated").when(F.array_contains(annual, useful), "useful_element_present").otherwise("neutral_or_indirect")


def stem_element(index: Column) -> Column:
    return cycle(ELEMENTS, F.floor(F.pmod(index, F.lit(10)) / 2))


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    if last < first:
        raise ValueError("the last year lies before the first")
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def months(years_: DataFrame) -> DataFrame:
    return years_.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    d = lambda s: F.lit(s).cast("date")
    return spark.range(1).select(F.explode(F.sequence(d(first), d(last))).alias("date"))


def phase(age: Column, width: int = 10, most: int = 9) -> Column:
    return F.least(F.floor(age / width), F.lit(most)).cast("int")


def angle_between(a: Column, b: Column) -> Column:
    """Circular distance in degrees."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)
