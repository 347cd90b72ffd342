"""Health and survey sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.session import cut_lineage

# Columns, indicators and patterns of the sources: fixed values.
DECEDENT_COLUMNS = (
    "district", "hl_id", "house_no", "house_hold_no", "m_serial_no", "year", "rural", "deceased_sex",
    "date_of_death", "month_of_death", "year_of_death", "age_of_death_below_one_month",
    "age_of_death_below_eleven_month", "age_of_death_above_one_year", "place_of_death", "wt",
)
INDICATORS = (
    ("pop_under15_pct", "Population below age 15 years", 0),
    ("electricity_pct", "Population living in households with electricity", 0),
    ("improved_water_pct", "Population living in households with an improved drinking-water", 0),
    ("improved_sanitation_pct", "Population living in households that use an improved sanitation", 0),
    ("clean_fuel_pct", "Households using clean fuel for cooking", 0),
    ("health_insurance_pct", "Households with any usual member covered under a health insurance", 0),
    ("women_literate_pct", "Women who are literate", 0),
    ("women_anaemic_pct", "All women age 15-49 years who are anaemic", 0),
    ("women_high_bp_pct", "Elevated blood pressure", 0),
    ("men_high_bp_pct", "Elevated blood pressure", 1),
    ("women_high_sugar_pct", "Blood sugar level - high or very high", 0),
    ("men_high_sugar_pct", "Blood sugar level - high or very high", 1),
)
HEADER_PATTERN = r"^([A-Za-z ]+), Odisha - Key Indicators"
NUMBER_PATTERN = r"^\(?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\)?$"
LABEL_PREFIX = r"^\s*\d+\.\s*"


def read_deaths(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated microdata, decedent columns only, all as text."""
    raw = spark.read.option("header", True).option("sep", "|").option("inferSchema", False).csv(path)
    return raw.select(*DECEDENT_COLUMNS)


def read_codebook(spark: SparkSession, path: str, state: int = 21) -> DataFrame:
    """District codes of one state from the code-book sheet saved as CSV."""
    raw = spark.read.option("header", False).schema("state string, code string, name string").csv(path)
    number = lambda c: F.expr(f"try_cast(trim({c}) AS int)")
    return raw.where((number("state") == state) & number("code").isNotNull()).select(
        number("code").alias("ahs_code"), F.trim("name").alias("codebook_name")
    )


def read_hvi(spark: SparkSession, path: str, state: str = "ODISHA") -> DataFrame:
    """Vulnerability indicators of one state; the code column stays text."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    keep_text = {"state", "district", "dist_code", "hvi_tier", "tier"}
    typed = [F.col(c) if c in keep_text else F.coalesce(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in raw.columns]
    return raw.where(F.upper("state") == state.upper()).select(*typed)


def first_number(line: Column) -> Column:
    """First readable number of a text; ``*`` or ``na`` before it means missing."""
    tokens = F.split(F.trim(line), r"\s+")
    usable = F.filter(tokens, lambda t: t.isin("*", "na") | t.rlike(NUMBER_PATTERN))
    head = F.try_element_at(usable, F.lit(1))
    digits = F.replace(F.regexp_extract(head, NUMBER_PATTERN, 1), F.lit(","), F.lit(""))
    return F.when(head.isin("*", "na"), F.lit(None).cast("double")).otherwise(F.nullif(digits, F.lit("")).cast("double"))


def _titled(lines: DataFrame, doc: str, header: str) -> DataFrame:
    """Lines of the pages whose first line names a district, with the two lines that follow each.

    Everything is taken within a page. Only the last two lines of a page need
    the start of the district's next page, which comes from a table of one row
    per page.
    """
    page = Window.partitionBy(doc).orderBy("line_no")
    title = F.nullif(F.trim(F.regexp_extract(F.trim("text"), header, 1)), F.lit(""))
    numbered = lines.withColumn("_n", F.row_number().over(page)).withColumn("_title", F.when(F.col("_n") == 1, title))
    named = numbered.withColumns(
        {
            "name": F.max("_title").over(Window.partitionBy(doc)),
            "_l1": F.lead("text", 1).over(page),
            "_l2": F.lead("text", 2).over(page),
            "_end": F.max("_n").over(Window.partitionBy(doc)),
        }
    ).where(F.col("name").isNotNull())
    starts = named.where("_n <= 2").groupBy("name", doc).agg(
        F.max(F.when(F.col("_n") == 1, F.col("text"))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col("text"))).alias("_b")
    )
    order = Window.partitionBy("name").orderBy(doc)
    following = starts.select(
        F.col("name").alias("_name"), F.col(doc).alias("_doc"), F.lead("_a").over(order).alias("_next1"),
        F.coalesce(F.lead("_b").over(order), F.lead("_a", 2).over(order)).alias("_next2"),
    )
    joined = named.join(following, (F.col("name") == F.col("_name")) & (F.col(doc) == F.col("_doc")))
    left = F.col("_end") - F.col("_n")
    return joined.withColumns(
        {
            "_l1": F.when(left >= 1, F.col("_l1")).otherwise(F.col("_next1")),
            "_l2": F.when(left >= 2, F.col("_l2")).when(left == 1, F.col("_next1")).otherwise(F.col("_next2")),
        }
    ).drop("_name", "_doc", "_next1", "_next2", "_title", "_end", "_n")


def indicator_values(lines: DataFrame, doc: str = "page", header: str = HEADER_PATTERN) -> DataFrame:
    """(name, pattern, occurrence, value) from the text lines of fact sheets.

    ``lines``: ``page, line_no, text``. The first line of a page names the
    district; a label may wrap over two more lines before its ``(%)`` mark, and
    the value is the first number after the last mark. As many occurrences are
    given as the indicators ask for.
    """
    mark = r"^.*\(%\)"

    def after(c: str) -> Column:
        return F.regexp_replace(F.col(c), mark, "")

    value = (
        F.when(F.col("text").contains("(%)"), first_number(after("text")))
        .when(F.col("_l1").contains("(%)"), first_number(after("_l1")))
        .when(F.col("_l2").contains("(%)"), first_number(after("_l2")))
        .otherwise(first_number(F.array_join(F.slice(F.split(F.trim("_l1"), r"\s+"), 1, 2), " ")))
    )
    label = F.lower(F.regexp_replace("text", LABEL_PREFIX, ""))
    patterns = sorted({p for _, p, _ in INDICATORS})
    which = F.coalesce(*[F.when(label.startswith(p.lower()), F.lit(p)) for p in patterns])
    found = _titled(lines, doc, header).where(F.col("text").rlike(LABEL_PREFIX)).withColumn("pattern", which)
    # The lines are matched once; the rounds below go over the few that did.
    hits = cut_lineage(found.where(F.col("pattern").isNotNull()).select("name", "pattern", F.struct(F.col(doc), "line_no").alias("at"), value.alias("value")))

    # The n-th hit is the smallest one after the (n-1)-th: plain minima, no sort of all hits of a name.
    out, rest = None, hits
    for n in range(max(k for _, _, k in INDICATORS) + 1):
        nth = rest.groupBy("name", "pattern").agg(F.min(F.struct("at", "value")).alias("m"))
        part = nth.select("name", "pattern", F.lit(n).alias("occurrence"), F.col("m.value").alias("value"))
        out = part if out is None else out.unionByName(part)
        taken = nth.select("name", "pattern", F.col("m.at").alias("_taken"))
        rest = rest.join(taken, ["name", "pattern"]).where(F.col("at") > F.col("_taken")).drop("_taken")
    return out


def indicator_table(values: DataFrame, indicators: Sequence[tuple[str, str, int]] = INDICATORS) -> DataFrame:
    """One row per district with one column per indicator."""
    return values.groupBy("name").agg(
        *[
            F.max(F.when((F.col("pattern") == p) & (F.col("occurrence") == n), F.col("value"))).alias(c)
            for c, p, n in indicators
        ]
    )


def text_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text) rows from whole texts."""
    return documents.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))
