"""Review state: orders, groups, roll-ups, decisions and hand-drawn areas over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import rects as R
from umbra.schemas import categories

KEY = ["doc_id", "page", "start", "length"]


def ordered(findings: DataFrame) -> DataFrame:
    """By page, then the first rectangle's top and left edge."""
    first = F.get("rects", F.lit(0))
    return findings.orderBy("doc_id", "page", first["y"], first["x"])


def group_key(text: Column) -> Column:
    """Equal values have equal keys: white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def state(accepted: Column, count: Column) -> Column:
    """all, none or some of the findings are accepted."""
    return F.when(accepted == 0, "none").when(accepted == count, "all").otherwise("some")


def value_groups(findings: DataFrame) -> DataFrame:
    """One row for each document and value: counts, first text, commonest category, pages, tri-state.

    Ties between categories go to the one met first by position. Manual areas never merge.
    """
    first = F.get("rects", F.lit(0))
    alone = F.col("is_manual") & F.col("text").startswith("Area ")
    key = F.when(alone, F.concat_ws("|", F.lit("area"), "page", "start", first["x"].cast("string"), first["y"].cast("string"))).otherwise(group_key(F.col("text")))
    rows = findings.withColumn("key", key).withColumn("place", F.struct("page", first["y"].alias("y"), first["x"].alias("x"), "start"))
    by_category = rows.groupBy("doc_id", "key", "category").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("ok"), F.min("place").alias("place"), F.min_by("text", "place").alias("text"), F.collect_set("page").alias("pages")
    )
    out = by_category.groupBy("doc_id", "key").agg(
        F.sum("n").alias("n_findings"),
        F.sum("ok").alias("n_accepted"),
        F.min_by("text", "place").alias("text"),
        F.min_by("category", F.struct((-F.col("n")).alias("n"), "place")).alias("category"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
    )
    return out.withColumn("state", state(F.col("n_accepted"), F.col("n_findings")))


def ordered_groups(groups: DataFrame) -> DataFrame:
    """By display name of the category, most findings first, then text."""
    names = categories(groups.sparkSession).select("category", "display_name")
    return groups.join(F.broadcast(names), "category").orderBy("display_name", F.desc("n_findings"), F.lower("text"))


def category_rollup(findings: DataFrame) -> DataFrame:
    """Counts and tri-state of every category, those without findings included."""
    counts = findings.groupBy("category").agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok"))
    joined = categories(findings.sparkSession).join(counts, "category", "left")
    n, ok = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("ok", F.lit(0)).cast("long")
    return joined.select("ordinal", "category", "display_name", n.alias("n_findings"), ok.alias("n_accepted"), state(ok, n).alias("state"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("found"), F.count_if("accepted").alias("selected"))


def decide(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the latest decision (doc_id, page, start, length, accepted, removed, decided_at) on each finding.

    Removed findings go; a null ``accepted`` leaves the default. Of decisions made at one moment a removal, then a rejection, wins.
    """
    rank = Window.partitionBy(*KEY).orderBy(F.desc("decided_at"), F.desc_nulls_last("removed"), F.asc_nulls_last("accepted"))
    latest = decisions.withColumn("n", F.row_number().over(rank)).where("n = 1").select(*KEY, F.col("accepted").alias("chosen"), "removed")
    joined = findings.join(latest, KEY, "left").where("not coalesce(removed, false)")
    return joined.withColumn("accepted", F.coalesce("chosen", "accepted")).select(*findings.columns)


def set_accepted(findings: DataFrame, value: bool | None, where: Column | None = None) -> DataFrame:
    """Accept, reject or (None) toggle all findings or some."""
    new = ~F.col("accepted") if value is None else F.lit(value)
    return findings.withColumn("accepted", F.when(where, new).otherwise(F.col("accepted")) if where is not None else new)


def remove(findings: DataFrame, gone: DataFrame, on: list[str] | None = None) -> DataFrame:
    return findings.join(gone.select(*(on or KEY)).distinct(), on or KEY, "left_anti")


def add_term_findings(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Add a term's findings; where one with the same place exists it stays and becomes accepted."""
    both = findings.withColumn("new", F.lit(False)).unionByName(found.select(*findings.columns).withColumn("new", F.lit(True)))
    place = Window.partitionBy(*KEY)
    ranked = both.withColumn("n", F.row_number().over(place.orderBy("new"))).withColumn("hit", F.max("new").over(place)).where("n = 1")
    return ranked.withColumn("accepted", F.col("accepted") | F.col("hit")).select(*findings.columns)


def add_terms(terms: list[str], term: str) -> list[str]:
    """A list of terms with one more, unless it is there in any case."""
    term = term.strip()
    return terms if not term or term.lower() in (t.lower() for t in terms) else [*terms, term]


def area_findings(areas: DataFrame, words: DataFrame) -> DataFrame:
    """A finding for each hand-drawn area (doc_id, page, area_id, rect): the words it covers by over 30 %, or the bare area."""
    covered = (F.col("w.rect.w") * F.col("w.rect.h") * 0.3 < R.shared_area(F.col("a.rect"), F.col("w.rect"))) & R.intersects(F.col("a.rect"), F.col("w.rect"))
    on = (F.col("a.doc_id") == F.col("w.doc_id")) & (F.col("a.page") == F.col("w.page")) & covered
    hits = areas.alias("a").join(words.alias("w"), on, "left").groupBy("a.doc_id", "a.page", "a.area_id", "a.rect").agg(
        F.array_sort(F.collect_list(F.when(F.col("w.idx").isNotNull(), F.struct(F.col("w.line").alias("line"), F.col("w.rect.x").alias("x"), F.col("w.text").alias("text"))))).alias("hit")
    )
    size = F.format_string("Area %.0fx%.0f pt", F.col("rect.w"), F.col("rect.h"))
    text = F.when(F.size("hit") > 0, F.array_join(F.transform("hit", lambda h: h["text"]), " ")).otherwise(size)
    return hits.select("doc_id", "page", "area_id", text.alias("text"), F.size("hit").cast("long").alias("n_words"))


def select_by_drag(findings: DataFrame, areas: DataFrame) -> DataFrame:
    """The findings that have a rectangle crossing an area of their page."""
    boxes = findings.select(*KEY, F.explode("rects").alias("r"))
    on = (boxes["doc_id"] == areas["doc_id"]) & (boxes["page"] == areas["page"]) & R.intersects(boxes["r"], areas["rect"])
    return findings.join(boxes.join(areas, on, "left_semi").select(*KEY).distinct(), KEY, "left_semi")


def highlights(findings: DataFrame, scale: float = 110 / 72) -> DataFrame:
    """Rectangles to draw, a point larger on each side, in pixels."""
    return findings.select(*KEY, F.explode("rects").alias("r")).select(*KEY, R.scale(R.inflate(F.col("r"), 1.0), scale).alias("box"))


def to_points(pixels: Column, scale: float = 110 / 72) -> Column:
    return pixels / scale
