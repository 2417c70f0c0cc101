"""Turn records, files and pages into one document relation: title, content, source, url, kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.functions import text as X

# The order in which fields appear in a document text, and where its title comes from.
TEXT_FIELDS = (
    "short_description", "description", "symptoms", "category", "subcategory", "business_service", "technology",
    "support_level", "assignment_group", "resolution_notes", "close_notes", "proposed_solution", "verification",
    "agent_action",
)
TITLE_FIELDS = ("number", "id", "key", "sys_id", "title")


def _as_text(name: str, kind: str) -> Column:
    """Text of a field, null when the field is empty or blank."""
    value = F.col(f"`{name}`")
    if kind.startswith(("array", "struct", "map")):
        value = F.when(X.present(value, "array") if kind.startswith(("array", "map")) else value.isNotNull(), F.to_json(value))
    elif kind in ("double", "float"):
        value = F.when(X.present(value, kind), value).cast("string")
    else:
        value = value.cast("string")
    return F.when(X.collapse(value) != "", value)


def record_documents(df: DataFrame, source: str, position: str | None = None, kind: str = "incident") -> DataFrame:
    """One document per record. ``position`` (0-based) names untitled records; it is not part of the text."""
    kinds = {n: t for n, t in df.dtypes if n != position}
    texts = {n: _as_text(n, t) for n, t in kinds.items()}
    names = [n for n in TEXT_FIELDS if n in kinds] + [n for n in kinds if n not in TEXT_FIELDS]
    untitled = F.concat(F.lit("record "), (F.col(position) + 1).cast("string")) if position else F.lit("record")
    title = F.coalesce(*[texts[n] for n in TITLE_FIELDS if n in kinds], untitled)
    lines = [F.concat(F.lit(f"{n}: "), X.clean_text(texts[n], X.VALUE_LIMIT)) for n in names]
    lines = [F.when(texts[n].isNotNull(), line) for n, line in zip(names, lines)]
    return df.select(
        *([position] if position else []),
        X.clean_text(title, X.TITLE_LIMIT).alias("title"),
        F.concat_ws("\n", *lines).alias("content"),
        F.lit(source).alias("source"),
        F.lit("").alias("url"),
        F.lit(kind).alias("kind"),
    )


def section_documents(files: DataFrame, name: str = "file", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One document per section of a text file."""
    cut = files.select(*keep, F.col(name).alias("source"), F.posexplode(X.sections(text)).alias("_pos", "_part"))
    return cut.select(
        *keep,
        (F.col("_pos") + 1).cast("bigint").alias("section"),
        F.concat(F.col("source"), F.lit(" section "), (F.col("_pos") + 1).cast("string")).alias("title"),
        X.clean_text("_part").alias("content"),
        "source",
        F.lit("").alias("url"),
        F.lit("kb").alias("kind"),
    )


def page_documents(pages: DataFrame, body_text: Column, site: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents of a page search result: id, title and webui link with the page body already as text."""
    link = F.concat_ws("/", F.lit(site.rstrip("/")), F.ltrim(F.col("webui"), F.lit("/")))
    return pages.select(
        *keep,
        X.clean_text(F.coalesce(F.col("title"), F.col("id").cast("string"), F.lit(f"{source} page")), X.TITLE_LIMIT).alias("title"),
        X.clean_text(body_text).alias("content"),
        F.lit(source).alias("source"),
        F.when(F.coalesce(F.col("webui"), F.lit("")) != "", link).otherwise("").alias("url"),
        F.lit("confluence").alias("kind"),
    )


def all_documents(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def phrase_filter(pages: DataFrame, query: str, text: str, limit: int = 3, order: str = "page_id", equals: dict[str, str] | None = None) -> DataFrame:
    """Second-source search: pages holding the first twelve query tokens as one literal phrase."""
    spark = pages.sparkSession
    phrase = spark.range(1).select(F.array_join(F.slice(X.tokens(F.lit(query)), 1, 12), " ").alias("p")).scalar()
    hits = pages.where((phrase != "") & F.contains(F.lower(F.col(text)), phrase))
    for column, value in (equals or {}).items():
        hits = hits.where(F.col(column) == value)
    return hits.orderBy(order).limit(X.clamp(limit, 1, 10))
