"""Accept raw generated records: parse, cap, keep exact-distinct ones, repair keys, resume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.functions import responses as R
from deskweave.functions import text as X
from deskweave.operators.ordering import SLICE, first_rows, numbered, running, sliced
from deskweave.operators.staging import stage

# Fixed values.
NUMBER_PREFIXES: Mapping[str, str] = {"incident": "INC", "change_request": "CHG", "sc_request": "REQ"}
OTHER_PREFIX, NUMBER_BASE = "REC", 1_000_000
DISTRIBUTION_FIELDS = ("category", "subcategory", "state", "priority", "assignment_group", "business_service", "type",
                       "risk", "request_type", "catalog_item", "approval", "stage", "_test_scenario")
RECENT_FIELDS = ("number", "category", "subcategory", "state", "priority", "assignment_group", "business_service",
                 "type", "risk", "request_type", "catalog_item", "approval", "stage", "opened_at",
                 "planned_start_date", "_test_scenario")


def response_records(responses: DataFrame, response: str = "response", requested: str = "requested") -> DataFrame:
    """One variant ``record`` per accepted row; a response gives at most as many as were requested."""
    items = F.slice(R.record_array(response, "records"), F.lit(1), F.col(requested))
    kept = [c for c in responses.columns if c not in (response, requested)]
    return responses.select(*kept, F.posexplode(items).alias("place", "record"))


def first_arrivals(df: DataFrame, key: str | Column, seq: str) -> DataFrame:
    """The first row of each content key.

    Only (key, seq) is grouped, with partial aggregation, so a text that makes up a third of the
    table costs one row per task; the wide rows are then picked by their unique ``seq``.
    """
    key = F.col(key) if isinstance(key, str) else key
    first = df.select(key.alias("_key"), F.col(seq).alias("_s")).groupBy("_key").agg(F.min("_s").alias("_first"))
    return df.join(first, F.col(seq) == F.col("_first"), "left_semi")


def exact_distinct(df: DataFrame, seq: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in df.columns if c != seq]
    return first_arrivals(df, X.fingerprint(columns), seq)


def resume_union(stored: DataFrame, incoming: DataFrame, seq: str, cap: int | None = None) -> DataFrame:
    """Stored rows, then new distinct ones in order of arrival, up to ``cap`` rows."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    content = X.fingerprint([c for c in stored.columns if c != seq])
    keyed = rows.withColumn("_key", content)
    order = F.struct("_new", seq)
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first")).select(
        F.col("_first._new").alias("_fn"), F.col(f"_first.{seq}").alias("_fs")
    )
    kept = keyed.join(first, (F.col("_new") == F.col("_fn")) & (F.col(seq) == F.col("_fs")), "left_semi")
    if cap is not None:
        kept = first_rows(kept, ["_new", seq], cap)
    return kept.drop("_new", "_key")


def _smaller_than(values: DataFrame, marks: DataFrame, inclusive: bool) -> DataFrame:
    """Each row of ``values(v, …)`` with the number of marks below it (or not above it)."""
    mark_first = 0 if inclusive else 2
    both = values.withColumn("_kind", F.lit(1)).unionByName(
        marks.select("v").withColumn("_kind", F.lit(mark_first)), allowMissingColumns=True
    ).withColumn("_tie", F.monotonically_increasing_id())
    is_mark = (F.col("_kind") != 1).cast("bigint")
    counted = running(sliced(both, [], ["v", "_kind", "_tie"]), [], ["v", "_kind", "_tie"], sums={"_below": is_mark})
    return counted.where(F.col("_kind") == 1).drop("_kind", "_tie", SLICE)


def repaired_numbers(df: DataFrame, table_name: str, seq: str = "seq", number: str = "number") -> DataFrame:
    """Give rows with a missing or repeated number a new one, skipping numbers in use.

    The first holder of a number keeps it. The row at position p gets base + p, or the next free
    number after it. In terms of free numbers only (those no first holder has) the i-th broken row
    gets free index max(own index, index of the broken row before + 1), which is a running maximum;
    counting the used numbers below a value turns numbers into free indexes and back.
    """
    prefix = NUMBER_PREFIXES.get(table_name, OTHER_PREFIX)
    given = F.when(F.coalesce(F.col(number).cast("string"), F.lit("")) != "", F.col(number).cast("string"))
    placed = stage(numbered(df, [seq], "position"), "placed")
    keepers = placed.where(given.isNotNull()).groupBy(given.alias("_n")).agg(F.min(seq).alias("_keeper"))
    keepers = stage(keepers, "keepers")
    marked = placed.join(keepers.select("_keeper"), F.col(seq) == F.col("_keeper"), "left")
    slot = F.try_to_number(F.regexp_extract("_n", f"^{prefix}([0-9]+)$", 1), F.lit("9" * 18)).cast("bigint")
    used = keepers.select(slot.alias("v"), "_n").where(
        (F.col("v") > NUMBER_BASE) & (F.col("_n") == F.format_string(f"{prefix}%07d", F.col("v")))
    ).select("v").distinct()
    broken = marked.where(F.col("_keeper").isNull()).select(seq, (F.col("position") + NUMBER_BASE).alias("v"))

    if used.isEmpty():
        chosen = broken.select(F.col(seq).alias("_s"), F.col("v").alias("_slot"))
    else:
        used = numbered(used, ["v"], "_rank")
        own = _smaller_than(broken, used, inclusive=False).withColumn("_own", F.col("v") - F.col("_below"))
        own = numbered(own.drop("v", "_below"), [seq], "_i")
        lead = running(sliced(own, [], [seq]), [], [seq], maxima={"_lead": F.col("_own") - F.col("_i")})
        index = lead.select(seq, (F.col("_lead") + F.col("_i")).alias("v"))
        gaps = used.select((F.col("v") - (F.col("_rank") - 1)).alias("v"))
        placed_back = _smaller_than(index, gaps, inclusive=True)
        chosen = placed_back.select(F.col(seq).alias("_s"), (F.col("v") + F.col("_below")).alias("_slot"))
    out = marked.join(chosen, F.col(seq) == F.col("_s"), "left")
    fresh = F.when(F.col("_slot").isNotNull(), F.format_string(f"{prefix}%07d", F.col("_slot")))
    return out.withColumn(number, F.coalesce(fresh, given)).drop("_keeper", "_s", "_slot")


def repaired_sys_ids(df: DataFrame, signature: str, fingerprint: str = "fingerprint", seq: str = "seq", sys_id: str = "sys_id") -> DataFrame:
    """Missing or repeated sys_id becomes 32 hex digits of (signature, position, fingerprint)."""
    given = F.when(F.coalesce(F.col(sys_id).cast("string"), F.lit("")) != "", F.col(sys_id).cast("string"))
    keepers = df.where(given.isNotNull()).groupBy(given.alias("_n")).agg(F.min(seq).alias("_keeper")).select("_keeper")
    made = F.substring(F.sha2(F.concat_ws(":", F.lit(signature), (F.col("position") - 1).cast("string"), fingerprint), 256), 1, 32)
    marked = df.join(keepers, F.col(seq) == F.col("_keeper"), "left")
    return marked.withColumn(sys_id, F.when(F.col("_keeper").isNotNull(), given).otherwise(made)).drop("_keeper")


def field_distribution(df: DataFrame, fields: Sequence[str] = DISTRIBUTION_FIELDS, top: int = 12) -> DataFrame:
    """Most frequent labels per field: count descending, label ascending."""
    from pyspark.sql import Window

    kinds = dict(df.dtypes)
    named = [f for f in fields if f in kinds and not kinds[f].startswith(("array", "map", "struct", "variant"))]
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.when(X.present(f, kinds[f]), F.substring(F.col(f).cast("string"), 1, 100)).alias("label"))
        for f in named
    ])
    counts = df.select(F.inline(pairs)).where(F.col("label").isNotNull()).groupBy("field", "label").agg(
        F.count(F.lit(1)).alias("records")
    )
    best = Window.partitionBy("field").orderBy(F.desc("records"), "label")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def continuity_summary(df: DataFrame, seq: str = "seq", number: str = "number") -> DataFrame:
    named = F.when(F.coalesce(F.col(number).cast("string"), F.lit("")) != "", F.col(seq))
    return df.agg(
        F.count(F.lit(1)).alias("generated_so_far"),
        F.min_by(number, named).alias("first_record_number"),
        F.max_by(number, named).alias("latest_record_number"),
    )


def recent_records(df: DataFrame, n: int, seq: str = "seq", fields: Sequence[str] = RECENT_FIELDS) -> DataFrame:
    """The last ``n`` rows (0..10), text cut to 160 characters. Zero means none."""
    n = X.clamp(n, 0, 10)
    kinds = dict(df.dtypes)
    shown = [F.substring(F.col(f), 1, 160).alias(f) if kinds[f] == "string" else F.col(f) for f in fields if f in kinds]
    return df.select(F.col(seq).alias("_seq"), *shown).orderBy(F.desc("_seq")).limit(n).drop("_seq")


def rotating_examples(batches: DataFrame, examples: DataFrame, per_batch: int, batch: str = "batch_no", position: str = "position") -> DataFrame:
    """``per_batch`` examples for each batch, starting where the last batch stopped and wrapping around."""
    k = X.clamp(per_batch, 0, 10)
    n = examples.agg(F.count(F.lit(1))).scalar()
    offsets = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")
    wanted = batches.select(batch, F.explode(offsets).alias("_o")).where(F.col("_o") < n).select(
        batch, F.col("_o").alias("place"), F.pmod((F.col(batch) - 1) * k + F.col("_o"), n).alias("_at")
    )
    return wanted.join(examples, F.col("_at") == F.col(position) - 1).drop("_at")


def compact_value(name: str, kind: str) -> Column:
    """Example value for a prompt: text up to 500 characters, lists up to 12 items."""
    value = F.col(name)
    if kind == "string":
        return F.substring(value, 1, 500).alias(name)
    if kind == "array<string>":
        return F.transform(F.slice(value, 1, 12), lambda x: F.substring(x, 1, 500)).alias(name)
    if kind.startswith("array"):
        return F.slice(value, 1, 12).alias(name)
    return value.alias(name)


def compact_examples(df: DataFrame) -> DataFrame:
    return df.select(*[compact_value(n, t) for n, t in df.dtypes])


def redacted(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values of the listed fields masked, at any depth of structs, lists and maps; e-mail addresses masked everywhere else.

    A listed map key keeps its place; a value that is no text becomes null there. A variant hides its fields from the
    plan, so it is refused unless its own name is listed.
    """
    from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

    listed = {f.strip().lower() for f in fields if f.strip()}

    def clean(value: Column, kind: DataType, name: str) -> Column:
        if name.lower() in listed:
            return F.lit(f"[REDACTED_{name.upper()}]")
        if isinstance(kind, StringType):
            return X.redact_email(value)
        if isinstance(kind, StructType):
            inner = F.struct(*[clean(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), inner)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType, name))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda k, v: by_key(k, v, kind))
        if isinstance(kind, VariantType):
            raise TypeError(f"Give the variant {name} a schema before it is redacted.")
        return value

    def by_key(key: Column, value: Column, kind: MapType) -> Column:
        kept = clean(value, kind.valueType, "")
        if not isinstance(kind.keyType, StringType):
            return kept
        mask = F.concat(F.lit("[REDACTED_"), F.upper(key), F.lit("]")) if isinstance(kind.valueType, StringType) else F.lit(None)
        return F.when(F.lower(key).isin(sorted(listed)), mask).otherwise(kept)

    return df.select(*[clean(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def prompt_rows(df: DataFrame) -> Column:
    """A row as compact JSON text, nulls included."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
