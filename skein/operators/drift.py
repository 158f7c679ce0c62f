"""Schemas that drift between files: one consistent table and a list of the changes.

Each line is parsed into a variant inside the JVM; the schema of a file is folded from its lines (how many carry a
field, how many values have each type), the types through a promotion lattice. Changes come from comparing each file
with the one before. A rename is found by values: for the addresses that two consecutive files share, what a field
that left held is compared with what a field that came holds, in a form that does not depend on the type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import SCHEME
from skein.runtime import drop_staged, stage

# The lattice, from narrow to wide. Two types promote to the wider one; anything meets array or object at string.
TYPES = ["boolean", "integer", "decimal", "array", "object", "string"]
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "decimal": "double", "array": "string", "object": "string", "string": "string"}
SHARE = 3  # a field belongs to a file if at least one line of SHARE carries it
RENAME_SCORE = 0.5
ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"
NUMBER = r"^-?\d{1,18}(\.\d+)?$"


def promote(left: str | None, right: str | None) -> str | None:
    """The narrowest type that holds values of both; None is the type of a field that has only nulls."""
    if left == right or right is None:
        return left
    if left is None:
        return right
    if {left, right} <= {"boolean", "integer", "decimal"}:
        return max(left, right, key=TYPES.index)
    return "string"


def value_type(kind: Column, text: Column) -> Column:
    """Type name of a variant value, from schema_of_variant and its text; null for a null."""
    whole = F.expr("try_cast(text as double)") == F.floor(F.expr("try_cast(text as double)"))
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), F.when(whole, "integer").otherwise("decimal"))
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def canonical_value(kind: Column, text: Column) -> Column:
    """The same text for one value in its different types: dates and epochs in ms, numbers, booleans as 0 and 1, ids without scheme, JSON in a string."""
    trimmed = F.trim(text)
    number = F.expr("try_cast(trim(text) as double)")
    scaled = F.when(F.abs(number) >= 1e11, number).when(F.abs(number) >= 1e8, number * 1000).otherwise(number)
    as_number = F.when(F.abs(number) >= 1e8, F.round(scaled).cast("long").cast("string")).otherwise(scaled.cast("string"))
    zoned = "case when trim(text) rlike '(Z|[+-][0-9]{2}:?[0-9]{2})$' then trim(text) else concat(trim(text), 'Z') end"
    as_time = F.unix_millis(F.expr(f"try_cast({zoned} as timestamp)")).cast("string")  # UTC, whatever the session's zone
    inner = F.try_parse_json(trimmed)
    is_json = kind.startswith("OBJECT") | kind.startswith("ARRAY") | ((kind == "STRING") & trimmed.rlike(r"^[\[{]"))
    address = F.try_variant_get(inner, "$.id", "string")
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(is_json & inner.isNotNull(), F.coalesce(F.regexp_replace(address, SCHEME, ""), F.to_json(inner)))
        .when((kind == "BOOLEAN") | trimmed.isin("true", "false"), F.when(trimmed == "true", "1.0").otherwise("0.0"))
        .when(trimmed.rlike(ISO), F.coalesce(as_time, trimmed))
        .when(trimmed.rlike(NUMBER), as_number)
        .otherwise(F.regexp_replace(trimmed, SCHEME, ""))
    )


def line_fields(rows: DataFrame) -> DataFrame:
    """(raw_id, feed, file_no, field, type, kind, text) of each field of each line that is a JSON object; kind is the type as the parser names it.

    Lines that are no JSON object, null ones and objects with repeated names included, give no rows.
    """
    whole = rows.select("raw_id", "feed", F.col("file_no").cast("long").alias("file_no"), F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]"))).alias("v"))
    whole = whole.filter(F.schema_of_variant("v").startswith("ARRAY<OBJECT") & F.try_variant_get("v", "$[1]", "variant").isNull())
    view = whole.select("raw_id", "feed", "file_no", F.variant_get("v", "$[0]", "variant").alias("v"))
    parts = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("v").outer()))
    flat = parts.select(
        "raw_id", "feed", "file_no", F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"), F.col("value").cast("string").alias("text")
    )
    return flat.select(
        "raw_id", "feed", "file_no", "field",
        value_type(F.col("kind"), F.col("text")).alias("type"),
        "kind", "text",
    )


def file_schemas(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """(feed, file_no, field, type) of the fields that belong to a file.

    The type is that of most non-null values, the wider one on ties; null if all are null.
    """
    lines = fields.groupBy("feed", "file_no", "raw_id").agg(F.lit(1).alias("one")).groupBy("feed", "file_no").agg(F.count("one").alias("n_lines"))
    by_type = [F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in TYPES]
    held = fields.groupBy("feed", "file_no", "field").agg(F.count(F.lit(1)).alias("n"), *by_type)
    best = F.array_max(F.array([F.struct(F.col(f"n_{t}").alias("n"), F.lit(i).alias("rank"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]))
    return (
        held.join(lines, ["feed", "file_no"])
        .filter(F.col("n") * SHARE >= F.col("n_lines"))
        .select("feed", "file_no", "field", F.when(best.getField("n") > 0, best.getField("type")).alias("type"))
    )


def schema_changes(rows: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(feed, file_no, change_kind, field_name, old_name) of each change against the file before.

    change_kind is added, removed, renamed or retyped. ``rows`` is (raw_id, feed, file_no, body). A file whose
    number less one is not in the feed has no changes; a field with only nulls is never retyped. The addresses
    (field url) that both files have decide on renames; a pair is taken if each is the other's best and at least
    half of the addresses where both have a value agree. Null feeds or numbers are left out; an empty table gives no rows.
    """
    rows = rows.filter("feed is not null and file_no is not null")
    fields = fields if fields is not None else stage(line_fields(rows), "fields")
    schemas = stage(file_schemas(rows, fields), "schemas")
    files = rows.select("feed", F.col("file_no").cast("long").alias("file_no")).distinct()
    compared = files.join(files.select("feed", (F.col("file_no") + 1).alias("file_no")), ["feed", "file_no"])
    before = schemas.select("feed", (F.col("file_no") + 1).alias("file_no"), "field", F.lit(True).alias("was"), F.col("type").alias("old_type"))
    now = schemas.withColumn("is", F.lit(True))
    both = stage(now.join(before, ["feed", "file_no", "field"], "full").join(compared, ["feed", "file_no"], "left_semi"), "compared")
    came = both.filter(F.col("was").isNull()).select("feed", "file_no", F.col("field").alias("new_name"), "type")
    left = both.filter(F.col("is").isNull()).select("feed", "file_no", F.col("field").alias("old_name"), "old_type")

    # values are brought into one form only where a field came or left
    canon = canonical_value(F.col("kind"), F.col("text")).alias("canon")
    compared_rows = fields.select("raw_id", "feed", "file_no", "field", "kind", "text")
    urls = stage(fields.filter("field = 'url'").select("raw_id", canon.alias("url")).filter("url is not null"), "urls")
    # written before they are brought into form, as the optimizer would test all values for a form before it joins
    picked = lambda v, pick, name: stage(
        v.join(pick.select("feed", "file_no", F.col(name).alias("field")), ["feed", "file_no", "field"], "left_semi").withColumnRenamed("field", name), name
    )
    held = lambda v, pick, name: stage(
        picked(v, pick, name).select("raw_id", "feed", "file_no", name, canon).filter("canon is not null").join(urls, "raw_id").select("feed", "file_no", "url", name, "canon").distinct(),
        name,
    )
    new, old = held(compared_rows, came, "new_name"), held(compared_rows.withColumn("file_no", F.col("file_no") + 1), left, "old_name")
    names = ["feed", "file_no", "old_name", "new_name"]
    shared = new.select("feed", "file_no", "url", "new_name").distinct().join(old.select("feed", "file_no", "url", "old_name").distinct(), ["feed", "file_no", "url"])
    n = shared.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    agreed = new.join(old, ["feed", "file_no", "url", "canon"]).select(*names, "url").distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("m"))
    scored = n.join(agreed, names).withColumn("score", F.col("m") / F.col("n")).filter(F.col("score") >= RENAME_SCORE)
    of = lambda name, other: F.row_number().over(Window.partitionBy("feed", "file_no", name).orderBy(F.desc("score"), F.desc("n"), other))
    mutual = scored.withColumn("a", of("old_name", "new_name")).withColumn("b", of("new_name", "old_name")).filter("a = 1 and b = 1")
    renamed = stage(mutual.select("feed", "file_no", "old_name", "new_name", "score", "n"), "renamed")

    out = lambda df, kind, name, old=None: df.select("feed", "file_no", F.lit(kind).alias("change_kind"), F.col(name).alias("field_name"), (F.col(old) if old else F.lit(None).cast("string")).alias("old_name"))
    key_new, key_old = ["feed", "file_no", "new_name"], ["feed", "file_no", "old_name"]
    types = renamed.join(came, key_new).join(left, key_old).filter("type <> old_type")
    return (
        out(came.join(renamed, key_new, "left_anti"), "added", "new_name")
        .union(out(left.join(renamed, key_old, "left_anti"), "removed", "old_name"))
        .union(out(renamed, "renamed", "new_name", "old_name"))
        .union(out(both.filter("was and is and type <> old_type").withColumnRenamed("field", "name"), "retyped", "name"))
        .union(out(types, "retyped", "new_name", "old_name"))
    )


def name_groups(pairs: DataFrame) -> DataFrame:
    """(name, head) of the names of pairs (left, right): linked names have one head, the least of them.

    Each round takes the least head among the neighbours' and then the head's own head, until nothing changes.
    """
    links = stage(pairs.select("left", "right").union(pairs.select("right", "left")).filter("left <> right").distinct(), "links")
    heads = stage(links.groupBy(F.col("left").alias("name")).agg(F.min("right").alias("least")).select("name", F.least("name", "least").alias("head")), "heads")
    while True:
        near = links.join(heads.select(F.col("name").alias("right"), "head"), "right").groupBy(F.col("left").alias("name")).agg(F.min("head").alias("near"))
        closer = heads.join(near, "name").select("name", F.col("head").alias("before"), F.least("head", "near").alias("head"))
        above = heads.select(F.col("name").alias("head"), F.col("head").alias("above"))
        step = stage(closer.join(above, "head").select("name", F.least("head", "above").alias("head"), (F.least("head", "above") < F.col("before")).alias("changed")), "heads")
        drop_staged(heads)
        heads = step.drop("changed")
        if step.filter("changed").isEmpty():
            return heads


def unified_names(changes: DataFrame) -> DataFrame:
    """(field, name): the name in the consistent table of each field that was ever renamed, from the renames of all feeds.

    Names that rename into each other are one field, named by the member renamed to most often (the smaller on ties).
    """
    pairs = stage(changes.filter("change_kind = 'renamed'").groupBy(F.col("old_name").alias("left"), F.col("field_name").alias("right")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    into = pairs.groupBy(F.col("right").alias("name")).agg(F.sum("n").alias("n"))
    groups = name_groups(pairs).join(into, "name", "left")
    chosen = groups.groupBy("head").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.col("name").alias("chosen"))).getField("chosen").alias("chosen"))
    return groups.join(chosen, "head").select(F.col("name").alias("field"), F.col("chosen").alias("name"))


def promoted(types: Column) -> Column:
    """The fold of an array of type names by ``promote``; string where there is none."""
    narrow = [t for t in TYPES if t in ("boolean", "integer", "decimal")]
    widest = F.element_at(F.array(*map(F.lit, narrow)), F.array_max(F.transform(types, lambda t: F.array_position(F.array(*map(F.lit, narrow)), t))).cast("int"))
    return F.when(F.size(types) == 0, "string").when(F.size(types) == 1, types[0]).when(F.forall(types, lambda t: t.isin(*narrow)), widest).otherwise("string")


def unified_types(fields: DataFrame, names: DataFrame) -> DataFrame:
    """(name, type): the fields of the consistent table and their promoted types, over all values of all files."""
    named = fields.join(names, "field", "left").select(F.coalesce("name", "field").alias("name"), "type")
    return named.groupBy("name").agg(F.collect_set("type").alias("types")).select("name", promoted(F.col("types")).alias("type"))


def consistent_table(rows: DataFrame, fields: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """One row per line that is a JSON object: raw_id, feed, file_no and a column f_<field> for each field of the union schema.

    Values are cast to the promoted type; one that can't be cast is null. If a line has a field under two of its
    names the larger text counts. Columns carry the prefix f_ so that no field clashes with the keys; names that
    differ only in letter case stay apart by a number. The fields are the columns of the table, so their names and types
    come to the driver as any table's schema does.
    """
    named = fields.join(names, "field", "left").select("raw_id", "feed", "file_no", F.coalesce("name", "field").alias("name"), "text")
    once = named.groupBy("raw_id", "feed", "file_no", "name").agg(F.max("text").alias("text"))
    lines = once.groupBy("raw_id", "feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("held"))
    columns, used = [], set()
    for field, kind in sorted(tuple(r) for r in types.collect()):
        label = f"f_{field}"
        while label.lower() in used:
            label += "_2"
        used.add(label.lower())
        columns.append(F.col("held").getItem(field).try_cast(SQL_TYPES[kind]).alias(label))
    return lines.select("raw_id", "feed", "file_no", *columns)
