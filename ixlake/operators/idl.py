"""Interface descriptions (IDLs) to catalogs, generated schemas and quality reports.

Everything about a document is in its own row, so these are narrow jobs: the documents
spread over the cluster, and no step here shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ixlake import constants as K
from ixlake.functions.text import or_default, snake_case, table_name
from ixlake.schema import IDL

_CORRUPT = "_corrupt"


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs(path, text)`` to ``(program_id, idl_name, idl)``, and ``modified`` if given.

    What :func:`split_documents` keeps.
    """
    return split_documents(docs)[0]


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interface documents, and those that cannot be used as (path, text, reason).

    The program id is the document's address, else its file name. Rejected are documents that
    aren't JSON of the known shape (``not_a_document``) and ids shorter than an address
    (``short_program_id``).
    """
    parsed = F.from_json(
        "text",
        IDL.replace("struct<", f"struct<{_CORRUPT}:string,", 1),
        {"columnNameOfCorruptRecord": _CORRUPT},
    )
    file_name = F.regexp_extract("path", r"([^/]+?)(\.json)?$", 1)
    bad = F.col("idl").isNull() | F.col(f"idl.{_CORRUPT}").isNotNull()
    # A one-element explode keeps the parse from being copied into each filter and field.
    judged = (
        docs.select("path", "text", *_modified(docs), F.explode(F.array(parsed)).alias("idl"))
        .withColumn("program_id", or_default(F.col("idl.address"), file_name))
        .withColumn(
            "reason",
            F.when(bad, F.lit("not_a_document")).when(
                ~F.coalesce(F.length("program_id") >= K.MIN_PROGRAM_ID_LENGTH, F.lit(False)), F.lit("short_program_id")
            ),
        )
    )
    kept = judged.filter("reason IS NULL").select(
        "program_id", or_default(F.col("idl.name"), "Unknown").alias("idl_name"), "idl", *_modified(docs)
    )
    return kept, judged.filter("reason IS NOT NULL").select("path", "text", "reason")


def newest_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One document per program, the newest (then the greatest by content), and the others.

    Repeated documents would otherwise multiply the rows of every join with the catalog.
    """
    age = [F.col(c).desc_nulls_last() for c in _modified(parsed)]
    newest = Window.partitionBy("program_id").orderBy(*age, F.xxhash64("idl").desc())
    ranked = parsed.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter("_rank = 1").drop("_rank"), ranked.filter("_rank > 1").drop("_rank")


def _fields(texts: Column) -> Column:
    """Fields as (name, type): an object's own, or a bare type named by its place."""
    return F.transform(
        _list(texts, "string"),
        lambda text, at: F.when(
            text.startswith("{") & F.get_json_object(text, "$.type").isNotNull(),
            F.struct(F.get_json_object(text, "$.name").alias("name"), F.get_json_object(text, "$.type").alias("type")),
        ).otherwise(F.struct(at.cast("string").alias("name"), text.alias("type"))),
    )


def _modified(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "modified"]


def _list(value: Column, element: str) -> Column:
    return F.coalesce(value, F.from_json(F.lit("[]"), f"array<{element}>"))


def _last_per_name(items: Column) -> Column:
    """Of items with the same lower-case name the last one stays."""
    return F.filter(
        items,
        lambda x, i: ~F.exists(
            F.slice(items, i + 2, F.size(items)),
            lambda later: F.lower(later["name"]) == F.lower(x["name"]),
        ),
    )


def discriminator(name: Column) -> Column:
    """First eight bytes of the SHA-256 of the instruction's global name."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit("global:"), snake_case(name)), 256)), 1, 8)


def instructions(parsed: DataFrame) -> DataFrame:
    """One row per instruction of every document."""
    items = _last_per_name(F.col("idl.instructions"))
    declared = F.unhex(
        F.array_join(F.transform("ix.discriminator", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )
    return (
        parsed.select(
            "program_id",
            "idl_name",
            *_modified(parsed),
            F.col("idl.types").alias("types"),
            F.posexplode(items).alias("ix_pos", "ix"),
        )
        .select(
            *_modified(parsed),
            "program_id",
            "idl_name",
            "ix_pos",
            F.col("ix.name").alias("name"),
            F.lower("ix.name").alias("instruction"),
            table_name("ix", F.col("ix.name")).alias("table_name"),
            F.coalesce(declared, discriminator(F.col("ix.name"))).alias("disc"),
            _list(F.col("ix.args"), "struct<name:string,type:string>").alias("args"),
            "types",
        )
    )


def resolve_names(names: Column, reserved: tuple[str, ...]) -> Column:
    """Column names for fields, in order: a taken name gets the next free ``_1``, ``_2``, ...

    Comparison ignores case, as column look-up does. The rule is sequential, so it is a
    fold over the fields of one table. Where no name is taken, the names stay and nothing is folded.
    """
    lowered = F.transform(F.concat(F.array(*[F.lit(r) for r in reserved]), names), F.lower)
    untouched = F.size(F.array_distinct(lowered)) == F.size(lowered)
    start = F.struct(
        F.array(*[F.lit(r) for r in reserved]).alias("seen"),
        F.from_json(F.lit("[]"), "array<string>").alias("out"),
    )

    def step(acc: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(1), F.size(acc["seen"])),
            lambda i: F.concat(name, F.lit("_"), i.cast("string")),
        )
        free = F.filter(numbered, lambda n: ~F.array_contains(acc["seen"], F.lower(n)))
        chosen = F.when(
            F.array_contains(acc["seen"], F.lower(name)), F.element_at(free, 1)
        ).otherwise(name)
        return F.struct(
            F.concat(acc["seen"], F.array(F.lower(chosen))).alias("seen"),
            F.concat(acc["out"], F.array(chosen)).alias("out"),
        )

    return F.when(untouched, names).otherwise(F.aggregate(names, start, step, lambda acc: acc["out"]))


def _nesting(type_text: Column) -> Column:
    """Upper bound of the wrapper depth of a type: its number of braces."""
    return F.length(type_text) - F.length(F.replace(type_text, F.lit("{"), F.lit("")))


def unwrap_type(type_text: Column) -> Column:
    """Innermost type name under option / vec / array / defined, at any depth.

    What is left as JSON text has no known shape.
    """

    def peel(t: Column, _: Column) -> Column:
        inner = F.coalesce(
            F.get_json_object(t, "$.defined.name"),
            F.get_json_object(t, "$.defined"),
            F.get_json_object(t, "$.option"),
            F.get_json_object(t, "$.vec"),
            F.get_json_object(t, "$.array[0]"),
            t,
        )
        return F.when(t.startswith("{"), inner).otherwise(t)

    unwrapped = F.aggregate(F.sequence(F.lit(1), _nesting(type_text)), type_text, peel)
    return F.when(type_text.startswith("{"), unwrapped).otherwise(type_text)


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def storage_type(type_text: Column) -> Column:
    """INTEGER for small numbers and flags, TEXT for everything else."""
    return F.coalesce(
        _lookup({k: v[0] for k, v in K.SCALAR_TYPES.items()}, type_text), F.lit("TEXT")
    )


def spark_type(type_text: Column) -> Column:
    """Spark type name: scalars by table, vec and array as ARRAY, option as its inner type,
    named and unknown shapes as VARIANT."""
    start = F.struct(type_text.alias("t"), F.lit(0).alias("depth"))

    def peel(acc: Column, _: Column) -> Column:
        t = acc["t"]
        item = F.coalesce(F.get_json_object(t, "$.vec"), F.get_json_object(t, "$.array[0]"))
        option = F.get_json_object(t, "$.option")
        wrapped = t.startswith("{") & F.get_json_object(t, "$.defined").isNull()
        return F.struct(
            F.when(wrapped, F.coalesce(option, item, t)).otherwise(t).alias("t"),
            F.when(wrapped & option.isNull() & item.isNotNull(), acc["depth"] + 1)
            .otherwise(acc["depth"])
            .alias("depth"),
        )

    scalars = {k: v[1] for k, v in K.SCALAR_TYPES.items()}
    nested = F.aggregate(
        F.sequence(F.lit(1), _nesting(type_text)),
        start,
        peel,
        lambda acc: F.concat(
            F.repeat(F.lit("ARRAY<"), acc["depth"]),
            F.coalesce(_lookup(scalars, acc["t"]), F.lit("VARIANT")),
            F.repeat(F.lit(">"), acc["depth"]),
        ),
    )
    plain = F.coalesce(_lookup(scalars, type_text), F.lit("VARIANT"))
    return F.when(type_text.startswith("{"), nested).otherwise(plain)


def _table_schema(items: DataFrame, fields: Column, fixed: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows (…, position, column_name, field_name, field_type, spark_type) of generated tables."""
    names = resolve_names(F.transform(fields, lambda f: f["name"]), tuple(n for n, _ in fixed))
    named = F.transform(
        fields,
        lambda f, i: F.struct(
            (i + F.lit(len(fixed) + 1)).alias("position"),
            F.get(F.col("_names"), i).alias("column_name"),
            f["name"].alias("field_name"),
            f["type"].alias("field_type"),
        ),
    )
    envelope = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(None).cast("string").alias("field_name"),
                F.lit(None).cast("string").alias("field_type"),
            )
            for i, (name, _) in enumerate(fixed)
        ]
    )
    fixed_types = dict(fixed)
    return (
        items.withColumn("_names", names)
        .select("program_id", "table_name", F.inline(F.concat(envelope, named)))
        .withColumn(
            "spark_type",
            F.when(F.col("field_type").isNull(), _lookup(fixed_types, F.col("column_name"))).otherwise(
                spark_type(F.col("field_type"))
            ),
        )
    )


def ix_schema(parsed: DataFrame) -> DataFrame:
    """Columns of every instruction table: four envelope columns, then the arguments."""
    return _table_schema(instructions(parsed), F.col("args"), K.IX_ENVELOPE)


def acc_schema(parsed: DataFrame) -> DataFrame:
    """Columns of every account table: three envelope columns, then the fields."""
    accounts = parsed.select(
        "program_id", F.explode(_last_per_name(F.col("idl.accounts"))).alias("acc")
    ).select(
        "program_id",
        table_name("acc", F.col("acc.name")).alias("table_name"),
        _fields(F.col("acc.type.fields")).alias("fields"),
    )
    return _table_schema(accounts, F.col("fields"), K.ACC_ENVELOPE)


def _references(idl: Column) -> Column:
    """Every type reference of a document: array of (context, type)."""

    def refs(prefix: Column, fields: Column, middle: str) -> Column:
        return F.transform(
            _list(fields, "struct<name:string,type:string>"),
            lambda f: F.struct(
                F.concat(prefix, F.lit(middle), f["name"]).alias("context"),
                f["type"].alias("type"),
            ),
        )

    def under(items: Column, make) -> Column:
        nested = F.transform(items, make)
        return F.coalesce(F.flatten(nested), F.from_json(F.lit("[]"), "array<struct<context:string,type:string>>"))

    args = under(
        idl["instructions"],
        lambda ix: refs(F.concat(F.lit("Instruction:"), ix["name"]), ix["args"], ":Arg:"),
    )
    fields = under(
        idl["types"],
        lambda t: refs(F.concat(F.lit("Type:"), t["name"]), _fields(t["type"]["fields"]), ":Field:"),
    )

    def variant_refs(t: Column, v: Column) -> Column:
        objects = F.filter(_list(v["fields"], "string"), lambda f: f.startswith("{"))
        return F.transform(
            objects,
            lambda f: F.struct(
                F.concat(F.lit("Type:"), t["name"], F.lit(":Variant:"), v["name"]).alias("context"),
                F.coalesce(F.get_json_object(f, "$.type"), f).alias("type"),
            ),
        )

    variants = under(
        idl["types"],
        lambda t: F.flatten(
            F.transform(
                _list(t["type"]["variants"], "struct<name:string,fields:array<string>>"),
                lambda v: variant_refs(t, v),
            )
        ),
    )
    events = under(
        idl["events"], lambda e: refs(F.concat(F.lit("Event:"), e["name"]), e["fields"], ":Field:")
    )
    return F.concat(args, fields, variants, events)


def type_audit(parsed: DataFrame) -> DataFrame:
    """Type references that cannot be resolved inside their document.

    ``problem`` is ``unresolved`` (a name neither primitive nor defined) or ``ambiguous``
    (an object of no known shape). Definitions and references meet inside the row.
    """
    known = F.concat(
        F.array(*[F.lit(t) for t in K.SCALAR_TYPES]),
        F.coalesce(F.transform("idl.types", lambda t: t["name"]), F.from_json(F.lit("[]"), "array<string>")),
    )
    judged = F.transform(
        _references(F.col("idl")),
        lambda r: F.struct(
            r["context"].alias("context"),
            r["type"].alias("type"),
            unwrap_type(r["type"]).alias("base_type"),
        ),
    )
    shapeless = lambda t: t.startswith("{") | t.startswith("[")
    return (
        parsed.withColumn("_known", known)
        .withColumn("_refs", F.filter(judged, lambda r: F.coalesce(r["type"], F.lit("")) != ""))
        .select(
            "program_id",
            F.inline(F.filter("_refs", lambda r: ~F.array_contains(F.col("_known"), r["base_type"]))),
        )
        .withColumn(
            "problem",
            F.when(shapeless(F.col("base_type")), F.lit("ambiguous")).otherwise(F.lit("unresolved")),
        )
    )


def collisions(parsed: DataFrame) -> DataFrame:
    """Argument names used more than once in an instruction, ignoring case."""
    names = F.transform("args", lambda a: F.lower(a["name"]))
    counted = F.transform(
        F.array_distinct(F.col("_lower")),
        lambda n: F.struct(
            n.alias("field"),
            F.size(F.filter(F.col("_lower"), lambda m: m == n)).cast("bigint").alias("uses"),
        ),
    )
    return (
        instructions(parsed)
        .withColumn("_lower", names)
        .select("program_id", "instruction", F.inline(F.filter(counted, lambda c: c["uses"] > 1)))
    )


def layouts(parsed: DataFrame) -> DataFrame:
    """(program_id, instruction, table_name, disc, layout): what a decoder needs.

    ``layout`` is the JSON of the argument list, the resolved column names, and the named
    types those arguments reach; it travels with every payload, so it is kept short.
    """
    names = resolve_names(
        F.transform("args", lambda a: a["name"]), tuple(n for n, _ in K.IX_ENVELOPE)
    )
    body = F.struct(
        names.alias("columns"),
        F.transform("args", lambda a: a["type"]).alias("fields"),
        _list(F.col("types"), IDL.split("types:array<")[1].split(">>,events")[0] + ">").alias("types"),
    )
    full = instructions(parsed).select(
        *_modified(parsed), "program_id", "instruction", "table_name", "disc", F.to_json(body).alias("layout")
    )
    return full.mapInArrow(_shorten, full.schema)


def _names_in(value: object, defined: dict[str, object]) -> set[str]:
    """Defined type names that occur in a JSON value."""
    if isinstance(value, str):
        nested = json.loads(value) if value.startswith("{") else None
        return _names_in(nested, defined) if nested else {value} & defined.keys()
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return set().union(*(_names_in(v, defined) for v in value))
    return set()


@lru_cache(maxsize=4096)
def only_reached_types(layout: str) -> str:
    """Drop the named types that no argument leads to."""
    body = json.loads(layout)
    defined = {t["name"]: t["type"] for t in body["types"]}
    reached: set[str] = set()
    new = _names_in(body["fields"], defined)
    while new:
        reached |= new
        new = set().union(*(_names_in(defined[n], defined) for n in new)) - reached
    body["types"] = [t for t in body["types"] if t["name"] in reached]
    return json.dumps(body, separators=(",", ":"))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("layout")
        texts = [only_reached_types(text) for text in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
