"""Catalogs, generated schemas and audits over one description document per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ixlake import constants as K
from ixlake.operators import idl
from ixlake.plans.registry import query
from ixlake.plans.views import v_idl, with_views


def _documents(spark, d):
    return idl.parse_documents(v_idl(spark, d))


@query("idl_catalog", with_views("SELECT program_id, idl_name FROM v_idl", "v_idl"))
def idl_catalog(spark, d):
    return _documents(spark, d).select("program_id", "idl_name")


@query(
    "idl_instructions",
    with_views(
        """
        SELECT program_id, idl_name, lower(ix ->> '$.name') AS instruction,
          'ix_' || lower(ix ->> '$.name') AS table_name,
          sha256('global:' || lower(regexp_replace(ix ->> '$.name', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')))[:16] AS disc,
          json_array_length(ix -> '$.args')::BIGINT AS arg_count
        FROM (SELECT program_id, idl_name, unnest((text -> '$.instructions')::JSON[]) AS ix FROM v_idl)
        """,
        "v_idl",
    ),
)
def idl_instructions(spark, d):
    """Catalog: one row per instruction with its table and discriminator."""
    return idl.instructions(_documents(spark, d)).select(
        "program_id",
        "idl_name",
        "instruction",
        "table_name",
        F.lower(F.hex("disc")).alias("disc"),
        F.size("args").cast("bigint").alias("arg_count"),
    )


def _case(column: str, which: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in K.SCALAR_TYPES.items())
    return f"CASE {column} {whens} END"


# Fold of the naming rule: one recursion step per field of a table.
_NAMES = """
, named AS (
  SELECT program_id, owner, pos, {reserved} || [chosen] AS seen, chosen AS column_name, field_name, field_type
  FROM (SELECT *, {first} AS chosen FROM fields WHERE pos = 1)
  UNION ALL
  SELECT program_id, owner, pos, seen || [lower(chosen)], chosen, field_name, field_type
  FROM (SELECT f.*, n.seen, {next} AS chosen
        FROM named n JOIN fields f ON f.program_id = n.program_id AND f.owner = n.owner AND f.pos = n.pos + 1)),
"""


def _choose(seen: str, name: str) -> str:
    return (
        f"CASE WHEN list_contains({seen}, lower({name})) THEN {name} || '_' || "
        f"list_filter(range(1, len({seen}) + 1), "
        f"lambda i: NOT list_contains({seen}, lower({name} || '_' || i)))[1] ELSE {name} END"
    )


def _schema_oracle(fields: str, kind: str, envelope) -> str:
    reserved = str([n for n, _ in envelope])
    names = _NAMES.format(
        reserved=reserved,
        first=_choose(reserved, "field_name"),
        next=_choose("n.seen", "f.field_name"),
    )
    types = f"""
    peeled AS (
      SELECT program_id, owner, pos, field_type AS t, 0 AS depth FROM fields
      UNION ALL
      SELECT program_id, owner, pos, CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE x::VARCHAR END, depth + step
      FROM (SELECT program_id, owner, pos, depth,
              CASE WHEN json_exists(try_cast(t AS JSON), '$.option') THEN 0 ELSE 1 END AS step,
              coalesce(try_cast(t AS JSON) -> '$.option', try_cast(t AS JSON) -> '$.vec', try_cast(t AS JSON) -> '$.array[0]') AS x
            FROM peeled WHERE starts_with(t, '{{')) WHERE x IS NOT NULL),
    mapped AS (
      SELECT program_id, owner, pos, repeat('ARRAY<', depth) || coalesce({_case('t', 1)}, 'VARIANT') || repeat('>', depth) AS spark_type
      FROM peeled QUALIFY row_number() OVER (PARTITION BY program_id, owner, pos ORDER BY depth DESC, length(t)) = 1)
    """
    fixed = " UNION ALL ".join(
        f"SELECT DISTINCT program_id, '{kind}_' || lower(owner), {i + 1}, '{n}', NULL, NULL, '{t}' FROM fields"
        for i, (n, t) in enumerate(envelope)
    )
    body = f"""
    SELECT program_id, '{kind}_' || lower(owner) AS table_name, (pos + {len(envelope)})::INT AS position, column_name,
      field_name, field_type, spark_type
    FROM named JOIN mapped USING (program_id, owner, pos)
    UNION ALL SELECT * FROM ({fixed})
    """
    return fields + names + types + body


_IX_FIELDS = with_views(
    ", fields AS (SELECT program_id, ix_name AS owner, pos, field_name, field_type FROM v_args)",
    "v_args",
    recursive=True,
)
_ACC_FIELDS = with_views(
    """
    , fields AS (
      SELECT program_id, owner, pos, f ->> '$.name' AS field_name,
        CASE json_type(f -> '$.type') WHEN 'VARCHAR' THEN f ->> '$.type' ELSE (f -> '$.type')::VARCHAR END AS field_type
      FROM (SELECT program_id, acc ->> '$.name' AS owner, unnest((acc -> '$.type.fields')::JSON[]) AS f,
              generate_subscripts((acc -> '$.type.fields')::JSON[], 1) AS pos
            FROM (SELECT program_id, unnest((text -> '$.accounts')::JSON[]) AS acc FROM v_idl)))
    """,
    "v_idl",
    recursive=True,
)


@query("idl_ix_schema", _schema_oracle(_IX_FIELDS, "ix", K.IX_ENVELOPE))
def idl_ix_schema(spark, d):
    return idl.ix_schema(_documents(spark, d))


@query("idl_acc_schema", _schema_oracle(_ACC_FIELDS, "acc", K.ACC_ENVELOPE))
def idl_acc_schema(spark, d):
    return idl.acc_schema(_documents(spark, d))


@query(
    "idl_column_names",
    _IX_FIELDS
    + _NAMES.format(
        reserved=str([n for n, _ in K.IX_ENVELOPE]),
        first=_choose(str([n for n, _ in K.IX_ENVELOPE]), "field_name"),
        next=_choose("n.seen", "f.field_name"),
    ).rstrip().rstrip(",")
    + " SELECT program_id, 'ix_' || lower(owner) AS table_name, field_name, column_name FROM named "
    "WHERE field_name <> column_name",
)
def idl_column_names(spark, d):
    """Arguments whose column had to be renamed."""
    return (
        idl.ix_schema(_documents(spark, d))
        .filter("field_name <> column_name")
        .select("program_id", "table_name", "field_name", "column_name")
    )


@query(
    "idl_types",
    with_views(
        f"""
        SELECT program_id, lower(ix_name) AS instruction, field_name, field_type,
          coalesce({_case('field_type', 0)}, 'TEXT') AS storage_type
        FROM v_args
        """,
        "v_args",
    ),
)
def idl_types(spark, d):
    """Storage class of every argument, as the generated tables declare it."""
    args = idl.instructions(_documents(spark, d)).select("program_id", "instruction", F.inline("args"))
    return args.select(
        "program_id",
        "instruction",
        F.col("name").alias("field_name"),
        F.col("type").alias("field_type"),
        idl.storage_type(F.col("type")).alias("storage_type"),
    )


# References of a document, unwrapped by recursion, then compared with its definitions.
_AUDIT = (
    with_views("", "v_args", recursive=True).rstrip()
    + """
, defs AS (SELECT program_id, t ->> '$.name' AS type_name, t FROM
    (SELECT program_id, unnest((text -> '$.types')::JSON[]) AS t FROM v_idl)),
struct_fields AS (SELECT program_id, 'Type:' || type_name || ':Field:' || (f ->> '$.name') AS context, f -> '$.type' AS x
  FROM (SELECT program_id, type_name, unnest((t -> '$.type.fields')::JSON[]) AS f FROM defs)),
variant_fields AS (SELECT program_id, 'Type:' || type_name || ':Variant:' || (v ->> '$.name') AS context,
    coalesce(f -> '$.type', f) AS x
  FROM (SELECT program_id, type_name, v, unnest((v -> '$.fields')::JSON[]) AS f FROM
    (SELECT program_id, type_name, unnest((t -> '$.type.variants')::JSON[]) AS v FROM defs))
  WHERE json_type(f) = 'OBJECT'),
event_fields AS (SELECT program_id, 'Event:' || (e ->> '$.name') || ':Field:' || (f ->> '$.name') AS context, f -> '$.type' AS x
  FROM (SELECT program_id, e, unnest((e -> '$.fields')::JSON[]) AS f FROM
    (SELECT program_id, unnest((text -> '$.events')::JSON[]) AS e FROM v_idl))),
refs AS (
  SELECT program_id, 'Instruction:' || ix_name || ':Arg:' || field_name AS context, field_type AS type FROM v_args
  UNION ALL
  SELECT program_id, context, CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE x::VARCHAR END
  FROM (FROM struct_fields UNION ALL FROM variant_fields UNION ALL FROM event_fields)),
peel AS (
  SELECT program_id, context, type, type AS base_type, 0 AS step FROM refs
  UNION ALL
  SELECT program_id, context, type, CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE x::VARCHAR END, step + 1
  FROM (SELECT program_id, context, type, step, coalesce(try_cast(base_type AS JSON) -> '$.defined.name', try_cast(base_type AS JSON) -> '$.defined',
          try_cast(base_type AS JSON) -> '$.option', try_cast(base_type AS JSON) -> '$.vec', try_cast(base_type AS JSON) -> '$.array[0]') AS x
        FROM peel WHERE starts_with(base_type, '{')) WHERE x IS NOT NULL),
bare AS (SELECT * FROM peel QUALIFY row_number() OVER (PARTITION BY program_id, context, type ORDER BY step DESC) = 1)
SELECT program_id, context, type, base_type FROM bare
WHERE """
)
_PRIMITIVE = "base_type IN " + str(tuple(K.SCALAR_TYPES))


@query(
    "idl_unresolved_types",
    _AUDIT
    + f"NOT starts_with(base_type, '{{') AND NOT {_PRIMITIVE} AND NOT EXISTS "
    "(SELECT 1 FROM defs WHERE defs.program_id = bare.program_id AND defs.type_name = bare.base_type)",
)
def idl_unresolved_types(spark, d):
    return idl.type_audit(_documents(spark, d)).filter("problem = 'unresolved'").drop("problem")


@query("idl_ambiguous_types", _AUDIT + "starts_with(base_type, '{')")
def idl_ambiguous_types(spark, d):
    return idl.type_audit(_documents(spark, d)).filter("problem = 'ambiguous'").drop("problem")


@query(
    "idl_collisions",
    with_views(
        """
        SELECT program_id, lower(ix_name) AS instruction, lower(field_name) AS field, count(*) AS uses
        FROM v_args GROUP BY ALL HAVING count(*) > 1
        """,
        "v_args",
    ),
)
def idl_collisions(spark, d):
    return idl.collisions(_documents(spark, d))
