"""Schema-on-read JSON columns, parsed once per row.

The event tables carry ``event_metadata`` and ``query_parameters`` as JSON
text, and every key the product reads is a scalar string. ``with_metadata``
extracts all of them in one streaming pass with ``json_tuple`` and packs
them into a struct column, which operators read with ``meta(key)``.

Why ``json_tuple`` rather than ``from_json`` or ``get_json_object``: it is a
generator, so Catalyst cannot inline the parse into filters pushed below the
projection (with ``from_json`` a pushed filter re-parses the text once per
reference -- measured 10x slower on the cohort scan), and it reads every key
in a single pass over the text instead of one pass per key.

A scalar lookup (``JSON_VALUE`` semantics) yields NULL for nested objects and
arrays; ``json_tuple`` returns their JSON text. Only for the rare values that
start with ``{`` or ``[`` the JSON type of the field is looked up: strings stay,
objects and arrays become NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import config


def _scalar_sql(value: str, text: str, key: str) -> str:
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    kind = f"schema_of_variant(variant_get(try_parse_json({text}), \"{path}\", 'variant'))"
    return (f"CASE WHEN NOT (startswith({value}, '{{') OR startswith({value}, '[')) THEN {value} "
            f"WHEN {kind} = 'STRING' THEN {value} END")


def with_metadata(df: DataFrame, col: str = "event_metadata", alias: str = "meta",
                  keys: Iterable[str] = config.EVENT_METADATA_KEYS) -> DataFrame:
    """Add struct column ``alias`` holding the scalar value of each key.

    Written as two SQL expressions so the plan is built with two calls into
    the JVM, whatever the number of keys.
    """
    keys = list(keys)
    tmp = [f"`__{alias}_{i}`" for i in range(len(keys))]
    key_list = ", ".join("'" + k.replace("'", "\\'") + "'" for k in keys)
    out = df.selectExpr("*", f"json_tuple(`{col}`, {key_list}) AS ({', '.join(tmp)})")
    packed = ", ".join(f"'{k}', {_scalar_sql(t, f'`{col}`', k)}" for k, t in zip(keys, tmp))
    keep = [f"`{c}`" for c in df.columns]
    return out.selectExpr(*keep, f"named_struct({packed}) AS `{alias}`")


def with_query_parameters(df: DataFrame, col: str = "query_parameters",
                          alias: str = "qp") -> DataFrame:
    return with_metadata(df, col, alias, config.QUERY_PARAMETER_KEYS)


def meta(field: str, struct_col: str = "meta") -> Column:
    """Scalar string of ``field`` in a struct added by ``with_metadata``."""
    return F.col(f"{struct_col}.{field}")


def json_value(col: str, key: str) -> Column:
    """Ad-hoc scalar lookup of one key (for keys outside the fixed list) in the column named ``col``."""
    return F.expr(_scalar_sql(f"get_json_object(`{col}`, '$.{key}')", f"`{col}`", key))
