"""Deeply nested records turned into flat tables that keep parent-child links.

Nested ``transform`` calls attach the ancestors' keys and positions, ``flatten`` joins the arrays, and one ``inline``
per target table emits the rows; no object is exploded before its table's columns are known, and nothing is shuffled.
JSON texts are parsed once to VARIANT, so a field may be an array, a single object, an object keyed by id, or any of
these once more encoded as text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of a recursive field unrolled in one expression; deeper objects go through the same expression again.
LEVELS = 4


def parsed(text: str) -> str:
    """SQL: the text as VARIANT; NULL unless it is exactly one complete JSON value."""
    return f"try_variant_get(try_parse_json(concat('[', {text}, ']')), '$', 'array<variant>')"


def whole(text: str) -> str:
    # brackets around the text make trailing or missing characters an error; more than one element is no JSON value
    return f"try_element_at(transform(filter(array({parsed(text)}), a -> size(a) = 1), a -> a[0]), 1)"


def _objects(u: str, key: str) -> str:
    return f"""coalesce(
      transform(try_variant_get({u}, '$', 'array<variant>'), x -> struct(CAST(NULL AS STRING) AS k, x AS o)),
      CASE WHEN try_variant_get({u}, '$.{key}', 'string') IS NOT NULL THEN array(struct(CAST(NULL AS STRING) AS k, {u} AS o)) END,
      CASE WHEN forall(map_values(try_variant_get({u}, '$', 'map<string,variant>')), y -> try_variant_get(y, '$', 'map<string,variant>') IS NOT NULL)
           THEN transform(map_entries(try_variant_get({u}, '$', 'map<string,variant>')), e -> struct(e.key AS k, e.value AS o)) END,
      array())"""


def members(v: str, key: str) -> str:
    """SQL: the objects held by VARIANT ``v`` as array<struct<k, o>>; k is the name where they are keyed by name.

    An object that has ``key`` is a single member; one whose values are all objects holds its members by name; a text
    is parsed and read in the same way. Anything else, NULL included, holds none."""
    text = f"CASE WHEN try_variant_get({{0}}, '$', 'array<variant>') IS NULL AND try_variant_get({{0}}, '$', 'map<string,variant>') IS NULL THEN {whole("try_variant_get({0}, '$', 'string')")} ELSE {{0}} END"
    bound = f"transform(array(struct({v} AS v)), m -> struct({text.format('m.v')} AS v))"
    return f"flatten(transform({bound}, m -> {_objects('m.v', key)}))"


def array_rows(df: DataFrame, record: str, steps: list[tuple[str, str]], fields: dict[str, str]) -> DataFrame:
    """Flat rows of a typed nested array.

    ``steps``: (array field, key field) from the outermost array inwards; ``fields``: output name -> SQL over ``x``, the
    innermost element. Columns: record_key, parent_key (key of the enclosing element, record_key at the top),
    position (indices joined by '.'), child_key, then ``fields``. NULL or empty arrays and NULL elements give no
    rows; an element without key keeps its row with a NULL child_key; repeated elements differ by position.
    """
    def struct(parent: str, pos: str, x: str) -> str:
        extra = "".join(f", {e.replace('x.', x + '.')} AS {a}" for a, e in fields.items())
        return f"struct({parent} AS parent_key, {pos} AS position, {x}.{steps[-1][1]} AS child_key{extra})"

    def level(i: int, source: str, parent: str, pos: str) -> str:
        field, key = steps[i]
        x, n = f"x{i}", f"i{i}"
        at = f"concat({pos}, '.', CAST({n} AS STRING))" if pos else f"CAST({n} AS STRING)"
        if i == len(steps) - 1:
            inner = f"CASE WHEN {x} IS NOT NULL THEN {struct(parent, at, x)} END"
            return f"filter(transform({source}{field}, ({x}, {n}) -> {inner}), r -> r IS NOT NULL)"
        return f"flatten(filter(transform({source}{field}, ({x}, {n}) -> {level(i + 1, x + '.', f'{x}.{key}', at)}), r -> r IS NOT NULL))"

    return df.selectExpr(f"{record} AS record_key", f"inline({level(0, '', record, '')})")


def _identity(key: str, keyed: bool) -> str:
    own = f"try_variant_get(c.o, '$.{key}', 'string')"
    return f"coalesce({own}, c.k)" if keyed else own


def _unrolled(df: DataFrame, record: str, top: str, key: str, again: str | None, keyed: bool) -> Iterator[tuple[DataFrame, str]]:
    """Tables with record_key and array columns of levels, and the SQL of all levels of such a table as one array.

    Deeper objects than one expression reaches come in further tables."""
    def row(parent: str, level: str, pos: str) -> str:
        return f"struct({parent} AS parent_key, {level} AS level, {pos} AS position, c.k AS k, {_identity(key, keyed)} AS child_key, c.o AS o)"

    below = members(f"try_variant_get(p.o, '$.{again}', 'variant')", key)
    deeper = f"transform({below}, (c, i) -> {row('p.child_key', 'p.level + 1', "concat(p.position, '.', CAST(i AS STRING))")})"
    count = LEVELS if again else 1
    every = f"concat({', '.join(f'l{i}' for i in range(count))})"

    def unroll(source: DataFrame, first: str) -> DataFrame:
        out = source.withColumn("l0", F.expr(first))
        for i in range(1, count):
            out = out.withColumn(f"l{i}", F.expr(f"flatten(transform(l{i - 1}, p -> {deeper}))"))
        return out

    chunk = unroll(df.selectExpr(f"{record} AS record_key", f"{top} AS v"), f"transform({members('v', key)}, (c, i) -> {row('record_key', '0', 'CAST(i AS STRING)')})")
    while True:
        yield chunk, every
        if not again:
            return
        last = chunk.selectExpr("record_key", f"filter(l{count - 1}, p -> size({below}) > 0) AS l").where("size(l) > 0")
        if not last.limit(1).count():
            return
        chunk = unroll(last, f"flatten(transform(l, p -> {deeper}))")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variant_tree(df: DataFrame, record: str, top: str, key: str, again: str | None = None, keyed: bool = False) -> DataFrame:
    """df: ``record`` and VARIANT ``top`` that holds objects -> record_key, parent_key, level, position, k, child_key, o.

    ``again`` names the field through which such objects hold further ones, to any depth. With ``keyed`` an object
    without ``key`` takes the name under which it is held as its key."""
    return _union([chunk.select("record_key", F.expr(f"inline({every})")) for chunk, every in _unrolled(df, record, top, key, again, keyed)])


def variant_links(df: DataFrame, record: str, top: str, kind: str, key: str, inner: list[tuple[str, str, str, str]], again: str | None = None, keyed: bool = False) -> DataFrame:
    """record_key, child_kind, parent_key, child_key of the objects below ``top`` and of those nested in them, in one pass.

    The outermost objects are of ``kind``; ``inner`` lists further kinds as (kind, kind of the holder, path from the holder, key field),
    holders first. Each text is read once: all kinds of a record become one array, and one ``inline`` emits its rows. Objects without a
    key give no rows."""
    parts = []
    for chunk, every in _unrolled(df, record, top, key, again, keyed):
        name = {kind: "a0"}
        chunk = chunk.withColumn("a0", F.expr(every))
        for n, (child, holder, path, field) in enumerate(inner, 1):
            held = members(f"try_variant_get(p.o, '$.{path}', 'variant')", field)
            chunk = chunk.withColumn(f"a{n}", F.expr(f"flatten(transform({name[holder]}, p -> transform({held}, (c, i) -> struct(p.child_key AS parent_key, {_identity(field, False)} AS child_key, c.o AS o))))"))
            name[child] = f"a{n}"
        rows = ", ".join(f"transform({column}, x -> struct('{k}' AS child_kind, x.parent_key AS parent_key, x.child_key AS child_key))" for k, column in name.items())
        parts.append(chunk.select("record_key", F.expr(f"inline(filter(concat({rows}), r -> r.child_key IS NOT NULL))")))
    return _union(parts)


def array_links(df: DataFrame, record: str, kinds: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """record_key, child_kind, parent_key, child_key of several kinds of objects in typed arrays, in one pass.

    ``kinds``: (kind, steps as in ``array_rows``). Objects without a key give no rows."""
    arrays = []
    for kind, steps in kinds:
        text = f"CAST({record} AS STRING)"
        inner = lambda parent, x, k: f"transform({x}, c -> struct('{kind}' AS child_kind, {parent} AS parent_key, c.{k} AS child_key))"  # noqa: B023, E731
        (field, key), *rest = steps
        if not rest:
            arrays.append(inner(text, field, key))
        else:
            (deep, deep_key), = rest
            arrays.append(f"flatten(filter(transform({field}, p -> {inner(f'p.{key}', f'p.{deep}', deep_key)}), r -> r IS NOT NULL))")
    every = ", ".join(f"coalesce({a}, array())" for a in arrays)
    return df.selectExpr(f"{record} AS record_key", f"inline(filter(concat({every}), r -> r.child_key IS NOT NULL))")


def variant_children(tree: DataFrame, field: str, key: str, keyed: bool = False) -> DataFrame:
    """One row per object held under ``field`` by each row of ``tree``; the same columns as there."""
    held = members(f"try_variant_get(o, '$.{field}', 'variant')", key)
    return tree.selectExpr("record_key", f"inline(transform({held}, (c, i) -> struct(child_key AS parent_key, level + 1 AS level, concat(position, '/', CAST(i AS STRING)) AS position, c.k AS k, {_identity(key, keyed)} AS child_key, c.o AS o)))")
