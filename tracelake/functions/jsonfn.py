"""JSON documents of any form as Column expressions: secrets masked at any depth, and the searchable text of what is left.

A document is parsed to a VARIANT and held as an array of nodes in their order. Each round of a fold replaces every object
and array in the array by its opening, its members (objects' by key) and its closing, so that after as many rounds as the document is
deep only texts are left, which are joined. Rows stay rows: there is no explosion, shuffle or Python, and what is no JSON, or deeper
than the limit, has a defined result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.binding import once

#: levels that are opened; what lies deeper is masked
DEEPEST = 64
#: fixed values
MASK = "[maskiert]"
ALWAYS_SECRET = ("passwort", "dcc2_hash", "dpapi_machinekey", "dpapi_userkey", "masterkey_hex")
SCOPED, FLAG = "wert", "sensibel"

_NODES = "array<struct<kind:string,json:string,text:string,value:variant,secret:boolean>>"


def depth(document: Column) -> Column:
    """How deep the objects and arrays of a JSON text are nested."""
    plain = F.replace(F.replace(document, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.split(F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, zero, step, lambda s: s["most"])


def _text(json: Column | str, text: Column | str | None = None) -> Column:
    """A node that is done: what it adds to the document and to the searchable text."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit("done").alias("kind"), lit(json).alias("json"), lit(json if text is None else text).alias("text"), F.lit(None).cast("variant").alias("value"), F.lit(False).alias("secret"))


def _open(value: Column, secret: Column) -> Column:
    """A node of a value that may have members."""
    return F.struct(F.lit("open").alias("kind"), F.lit("").alias("json"), F.lit("").alias("text"), value.alias("value"), secret.alias("secret"))


def _array(*nodes: Column) -> Column:
    return F.array(*nodes).cast(_NODES)


def _expanded(node: Column, always: Sequence[str], scoped: str, flag: str) -> Column:
    """What stands for an open node one round later."""
    members = F.try_variant_get(node["value"], "$", "map<string,variant>")
    elements = F.try_variant_get(node["value"], "$", "array<variant>")

    def object_nodes(own: Column) -> Column:
        inside = node["secret"] | F.coalesce(F.try_variant_get(F.element_at(own, flag), "$", "string") == "true", F.lit(False))

        def member(e: Column, k: Column) -> Column:
            masked = e["key"].isin(*always) | (inside & (e["key"] == scoped))
            name = _text(F.concat(F.when(k > 0, ",").otherwise(""), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":")), F.concat(F.when(k > 0, " ").otherwise(""), e["key"], F.lit(": ")))
            return _array(name, F.when(masked, _text(f'"{MASK}"', MASK)).otherwise(_open(e["value"], inside)))

        entries = F.map_entries(own)
        order = F.array_sort(F.map_keys(own))
        sorted_entries = F.transform(order, lambda key: F.struct(key.alias("key"), F.element_at(own, key).alias("value")))
        return F.when(F.size(entries) == 0, _array(_text("{}", ""))).otherwise(F.concat(_array(_text("{", "")), F.flatten(F.transform(sorted_entries, member)), _array(_text("}", ""))))

    def array_nodes(own: Column) -> Column:
        element = lambda v, k: _array(_text(F.when(k > 0, ",").otherwise(""), F.when(k > 0, " ").otherwise("")), _open(v, node["secret"]))
        return F.concat(_array(_text("[", "")), F.flatten(F.transform(own, element)), _array(_text("]", "")))

    return F.when(node["kind"] == "done", _array(node)).when(members.isNotNull(), once(members, object_nodes)).when(elements.isNotNull(), once(elements, array_nodes)).otherwise(_array(node))


def _closed(node: Column) -> Column:
    """An open node of a single value as its texts; of an object or array, which lies too deep, as it is."""
    container = F.try_variant_get(node["value"], "$", "map<string,variant>").isNotNull() | F.try_variant_get(node["value"], "$", "array<variant>").isNotNull()
    scalar = _text(F.coalesce(F.to_json(node["value"]), F.lit("null")), F.coalesce(F.try_variant_get(node["value"], "$", "string"), F.lit("")))
    return F.when((node["kind"] == "done") | container, node).otherwise(scalar)


def masked(document: Column, secret: Column | None = None, always: Sequence[str] = ALWAYS_SECRET, scoped: str = SCOPED, flag: str = FLAG, deepest: int = DEEPEST) -> Column:
    """A JSON text as ``json``, masked and with keys in order, ``text``, ``key: value`` of it for searches, and ``too_deep``; null if it is no JSON.

    Keys in ``always`` are masked anywhere, whatever their value; ``scoped`` is masked in a secret scope: that of a ``secret`` row, or of
    an object whose ``flag`` is true, and of all below. A secret row that is no object is masked whole, as is what lies deeper than
    ``deepest`` levels. Numbers come out in plain form (1.50 as 1.5). An object with equal keys is no JSON unless
    ``spark.sql.variant.allowDuplicateKeys`` is set, as this library's sessions do; then the last one counts. What
    follows a document's first value isn't read.
    """
    inside = F.coalesce(secret, F.lit(False)) if secret is not None else F.lit(False)
    value = F.try_parse_json(document)

    def whole(v: Column) -> Column:
        is_object = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit(False))
        first = F.when(inside & ~is_object, _array(_text(f'"{MASK}"', MASK))).otherwise(_array(_open(v, inside)))
        rounds = F.array_repeat(F.lit(0), F.least(F.coalesce(depth(document), F.lit(0)), F.lit(deepest)))
        opened = F.aggregate(rounds, first, lambda now, _: F.flatten(F.transform(now, lambda n: _expanded(n, always, scoped, flag))).cast(_NODES))
        nodes = F.transform(opened, _closed).cast(_NODES)
        said = lambda name, mask: lambda n: F.when(n["kind"] == "open", mask).otherwise(n[name])
        made = once(nodes, lambda ns: F.struct(F.array_join(F.transform(ns, said("json", f'"{MASK}"')), "").alias("json"), F.array_join(F.transform(ns, said("text", MASK)), "").alias("text"), F.exists(ns, lambda n: n["kind"] == "open").alias("too_deep")))
        return F.when(v.isNotNull(), made)

    return once(value, whole)
