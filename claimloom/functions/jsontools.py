"""JSON documents as VARIANT: flatten, pointers, comparison, repair, conformance."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import text as X
from claimloom.schemas import spark_type

OBJECT = "map<string,variant>"
ARRAY = "array<variant>"
NODE = "array<struct<pointer:string,label:string,node:variant>>"


def kind_of(node: Column) -> Column:
    """object, array, string, number, boolean or null; SQL NULL when the node is absent."""
    name = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), F.lit(None))
        .when(name.startswith("OBJECT<"), F.lit("object"))
        .when(name.startswith("ARRAY<"), F.lit("array"))
        .when(name == "STRING", F.lit("string"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(name == "VOID", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def as_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", OBJECT)


def as_array(node: Column) -> Column:
    return F.try_variant_get(node, "$", ARRAY)


def strict_parse(text: Column) -> Column:
    """The document, or NULL unless the whole text is exactly one JSON value (nothing may follow it)."""
    listed = as_array(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def text_of(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def number_of(node: Column) -> Column:
    return F.when(kind_of(node) == "number", F.try_variant_get(node, "$", "double"))


# ---------------------------------------------------------------- pointers


def escape_token(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.replace(F.replace(col, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_tokens(pointer: Column) -> Column:
    """'' has no tokens; anything else must start with '/'."""
    body = F.split(F.substring(pointer, F.lit(2), F.length(pointer)), "/")
    return (
        F.when(pointer == "", X.literal_array([]))
        .when(F.startswith(pointer, F.lit("/")), F.transform(body, unescape_token))
        .otherwise(F.raise_error(F.lit("a JSON pointer must start with '/'")).cast("array<string>"))
    )


def pointer_get(document: Column, pointer: Column) -> Column:
    """The node at a pointer, or NULL when the path leads nowhere."""
    def step(node: Column, token: Column) -> Column:
        return F.coalesce(
            F.try_element_at(as_object(node), token), F.get(as_array(node), token.try_cast("int"))
        )

    return F.aggregate(pointer_tokens(pointer), document, step)


def dotted_get(document: Column, path: str) -> Column:
    node = document
    for name in path.split("."):
        node = F.try_element_at(as_object(node), F.lit(name))
    return node


# ---------------------------------------------------------------- leaves


def _children(entry: Column) -> Column:
    """Child entries of a non-empty container, null for anything else."""
    pointer, label = entry["pointer"], entry["label"]

    def members(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.transform(
            F.map_entries(found),
            lambda m: F.struct(
                F.concat(pointer, F.lit("/"), escape_token(m["key"])).alias("pointer"),
                F.when(label == "", m["key"]).otherwise(F.concat(label, F.lit("."), m["key"])).alias("label"),
                m["value"].alias("node"),
            ),
        ))

    def items(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.transform(
            found,
            lambda v, i: F.struct(
                F.concat(pointer, F.lit("/"), i.cast("string")).alias("pointer"),
                F.concat(label, F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("label"),
                v.alias("node"),
            ),
        ))

    return F.coalesce(X.let(as_object(entry["node"]), members), X.let(as_array(entry["node"]), items))


def _has_children(entry: Column) -> Column:
    return F.coalesce((F.size(as_object(entry["node"])) > 0) | (F.size(as_array(entry["node"])) > 0), F.lit(False))


def deeper_than(text: Column, depth: int) -> Column:
    """Whether a JSON text nests containers more than ``depth`` levels, told from its brackets alone."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]+", "")
    for _ in range(depth):
        brackets = F.regexp_replace(brackets, r"\[\]|\{\}", "")
    return F.coalesce(F.length(brackets) > 0, F.lit(False))


def leaves(document: Column, levels: int = 8, strict: bool = True) -> Column:
    """Every leaf of a document of at most ``levels`` levels as ARRAY<STRUCT<pointer, label, node>>.

    One array expression per nesting level, evaluated inside the row: no
    recursion, no shuffle.  Empty containers below the root are leaves.  A
    deeper document raises instead of losing leaves; :func:`with_leaves` takes
    documents of any depth.  Not ``strict``: the caller has sorted out deeper ones.
    """
    level = F.array(F.struct(F.lit("").alias("pointer"), F.lit("").alias("label"), document.alias("node")))
    for _ in range(levels):
        level = F.flatten(F.transform(level, lambda e: F.coalesce(_children(e), F.array(e))))

    def finish(found: Column) -> Column:
        deeper = F.exists(found, _has_children)
        kept = F.filter(found, lambda e: (e["pointer"] != "") | ~kind_of(e["node"]).isin("object", "array"))
        named = F.transform(
            kept,
            lambda e: F.struct(
                e["pointer"].alias("pointer"),
                F.when(e["label"] == "", F.lit("(root)")).otherwise(e["label"]).alias("label"),
                e["node"].alias("node"),
            ),
        )
        return named if not strict else F.when(deeper, F.raise_error(F.lit(f"document nested deeper than {levels}")).cast(NODE)).otherwise(named)

    return X.let(level, finish)


def _walk(document: str) -> list[tuple[str, str, str]]:
    found, todo = [], [("", "", json.loads(document))]
    while todo:
        pointer, label, node = todo.pop()
        if isinstance(node, dict) and node:
            todo += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", f"{label}.{k}" if label else k, v) for k, v in node.items()]
        elif isinstance(node, list) and node:
            todo += [(f"{pointer}/{i}", f"{label}[{i + 1}]", v) for i, v in enumerate(node)]
        elif pointer or not isinstance(node, (dict, list)):
            found.append((pointer, label or "(root)", json.dumps(node, ensure_ascii=False)))
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("pointer", "label", "json")])))
def _deep_leaves(documents: pd.Series) -> pd.Series:
    return documents.map(_walk)


def with_leaves(df, json_col: str, name: str = "leaves", levels: int = 8):
    """Add every leaf of a JSON text of any depth as ARRAY<STRUCT<pointer, label, node>>.

    Documents of up to ``levels`` levels, nearly all, stay in the row expression;
    the deeper ones are walked in Arrow batches.  ``levels`` steers the cost, not the result.
    """
    deep = deeper_than(F.col(json_col), levels)
    flat = df.filter(~deep).withColumn(name, leaves(F.parse_json(F.col(json_col)), levels, strict=False))
    walked = df.filter(deep).withColumn("_walked", _deep_leaves(F.col(json_col)))
    nodes = F.transform("_walked", lambda e: F.struct(e["pointer"].alias("pointer"), e["label"].alias("label"), F.parse_json(e["json"]).alias("node")))
    return flat.unionByName(walked.withColumn(name, nodes).drop("_walked"))


def display_node(node: Column, limit: int = 220) -> Column:
    kind = kind_of(node)
    return X.display_value(
        F.when(kind == "null", F.lit("null")).when(kind == "string", text_of(node)).otherwise(F.to_json(node)), limit
    )


def nodes_equal(left: Column, right: Column, pointer: Column,
                relative: float = config.RELATIVE_TOLERANCE, absolute: float = config.ABSOLUTE_TOLERANCE) -> Column:
    """Leaf equality: numbers by tolerance, text by normal form, the rest by canonical JSON."""
    a, b = kind_of(left), kind_of(right)
    null_a = left.isNull() | (a == "null")
    null_b = right.isNull() | (b == "null")
    text_a, text_b = text_of(left), text_of(right)
    return F.coalesce(
        F.when(null_a & null_b, F.lit(True))
        .when(null_a | null_b, F.lit(False))
        .when((a == "number") & (b == "number"),
              N.numeric_close(number_of(left), number_of(right), relative, absolute))
        .when((a == "string") & (b == "string") & (pointer == "/compound"),
              X.compound_code(text_a) == X.compound_code(text_b))
        .when((a == "string") & (b == "string"), X.normalise(text_a) == X.normalise(text_b))
        .otherwise(F.to_json(left) == F.to_json(right)),
        F.lit(False),
    )


def string_list(node: Column) -> Column:
    """Scalar-or-array JSON: a bare scalar counts as a one-element list."""
    return F.coalesce(
        F.transform(as_array(node), text_of),
        F.when(node.isNotNull() & (kind_of(node) != "null"), F.array(text_of(node))),
        X.literal_array([]),
    )


def _merged(base, update):
    if isinstance(base, dict) and isinstance(update, dict):
        return base | {k: _merged(base[k], v) if k in base else v for k, v in update.items()}
    return update


@F.pandas_udf(T.StringType())
def merge_objects(bases: pd.Series, updates: pd.Series) -> pd.Series:
    """Recursive override of two JSON object texts, at every depth: members of both are merged, others replaced or added.

    A null update leaves the base, a null base gives the update.
    """
    def one(base: str | None, update: str | None) -> str | None:
        if base is None or update is None:
            return update if base is None else base
        return json.dumps(_merged(json.loads(base), json.loads(update)), separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(b, u) for b, u in zip(bases, updates)], dtype=object)


# ---------------------------------------------------------------- repair


def _assign(current, tokens, value):
    if not tokens:
        return value
    head, rest = tokens[0], tokens[1:]
    is_list = isinstance(current, list) or (isinstance(current, dict) and not current)
    if is_list and head.isdigit():
        items = list(current) if isinstance(current, list) else []
        items += [None] * (int(head) + 1 - len(items))
        items[int(head)] = _assign(items[int(head)], rest, value)
        return items
    members = dict(current) if isinstance(current, dict) else {}
    members[head] = _assign(members.get(head), rest, value)
    return members


def _patched(document: str | None, pointers, values) -> str | None:
    if document is None or pointers is None or values is None:
        return document
    body = json.loads(document)
    for pointer, value in zip(pointers, values):
        if pointer and not pointer.startswith("/"):
            raise ValueError("a JSON pointer must start with '/'")
        tokens = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
        body = _assign(body, tokens, json.loads(value))
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _set_pointers(documents: pd.Series, pointers: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([_patched(*row) for row in zip(documents, pointers, values)], dtype=object)


def pointer_set(document: Column, pointer: Column, value_json: Column) -> Column:
    """Replace, create or extend at a pointer.  Apply to corrected rows only."""
    return pointer_set_all(document, F.array(pointer), F.array(value_json))


def pointer_set_all(document: Column, pointers: Column, values_json: Column) -> Column:
    """Several assignments in order: two arrays of the same length."""
    return _set_pointers(document, pointers, values_json)


PROBABILITY_KEY = r"^(?:confidence|recoverability|coverage)$|(?:^|_)(?:confidence|probability)$"


def normalise_probabilities(df, json_col: str, error: str = "error", levels: int = 8):
    """Percentages under confidence, recoverability, coverage and *_probability keys, at any depth, become 0..1.

    Documents with nothing to change keep their text; Python sees only nulls of them.
    A number outside 0-1 and 0-100% is reported in ``error``.
    """
    def changed(leaf: Column) -> Column:
        kind = kind_of(leaf["node"])
        value = F.when(kind.isin("number", "string"), N.probability_text(text_of(leaf["node"])))
        return F.struct(leaf["pointer"].alias("pointer"), value.alias("value"),
                        F.coalesce((kind == "string") | (value != number_of(leaf["node"])), F.lit(False)).alias("new"))

    def in_context(leaf: Column) -> Column:
        return F.exists(pointer_tokens(leaf["pointer"]), lambda token: token.rlike(PROBABILITY_KEY))

    found = F.transform(F.filter("_leaves", in_context), changed)
    marked = with_leaves(df, json_col, "_leaves", levels).withColumn("_p", F.filter(found, lambda p: p["value"].isNotNull())).drop("_leaves")
    wrong = F.get(F.filter("_p", lambda p: ~p["value"].between(0, 1)), F.lit(0))["pointer"]
    marked = marked.withColumn(error, F.when(wrong.isNotNull(), F.concat(F.lit("invalid probability at "), wrong)))
    fixes = F.filter("_p", lambda p: p["new"])
    # No filter on what the leaves say: Spark would move it below the exchange that spreads a small file and find the leaves twice.
    marked = marked.withColumn("_fixes", F.when(F.col(error).isNull() & (F.size(fixes) > 0), fixes)).drop("_p")
    todo = F.col("_fixes").isNotNull()
    fixed = pointer_set_all(F.when(todo, F.col(json_col)), F.transform("_fixes", lambda p: p["pointer"]), F.transform("_fixes", lambda p: p["value"].cast("string")))
    return marked.withColumn(json_col, F.when(todo, fixed).otherwise(F.col(json_col))).drop("_fixes")


_FENCE = re.compile(r"^```(?:json)?\s*|\s*```\s*$", re.IGNORECASE)
_TRAILING = re.compile(r",(\s*[}\]])")


def _salvage_one(text: str | None) -> tuple[str | None, str | None]:
    if text is None or not text.strip():
        return None, "empty structured response"
    body = _FENCE.sub("", text.strip())
    start = re.search(r"[\[{]", body)
    if not start:
        return None, "no JSON object or array found"
    body = body[start.start():]
    pairs = {"{": "}", "[": "]"}
    stack: list[str] = []
    quoted = False
    end = None
    for token in re.finditer(r'\\.|["{}\[\]]', body, re.DOTALL):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif quoted or mark.startswith("\\"):
            continue
        elif mark in pairs:
            stack.append(pairs[mark])
        elif stack and stack[-1] == mark:
            stack.pop()
            if not stack:
                end = token.end()
                break
        else:
            return None, "mismatched closing delimiter"
    if end is None:
        if quoted or body.rstrip()[-1] in ":,":
            return None, "a value was truncated"
        body = body + "".join(reversed(stack))
    else:
        body = body[:end]
    while True:
        fixed = _TRAILING.sub(r"\1", body)
        if fixed == body:
            break
        body = fixed
    try:
        json.loads(body, parse_constant=_refuse_constant)
    except ValueError as problem:
        return None, f"invalid JSON: {problem.args[0].split(':')[0]}"
    return body, None


def _refuse_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


@F.pandas_udf(T.StructType([T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())]))
def _salvage(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_salvage_one(t) for t in texts], columns=["payload", "error"])


# Spark moves a filter on what a deterministic function returns below the function, and below the exchange that spreads
# a small file: the function then runs twice for each row, once in a single task.
_salvage = _salvage.asNondeterministic()


def salvage(df, text_col: str, payload: str = "payload", error: str = "error"):
    """Repair response text: valid JSON passes on the JVM, only the rest goes through Python, which sees nulls of the others."""
    text = F.col(text_col)
    # The whole text is one JSON value, so that its first mark tells a container; its kind would come from a walk through all of it.
    valid = strict_parse(text).isNotNull() & text.rlike(r"^[ \t\r\n]*[\[{]")
    told = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    fixed = told.withColumn("_fix", _salvage(F.when(~F.col("_valid"), text)))
    # What Python accepts counts only if the JVM parser accepts it too.
    fixed = fixed.withColumn("_good", F.when(~F.col("_valid"), strict_parse(F.col("_fix.payload")).isNotNull()))
    trimmed, failed = F.trim(text), F.when(F.col("_fix.error").isNull() & ~F.col("_good"), F.lit("invalid JSON")).otherwise(F.col("_fix.error"))
    return fixed.withColumns({payload: F.when(F.col("_valid"), trimmed).when(F.col("_good"), F.col("_fix.payload")),
                              error: F.when(~F.col("_valid"), failed)}).drop("_valid", "_fix", "_good")


# ---------------------------------------------------------------- conformance


def _type_ok(node: Column, kind: Column, wanted: str) -> Column:
    if wanted == "integer":
        number = number_of(node)
        return (kind == "number") & (number == F.round(number)) & (F.abs(number) < 2.0**63)
    return kind == wanted


def conformance_error(node: Column, spec: dict, path: Column | None = None) -> Column:
    """The first way a node breaks its contract, as text; NULL when it conforms or is absent.

    ``spec`` is one of the typed contracts in :mod:`claimloom.schemas`; the
    walk over it happens once, when the expression is built.  A node's kind,
    members and items are read once per row.
    """
    where = F.lit("response") if path is None else path
    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    facts = [kind_of(node).alias("kind"), node.alias("node")]
    if "object" in types:
        facts.append(as_object(node).alias("members"))
    if "array" in types:
        facts.append(as_array(node).alias("items"))
    found = X.let(F.struct(*facts), lambda f: _first_fault(f, spec, types, where))
    return F.when(node.isNotNull(), found)


def _kind(value) -> str:
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return {str: "string", dict: "object", list: "array"}.get(type(value), "number")


def _fault(value, spec: dict, where: str) -> str | None:
    """The first way a parsed value breaks its contract; says the same as :func:`conformance_error`."""
    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    kind = _kind(value)
    whole = kind == "number" and abs(value) < 2.0**63 and value == int(value)
    if types and kind not in types and not (whole and "integer" in types):
        return f"{where}: expected {' or '.join(types)}"
    if kind == "string" and value not in spec.get("enum", [value]):
        return f"{where}: outside the enumeration"
    if kind == "number" and value < spec.get("minimum", value):
        return f"{where}: below minimum"
    if kind == "number" and value > spec.get("maximum", value):
        return f"{where}: above maximum"
    if kind == "object":
        known = spec.get("properties", {})
        missing = next((name for name in spec.get("required", []) if name not in value), None)
        if missing is not None:
            return f"{where}: missing required field {missing}"
        extra = min((name for name in value if name not in known), default=None)
        if spec.get("additionalProperties") is False and extra is not None:
            return f"{where}: unexpected field {extra}"
        return next((f for name, child in known.items() if name in value and (f := _fault(value[name], child, f"{where}.{name}"))), None)
    if kind == "array":
        if len(value) > spec.get("maxItems", len(value)):
            return f"{where}: too many items"
        if "items" in spec:
            return next((f for i, v in enumerate(value) if (f := _fault(v, spec["items"], f"{where}[{i + 1}]"))), None)
    return None


def payload_fault(payload: Column, spec: dict) -> Column:
    """:func:`conformance_error` for JSON text and contracts of any size, in Arrow batches.

    A contract with hundreds of fields as one row expression takes longer to plan than its rows take to check.
    Not deterministic to Spark, for the reason that :func:`_salvage` is not: each text is checked once.
    """

    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else _fault(json.loads(text), spec, "response")).astype(object)

    return F.pandas_udf(check, "string").asNondeterministic()(payload)


def typed(payload: Column, spec: dict) -> Column:
    """The nested value of a contract's type from JSON text that conforms to it.

    Whole numbers are read as numbers first, since 5.0 is as good an integer as 5.  Text that does not conform
    must be refused beforehand: what has another type would become null here.
    """
    read = F.from_json(payload, spark_type(spec, T.DoubleType()))
    return F.when(read.isNotNull(), read.cast(spark_type(spec)))


def decode(df, payload: str, spec: dict, name: str, error: str = "error"):
    """Add ``name``, the typed value of the JSON text ``payload``, and name the first fault in ``error``.

    A row with a fault, or with one named before, has no value; a row without a fault has all of it.
    """
    checked = df.withColumn(error, F.coalesce(F.col(error), payload_fault(F.when(F.col(error).isNull(), F.col(payload)), spec)))
    return checked.withColumn(name, typed(F.when(F.col(error).isNull(), F.col(payload)), spec))


def _first_fault(f: Column, spec: dict, types: list[str], where: Column) -> Column:
    node, kind = f["node"], f["kind"]

    def fault(message: str) -> Column:
        return F.concat(where, F.lit(": " + message))

    ok = F.lit(False)
    for wanted in types:
        ok = ok | _type_ok(node, kind, wanted)
    checks: list[Column] = []
    if types:
        checks.append(F.when(~ok, fault("expected " + " or ".join(types))))
    if "enum" in spec:
        checks.append(F.when((kind == "string") & ~text_of(node).isin(*spec["enum"]), fault("outside the enumeration")))
    if "minimum" in spec:
        checks.append(F.when(number_of(node) < spec["minimum"], fault("below minimum")))
    if "maximum" in spec:
        checks.append(F.when(number_of(node) > spec["maximum"], fault("above maximum")))
    if "object" in types:
        members = f["members"]
        for name in spec.get("required", []):
            checks.append(F.when((kind == "object") & ~F.map_contains_key(members, F.lit(name)),
                                 fault(f"missing required field {name}")))
        properties = spec.get("properties", {})
        if spec.get("additionalProperties") is False:
            extra = F.array_except(F.map_keys(members), X.literal_array(properties))
            checks.append(F.when((kind == "object") & (F.size(extra) > 0),
                                 F.concat(where, F.lit(": unexpected field "), F.get(extra, F.lit(0)))))
        for name, child in properties.items():
            checks.append(conformance_error(F.try_element_at(members, F.lit(name)), child,
                                            F.concat(where, F.lit("." + name))))
    if "array" in types:
        items = f["items"]
        if "maxItems" in spec:
            checks.append(F.when(F.size(items) > spec["maxItems"], fault("too many items")))
        if "items" in spec:
            child = spec["items"]
            faults = F.transform(
                items,
                lambda v, i: conformance_error(
                    v, child, F.concat(where, F.lit("["), (i + 1).cast("string"), F.lit("]"))
                ),
            )
            checks.append(F.get(F.array_compact(faults), F.lit(0)))
    return F.coalesce(*checks) if len(checks) > 1 else checks[0]
