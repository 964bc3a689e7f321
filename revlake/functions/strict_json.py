"""Whether a text is JSON as a whole.

``from_json`` reads the first value of a text, overlooks what stands behind it
and turns numbers and objects into strings. These tests come before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.text import let

# A JSON string, and any other lasting token.
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'
_SCALAR = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity"
_WHITE = r"[ \t\n\r]"


def _reduced(text: Column) -> Column:
    """The text with each scalar as one letter and without white space: s for strings, v for others."""
    letters = F.regexp_replace(text, _STRING, "s")
    letters = F.regexp_replace(letters, rf"(?<![\w.+-])(?:{_SCALAR})(?![\w.+-])", "v")
    return F.regexp_replace(letters, _WHITE + "+", "")


def _parses(text: Column) -> Column:
    """Whether the parser takes the whole text. Alone it stops behind the first value;
    what passes both as a list's only item and as an object's only field is that value."""
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return as_item.isNotNull() & as_field.isNotNull()


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; duplicate keys are allowed, null text is not JSON.

    Most texts are settled by the parser; only those it refuses are looked at
    for duplicate keys, the one thing it refuses and JSON allows.
    """

    def folded(reduced: Column) -> Column:
        # Innermost objects and lists become values, level by level, until nothing changes.
        levels = F.sequence(F.lit(1), F.greatest(F.length(F.regexp_replace(reduced, r"[^\[{]", "")), F.lit(1)))

        def fold(state: Column, _: Column) -> Column:
            shorter = F.regexp_replace(state["text"], r"\{(?:s:[sv](?:,s:[sv])*+)?\}|\[(?:[sv](?:,[sv])*+)?\]", "v")
            moved = let(shorter, lambda s: F.struct(s.alias("text"), (s == state["text"]).alias("done")))
            return F.when(state["done"], state).otherwise(moved)

        start = F.struct(reduced.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(levels, start, fold, lambda state: state["text"])

    return F.when(text.isNull(), False).when(_parses(text), True).otherwise(let(_reduced(text), folded).rlike("^[sv]$"))


def is_typed_object(text: Column, names: list[str]) -> Column:
    """Whether the text is one JSON object in which the named fields are strings, null or left out.

    An object that repeats a key is refused.
    """
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    strings = F.lit(True)
    for name in names:
        field = F.try_variant_get(value, f"$.{name}", "variant")
        known = F.coalesce(F.schema_of_variant(field), F.lit("VOID"))
        strings = strings & known.isin("STRING", "VOID")
    return F.coalesce(_parses(text) & kind.startswith("OBJECT") & strings, F.lit(False))
