"""JSON Schemas made flat for a provider: references inlined, unsupported keywords dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

UNSUPPORTED = ("$defs", "$schema", "additionalProperties", "default", "examples", "title", "pattern", "minLength", "maxLength")


def flatten(schema: Mapping[str, object], drop: Sequence[str] = UNSUPPORTED) -> dict[str, object]:
    """schema without references and dropped keywords; a union with null becomes nullable. A cycle of references raises."""
    definitions = schema.get("$defs") or {}

    def walk(node: object, inside: tuple[str, ...]) -> object:
        if isinstance(node, list):
            return [walk(x, inside) for x in node]
        if not isinstance(node, Mapping):
            return node
        if "$ref" in node:
            name = str(node["$ref"]).rsplit("/", 1)[-1]
            if name in inside:
                raise ValueError(f"{name} refers to itself")
            rest = {k: v for k, v in node.items() if k != "$ref"}
            return walk({**definitions[name], **rest}, (*inside, name))
        options = node.get("anyOf")
        if isinstance(options, list) and len(options) == 2 and {"type": "null"} in options:
            other = next(o for o in options if o != {"type": "null"})
            rest = {k: v for k, v in node.items() if k != "anyOf"}
            return walk({**other, **rest, "nullable": True}, inside)
        # names of properties are no keywords
        return {k: {n: walk(p, inside) for n, p in v.items()} if k == "properties" else walk(v, inside) for k, v in node.items() if k not in drop}

    return walk(schema, ())
