"""Identity: escaping, normal forms, canonical keys and hashed ids, all as column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tag of identities, and the characters that are escaped, the escape sign first.
FORMAT = "csharp/v1"
ESCAPES = (("%", "%25"), ("|", "%7C"), ("=", "%3D"), (",", "%2C"), (";", "%3B"))
#: Prefixes of parameter types by how they are passed.
MODIFIERS = ("ref", "out", "in", "this", "params")
SEPARATOR = "\x1f"
GLOBAL = "global::"


def escape(col: Column) -> Column:
    for a, b in ESCAPES:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def normal_namespace(col: Column) -> Column:
    parts = F.transform(F.split(F.replace(col, F.lit(GLOBAL), F.lit("")), r"\."), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), ".")


def normal_type(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit(GLOBAL), F.lit("")), r"\s", "")


def normal_path(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def canonical_text(path: str, root: str | None = None) -> str:
    """A path with forward slashes and without steps in place or back, below ``root`` if it is relative."""
    path = path.replace("\\", "/")
    return posixpath.normpath(path if path.startswith("/") or not root else f"{root}/{path}")


def canonical_path(col: Column) -> Column:
    """``canonical_text`` of a column: steps in place go, a step back takes the folder before it."""

    def step(held: Column, part: Column) -> Column:
        back = F.when((F.size(held) > 0) & (F.element_at(held, -1) != ".."), F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.concat(held, F.array(part)))
        return F.when(part.isin("", "."), held).when(part == "..", back).otherwise(F.concat(held, F.array(part)))

    parts = F.aggregate(F.split(normal_path(col), "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(normal_path(col), F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def project_key(path: Column, tfm: Column) -> Column:
    return F.concat(F.lit("project="), escape(normal_path(path)), F.lit("|tfm="), escape(F.coalesce(F.nullif(F.trim(tfm), F.lit("")), F.lit("unknown"))))


def parameter_text(p: Column) -> Column:
    """A parameter (type, modifier) as a key spells it."""
    return F.concat(F.when(p["modifier"].isin(*MODIFIERS), F.concat(p["modifier"], F.lit(":"))).otherwise(F.lit("")), escape(normal_type(p["type"])))


def containing_text(t: Column) -> Column:
    """A containing type (name, arity, discriminator) as a key spells it."""
    arity = F.when(t["arity"] > 0, F.concat(F.lit("`"), t["arity"].cast("string"))).otherwise(F.lit(""))
    extra = F.when(F.coalesce(t["discriminator"], F.lit("")) != "", F.concat(F.lit("["), t["discriminator"], F.lit("]"))).otherwise(F.lit(""))
    return F.concat(t["name"], arity, extra)


def reference_key(kind: Column, namespace: Column, containing: Column, member: Column, name: Column, arity: Column, params: Column, returns: Column, discriminator: Column) -> Column:
    """Nine parts that name a symbol whatever project it is seen from; lists are given as texts already."""
    parts = [("symbol", kind), ("namespace", escape(normal_namespace(namespace))), ("type", escape(containing)), ("member", escape(member)), ("name", escape(name)), ("arity", arity.cast("string")), ("params", params), ("return", escape(normal_type(returns))), ("discriminator", escape(discriminator))]
    return F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.coalesce(v, F.lit(""))) for n, v in parts))


def method_signature(kind: Column, name: Column, arity: Column, params: Column, returns: Column) -> Column:
    """A method on the way to a local symbol; ``params`` is an array of texts, constructors return nothing."""
    back = F.when(kind.isin("Constructor", "StaticConstructor"), "").otherwise(normal_type(returns))
    return F.concat(kind, F.lit(":"), name, F.lit("`"), arity.cast("string"), F.lit("("), F.array_join(params, ","), F.lit("):"), back)


def property_signature(name: Column, params: Column, type_: Column) -> Column:
    return F.concat(F.lit("property:"), name, F.lit("("), F.array_join(params, ","), F.lit("):"), normal_type(type_))


def typed_signature(word: str, name: Column, type_: Column) -> Column:
    """Events and fields, by their word."""
    return F.concat(F.lit(f"{word}:"), name, F.lit(":"), normal_type(type_))


def extension_signature(type_: Column) -> Column:
    return F.concat(F.lit("extension:"), normal_type(type_))


def json_scalar(value: Column, kind: Column) -> Column:
    """A constant's text as JSON: truth values and numbers bare, all else as a string, no value as null."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").when(kind.isin("bool", "number"), F.lower(value)).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def canonical_key(project: Column, reference: Column) -> Column:
    return F.concat_ws("|", F.lit(FORMAT), project, reference)


def node_id(key: Column) -> Column:
    return F.concat(F.lit("cs_"), F.sha2(key, 256))


def is_sha256(col: Column) -> Column:
    return col.rlike("^[0-9a-fA-F]{64}$")


def display_name(kind: Column, name: Column, namespace: Column, containing: Column, members: Column, arity: Column, params: Column, discriminator: Column) -> Column:
    """How a symbol is shown; ``containing``, ``members`` and ``params`` are arrays of texts.

    Namespace and types lead, a member path follows with "::"; a constructor goes by its type's name. Arity and parameters are shown where there
    are any, a discriminator only for local symbols.
    """
    last = F.element_at(containing, -1)
    own = F.when((kind == "constructor") & (F.size(containing) > 0), last).otherwise(name)
    path = F.when(F.size(members) > 0, F.concat(F.array_join(members, "::"), F.lit("::"))).otherwise(F.lit(""))
    parts = F.filter(F.array(F.coalesce(namespace, F.lit("")), F.array_join(containing, ".")), lambda p: p != "")
    qualified = F.array_join(F.concat(parts, F.array(F.concat(path, own))), ".")
    generic = F.when(arity > 0, F.concat(F.lit("<"), arity.cast("string"), F.lit(">"))).otherwise(F.lit(""))
    called = F.when(F.size(params) > 0, F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")"))).otherwise(F.lit(""))
    local = F.when(kind.isin("local", "range_variable", "label") & discriminator.isNotNull(), F.concat(F.lit(" ["), discriminator, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(qualified, generic, called, local)


def snake_case(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col, "([A-Z])", "_$1"), "^_+", ""))


def location_text(line: Column, column: Column) -> Column:
    return F.concat(F.lit("L"), line.cast("string"), F.lit(":C"), column.cast("string"))


def location_key(loc: Column) -> Column:
    return F.concat_ws(":", loc["file"], loc["line"].cast("string"), loc["column"].cast("string"))


def ordinal_text(col: Column) -> Column:
    """A sort key in the order of UTF-16 code units, which differs from Spark's beyond the basic plane."""
    return F.encode(col, "UTF-16BE")


def call_site_text(snapshot: Column, project: Column, file: Column, start: Column, length: Column) -> Column:
    """What a call site's id is the hash of: as apt to group by, and short to move."""
    return F.concat_ws(SEPARATOR, snapshot, project, file, start.cast("string"), length.cast("string"))


def call_site_id(snapshot: Column, project: Column, file: Column, start: Column, length: Column) -> Column:
    return F.concat(F.lit("call-"), F.sha2(call_site_text(snapshot, project, file, start, length), 256))


def source_symbol_key(kind: Column, name: Column, file: Column, start: Column, length: Column) -> Column:
    return F.concat_ws(SEPARATOR, kind, name, file, start.cast("string"), length.cast("string"))


def options_key(options: Column) -> Column:
    """Ordered name=hex pairs of a map of options."""
    pairs = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.hex(F.encode(e["value"], "UTF-8")))), SEPARATOR)


def under(path: Column, folder: Column) -> Column:
    """Whether a normalised path is the folder or lies below it."""
    return (path == folder) | F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def ancestors(path: Column) -> Column:
    """All proper ancestor folders of a path, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def preview(col: Column, most: int = 512) -> Column:
    return F.when(F.length(col) > most, F.concat(F.substring(col, 1, most), F.lit("…"))).otherwise(col)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole normalised paths: ** crosses folders, * and ? do not."""
    import re

    out = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob.replace("\\", "/")):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.sub(r"([.^$+{}()\[\]|\\])", r"\\\1", token))
    return f"^{''.join(out)}$"
