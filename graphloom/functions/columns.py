"""Column functions of the data model: identities, names, paths, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FAMILY_OF


def node_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))


def file_node_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def name_tail(name: Column) -> Column:
    """The part after the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def last_segment(name: Column) -> Column:
    """The part after the last dot or double colon."""
    return F.element_at(F.split(name, r"\.|::"), -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def module_of(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, or ``(root)``."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1)))
    return F.when(F.size(dirs) > 0, F.array_join(dirs, "/")).otherwise(F.lit("(root)"))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", ""), r"/{2,}", "/")


def family(language: Column) -> Column:
    out = F.lit(None).cast("string")
    for lang, name in FAMILY_OF.items():
        out = F.when(language == lang, name).otherwise(out)
    return out


def language_key(language: Column) -> Column:
    """A language's name in one spelling; unknown ones are null."""
    low = F.lower(F.trim(language))
    for short, name in {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "golang": "go", "c++": "cpp", "c#": "csharp", "kt": "kotlin", "rb": "ruby"}.items():
        low = F.when(low == short, name).otherwise(low)
    return F.when(low.isin("", "unknown"), F.lit(None)).otherwise(low)


def camel_words(text: Column) -> Column:
    """Words of identifiers and prose, lower case and without accents."""
    plain = F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\x00-\x7f\s]+)"), 1), lambda w: F.lower(w))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    pairs = F.zip_with(F.slice(F.split(a, "/"), 1, 64), F.slice(F.split(b, "/"), 1, 64), lambda x, y: x == y)
    n = F.least(F.size(F.split(a, "/")), F.size(F.split(b, "/"))) - 1
    flags = F.slice(pairs, 1, F.greatest(n, F.lit(0)))
    first_miss = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(first_miss > 0, first_miss - 1).otherwise(F.size(flags)).cast("int")


def symbol_matches(name: Column, qualified: Column, path: Column, symbol: str) -> Column:
    """A symbol as people write it: dots equal double colons, ``crate``, ``super`` and ``self`` do not count; it may be
    the name, the end of the qualified name, or path segments and a name."""
    parts = [p for p in symbol.replace("::", ".").split(".") if p and p not in ("crate", "super", "self")]
    if not parts:
        return F.lit(False)
    want = "::".join(parts)
    q = F.regexp_replace(qualified, r"\.", "::")
    hit = (q == want) | q.endswith("::" + want)
    if len(parts) == 1:
        return hit | (name == parts[0])
    owner = "/".join(parts[:-1])
    stem = F.concat(F.lit("/"), F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"))
    return hit | ((name == parts[-1]) & stem.contains(f"/{owner}/"))
