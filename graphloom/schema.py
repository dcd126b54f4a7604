"""The graph's tables, kinds and identities."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire strings of the data model.
NODE_KINDS = tuple("file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component document section".split())
EDGE_KINDS = tuple("contains calls imports exports extends implements references type_of returns instantiates overrides decorates mentions".split())
REFERENCE_KINDS = EDGE_KINDS + ("function_ref", "doc_path", "doc_mention", "doc_link")
PROVENANCES = ("tree-sitter", "scip", "heuristic", "parser", "embedding")
RESOLVED_BY = ("exact-match", "import", "qualified-name", "framework", "fuzzy", "instance-method", "file-path", "function-ref")
FAMILIES = {
    "jvm": ("java", "kotlin", "scala"),
    "apple": ("swift", "objc"),
    "web": ("typescript", "tsx", "javascript", "jsx", "arkts"),
    "c": ("c", "cpp"),
    "dotnet": ("csharp", "razor"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
CALL_KINDS = ("calls", "references", "imports", "instantiates")
HIERARCHY_KINDS = ("extends", "implements")
CONTAINER_KINDS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
CLASS_LIKE = ("class", "struct", "interface", "trait", "protocol", "enum")
CALLABLE = ("function", "method", "component")
LOW_SIGNAL = ("file", "import", "variable", "parameter", "document", "section")
DEFINITIONS = ("class", "interface", "struct", "trait", "protocol", "enum", "type_alias")

_s, _i, _b, _l = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()
_a = T.ArrayType(T.StringType())
NODE = T.StructType(
    [T.StructField(n, _s) for n in ("id", "kind", "name", "qualified_name", "file_path", "language")]
    + [T.StructField(n, _i) for n in ("start_line", "end_line", "start_column", "end_column")]
    + [T.StructField(n, _s) for n in ("docstring", "signature", "visibility")]
    + [T.StructField(n, _b) for n in ("is_exported", "is_async", "is_static", "is_abstract")]
    + [T.StructField("decorators", _a), T.StructField("type_parameters", _a)]
    + [T.StructField(n, _s) for n in ("return_type", "route_method", "route_path", "framework")]
    + [T.StructField("updated_at", _l)]
)
EDGE = T.StructType([T.StructField(n, _s) for n in ("source", "target", "kind", "metadata")] + [T.StructField("line", _i), T.StructField("column_no", _i), T.StructField("provenance", _s)])
REF = T.StructType(
    [T.StructField(n, _s) for n in ("from_node_id", "reference_name", "reference_kind")] + [T.StructField("line", _i), T.StructField("column_no", _i), T.StructField("candidates", _a)]
    + [T.StructField(n, _s) for n in ("file_path", "language", "status", "name_tail")]
)
FILE = T.StructType([T.StructField(n, _s) for n in ("repo", "path", "content_hash", "language")] + [T.StructField(n, _l) for n in ("size", "modified_at", "indexed_at")] + [T.StructField("node_count", _i), T.StructField("errors", _a)])
EDGE_KEY = ("source", "target", "kind", "line", "column_no")
