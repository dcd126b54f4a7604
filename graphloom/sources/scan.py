"""Where files come from: directories, git revisions, ignore rules; and a generator of test graphs."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import EXTENSIONS, MAX_BYTES

# Directories that are never source.
IGNORED_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "web_modules", ".yarn", ".pnpm-store", ".next", ".nuxt", ".svelte-kit", ".turbo", ".vite", ".parcel-cache", ".angular", ".docusaurus", "storybook-static", ".vinxi",
    ".nitro", "out-tsc", ".vercel", ".netlify", ".wrangler", "dist", "build", "out", ".output", "coverage", ".nyc_output", "__pycache__", "__pypackages__", ".venv", "venv", ".pixi", ".pdm-build", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".hypothesis", ".ipynb_checkpoints", ".eggs", "target", ".gradle", "obj", "vendor", ".build", "Pods", "Carthage", "DerivedData", ".swiftpm", ".dart_tool", ".pub-cache",
    ".cxx", ".externalNativeBuild", "vcpkg_installed", ".bloop", ".metals", "lua_modules", ".luarocks", "__history", "__recovery", ".cache",
)
IGNORED_GLOBS = ("*.egg-info", "cmake-build-*", "bazel-*")
_ANDROID_RES = r"(?:^|/)res/(?:anim|color|drawable|font|layout|menu|mipmap|raw|values|xml)[\w-]*/"
# Endings of files that tools write.
GENERATED_ENDINGS = (
    ".pb.go", ".pulsar.go", "_mock.go", "_mocks.go", ".generated.js", ".generated.jsx", ".generated.ts", ".generated.tsx", ".gen.js", ".gen.jsx", ".gen.ts", ".gen.tsx", ".pb.js", ".pb.ts", "_pb.js", "_pb.ts",
    ".min.js", ".min.mjs", "_pb2.py", "_pb2_grpc.py", "_pb2.pyi", ".pb.cc", ".pb.h", ".g.cs", "Grpc.cs", "OuterClass.java", "Grpc.java", ".pb.swift", ".g.dart", ".freezed.dart", ".pb.dart", ".pbgrpc.dart",
    ".chopper.dart", ".generated.rs",
)


def is_ignored(path: Column, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> Column:
    """Default directories are always ignored; otherwise exclude beats include, and with includes all else is ignored."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    always = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | path.rlike(_ANDROID_RES)
    for g in IGNORED_GLOBS:
        always = always | F.exists(parts, _like(g))
    globs = lambda gs: [path.rlike(_glob(g)) for g in gs]
    out = F.lit(False)
    for c in globs(exclude):
        out = out | c
    inc = globs(include)
    if inc:
        hit = inc[0]
        for c in inc[1:]:
            hit = hit | c
        out = out | ~hit
    return always | out


def _like(g: str):
    return lambda part: part.rlike(fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$"))


def _glob(g: str) -> str:
    """A gitignore-like pattern as a regular expression over the whole path."""
    anchored = g.startswith("/") or "/" in g.rstrip("/")
    body, i, g = "", 0, g.strip("/")
    while i < len(g):
        if g.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        else:
            body += "[^/]*" if g[i] == "*" else "[^/]" if g[i] == "?" else re.escape(g[i])
            i += 1
    return ("^" if anchored else "(?:^|/)") + body + "(?:/|$)"


def language_column(path: Column, head: Column | None = None) -> Column:
    """The language by the last extension whatever its case; C headers by their first 8 KiB."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    lang = table[ext]
    if head is None:
        return lang
    part = F.substring(head, 1, 8192)
    header = F.when(part.rlike(r"(?m)^\s*(?:@interface|@protocol|@property|#import)\b"), "objc").when(part.rlike(r"(?m)^\s*(?:namespace\s+\w+|template\s*<|class\s+\w+|using\s+\w+|public:|private:)"), "cpp").otherwise("c")
    return F.when(ext == "h", header).otherwise(lang)


def is_source_file(path: Column) -> Column:
    return language_column(path).isNotNull()


def is_generated(path: Column) -> Column:
    """By its ending, or a mock at the root."""
    out = path.rlike(r"^mock_[^/]+\.go$")
    for e in GENERATED_ENDINGS:
        out = out | path.endswith(e)
    return out


def scan_directory(spark: SparkSession, root: str, exclude: Iterable[str] = (), include: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, size, modified_at, language, content_hash, text, error`` of the files below a folder; too large ones have
    an error instead of a text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/?", "")
    big = F.col("length") > max_bytes
    text = F.when(~big, F.decode("content", "UTF-8"))
    out = raw.select(rel.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"), text.alias("text"), F.when(big, "too_large").alias("error"))
    out = out.withColumn("language", language_column(F.col("path"), F.col("text")))
    return out.filter(~is_ignored(F.col("path"), exclude, include) & F.col("language").isNotNull())


def git_files(spark: SparkSession, repo: str, revision: str) -> DataFrame:
    """``path, text`` of a revision, without a checkout; listing on the driver, contents read there too (one repository)."""
    run = lambda *a, **k: subprocess.run(["git", "-C", repo, *a], capture_output=True, check=True, **k)
    names = [(x.split(b"\t", 1)[1].decode("utf-8", "replace"), x.split()[2].decode()) for x in run("ls-tree", "-r", "-z", revision).stdout.split(b"\0") if x and x.split()[1] == b"blob"]
    got = run("cat-file", "--batch", input="\n".join(h for _, h in names).encode()).stdout
    rows, at = [], 0
    for name, _ in names:
        end = got.index(b"\n", at)
        size = int(got[at:end].split()[2])
        data = got[end + 1 : end + 1 + size]
        at = end + 2 + size
        rows.append((name, None if b"\0" in data[:8000] else data.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, text string")


def synthetic_graph(spark: SparkSession, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for measurements: 25 symbols a file, chains of 16, a hub with a fiftieth of all callers, about
    five edges a node."""
    words = "user order cache token batch queue frame index layer model route store table timer value write".split()
    word = lambda c: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(len(words))) + 1).cast("int"))
    ids = spark.range(n)
    name = F.concat(word(F.col("id")), F.lit("_"), word(F.col("id") + 7919), F.lit("_"), F.col("id").cast("string"))
    path = F.concat(F.lit("src/m"), (F.col("id") / 2500).cast("long").cast("string"), F.lit("/f"), (F.col("id") / 25).cast("long").cast("string"), F.lit(".py"))
    nodes = ids.select(F.concat(F.lit("n"), "id").alias("id"), F.lit("function").alias("kind"), name.alias("name"), name.alias("qualified_name"), path.alias("file_path"), F.lit("python").alias("language"), F.pmod("id", F.lit(25)).cast("int").alias("start_line"))
    at = lambda c: F.concat(F.lit("n"), c.cast("string"))
    chain = ids.filter(F.pmod("id", F.lit(16)) < 15).select(at(F.col("id")).alias("source"), at(F.col("id") + 1).alias("target"), F.lit("calls").alias("kind"), F.lit(1).alias("line"))
    hub = ids.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10)) == 0).select(at(F.col("id")).alias("source"), F.lit("n0").alias("target"), F.lit("calls").alias("kind"), F.lit(2).alias("line"))
    rand = ids.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(at(F.col("id")).alias("source"), at(F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(n))).alias("target"), F.when(F.col("k") < 3, "calls").when(F.col("k") == 3, "references").otherwise("imports").alias("kind"), (F.col("k") + 2).cast("int").alias("line"))
    return nodes, chain.unionByName(hub).unionByName(rand)
