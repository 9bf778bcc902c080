"""Text columns: keywords, keys, paths, code and LaTeX patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, prefixes that aren't project modules, languages and readers by extension.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "have")
OUTSIDE = (
    "os", "sys", "re", "json", "typing", "pathlib", "collections", "dataclasses", "logging", "datetime", "time", "random", "math", "__future__",
    "abc", "enum", "functools", "itertools", "io", "torch", "numpy", "transformers", "sentence_transformers", "httpx", "grpc", "pytest",
    "tree_sitter",
)
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".cs": "c_sharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".lua": "lua", ".jl": "julia", ".m": "objc", ".mm": "objc",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html",
    ".css": "css", ".scss": "scss", ".sql": "sql", ".md": "markdown", ".markdown": "markdown", ".toml": "toml", ".ini": "ini", ".cfg": "ini",
    ".conf": "ini", ".properties": "ini", ".env": "ini",
}
READERS = {".pdf": "pdf", ".tex": "latex", ".py": "code", ".js": "code", ".ts": "code", ".java": "code", ".cpp": "code", ".c": "code", ".rs": "code", ".go": "code"}
READ_ONLY_WORDS = (
    "INSERT", "UPDATE", "UPSERT", "REMOVE", "REPLACE", "TRUNCATE", "DROP", "CREATE", "ALTER", "RENAME", "GRANT", "REVOKE", "GRAPH",
)
ALLOWED_PATH = r"^/_db/[^/]+/_api/(document|index|collection|import|cursor)(/|$)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three or more letters a to z, without stop words, in order of appearance."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    return F.array_except(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$")), F.array(*map(F.lit, STOP_WORDS)))


def keyword_overlap(query: Column, text: Column, share: int = 1) -> Column:
    """The part of the query's keywords that the text has, of it one in `share`; 0 if the query has none."""
    own = keywords(query)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, keywords(text))) / F.lit(share) / F.size(own)).otherwise(F.lit(0.0))


def safe_key(path: Column) -> Column:
    """A path as a key: slashes and spaces become underscores, only letters, digits and -_.:@()+ stay, no ._- at the ends; long ones end in a hash."""
    key = F.regexp_replace(F.regexp_replace(path, "[/ ]", "_"), r"[^\p{L}\p{N}_.:@()+-]", "")
    key = F.coalesce(F.nullif(F.regexp_replace(key, "^[._-]+|[._-]+$", ""), F.lit("")), F.lit("item"))
    cut = lambda k: F.concat(F.substring(k, 1, 243), F.lit("_"), F.substring(F.sha1(k), 1, 10))
    return let(key, lambda k: F.when(F.octet_length(k) > 254, cut(k)).otherwise(k))


def directory(path: Column) -> Column:
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(ext: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), ext)


def reader(ext: Column) -> Column:
    pairs = [F.lit(x) for pair in READERS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("pdf"))


def import_key(statement: Column, path: Column) -> Column:
    """The key of the file that an import statement names; null if it is outside of the project."""
    named = lambda word: F.nullif(F.regexp_extract(statement, word + r"\s+([\w.]+)", 1), F.lit(""))
    outside = "^(" + "|".join(OUTSIDE) + ")"

    def relative(module: Column) -> Column:
        dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
        rest = F.regexp_replace(module, r"^\.+", "")
        up = let(F.split(directory(path), "/"), lambda parts: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/"))
        own = F.when(up.isin("", "."), F.lit("")).otherwise(F.concat(up, F.lit("/")))
        return F.concat(own, F.when(rest == "", F.lit("__init__")).otherwise(rest), F.lit(".py"))

    absolute = lambda module: F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))
    target = lambda module: F.when(module.isNotNull() & ~module.rlike(outside), F.when(module.startswith("."), relative(module)).otherwise(absolute(module)))
    return let(let(F.coalesce(named("from"), named("import")), target), lambda x: F.when(x.isNotNull(), safe_key(x)))


def called_names(text: Column) -> Column:
    """Distinct names that stand before an opening bracket."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\w+)\s*\("), F.lit(1)))


def window_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def citations(text: Column) -> Column:
    """Keys of \\cite, \\citep and \\citet, the first of each kept."""
    groups = F.regexp_extract_all(text, F.lit(r"\\cite[pt]?\{([^}]+)\}"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))))


def equations(text: Column) -> Column:
    """Bodies of equation and align environments, then up to a hundred inline formulas of 2 to 200 characters."""
    outer = F.regexp_extract_all(text, F.lit(r"(?s)\\begin\{(?:equation|align)\*?\}(.*?)\\end\{(?:equation|align)\*?\}"), F.lit(1))
    inline = F.slice(F.filter(F.regexp_extract_all(text, F.lit(r"\$([^$]+)\$"), F.lit(1)), lambda x: F.length(x).between(2, 200)), 1, 100)
    return F.transform(F.concat(outer, inline), lambda x: F.trim(x))


def sections(text: Column) -> Column:
    """(level, title) of LaTeX sections."""
    pattern = r"\\((?:sub)*)section\*?\{([^}]*)\}"
    level = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.length(x) / 3 + 1)
    return F.zip_with(level.cast("array<int>"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.struct(a.alias("level"), b.alias("title")))


def table_captions(text: Column) -> Column:
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)\\begin\{table\*?\}(.*?)\\end\{table\*?\}"), F.lit(1))
    return F.transform(bodies, lambda x: F.regexp_extract(x, r"\\caption\{((?:[^{}]|\{[^{}]*\})*)\}", 1))


def code_counts(text: Column) -> Column:
    """Python source: lines, imports, functions, classes by the starts of stripped lines."""
    lines = F.split(text, "\n")
    starts = lambda *words: F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^(" + "|".join(words) + ")")))
    return F.struct(F.size(lines).alias("lines"), starts("import ", "from ").alias("imports"), starts("def ", "async def ").alias("functions"), starts("class ").alias("classes"))


def first_docstring(text: Column) -> Column:
    """The first sentence of the first docstring; null without one."""
    body = F.trim(F.regexp_extract(text, r'(?s)"""(.*?)"""', 1))
    return F.nullif(F.regexp_extract(body, r"(?s)^([^.\n]*)", 1), F.lit(""))


def flag(text: Column) -> Column:
    """A word as a boolean; null if it is none."""
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def names_list(text: Column) -> Column:
    """A JSON list, or words split at commas with quotes stripped."""
    loose = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'\\[]+|[\"'\\]]+$", "")), lambda x: x != "")
    return F.when(text.rlike(r"^\s*\["), F.coalesce(F.from_json(text, "array<string>"), loose)).otherwise(loose)


def rendered(template: str, **values: Column) -> Column:
    """A template with {name} replaced; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def only_reads(statement: Column) -> Column:
    tokens = F.split(F.upper(statement), "[^A-Z]+")
    return ~F.arrays_overlap(tokens, F.array(*map(F.lit, READ_ONLY_WORDS)))


def json_at(text: Column, *keys: str) -> Column:
    """The value under nested keys of a JSON text, as text; an absent key is an error that names it, as is a null on the way."""
    at, out = "$", text
    for key in keys:
        at += f"['{key}']"
        found = F.get_json_object(text, at)
        out = F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"no {at[1:]} in "), F.substring(F.coalesce(text, F.lit("null")), 1, 80)))).otherwise(found)
    return out


def function_names(text: Column) -> Column:
    """Names of Python functions, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))


def summary(text: Column) -> Column:
    """The first sentence of the first text in three quotes, double ones before single ones; null without one."""
    quoted = lambda q: F.when(text.rlike(f"(?s){q}.*?{q}"), F.trim(F.regexp_extract(text, f"(?s){q}(.*?){q}", 1)))
    body = F.coalesce(quoted('"""'), quoted("'''"))
    return F.nullif(F.trim(F.get(F.split(body, r"[.!?]\s+"), F.lit(0))), F.lit(""))


def symbol_digest(categories: Column) -> Column:
    """SHA-256 of a map from category to names: categories in order, each with its names in order, so that it changes with the structure alone."""
    line = lambda x: F.concat(x["key"], F.lit(":"), F.array_join(F.sort_array(F.filter(x["value"], lambda n: n != "")), ","), F.lit(";"))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(categories), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), line), ""), 256)


def query_templates(path: Column, text: Column) -> Column:
    """What one may ask of a file: by its name, by its name's words, its summary, and its first two functions if it is Python."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    stem = F.when(F.coalesce(path, F.lit("")) == "", F.lit("unknown")).otherwise(stem)
    asked = F.array(F.concat(F.lit("What does "), stem, F.lit(" do?")), F.concat(F.lit("How does "), F.replace(stem, F.lit("_"), F.lit(" ")), F.lit(" work?")), summary(text))
    functions = F.transform(F.slice(function_names(text), 1, 2), lambda f: F.concat(F.lit("How does "), f, F.lit(" function work?")))
    return F.concat(F.array_compact(asked), F.when(path.endswith(".py"), functions).otherwise(F.array().cast("array<string>")))
