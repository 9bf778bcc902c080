"""Rules on single values: units, bounds, keys, paths, statements, files by their names, and what readers make of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, texts
from ..operators import chunks, learning, sessions
from ..sources import files, symbols
from .registry import query
from .tables import Tables


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _sql_pick(values: list, at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({at}) % {len(values)} + 1]"


_UNITS = ["s", "ms", "us", "h"]


@query(f"""select event_id, unit, round(case when unit <> 'h' then greatest("value" / case unit when 's' then 1 when 'ms' then 1000 else 1000000 end, 1e-9) end, 9) secs from (select event_id, "value", {_sql_pick(_UNITS, "event_id")} unit from events)""")
def time_units(t: Tables) -> DataFrame:
    """Durations in several units; an unknown one gives null."""
    rows = t.read("events").select("event_id", "value", _pick(_UNITS, F.col("event_id")).alias("unit"))
    return rows.select("event_id", "unit", F.round(scores.in_seconds(F.col("value"), F.col("unit")), 9).alias("secs"))


_BOUNDS = scores.PLAN_BOUNDS
_DEFAULTS = {"hops": 1, "fanout": 2, "beam": 8, "rerank_m": 20, "final_context": 6, "docs_max": 160, "latency_ms": 2000}
#: What each bound is asked for: a factor of the event's number, a divisor of the remainder, and what is added.
_ASKED = {"hops": (1, 7, -2), "fanout": (3, 8, -1), "beam": (5, 41, -3), "rerank_m": (7, 50, 0), "final_context": (11, 20, -4), "docs_max": (13, 900, 0), "latency_ms": (97, 20001, 0)}


@query(
    "select event_id, "
    + ", ".join(f"greatest({lo}, least({hi}, {k})) {k}" for k, (lo, hi) in _BOUNDS.items())
    + ", array_to_string(list_filter(["
    + ", ".join(f"case when {k} < {lo} then '{k}:min' when {k} > {hi} then '{k}:max' end" for k, (lo, hi) in _BOUNDS.items())
    + "], lambda x: x is not null), ',') reasons from (select event_id, "
    + ", ".join(f"case when (event_id + {n}) % 5 = 0 then {_DEFAULTS[k]} else event_id * {f} % {d} + {a} end {k}" for n, (k, (f, d, a)) in enumerate(_ASKED.items()))
    + " from events)"
)
def plan_clamp(t: Tables) -> DataFrame:
    """Retrieval plans asked for by events: what is left out takes its default, what lies outside its bounds is clamped, with a reason."""
    e = F.col("event_id")
    asked = [F.coalesce(F.when((e + n) % 5 != 0, e * f % d + a), F.lit(_DEFAULTS[k])).alias(k) for n, (k, (f, d, a)) in enumerate(_ASKED.items())]
    rows = t.read("events").select("event_id", *asked)
    reasons = F.array_compact(F.array(*[scores.clamp_reason(k, F.col(k), lo, hi) for k, (lo, hi) in _BOUNDS.items()]))
    return rows.select("event_id", *[scores.clamped(F.col(k), lo, hi).alias(k) for k, (lo, hi) in _BOUNDS.items()], F.array_join(reasons, ",").alias("reasons"))


_FORMS = ["FOR d IN x FILTER d.t == ", "insert {} INTO x // ", "RETURN d.inserted, ", "for d in x update d with {} in x // ", "RETURN ", "create_graph() // "]


@query(
    f"""select conv_id, turn, len(list_intersect(regexp_split_to_array(upper({_sql_pick(_FORMS, "conv_id + turn")} || left("text", 200)), '[^A-Z]+'), {list(texts.READ_ONLY_WORDS)})) = 0 allowed from conversations"""
)
def read_only_guard(t: Tables) -> DataFrame:
    """Which statements, made of the turns of conversations, only read."""
    text = F.concat(_pick(_FORMS, F.col("conv_id") + F.col("turn")), F.left("text", F.lit(200)))
    return t.read("conversations").select("conv_id", "turn", texts.only_reads(text).alias("allowed"))


_ROUTES = ["/_db/main/_api/document/", "/_db/main/_api/cursor/", "/_api/database/", "/_db/m/_api/view/", "/_db//_api/index/", "/_db/a/_api/documents", "/_db/b/_api/import?x="]


@query(f"""select page_id, {_sql_pick(_ROUTES, "page_id")} || path as route, regexp_matches({_sql_pick(_ROUTES, "page_id")} || path, '{texts.ALLOWED_PATH}') allowed from repo_docs""", "repo_docs")
def path_allow_list(t: Tables) -> DataFrame:
    """Which requests, to routes with the paths of pages, are let through."""
    route = F.concat(_pick(_ROUTES, F.col("page_id")), "path")
    return t.repo_docs.select("page_id", route.alias("route"), route.rlike(texts.ALLOWED_PATH).alias("allowed"))


@query(
    """with p as (select 'page' origin, page_id n, path from repo_docs union all select 'text', doc_id, left("text", doc_id % 400) from documents),
    k as (select origin, n, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(path, '[/ ]', '_', 'g'), '[^\\p{L}\\p{N}_.:@()+-]', '', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'item') k from p)
    select origin, n, case when octet_length(encode(k)) > 254 then left(k, 243) || '_' || left(sha1(k), 10) else k end as "key" from k""",
    "repo_docs",
)
def safe_keys(t: Tables) -> DataFrame:
    """Keys of pages' paths and of starts of texts; what nothing is left of is an item, long ones end in a hash."""
    pages = t.repo_docs.select(F.lit("page").alias("origin"), F.col("page_id").alias("n"), "path")
    starts = t.read("documents").select(F.lit("text").alias("origin"), F.col("doc_id").alias("n"), F.left("text", (F.col("doc_id") % 400).cast("int")).alias("path"))
    return pages.unionByName(starts).select("origin", "n", texts.safe_key(F.col("path")).alias("key"))


_ENDINGS = [*texts.LANGUAGES, ".PDF", ".Tex", "", ".", ".tar.gz", "/.env"]
_case = lambda table, ext: "case " + ext + " " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


@query(
    f"""select page_id, ext, coalesce({_case(texts.READERS, "ext")}, 'pdf') reader, {_case(texts.LANGUAGES, "ext")} lang from (
    select page_id, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) ext from (select page_id, path || {_sql_pick(_ENDINGS, "page_id")} path from repo_docs))""",
    "repo_docs",
)
def reader_registry(t: Tables) -> DataFrame:
    """Reader and language of files by their extension: the pages' paths with every ending in turn."""
    ext = texts.extension(F.concat("path", _pick(_ENDINGS, F.col("page_id"))))
    return t.repo_docs.select("page_id", ext.alias("ext"), texts.reader(ext).alias("reader"), texts.language(ext).alias("lang"))


_FLAGS = ["TRUE", "1", "no", "maybe", "Off", "yes", "0", ""]


@query(
    f"""select event_id, coalesce(case when lower(w) in ('true', '1', 'yes', 'on') then 'true' when lower(w) in ('false', '0', 'no', 'off') then 'false' end, 'none') flag from (select event_id, {_sql_pick(_FLAGS, "event_id")} w from events)"""
)
def flags(t: Tables) -> DataFrame:
    """Words of settings as booleans."""
    return t.read("events").select("event_id", F.coalesce(texts.flag(_pick(_FLAGS, F.col("event_id"))).cast("string"), F.lit("none")).alias("flag"))


@query(
    """select page_id, case page_id % 4 when 2 then null when 3 then regexp_replace(html, '[^A-Za-z ]', '', 'g') else html end body, case page_id % 4 when 0 then 'text' when 1 then 'latex' else 'pdf' end kind, page_id % 4 = 2 failed from pages"""
)
def extraction_rows(t: Tables) -> DataFrame:
    """Pages as files of three kinds through their readers: text and LaTeX as they are, words of text operators of a PDF, an error for what is none."""
    n = F.col("page_id") % 4
    path = F.concat(F.col("page_id").cast("string"), _pick([".txt", ".tex", ".pdf", ".pdf"], n))
    words = F.concat(F.lit("%PDF-1.4 BT ("), F.regexp_replace("html", "[^A-Za-z ]", ""), F.lit(") Tj ET"))
    rows = t.read("pages").select(path.alias("path"), F.when(n == 3, words).otherwise(F.col("html")).cast("binary").alias("content"))
    out = files.extracted(rows)
    return out.select(F.substring_index("path", ".", 1).cast("long").alias("page_id"), F.col("text").alias("body"), "kind", F.col("error").isNotNull().alias("failed"))


def _code(t: Tables) -> DataFrame:
    """A file for each document: every third in another language, every seventh that no parser takes."""
    i, name = F.col("doc_id").cast("string"), F.regexp_replace("source", "[^a-z]", "")
    go = F.concat(F.lit("type T"), i, F.lit(" struct {}\nfunc Run"), i, F.lit("(x int) {\n}\n"))
    python = F.concat(
        F.lit("import "), "lang", F.lit("\nfrom "), name, F.lit(".m import c\nLIMIT_"), i, F.lit(" = 3\nclass K"), i,
        F.lit(":\n    def m(self):\n        return 1 if self else 2\n"), F.expr("repeat('def f():\\n    pass\\n', cast(doc_id % 4 as int))"),
    )
    kind = F.when(F.col("doc_id") % 7 == 6, 2).when(F.col("doc_id") % 3 == 2, 1).otherwise(0)
    text = F.when(kind == 2, F.lit("def (")).when(kind == 1, go).otherwise(python)
    return t.read("documents").select("doc_id", kind.alias("k"), i.alias("path"), text.alias("text"), F.when(kind == 1, "go").otherwise("python").alias("language"))


_OWN = "(select doc_id, lang, regexp_replace(source, '[^a-z]', '', 'g') src, case when doc_id % 7 = 6 then 2 when doc_id % 3 = 2 then 1 else 0 end k from documents)"


@query(
    f"""select doc_id, 'import' kind, lang as "name", 1 line from {_OWN} where k = 0 union all select doc_id, 'import', src || '.m', 2 from {_OWN} where k = 0 union all select doc_id, 'constant', 'LIMIT_' || doc_id, 3 from {_OWN} where k = 0
    union all select doc_id, 'class', 'K' || doc_id, 4 from {_OWN} where k = 0 union all select doc_id, 'function', 'm', 5 from {_OWN} where k = 0
    union all select doc_id, 'function', 'f', unnest(list_transform(range(doc_id % 4), lambda x: 7 + 2 * x)) from {_OWN} where k = 0
    union all select doc_id, 'type', 'T' || doc_id, 1 from {_OWN} where k = 1 union all select doc_id, 'function', 'Run' || doc_id, 2 from {_OWN} where k = 1"""
)
def code_symbols(t: Tables) -> DataFrame:
    """Symbols of files in two languages, by line."""
    return symbols.symbols(_code(t)).select(F.col("path").cast("long").alias("doc_id"), "kind", "name", "line")


@query(f"""select doc_id, case k when 0 then 7 + 2 * (doc_id % 4) when 1 then 4 else 1 end lines, case k when 0 then 2 else 1 end complexity, k = 0 parsed from {_OWN}""")
def code_metrics(t: Tables) -> DataFrame:
    """Lines and branches of files; what isn't Python has no syntax nodes."""
    return symbols.metrics(_code(t)).select(F.col("path").cast("long").alias("doc_id"), "lines", "complexity", (F.col("nodes") > 0).alias("parsed"))


@query(
    """with w as (select doc_id, list_filter(regexp_split_to_array("text", '\\s+'), lambda w: w <> '') w from documents),
    c as (select doc_id, w, unnest(range(0, len(w), 2048)) s from w)
    select doc_id, s // 2048 chunk_index, case when s = 0 then 0 else length(array_to_string(w[1:s], ' ')) end start_char, case when s = 0 then 0 else length(array_to_string(w[1:s], ' ')) end + length(array_to_string(w[s + 1:s + 4096], ' ')) end_char from c"""
)
def chunk_offsets(t: Tables) -> DataFrame:
    """Where windows of 4096 words with an overlap of 2048 lie, in code points."""
    return chunks.windows(t.read("documents"), "doc_id", "text", 4096, 2048).select("doc_id", "chunk_index", "start_char", "end_char")


@query(
    f"""with f as (select doc_id, k, lang, src, doc_id % 4 n from {_OWN}), c as (select doc_id, case k when 0 then 'class:K' || doc_id || ';constant:LIMIT_' || doc_id || ';function:' || array_to_string(list_transform(range(n), lambda x: 'f') || ['m'], ',')
    || ';import:' || array_to_string(list_sort([lang, src || '.m']), ',') || ';' when 1 then 'function:Run' || doc_id || ';type:T' || doc_id || ';' end s from f)
    select doc_id, sha256(s) digest from c where s is not null"""
)
def symbol_digests(t: Tables) -> DataFrame:
    """A digest of each file's symbols by category: a file's names are one bounded group."""
    rows = symbols.symbols(_code(t)).groupBy("path", "kind").agg(F.collect_list("name").alias("names"))
    maps = rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("kind", "names"))).alias("categories"))
    return maps.select(F.col("path").cast("long").alias("doc_id"), texts.symbol_digest(F.col("categories")).alias("digest"))


@query(
    """with b as (select event_id, json_object('model', json_object('size', 'small', 'deep', json_object('a', 1, 'b', json_object('x', event_id % 3))), 'n', event_id) base,
    json_object('model', json_object('deep', json_object('b', json_object('y', user_id), 'c', event_type)), case when event_id % 2 = 0 then 'n' else 'm' end, json_object('k', 1)) over_ from events)
    select event_id, (m->'model'->>'size') size, (m->'model'->'deep'->>'a')::bigint a, (m->'model'->'deep'->'b'->>'x')::bigint x, (m->'model'->'deep'->'b'->>'y')::bigint y, (m->'model'->'deep'->>'c') c, (m->>'n') n from (select event_id, json_merge_patch(base, over_) m from b)"""
)
def deep_merges_any(t: Tables) -> DataFrame:
    """Settings of four levels merged as JSON, taken apart again."""
    i = F.col("event_id").cast("string")
    base = F.concat(F.lit('{"model":{"size":"small","deep":{"a":1,"b":{"x":'), (F.col("event_id") % 3).cast("string"), F.lit("}}},"), F.lit('"n":'), i, F.lit("}"))
    over = F.concat(F.lit('{"model":{"deep":{"b":{"y":'), F.col("user_id").cast("string"), F.lit('},"c":"'), "event_type", F.lit('"}},"'), F.when(F.col("event_id") % 2 == 0, "n").otherwise("m"), F.lit('":{"k":1}}'))
    rows = t.read("events").select("event_id", sessions.deep_merged_json(base, over).alias("m"))
    at = lambda path: F.get_json_object("m", f"$.{path}")
    return rows.select("event_id", at("model.size").alias("size"), at("model.deep.a").cast("long").alias("a"), at("model.deep.b.x").cast("long").alias("x"), at("model.deep.b.y").cast("long").alias("y"), at("model.deep.c").alias("c"), at("n").alias("n"))


@query("""select event_id, (props::json->>'k') k from events""")
def required_json(t: Tables) -> DataFrame:
    """A nested value that must be there; without it the query fails with the key's name."""
    whole = F.concat(F.lit('{"stats":{"wall":'), "props", F.lit("}}"))
    return t.read("events").select("event_id", texts.json_at(whole, "stats", "wall", "k").alias("k"))


@query(
    """with e as (select from_id, case when from_id = to_id then null when kind = 'relates_to' then 'a' else 'b' end kind, strength, (regexp_extract(from_id, '[0-9]+')::bigint * 7 + regexp_extract(to_id, '[0-9]+')::bigint) % 13 h from relationships)
    select kind, count(*) n, count(*) filter (h = 1) unweighted, round(sum(case when h = 0 then 1.0 when h = 1 then null else strength end), 4) total, round(min(case when h = 0 then 1.0 when h = 1 then null else strength end), 6) least, round(max(case when h = 0 then 1.0 when h = 1 then null else strength end), 6) most from e group by kind""",
    "relationships",
)
def edge_weight_totals(t: Tables) -> DataFrame:
    """Weights of edges by kind, from properties in which the weight is absent for some and null for others."""
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    h = (number("from_id") * 7 + number("to_id")) % 13
    none = F.create_map().cast("map<string,string>")
    props = F.when(h == 0, none).when(h == 1, F.create_map(F.lit("weight"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("weight"), F.col("strength").cast("string")))
    kind = F.when(F.col("from_id") != F.col("to_id"), F.when(F.col("kind") == "relates_to", "a").otherwise("b"))
    rows = learning.edge_weights(t.relationships.select(kind.alias("kind"), props.alias("props")))
    return rows.select("kind", "n", "unweighted", F.round("total", 4).alias("total"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


_PICK = "('0x' || substr(md5('pairs|' || f.n || '|' || k || '|' || {0}), 1, 8))::bigint"


@query(
    f"""with f as (select doc_id id, row_number() over (order by doc_id) - 1 n, case when doc_id % 7 = 6 then 'def (' when doc_id % 3 = 2 then 'go' else 'py' end kind, doc_id % 4 fs, count(*) over () size from documents),
    g as (select *, unnest(['What does file_' || id || ' do?', 'How does file ' || id || ' work?'] || case when kind = 'py' then list_transform((['m'] || list_transform(range(fs), lambda x: 'f'))[1:2], lambda x: 'How does ' || x || ' function work?') else [] end) query,
        unnest(range(2 + case when kind = 'py' then least(2, 1 + fs) else 0 end)) k from f),
    b as (select query, n, size, {_PICK.replace("f.n", "n").format("i")} % size p from g, (select unnest([1, 2]) i))
    select query, id, 1 as "label" from g union all select b.query, f.id, 0 from b join f on f.n = case when b.p = b.n then (b.p + 1) % b.size else b.p end"""
)
def query_pairs(t: Tables) -> DataFrame:
    """Questions that files answer, with twice as many of other files."""
    rows = _code(t).select(F.col("doc_id").alias("id"), F.concat(F.lit("src/file_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    return learning.query_pairs(rows)


@query(
    """select page_id, regexp_matches(path, '^.*/[1-5].*$') or regexp_matches(path, '^.*\\.html$') or regexp_matches(path, '^m\\..*$') or regexp_matches(path, '^blog\\.t[^h].*$') or starts_with(path, 'spam-farm.example.org/') ignored from repo_docs""",
    "repo_docs",
)
def ignored_paths(t: Tables) -> DataFrame:
    """Pages' paths against a file of ignore patterns: classes, stars, a folder, a comment, a blank line, and a bracket that isn't closed."""
    lines = ["# what to leave out", "", "*/[1-5]*", "*.html", "m.*", "/blog.t[!h]*", "spam-farm.example.org/", "x[y"]
    return t.repo_docs.select("page_id", files.ignored(F.col("path"), lines).alias("ignored"))
