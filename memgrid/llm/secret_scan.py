"""Secret scans with multipart credential linking.

Only DataFrame functions are used, and no row leaves its place: spans are arrays of a document. Base kinds are reported as they are.
Weak candidates (identifiers, secrets without a clear label, endpoints) are common in harmless text; they are joined by interval: one
is reported only if its complementary parts (for an identifier a secret, for a secret an identifier, for an endpoint both) lie within
its scope, so many code points to either side. Base spans count as parts: access keys as identifiers, the others as secrets.

Positions follow from the lengths of matches and of the pieces between them, as no SQL function gives them; they are added up in groups
of GROUP matches, so that lists are not copied at each. Only weak candidates without a complement compare with all parts of their text.

Defined results: a null text is an empty one without spans; repeated rows each get their result; an empty table gives an empty one;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base


def either(text: str) -> str:
    """A pattern for the text with its letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


_SET = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: Kinds in the order they are listed in. Fixed values.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = f"({either('password|passwd|secret|token|api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
WEAK_ID = f"(?:AGPA|AIDA|AIPA|ANPA|AROA|ASIA)[A-Z0-9]{{12,}}|(?:{either('username|user_id|login|client_id|access_key_id|account_id')}){_SET}[A-Za-z0-9._@-]{{3,}}"
WEAK_SECRET = "[A-Za-z0-9+/_-]{20,}"
ENDPOINT = "[a-z]{2,10}://[^\\x20\\x09-\\x0D\"'<>]+"
SCOPE = 300
#: Matches whose positions are added up at once.
GROUP = 128


def found(text: Column, pattern: str, kind: int, part: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, text) of a pattern's matches whose group `part` has at least so many code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("part"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,size:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"), F.length(x["part"]).alias("size"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def group(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(rows, k * GROUP + 1, F.lit(GROUP)), F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.aggregate(F.array(own), acc, lambda acc, own: F.struct(own["at"].alias("at"), F.concat(acc["groups"], F.array(own["spans"])).alias("groups")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,hit:string,size:int>>>").alias("groups"))
    spans = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / GROUP).cast("int")), start, group, lambda acc: acc["groups"]))
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x["size"] >= least)).otherwise(none)


def near(x: Column, parts: Column, scope: int) -> Column:
    return F.exists(parts, lambda y: (y["start"] < x["end"] + scope) & (y["end"] > x["start"] - scope) & ((y["start"] != x["start"]) | (y["end"] != x["end"])))


def scanned(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc, base, spans): the columns of docs as a struct, and arrays of (start, kind, end) of base spans and of all spans.

    Ends are exclusive, places in code points, kind is a place in KINDS; arrays are ordered by start and then kind.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("base", F.array_sort(F.concat(found(text, ASSIGN, 0, 2, 8), found(text, ACCESS, 1), found(text, HEX, 2))))
    named = text.rlike(WEAK_ID) | text.contains("AKIA")
    clear = lambda spans: F.filter(spans, lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])))
    weak = F.concat(
        found(text, WEAK_ID, 3),
        F.filter(found(text, WEAK_SECRET, 4), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[a-z]")),
        found(text, ENDPOINT, 5),
    )
    weak = F.filter(weak, lambda x: (x["kind"] != 4) | ~text.substr(F.greatest(x["start"] - 2, F.lit(1)), F.lit(3)).contains("://"))
    rows = rows.withColumn("weak", F.when(named, clear(weak)))
    both = F.concat("base", F.coalesce("weak", F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,size:int>>")))
    rows = rows.withColumns({"ids": F.filter(both, lambda x: x["kind"].isin(1, 3)), "secrets": F.filter(both, lambda x: x["kind"].isin(0, 2, 4))})
    kept = F.filter("weak", lambda x: F.when(x["kind"] == 3, near(x, F.col("secrets"), scope)).when(x["kind"] == 4, near(x, F.col("ids"), scope)).otherwise(near(x, F.col("ids"), scope) & near(x, F.col("secrets"), scope)))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    every = F.array_sort(F.transform(F.when(F.size("weak") > 0, F.concat("base", kept)).otherwise(F.col("base")), bare))
    return rows.select("doc", F.transform("base", bare).alias("base"), every.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])))


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in `text` replaced by the mark; texts without spans stay as they are, null included."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("doc.text")

    def step(acc: Column, x: Column) -> Column:
        gap = text.substr(acc["at"] + 1, x["start"] - acc["at"])
        out = F.when((x["start"] >= acc["at"]), F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    new = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)).otherwise(text)
    return scanned(docs, scope).select(*(new.alias(c) if c.lower() == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(base.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _sql(pattern: str, kind: int, part: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    hits, gaps = f"regexp_extract_all(t, '{p}')", f"string_split_regex(t, '{p}')"
    return f"""list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{'s': (list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(({hits})[1:i-1], lambda g: length(g))), 0))::bigint,
    'k': {kind}, 'n': length(({hits})[i]), 'h': ({hits})[i], 'z': length((regexp_extract_all(t, '{p}', {part}))[i])}}), lambda x: x.z >= {least})"""


_NEAR = f"y.s < x.s + x.n + {SCOPE} and y.s + y.n > x.s - {SCOPE} and (y.s <> x.s or y.n <> x.n)"
_LIST = "list_aggregate(list_transform({0}, lambda x: ['" + "','".join(KINDS) + "'][x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), 'string_agg', ',')"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce("text", '') t from documents),
b as (select *, list_sort({_sql(ASSIGN, 0, 2, 8)} || {_sql(ACCESS, 1)} || {_sql(HEX, 2)}) b from d),
w as (select *, case when regexp_matches(t, '{WEAK_ID.replace("'", "''")}') or contains(t, 'AKIA') then
    list_filter({_sql(WEAK_ID, 3)} || list_filter({_sql(WEAK_SECRET, 4)}, lambda x: regexp_matches(x.h, '[0-9]') and regexp_matches(x.h, '[A-Z]') and regexp_matches(x.h, '[a-z]')
        and not contains(substr(t, greatest(x.s - 2, 1), 3), '://')) || {_sql(ENDPOINT, 5)},
    lambda x: len(list_filter(b, lambda y: y.s < x.s + x.n and y.s + y.n > x.s)) = 0) else [] end w from b),
p as (select *, list_filter(b || w, lambda x: x.k in (1, 3)) ids, list_filter(b || w, lambda x: x.k in (0, 2, 4)) secrets from w),
e as (select *, list_sort(b || list_filter(w, lambda x: (x.k = 4 or len(list_filter(secrets, lambda y: {_NEAR})) > 0) and (x.k = 3 or len(list_filter(ids, lambda y: {_NEAR})) > 0))) e from p)
select doc_id, len(list_filter(b, lambda x: x.k = 0))::bigint n_assign, len(list_filter(b, lambda x: x.k = 1))::bigint n_access, len(list_filter(b, lambda x: x.k = 2))::bigint n_hex,
    sha256(coalesce({_LIST.format("b")}, '')) base_sha256, coalesce({_LIST.format("e")}, '') spans from e
"""
