"""The driver's tables, and the tables of the data model derived from them, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import nearest
from ..sources.stage import stored, version

#: The unit of created_at_unix starts here.
EPOCH = 1704067200
KINDS = ("observation", "decision", "learning", "event")

VIEWS = {
    "observations": f"""select d.doc_id, 'obs_' || d.doc_id as "key", 'observations/obs_' || d.doc_id id, d."text" content, 'sha256:' || sha256(d."text") content_hash,
        {list(KINDS)}[(d.doc_id % 4 + 1)::int] memory_type, [d.lang, d.source, 'b' || (d.doc_id % 7)] tags, e.embedding::double[] embedding, e.label,
        {EPOCH} + d.doc_id * 3600 created_at_unix, 's' || (d.doc_id % 20) session_id, case when d.doc_id % 17 = 0 then 'archived' else 'active' end status
        from documents d left join embeddings e on d.doc_id = e.vec_id""",
    "reflections": """select 'ref_' || (doc_id // 10) as "key", 'reflections/ref_' || (doc_id // 10) id, list(id order by id) consolidates, count(*) source_count,
        max(created_at_unix) created_at_unix, case when any_value(doc_id // 10) % 5 = 0 then 'archived' else 'active' end status, arg_min(doc_id, doc_id) first_doc
        from observations where (doc_id // 10) % 3 = 0 group by doc_id // 10""",
    "knn_edges": """select src, dst, w from (select a.vec_id src, b.vec_id dst, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) w
        from embeddings a join embeddings b on a.vec_id <> b.vec_id) qualify row_number() over (partition by src order by w desc, dst) <= 3""",
    "relationships": """select 'observations/obs_' || src from_id, 'observations/obs_' || dst to_id, least(1.0, greatest(0.0, w)) strength,
        case when a.label = b.label then 'relates_to' else 'conflicts_with' end kind, case when (src + dst) % 11 = 0 then 'invalidated' else 'active' end status
        from knn_edges join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst""",
    "entities": """select source || '_' || lang as "key", source || ' ' || lang as "name", count(*) mention_count from documents group by source, lang""",
    "messages": """select conv_id session_id, turn turn_index, role, "text" content, case when turn % 9 = 8 then null else length("text") // 4 end tokens from conversations""",
    "spans": """select event_id, user_id session_id, event_type label, "value" duration_ms, ts as "at", (props::json->>'k')::bigint k, event_type <> 'error' success from events""",
    "changes": """select event_id, user_id as "key", event_id seq_no, case when event_type = 'error' then 'delete_node' else 'upsert_node' end op, "value" payload from events""",
    "mentions": """select doc_id id, entity, ((length(t) - length(replace(t, name, ''))) // length(name))::bigint n from (select doc_id, lower("text") t from documents) join
        (select item_id entity, array_to_string((list_filter(regexp_split_to_array(lower("text"), '\\s+'), lambda w: w <> ''))[3:4], ' ') name from benchmark) on name <> '' and contains(t, name)""",
    "repo_docs": """select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path, html content from pages""",
    "doc_chunks": """select doc_id, chunk_index, start_token, least(start_token + 512, n) end_token, array_to_string(words[start_token + 1:least(start_token + 512, n)], ' ') chunk, n total_tokens from (
        select doc_id, words, len(words) n, unnest(range(0, len(words), 384)) start_token, unnest(range(0, len(range(0, len(words), 384)))) chunk_index
        from (select doc_id, list_filter(regexp_split_to_array("text", '\\s+'), lambda w: w <> '') words from documents))""",
    "pair_inputs": """select l_orderkey, l_linenumber, l_discount * 10 w_out, 1 - l_tax r_encode, l_quantity / 50 h_out, l_linenumber::double t_out,
        l_tax * 10 w_in, 1 - l_discount r_decode, l_quantity / 40 h_in, (l_linenumber + 1)::double t_in, 0.25 * (l_discount + l_tax + l_quantity / 50 + 0.5) context, 1.7::double alpha from lineitem""",
    "training_pairs": """select l.doc_id, l.quality label, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) sim
        from labels l join embeddings q on q.vec_id = l.doc_id join embeddings v on v.vec_id = (l.doc_id + 1) % (select count(*) from embeddings)""",
    "containment": """select 'region/' || n_regionkey src, 'nation/' || n_nationkey dst from nation union all
        select 'nation/' || c_nationkey, 'customer/' || c_custkey from customer union all select 'customer/' || o_custkey, 'orders/' || o_orderkey from orders""",
    "vertices": """select id, "key", 'observations' collection, embedding, created_at_unix from observations union all
        select r.id, r."key", 'reflections', o.embedding, r.created_at_unix from reflections r join observations o on o.doc_id = r.first_doc""",
}
NEEDS = {"reflections": ["observations"], "relationships": ["knn_edges"], "vertices": ["observations", "reflections"]}


def with_views(*names: str) -> str:
    """The start of a statement that defines these views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)


class Tables:
    """Derived tables are attributes, the driver's own are read by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table's files as a stream, whether it is one file or a folder of them."""
        path = f"{self.sf_dir}/{name}.parquet"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
        return self.spark.readStream.schema(self.read(name).schema).parquet(path if folder else f"{self.sf_dir}/{name}*.parquet")

    @cached_property
    def named_entities(self) -> DataFrame:
        """Entities whose names can stand in texts: for each benchmark item its third and fourth word."""
        words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
        rows = self.read("benchmark").select(F.col("item_id").alias("entity"), F.concat_ws(" ", F.slice(words, 3, 2)).alias("name"))
        return rows.where("name <> ''")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")

    @cached_property
    def observations(self) -> DataFrame:
        d = self.read("documents")
        rows = d.join(self.embeddings, d["doc_id"] == F.col("vec_id"), "left")
        key = F.concat(F.lit("obs_"), F.col("doc_id"))
        return rows.select(
            "doc_id",
            key.alias("key"),
            F.concat(F.lit("observations/"), key).alias("id"),
            F.col("text").alias("content"),
            F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"),
            F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("memory_type"),
            F.array("lang", "source", F.concat(F.lit("b"), F.col("doc_id") % 7)).alias("tags"),
            "embedding",
            "label",
            (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("created_at_unix"),
            F.concat(F.lit("s"), F.col("doc_id") % 20).alias("session_id"),
            F.when(F.col("doc_id") % 17 == 0, "archived").otherwise("active").alias("status"),
        )

    @cached_property
    def reflections(self) -> DataFrame:
        group = F.floor(F.col("doc_id") / 10).cast("long")
        rows = self.observations.select("doc_id", "id", "created_at_unix", group.alias("g")).where("g % 3 = 0").groupBy("g")
        rows = rows.agg(F.sort_array(F.collect_list("id")).alias("consolidates"), F.count(F.lit(1)).alias("source_count"), F.max("created_at_unix").alias("created_at_unix"), F.min("doc_id").alias("first_doc"))
        key = F.concat(F.lit("ref_"), F.col("g"))
        return rows.select(key.alias("key"), F.concat(F.lit("reflections/"), key).alias("id"), "consolidates", "source_count", "created_at_unix", F.when(F.col("g") % 5 == 0, "archived").otherwise("active").alias("status"), "first_doc")

    @cached_property
    def knn_edges(self) -> DataFrame:
        """The stored edge table: made once a session, and anew when the vectors' files change."""
        return stored(lambda: nearest(self.embeddings, "vec_id", "embedding", 3), self.spark, "knn-edges", f"{self.sf_dir}/embeddings.parquet")

    @cached_property
    def relationships(self) -> DataFrame:
        return stored(self._relationships, self.spark, "relationships", f"{self.sf_dir}/embeddings.parquet")

    def _relationships(self) -> DataFrame:
        a, b = self.embeddings.select(F.col("vec_id").alias("src"), F.col("label").alias("la")), self.embeddings.select(F.col("vec_id").alias("dst"), F.col("label").alias("lb"))
        rows = self.knn_edges.join(a, "src").join(b, "dst")
        return rows.select(
            F.concat(F.lit("observations/obs_"), "src").alias("from_id"),
            F.concat(F.lit("observations/obs_"), "dst").alias("to_id"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), "w")).alias("strength"),
            F.when(F.col("la") == F.col("lb"), "relates_to").otherwise("conflicts_with").alias("kind"),
            F.when((F.col("src") + F.col("dst")) % 11 == 0, "invalidated").otherwise("active").alias("status"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        rows = self.read("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("mention_count"))
        return rows.select(F.concat_ws("_", "source", "lang").alias("key"), F.concat_ws(" ", "source", "lang").alias("name"), "mention_count")

    @cached_property
    def messages(self) -> DataFrame:
        tokens = F.when(F.col("turn") % 9 != 8, F.floor(F.length("text") / 4).cast("long"))
        return self.read("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"), tokens.alias("tokens"))

    @cached_property
    def spans(self) -> DataFrame:
        rows = self.read("events")
        return rows.select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("label"), F.col("value").alias("duration_ms"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") != "error").alias("success"))

    @cached_property
    def changes(self) -> DataFrame:
        op = F.when(F.col("event_type") == "error", "delete_node").otherwise("upsert_node")
        return self.read("events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("seq_no"), op.alias("op"), F.col("value").alias("payload"))

    @cached_property
    def repo_docs(self) -> DataFrame:
        path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
        return self.read("pages").select("page_id", path.alias("path"), F.col("html").alias("content"))

    @cached_property
    def pair_inputs(self) -> DataFrame:
        c = F.col
        return self.read("lineitem").select(
            "l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("w_out"), (1 - c("l_tax")).alias("r_encode"), (c("l_quantity") / 50).alias("h_out"), c("l_linenumber").cast("double").alias("t_out"),
            (c("l_tax") * 10).alias("w_in"), (1 - c("l_discount")).alias("r_decode"), (c("l_quantity") / 40).alias("h_in"), (c("l_linenumber") + 1).cast("double").alias("t_in"),
            (0.25 * (c("l_discount") + c("l_tax") + c("l_quantity") / 50 + 0.5)).alias("context"), F.lit(1.7).alias("alpha"),
        )

    @cached_property
    def training_pairs(self) -> DataFrame:
        from ..functions.vectors import cosine

        e = self.embeddings
        n = e.agg(F.count(F.lit(1)).alias("n"))  # one row
        q = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("q"))
        v = e.select(F.col("vec_id").alias("at"), F.col("embedding").alias("v"))
        rows = self.read("labels").join(q, "doc_id").crossJoin(F.broadcast(n)).withColumn("at", (F.col("doc_id") + 1) % F.col("n")).join(v, "at")
        return rows.select("doc_id", F.col("quality").alias("label"), cosine(F.col("q"), F.col("v")).alias("sim"))

    @cached_property
    def containment(self) -> DataFrame:
        edge = lambda t, a, ka, b, kb: self.read(t).select(F.concat(F.lit(f"{a}/"), ka).alias("src"), F.concat(F.lit(f"{b}/"), kb).alias("dst"))
        return edge("nation", "region", "n_regionkey", "nation", "n_nationkey").unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey")).unionByName(edge("orders", "customer", "o_custkey", "orders", "o_orderkey"))

    @cached_property
    def vertices(self) -> DataFrame:
        """Observations and reflections as vertices with their vectors, kept as the edges are."""
        name = f"vertices-{version(self.spark, f'{self.sf_dir}/embeddings.parquet')}"
        return stored(self._vertices, self.spark, name, f"{self.sf_dir}/documents.parquet")

    def _vertices(self) -> DataFrame:
        o = self.observations.select("id", "key", F.lit("observations").alias("collection"), "embedding", "created_at_unix")
        first = self.observations.select(F.col("doc_id").alias("first_doc"), "embedding")
        r = self.reflections.join(first, "first_doc").select("id", "key", F.lit("reflections").alias("collection"), "embedding", "created_at_unix")
        return o.unionByName(r)
