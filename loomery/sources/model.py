"""The record model over the driver's tables: tickets, comments, search documents and passages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Mirror:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tickets(self) -> DataFrame:
        """A ticket a row; members that filters need are typed columns, so predicates reach the scan or stay in codegen."""
        d = self.table("documents")
        marks = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        i, cut = F.col("doc_id"), F.instr("text", "\n")
        d = d.join(marks, "doc_id", "left").where("text is not null")
        named = lambda p, m: F.concat(F.lit(p), (i % m).cast("string"))
        return d.select(
            F.concat(F.lit("demo/"), "source").alias("repo"),
            (i + 1).alias("number"),
            F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.substring("text", 1, 60)).alias("title"),
            F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.expr("substring(text, 61)")).alias("body"),
            F.when(i % 3 == 0, "open").otherwise("closed").alias("state"),
            F.when(i % 4 == 0, "pull_request").otherwise("issue").alias("kind"),
            F.when(i % 5 == 0, "Bug").when(i % 5 == 1, "Feature").when(i % 5 == 2, "Task").alias("type"),
            named("user", 17).alias("author"),
            F.array_distinct(F.array(named("dev", 7), named("dev", 11))).alias("assignees"),
            F.when(i % 6 > 0, named("v", 6)).alias("milestone_title"),
            F.when(i % 6 > 0, (i % 6).cast("string")).alias("milestone_number"),
            F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("quality:"), F.col("q").cast("string")), F.concat(F.lit("toxic:"), F.col("t").cast("string")))).alias("labels"),
            F.array(F.struct(F.lit("size").alias("name"), F.floor(F.col("n_chars") / 1000).cast("string").alias("value"))).alias("field_values"),
            F.array(F.concat(F.lit("https://host.example/orgs/demo/projects/"), (i % 9).cast("string"))).alias("project_urls"),
            (i * 3600 + 1704067200).alias("created_s"),
            (i * 3600 + 1704067200 + (i * 7919 % 500) * 3600).alias("updated_s"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Tickets as upstream sends them: payload, fields and extra are JSON."""
        t, n = self.tickets, F.col("number")
        named = lambda c, member: F.transform(c, lambda x: F.struct(x.alias(member)))
        when = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        payload = F.struct(
            "number", F.concat(F.lit("T_"), n.cast("string")).alias("node_id"), "title", "state", F.concat(F.lit("https://host.example/"), "repo", F.lit("/"), n.cast("string")).alias("html_url"),
            when.alias("created_at"), when.alias("updated_at"), F.struct(F.col("type").alias("name")).alias("type"), F.struct(F.col("author").alias("login")).alias("user"),
            named("labels", "name").alias("labels"), named("assignees", "login").alias("assignees"), F.struct(F.col("milestone_title").alias("title")).alias("milestone"),
            F.when(F.col("kind") == "pull_request", F.struct(F.when(F.col("state") == "closed", when).alias("merged_at"))).alias("pull_request"),
        )
        node = lambda at: F.struct(at.alias("number"), F.struct(F.col("repo").alias("nameWithOwner")).alias("repository"))
        extra = F.struct(
            F.when(n % 5 == 0, node(n - 1)).alias("parent"), F.when(n % 7 == 0, F.array(node(n + 1), node(n + 2))).alias("subIssues"), F.when(n % 4 == 0, F.array(node(n + 3))).alias("blocking"),
            F.transform("project_urls", lambda u: F.struct(F.struct(u.alias("url")).alias("project"))).alias("projectItems"),
        )
        fields = F.transform("field_values", lambda f: F.struct(F.struct(f["name"].alias("name")).alias("field"), f["value"].alias("number")))
        team = F.array(F.struct(F.struct(F.lit("team").alias("name")).alias("field"), F.concat(F.lit("team"), (n % 3).cast("string")).alias("name")))
        return t.select("repo", "number", "kind", F.to_json(payload).alias("payload"), F.to_json(extra).alias("extra"), F.to_json(fields).alias("fields"), F.to_json(team).alias("teams"))

    @cached_property
    def catalog(self) -> DataFrame:
        """(kind, scope, id, payload): labels and milestones of repositories, projects of the owner."""
        t = self.tickets
        own = lambda kind, c: t.select(F.lit(kind).alias("kind"), F.col("repo").alias("scope"), F.explode(c).alias("id")).distinct()
        named = own("labels", F.col("labels")).unionByName(own("milestones", F.array_compact(F.array("milestone_title"))))
        named = named.withColumn("payload", F.to_json(F.struct(F.col("id").alias("name"))))
        number = F.regexp_extract("url", r"(\d+)$", 1)
        plans = t.select(F.explode("project_urls").alias("url")).select(number.alias("id")).distinct().select(F.lit("projects").alias("kind"), F.lit("demo").alias("scope"), "id", F.to_json(F.struct(F.col("id").cast("long").alias("number"))).alias("payload"))
        return named.unionByName(plans)

    @cached_property
    def comments(self) -> DataFrame:
        c, t = self.table("conversations"), self.tickets.select("repo", "number")
        key = F.col("conv_id") * 1000 + F.col("turn")
        c = c.withColumn("number", F.col("conv_id") + 1).join(t, "number")
        return c.select(
            F.when(F.col("turn") % 3 == 2, F.concat(F.lit("review:"), key.cast("string"))).otherwise(key.cast("string")).alias("id"),
            "repo", "number", F.col("text").alias("body"), F.col("role").alias("author"),
            F.when(F.col("role") == "assistant", "Bot").otherwise("User").alias("author_type"),
            (F.col("conv_id") * 3600 + F.col("turn") * 60 + 1704067200).alias("created_s"),
            F.when((F.col("turn") % 3 == 2) & (F.col("turn") > 2), F.concat(F.lit("review:"), (key - 3).cast("string"))).alias("in_reply_to"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """Search units: the ticket itself, its label names in the title column, and each comment."""
        t = self.tickets
        own = t.select(F.concat(F.lit("issue:"), "repo", F.lit(":"), F.col("number").cast("string")).alias("id"), "repo", "number", F.lit("issue").alias("family"), "title", "body")
        marks = t.where(F.size("labels") > 0).select(F.concat(F.lit("labels:"), "repo", F.lit(":"), F.col("number").cast("string")).alias("id"), "repo", "number", F.lit("labels").alias("family"), F.array_join("labels", "\n").alias("title"), F.lit("").alias("body"))
        said = self.comments.select(F.concat(F.lit("comment:"), "id").alias("id"), "repo", "number", F.when(F.col("id").startswith("review:"), "review").otherwise("comment").alias("family"), F.lit("").alias("title"), "body")
        return own.unionByName(marks).unionByName(said)

    @cached_property
    def passages(self) -> DataFrame:
        """Stored vectors as passages: ticket and field by vec_id."""
        e, v = self.table("embeddings"), F.col("vec_id")
        e = e.crossJoin(F.broadcast(self.tickets.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))))  # one row
        field = F.element_at(F.array(*(F.lit(x) for x in ("title", "body", "labels", "comment", "review_comment"))), (v % 5 + 1).cast("int"))
        e = e.select((v % F.col("n") + 1).alias("number"), field.alias("field"), v.alias("chunk"), F.col("embedding").alias("vector"))
        return e.join(self.tickets.select("repo", "number"), "number").select("repo", "number", "field", "chunk", "vector")
