"""Session metadata, transcripts, hook logs, signatures, policies, pair lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions import globs, naming
from vestige.schema import CONTENT_BLOCKS, ENVELOPE_BODY, HOOK_EVENT, SESSION_META, TRANSCRIPT
from vestige.sources import hostlog, lines, strace
from vestige.session import settle


def read_meta(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """All ``session.json`` files below ``root`` (the first ``limit`` by path)."""
    found = (
        spark.read.schema(SESSION_META)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "session.json")
        .json(root)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("session_dir", lines.folder_of(F.col("file")))
    )
    return found.orderBy("file").limit(limit) if limit else found


def read_transcript(spark: SparkSession, root: str) -> DataFrame:
    raw = lines.read_lines(spark, root, "stream.jsonl")
    return parse_transcript(raw.withColumn("session_dir", lines.folder_of(F.col("file"))))


def parse_transcript(text: DataFrame, value: str = "value") -> DataFrame:
    """Records of JSON text lines; ``content`` is NULL unless it is a list of blocks."""
    parsed = text.withColumn(
        "__r", F.from_json(value, TRANSCRIPT, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    keep = [c for c in text.columns if c != value]
    rows = parsed.select(*keep, "__r.*").filter("_corrupt_record IS NULL").drop("_corrupt_record")
    content = F.get_json_object("message", "$.content")
    return rows.withColumn(
        "content", F.when(F.ltrim(content).startswith("["), F.from_json(content, CONTENT_BLOCKS))
    )


def read_hooks(spark: SparkSession, root: str) -> DataFrame:
    raw = (
        spark.read.schema(HOOK_EVENT)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.events.jsonl")
        .json(root)
    )
    return clean_hooks(raw)


def clean_hooks(raw: DataFrame) -> DataFrame:
    """Integer clock, one spelling of the hook names, broken lines dropped."""
    rows = raw.filter("_corrupt_record IS NULL").drop("_corrupt_record") if "_corrupt_record" in raw.columns else raw
    spelled = F.when(F.col("hook") == "preToolUse", "PreToolUse").when(
        F.col("hook") == "postToolUse", "PostToolUse"
    )
    return rows.withColumn("hook", F.coalesce(spelled, F.col("hook"))).withColumn(
        "ts_ns", naming.seconds_to_ns(F.col("ts"))
    )


def agent_session_ids(transcript: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """The agent's own id: of the first init record, else of the first record with one."""
    init = (F.col("type") == "system") & (F.col("subtype") == "init")
    has = F.length("session_id") > 0
    rows = transcript.filter(has)
    return rows.groupBy(*by).agg(
        F.min_by("session_id", F.struct((~F.coalesce(init, F.lit(False))).alias("late"), F.col(order))).alias(
            "agent_session_id"
        )
    )


def signature_predicates(signatures: DataFrame, key: str, predicates: str = "predicates") -> DataFrame:
    """Leaves ``kind = l1_syscall`` of recursive any/all/not predicate trees.

    ``predicates`` is JSON text.  Each round opens one nesting level of the nodes not yet
    at a leaf, until none is left; ``negated`` counts the nots above a leaf (the matching rules ignore it, as
    the stored signatures expect).
    """
    todo = signatures.select(
        key, F.array(F.lit(0)).alias("place"), F.col(predicates).alias("text"), F.lit(0).alias("negations")
    )
    leaves = None
    while leaves is None or not todo.isEmpty():
        todo = todo.select(key, "place", F.parse_json("text").alias("node"), "negations")
        kind = F.try_variant_get("node", "$.kind", "string")
        leaf = todo.filter(kind == "l1_syscall").select(
            key,
            "place",
            F.try_variant_get("node", "$.syscall", "string").alias("syscall"),
            F.try_variant_get("node", "$.path_contains", "string").alias("path_contains"),
            F.try_variant_get("node", "$.path_starts_with", "string").alias("path_starts_with"),
            (F.col("negations") % 2 == 1).alias("negated"),
        )
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        rest = todo.filter(F.coalesce(kind, F.lit("")) != "l1_syscall")
        listed = F.try_variant_get("node", "$", "array<variant>")
        branches = F.array(
            *[
                F.struct(F.lit(i).alias("slot"), F.lit(int(name == "not")).alias("neg"),
                         F.try_variant_get("node", f"$.{name}", "variant").alias("child"))
                for i, name in enumerate(("any", "all", "not"))
            ]
        )
        items = F.transform(
            listed, lambda x, i: F.struct(i.alias("slot"), F.lit(0).alias("neg"), x.alias("child"))
        )
        todo = (
            rest.withColumn("__b", F.explode(F.coalesce(items, branches)))
            .filter("__b.child IS NOT NULL")
            .select(
                key,
                F.concat("place", F.array(F.col("__b.slot"))).alias("place"),
                F.to_json("__b.child").alias("text"),
                (F.col("negations") + F.col("__b.neg")).alias("negations"),
            )
        )
        todo = settle(todo)
    return leaves


def parse_envelopes(docs: DataFrame, value: str = "value") -> DataFrame:
    """Policy documents, bare or wrapped, with their lists compiled for matching.

    Documents with an ``_error`` or no body are dropped; absent lists are empty, absent
    switches are off.
    """
    shape = f"STRUCT<envelope: STRUCT<{ENVELOPE_BODY}>, _error: STRING, {ENVELOPE_BODY}>"
    parsed = docs.withColumn("__d", F.from_json(value, shape))
    keep = [c for c in docs.columns if c != value]

    def part(name):
        return F.when(F.col("__d.envelope").isNotNull(), F.col(f"__d.envelope.{name}")).otherwise(F.col(f"__d.{name}"))

    broken = F.coalesce(F.get_json_object(value, "$.envelope._error"), F.col("__d._error"))
    body = parsed.filter(broken.isNull()).select(
        *keep, part("file_ops").alias("file_ops"), part("network").alias("network"), part("process").alias("process"),
    )
    body = body.filter("file_ops IS NOT NULL OR network IS NOT NULL OR process IS NOT NULL")
    return compile_envelopes(
        body.select(
            *keep,
            F.col("file_ops.read_paths").alias("read_paths"),
            F.col("file_ops.write_paths").alias("write_paths"),
            F.col("file_ops.delete_paths").alias("delete_paths"),
            F.col("network.allow_hosts").alias("allow_hosts"),
            F.col("process.allow_binaries").alias("allow_binaries"),
            F.col("network.allow_egress").alias("allow_egress"),
            F.col("process.allow_spawn").alias("allow_spawn"),
        )
    )


LISTS = ("read_paths", "write_paths", "delete_paths", "allow_hosts", "allow_binaries")


def compile_envelopes(policies: DataFrame, dialect: str = "shell") -> DataFrame:
    """Add one compiled expression per pattern list and one over all three path lists."""
    empty = F.array().cast("array<string>")
    df = policies
    for name in LISTS:
        df = df.withColumn(name, F.coalesce(F.col(name), empty))
    for name in ("allow_egress", "allow_spawn"):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    for name in LISTS:
        df = df.withColumn(f"{name}_re", globs.compile_list(F.col(name), dialect))
    every = F.concat("read_paths", "write_paths", "delete_paths")
    return df.withColumn("any_paths_re", globs.compile_list(every, dialect))


def read_pairs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON list of pair or key objects."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


@dataclass
class Corpus:
    """The tables of a capture tree, read lazily and keyed by session folder."""

    spark: SparkSession
    root: str

    def meta(self, limit: int | None = None) -> DataFrame:
        return read_meta(self.spark, self.root, limit)

    def _host(self, name: str) -> DataFrame:
        files = lines.read_lines(self.spark, self.root, name)
        return hostlog.parse_host_lines(files.withColumn("trace_id", lines.folder_of(F.col("file"))))

    def l3(self) -> DataFrame:
        return self._host("l3.jsonl")

    def l2ext(self) -> DataFrame:
        return self._host("l2ext.jsonl")

    def oracle_lines(self, glob: str = "*.strace*") -> DataFrame:
        files = lines.read_lines(self.spark, self.root, glob)
        return files.withColumn("session_dir", lines.folder_of(F.col("file")))

    def oracle(self) -> DataFrame:
        return strace.parse_oracle(self.oracle_lines())

    def transcript(self) -> DataFrame:
        return read_transcript(self.spark, self.root)

    def bare_host(self) -> dict[str, DataFrame]:
        """Metadata, host events and transcript: what a bare-host capture has."""
        return {"meta": self.meta(), "l3": self.l3(), "transcript": self.transcript()}

    def bundle(self) -> dict[str, DataFrame]:
        return {**self.bare_host(), "l2ext": self.l2ext(), "oracle": self.oracle()}
