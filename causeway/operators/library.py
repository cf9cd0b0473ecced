"""What a project holds beside its trees: versions, chunks, files, sessions, projects and drafts; listings and edits of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S


def clamped(n: int, most: int) -> int:
    return max(1, min(n, most))


# Versions.


def history(versions: DataFrame) -> DataFrame:
    """Versions (tree_id, version, payload, ...) without their payload, with `place` (1 is the newest) and is_historical."""
    newest = Window.partitionBy("tree_id").orderBy(F.desc("version"))
    place = F.row_number().over(newest)
    return versions.drop("payload").withColumn("place", place).withColumn("is_historical", F.col("place") > 1)


def at_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of versions that wanted (tree_id, version) names."""
    return versions.join(wanted.select("tree_id", "version").distinct(), ["tree_id", "version"], "left_semi")


def version_options(versions: DataFrame, current: DataFrame) -> DataFrame:
    """(tree_id, version) to choose from: of each tree of `current` (tree_id, version) its versions, or the current one alone."""
    known = versions.select("tree_id", "version").join(current.select("tree_id"), "tree_id", "left_semi")
    return known.unionByName(current.select("tree_id", "version").join(known.select("tree_id"), "tree_id", "left_anti"))


# Chunks and files.


def listed_chunks(chunks: DataFrame, *, file_names: Sequence[str] = (), version_ids: Sequence[str] = (), limit: int = 1000, order: Column | None = None) -> DataFrame:
    """At most `limit` (1 to 1,000) chunks (file_name, file_version_id, ...) of the files or versions, of all where none are named, in order."""
    named = F.lit(not file_names and not version_ids)
    if file_names:
        named = named | F.col("file_name").isin(*file_names)
    if version_ids:
        named = named | F.col("file_version_id").isin(*version_ids)
    return chunks.filter(named).orderBy(order if order is not None else F.col("pos")).limit(clamped(limit, 1000))


def chunk_details(chunks: DataFrame, wanted: DataFrame, most: int = 1200) -> DataFrame:
    """The chunks that wanted (chunk_id, file_version_id or null for any) names, their text bounded for display."""
    any_, own = wanted.filter("file_version_id IS NULL").select("chunk_id").distinct(), wanted.filter("file_version_id IS NOT NULL").distinct()
    found = chunks.join(any_, "chunk_id", "left_semi").unionByName(chunks.join(own, ["chunk_id", "file_version_id"], "left_semi").select(*chunks.columns)).distinct()
    return found.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, most))


def root_candidates(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """At most `limit` (1 to 30) top events (id, label, type, pos) in document order."""
    return nodes.filter("type = 'top'").orderBy("pos").limit(clamped(limit, 30))


def eligible_files(files: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Files (id, file_version_id, import_complete, status) that have a version and are imported; of the allowed (id) where these are given."""
    ready = files.filter((F.trim(F.coalesce("file_version_id", F.lit(""))) != "") & (F.coalesce("import_complete", F.lit(False)) | (F.col("status") == "done")))
    return ready if allowed is None else ready.join(allowed.select("id").distinct(), "id", "left_semi")


def selected_versions(eligible: DataFrame, selection: DataFrame) -> DataFrame:
    """(file_version_id, pos): versions of the selection (id, pos), each at its first place (F2)."""
    return selection.join(eligible.select("id", F.trim("file_version_id").alias("file_version_id")), "id").groupBy("file_version_id").agg(F.min("pos").alias("pos"))


def batch_scope(files: DataFrame) -> DataFrame:
    """(file_version_id, pos): versions of files (status, include, file_version_id, pos) that are done and not excluded."""
    own = files.filter((F.col("status") == "done") & F.coalesce("include", F.lit(True))).select(S.present(F.trim("file_version_id")).alias("file_version_id"), "pos")
    return own.filter("file_version_id IS NOT NULL").groupBy("file_version_id").agg(F.min("pos").alias("pos"))


def deleted_files(files: DataFrame, links: DataFrame, doomed: DataFrame, epoch: Column) -> tuple[DataFrame, DataFrame]:
    """files (id, ...) and links (id, ...) without those of `doomed` (id), and the epoch one on."""
    gone = doomed.select("id").distinct()
    return files.join(gone, "id", "left_anti").withColumn("epoch", epoch + 1), links.join(gone, "id", "left_anti")


def failed_imports(files: DataFrame, failures: DataFrame) -> DataFrame:
    """files (id, status, error, ...) with those of failures (id, error) marked, but for what is imported already."""
    marked = files.drop("error").join(failures.groupBy("id").agg(F.max("error").alias("error")), "id", "left")
    hit = F.col("error").isNotNull() & (F.col("status") != "done")
    return marked.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("error", F.when(hit, F.col("error")))


# Sessions.


def session(memory: DataFrame, messages: DataFrame, pending: DataFrame, wanted: DataFrame, *, tail: int = 40) -> DataFrame:
    """(session_id, memory, n_messages, last_messages, n_pending) of each wanted session (S7, S33, M30): its last `tail` messages (pos, content), and what waits."""
    own = lambda df: df.join(wanted.select("session_id").distinct(), "session_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos")))
    told = own(messages).withColumn("_n", place).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= tail, F.struct("pos", "content")))), lambda x: x["content"]), "|").alias("last_messages"))
    open_ = own(pending).filter("status = 'waiting'").groupBy("session_id").agg(F.count("*").alias("n_pending"))
    return wanted.select("session_id").distinct().join(memory.select("session_id", "memory"), "session_id", "left").join(told, "session_id", "left").join(open_, "session_id", "left").fillna(0, ["n_messages", "n_pending"])


def rolled_back_to(messages: DataFrame, snapshots: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (session_id, pos, message_id, role) before each wanted user message (session_id, message_id), and the newest snapshot (session_id, pos, ...) taken before it."""
    cut = messages.filter("role = 'user'").join(wanted.select("session_id", "message_id"), ["session_id", "message_id"]).groupBy("session_id").agg(F.min("pos").alias("cut"))
    left = messages.join(cut, "session_id", "left").filter("cut IS NULL OR pos < cut").select(*messages.columns)
    rest = [c for c in snapshots.columns if c != "session_id"]
    last = snapshots.join(cut, "session_id").filter("pos < cut").groupBy("session_id").agg(F.max_by(F.struct(*rest), "pos").alias("s")).select("session_id", "s.*")
    return left, last


# Projects and drafts.

# What a project that nobody named is called.
BLANK = "空白项目"


def next_blank(projects: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, name) of the next blank project: one more than the largest number that one has."""
    number = S.present(F.regexp_extract("name", f"^{BLANK}(\\d+)$", 1)).try_cast("int")
    return projects.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n")).select(*by, F.concat(F.lit(BLANK), F.col("n").cast("string")).alias("name"))


def edited_projects(projects: DataFrame, edits: DataFrame) -> DataFrame:
    """projects (id, name, reviewed) after edits (id, name, reviewed, deleted): null leaves as it was."""
    e = edits.select("id", F.col("name").alias("_name"), F.col("reviewed").alias("_reviewed"), F.coalesce("deleted", F.lit(False)).alias("_gone"))
    out = projects.join(e, "id", "left").filter("_gone IS NULL OR NOT _gone")
    return out.withColumn("name", F.coalesce("_name", "name")).withColumn("reviewed", F.coalesce("_reviewed", "reviewed")).select(*projects.columns)


def ensured(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """projects, and those of `wanted` whose id is not among them."""
    return projects.unionByName(wanted.join(projects.select("id"), "id", "left_anti").select(*projects.columns))


def recent_drafts(drafts: DataFrame, messages: DataFrame) -> DataFrame:
    """drafts (draft_id, title, updated_at) with last_at: their last message's time, or when they were changed."""
    at = F.col("at").try_cast("double")
    last = messages.groupBy("draft_id").agg(F.max(F.when(at > 0, at)).alias("last_message_at"))
    return drafts.join(last, "draft_id", "left").withColumn("last_at", F.coalesce("last_message_at", F.col("updated_at").cast("double"), F.lit(0.0)))


def drafts_of_items(items: DataFrame, versions: DataFrame) -> DataFrame:
    """(item_id, payload): finished items (item_id, tree_id, version, payload, status) with their own payload, or that of the version they name."""
    done = items.filter("status = 'success'").withColumnRenamed("payload", "_own")
    return done.join(versions.select("tree_id", "version", "payload"), ["tree_id", "version"], "left").select("item_id", F.coalesce("_own", "payload").alias("payload"))


def parsed_drafts(drafts: DataFrame) -> DataFrame:
    """(draft_id, title, updated_at) of drafts (draft_id, document): JSON that is bad is an empty draft (S29, S30, P51): its first top event
    names it."""
    v = drafts.select("draft_id", F.try_parse_json("document").alias("v"))
    nodes = F.coalesce(F.try_variant_get("v", "$.nodes", "array<struct<type:string,label:string>>"), F.array().cast("array<struct<type:string,label:string>>"))
    top = F.try_element_at(F.filter(nodes, lambda n: (n["type"] == "top") & (F.trim(n["label"]) != "")), F.lit(1))["label"]
    return v.select("draft_id", F.coalesce(S.present(F.trim(F.try_variant_get("v", "$.title", "string"))), F.trim(top), F.lit("空白画布")).alias("title"), F.coalesce(F.try_variant_get("v", "$.updatedAt", "double"), F.lit(0.0)).alias("updated_at"))


def stale(current: DataFrame, kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, is_stale): whether the signature kept (*by, signature) is another than the current one; without one nothing is stale."""
    old = kept.select(*by, F.col("signature").alias("_kept"))
    return current.join(old, list(by), "left").select(*by, F.coalesce(F.col("_kept") != F.col("signature"), F.lit(False)).alias("is_stale"))
