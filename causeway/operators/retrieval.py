"""Evidence: nodes and text chunks, chunks and files, neighbours in a knowledge graph, ranked text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.naming import containing


def text_score(needle: Column, blob: Column) -> Column:
    """10 where blob holds the whole needle, and 1 for each token of it that blob holds; repeated tokens count again."""
    tokens = F.filter(F.split(F.translate(F.coalesce(needle, F.lit("")), "/-", "  "), r"\s+"), lambda t: t != "")
    found = F.aggregate(tokens, F.lit(0), lambda n, t: n + blob.contains(t).cast("int"))
    return F.when((needle != "") & blob.contains(needle), 10).otherwise(0) + found


#: Needles that one expression holds, more are answered in as many passes over the chunks; and that may be asked at once.
NEEDLES, MOST_NEEDLES = 64, 4096


def ranked_chunks(chunks: DataFrame, needles: DataFrame, limit: int = 10) -> DataFrame:
    """(query, chunk_id, score, rank): the best chunks (chunk_id, title, source, text, pos) for each of a stated set of
    needles (query, needle), ties in document order (T1). Needles are a report's few questions and come to the driver; more than MOST_NEEDLES are refused."""
    blob = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    asked, order = [(r["query"], r["needle"]) for r in needles.limit(MOST_NEEDLES + 1).collect()], Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    if len(asked) > MOST_NEEDLES:
        raise ValueError(f"more than {MOST_NEEDLES} needles")
    found = []
    for at in range(0, max(1, len(asked)), NEEDLES):
        scores = F.array(*(F.struct(F.lit(q).alias("query"), text_score(F.lit(n), F.col("blob")).alias("score")) for q, n in asked[at : at + NEEDLES]))
        hits = chunks.select("chunk_id", "pos", blob.alias("blob")).select("chunk_id", "pos", F.inline(scores)).filter("score > 0")
        found.append(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(limit, 10))))
    return reduce(DataFrame.unionByName, found).select("query", "chunk_id", "score", "rank")


# The names under which nodes, and entries of a graph's context, hold their evidence.
CHUNK_KEYS = ("evidence_chunk_ids", "source_chunk_ids", "chunk_ids", "chunks", "evidenceChunks", "sourceChunks")
GRAPH_CHUNK_KEYS = ("source_chunk_ids", "source_chunk_refs", "chunk_ids", "documents")


def _ids_under(v: Column, key: str, names: tuple[str, ...]) -> Column:
    """The ids that a value under a key gives: a list or one alone, of texts, numbers or objects with one of the names."""
    one = F.try_variant_get(v, f"$.{key}", "variant")
    many = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array(one))
    text = lambda x: F.trim(F.coalesce(*(S.present(F.try_variant_get(x, f"$.{n}", "string")) for n in names), F.when(~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)), F.try_variant_get(x, "$", "string")), F.lit("")))
    return F.transform(F.filter(many, lambda x: x.isNotNull()), text)


def chunk_ids(v: Column) -> Column:
    """All distinct chunk ids of a node (VARIANT), in order of its keys (P25)."""
    return S.distinct_values(F.concat(*(_ids_under(v, k, ("id", "chunk_id")) for k in CHUNK_KEYS)))


def graph_chunk_ids(v: Column) -> Column:
    """All distinct chunk ids of a graph's context (VARIANT with nodes and edges)."""
    entries = F.concat(*(F.coalesce(F.try_variant_get(v, f"$.{g}", "array<variant>"), F.array().cast("array<variant>")) for g in ("nodes", "edges")))
    of = lambda e: F.concat(*(_ids_under(e, k, ("chunk_uid", "chunk_id", "id")) for k in GRAPH_CHUNK_KEYS))
    return S.distinct_values(F.flatten(F.transform(entries, of)))


def edge_evidence(edges: DataFrame) -> DataFrame:
    """(tree_id, source, target, file_version_id, chunk_id): the documents of edges (tree_id, source, target, documents) once
    for each reference, the first of each, by number (A13, P17, P73). Parallel edges may be rows of their own.

    References are mostly different ones, so they are dealt by their keys before they are looked through: a task holds its share of the
    keys, in as many shares as the session's shuffles have, and not those of all that it has read."""
    each = edges.select("tree_id", "source", "target", F.posexplode("documents").alias("k", "d")).select("tree_id", "source", "target", "k", F.col("d.file_version_id").alias("file_version_id"), S.present(F.col("d.chunk_id")).alias("chunk_id"))
    keys, reference = ["tree_id", "source", "target", "key"], ["file_version_id", "chunk_id"]
    dealt = each.filter("chunk_id IS NOT NULL").withColumn("key", S.chunk_key(F.col("file_version_id"), F.col("chunk_id"))).repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys[1:])
    first = dealt.groupBy(*keys, *reference).agg(F.min("k").alias("k")).groupBy(*keys).agg(F.min(F.struct("k", *reference)).alias("d"))
    return first.select("tree_id", "source", "target", *(f"d.{c}" for c in reference))


def node_documents(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, documents): references of a node (documents: an array of structs with chunk_id or text), chunks by number before texts."""
    chunks = F.filter("documents", lambda d: S.present(d["chunk_id"]).isNotNull())
    texts = F.filter("documents", lambda d: S.present(d["chunk_id"]).isNull())
    number = F.array_sort(F.transform(chunks, lambda d: F.struct(d["chunk_id"].try_cast("double").alias("n"), d["chunk_id"].alias("chunk_id"))))
    return nodes.select("tree_id", "id", F.concat(F.transform(number, lambda d: d["chunk_id"]), F.transform(texts, lambda d: d["text"])).alias("documents"))


def named_in(chunks: DataFrame, names: list[str]) -> DataFrame:
    """chunks (chunk_id, source, chunk_name, file, doc_name, path) with the file_name of the first of a few names whose last part one of these
    holds; without one the first name, or a dash (J6)."""
    blob = F.lower(F.concat_ws(" ", "source", "chunk_name", "file", "doc_name", "path"))
    bases = [n.strip().replace("\\", "/").split("/")[-1].lower() for n in names]
    hit = [F.when(blob.contains(b), F.lit(n)) for n, b in zip(names, bases, strict=True) if b]
    return chunks.withColumn("file_name", F.coalesce(*hit, F.lit(names[0] if names else "—")))


def question_neighbours(edges: DataFrame, names: DataFrame, question: str) -> DataFrame:
    """`neighbours` of the first 80 characters of a question."""
    return neighbours(edges, names, [question.strip()[:80]])


def chunk_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks (chunk_id, file_id, file_version_id, doc_name) with the file_name of the file they belong to.

    By version, then by file, then by name, the first file of the best kind; where none matches, the first file's name
    or a dash. Three equality joins instead of one on alternatives.
    """
    tiers = (("file_version_id", "file_version_id"), ("file_id", "file_id"), ("doc_name", "name"))
    out = chunks
    for i, (mine, theirs) in enumerate(tiers):
        first = files.filter(S.present(F.col(theirs)).isNotNull()).groupBy(F.col(theirs).alias(mine)).agg(F.min_by("name", "pos").alias(f"_{i}"))
        out = out.join(first, mine, "left")
    default = files.agg(F.min_by("name", "pos").alias("_d"))
    out = out.join(F.broadcast(default), how="left")  # one row
    return out.select(*chunks.columns, F.coalesce("_0", "_1", "_2", "_d", F.lit("—")).alias("file_name"))


def node_evidence(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tree_id, id, chunk_id, text, matched_by): chunks that a node (source_chunk_ids) names."""
    named = nodes.select("tree_id", "id", F.explode(S.distinct_values(F.col("source_chunk_ids"))).alias("chunk_id"))
    return named.join(chunks.select("chunk_id", "text"), "chunk_id").select("tree_id", "id", "chunk_id", "text", F.lit("node").alias("matched_by"))


def evidence_with_fallback(nodes: DataFrame, chunks: DataFrame, neighbours: DataFrame) -> DataFrame:
    """As node_evidence; nodes without a chunk take those of their neighbours (tree_id, id, neighbour_chunk_id)."""
    own = node_evidence(nodes, chunks)
    left = neighbours.join(own.select("tree_id", "id").distinct(), ["tree_id", "id"], "left_anti")
    near = left.join(chunks.select(F.col("chunk_id").alias("neighbour_chunk_id"), "text"), "neighbour_chunk_id")
    return own.unionByName(near.select("tree_id", "id", F.col("neighbour_chunk_id").alias("chunk_id"), "text", F.lit("neighbour").alias("matched_by")))


def neighbours(edges: DataFrame, names: DataFrame, terms: list[str], most_terms: int = 8) -> DataFrame:
    """(id, neighbour, rel): edges (src, dst, rel) both ways, where one end's name (id, name) contains one of the terms."""
    terms = [t for t in terms if t][:most_terms]
    hit = F.array(*map(F.lit, terms)).cast("array<string>")
    matched = names.filter(F.exists(hit, lambda t: F.col("name").contains(t))).select("id")
    there = edges.join(matched.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "rel")
    back = edges.join(matched.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "rel")
    return there.unionByName(back).distinct()


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, rel_id, index, total): the place of each edge among those between the same two nodes."""
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.select("src", "dst", "rel_id", (F.row_number().over(pair.orderBy("rel_id")) - 1).cast("bigint").alias("index"), F.count("*").over(pair).alias("total"))


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the labels of both ends, or their ids."""
    label = lambda end: nodes.select("tree_id", F.col("id").alias(end), F.col("label").alias(f"{end}_name"))
    out = edges.join(label("source"), ["tree_id", "source"], "left").join(label("target"), ["tree_id", "target"], "left")
    return out.select(*edges.columns, F.coalesce("source_name", "source").alias("source_label"), F.coalesce("target_name", "target").alias("target_label"))


def best_match(nodes: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id): by id, then by equal label, then the shortest label that contains it.

    All three are equality joins, the last by an index of grams.
    """
    asked = needles.select("needle").distinct()
    rank = F.struct(F.length("label"), F.col("pos"))
    by_id = asked.join(nodes.select(F.col("id").alias("needle"), "id", "pos"), "needle").groupBy("needle").agg(F.min_by("id", "pos").alias("id"))
    left = asked.join(by_id, "needle", "left_anti")
    by_label = left.join(nodes.select(F.col("label").alias("needle"), "id", "pos"), "needle").groupBy("needle").agg(F.min_by("id", "pos").alias("id"))
    left = left.join(by_label, "needle", "left_anti")
    pairs = containing(left.select(F.col("needle").alias("name")), nodes.select("label"), [])
    inside = pairs.join(nodes.select("label", "id", "pos"), "label").groupBy(F.col("name").alias("needle")).agg(F.min_by("id", rank).alias("id"))
    return by_id.unionByName(by_label).unionByName(inside)


def overlay_items(events: DataFrame, most: int = 4) -> DataFrame:
    """(tree_id, id, parent, kind, label): up to `most` readable items of an event's maintenance text as nodes."""
    items = F.slice(S.readable_items(F.col("investigate")), 1, most)
    found = events.select("tree_id", "id", F.posexplode(items).alias("k", "label"))
    return found.select("tree_id", F.concat("id", F.lit("-maintenance-"), F.col("k") + 1).alias("id"), F.col("id").alias("parent"), F.lit("maintenance").alias("kind"), "label")
