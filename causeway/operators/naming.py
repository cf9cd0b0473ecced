"""Names: which labels contain a name, by an index of their n-grams, and ids that are not taken yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.storage import stored

#: Characters of a gram; shorter names are grams themselves.
GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct stretches of `size` characters of a text that has as many."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, size)))


def containing(names: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, name, label): the distinct pairs of names (*keys, name) and labels (*keys, label) with equal keys, where the label contains the name.

    A name is looked up by the one of its grams that the fewest labels have, an equality join on (*keys, gram); what this finds is then held against the whole name.
    Names with a gram that no label has are out at once. Empty names and labels are in no pair.
    """
    names = names.filter(F.length("name") > 0).select(*keys, "name").distinct()
    labels = labels.filter(F.length("label") > 0).select(*keys, "label").distinct()
    asked = names.select(*keys, "name", F.explode(_grams(F.col("name"), F.least(F.length("name"), F.lit(GRAM)))).alias("gram"))
    sizes = F.concat(*(F.when(F.length("label") >= n, _grams(F.col("label"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)))
    wanted = asked.select(*keys, "gram").distinct()
    index = labels.select(*keys, "label", F.explode(sizes).alias("gram")).join(wanted, [*keys, "gram"], "left_semi")
    many = index.groupBy(*keys, "gram").agg(F.count("*").alias("many"))
    rarest = asked.join(many, [*keys, "gram"], "left").groupBy(*keys, "name").agg(F.min_by("gram", F.struct(F.coalesce("many", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, [*keys, "gram"]).filter(F.col("label").contains(F.col("name"))).select(*keys, "name", "label")


# How texts call the types of events; the first that a text has counts.
TYPE_NAMES = (
    ("basic", ("底事件", "basic event", "basic_event")),
    ("intermediate", ("中间事件", "intermediate event", "intermediate_event")),
    ("top", ("顶事件", "top event", "top_event")),
)


def mentioned_type(text: Column) -> Column:
    """The event type that a text speaks of, or null."""
    low = F.lower(text)
    found = [F.when(F.greatest(*(F.coalesce(low.contains(name), F.lit(False)) for name in names)), kind) for kind, names in TYPE_NAMES]
    return F.coalesce(*found)


# The fields of a decision that name a node, and what shows that a message speaks of one.
QUERY_FIELDS = ("node_label", "node_name", "target_node", "target_label", "event_name")
QUERY_MARKS = ("节点", "事件", "“", "「", '"')


def node_query(message: Column, decision: Column, top_event: Column) -> Column:
    """What a request asks for (P63): the node that the decision (VARIANT) names, itself or in its requirements; else the message, where it speaks of a node; else
    the tree's top event, or the message."""
    named = [S.present(F.trim(F.try_variant_get(decision, f"{place}.{field}", "string"))) for place in ("$", "$.requirements") for field in QUERY_FIELDS]
    text = F.trim(F.coalesce(message, F.lit("")))
    speaks = F.greatest(*(text.contains(m) for m in QUERY_MARKS))
    return F.coalesce(*named, F.when(speaks, text), S.present(F.trim(top_event)), text)


def fresh_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (tree_id, base, pos) with `id`: base for the first of its tree, where that is free, then base-1, base-2 and so on, leaving out those in taken (tree_id, id).

    All at once: the k-th free number is k plus how many taken ones lie below it. A taken number with f free ones under it lies below all wanted places k >= f, so
    both are put in one order and counted, in stretches of `1 << 16` places, whose counts are added up first; no base is gone through as a whole by one task.
    """
    parts = F.regexp_extract("id", r"^(.*)-([1-9][0-9]{0,17})$", 2)
    numbered = taken.select("tree_id", "id", parts.alias("n")).select(
        "tree_id", F.when(F.col("n") != "", F.expr("substring(id, 1, length(id) - length(n) - 1)")).alias("base"), F.expr("try_cast(n AS long)").alias("n"), "id"
    )
    bases = wanted.select("tree_id", "base").distinct()
    bare = taken.select("tree_id", F.col("id").alias("base"), F.lit(0).cast("long").alias("n")).join(bases, ["tree_id", "base"], "left_semi")
    used = numbered.filter("base IS NOT NULL").select("tree_id", "base", "n").join(bases, ["tree_id", "base"], "left_semi").unionByName(bare).distinct()
    keys = ["tree_id", "base"]
    free_below = ranked(used, keys, ["n"], "i").select(*keys, (F.col("n") - F.col("i")).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("pos"))
    places = ranked(wanted.select(*keys, "pos"), keys, ["pos"], "k").select(*keys, F.col("k").alias("at"), F.lit(1).alias("asks"), "pos")
    both = free_below.unionByName(places).withColumn("stretch", F.shiftright("at", 16))
    sums = both.groupBy(*keys, "stretch").agg(F.sum(1 - F.col("asks")).alias("own"))
    before = sums.select(*keys, "stretch", (F.sum("own").over(Window.partitionBy(*keys).orderBy("stretch")) - F.col("own")).alias("before"))
    inside = F.sum(1 - F.col("asks")).over(Window.partitionBy(*keys, "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("inside", inside).filter("asks = 1").join(before, [*keys, "stretch"]).select(*keys, "pos", (F.col("at") + F.col("before") + F.col("inside")).alias("n"))
    return found.select(*keys, "pos", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("id"))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with its rank from 0 within equal keys, by `order` (distinct within a key).

    Rows are dealt by ranges of (keys, order), numbered within a range, and each range starts where the ones before it end: a key with very many
    rows is spread over many tasks.
    """
    cut = stored(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    own = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)))
    sizes = cut.groupBy(*keys, "_p").agg(F.count("*").alias("_many"))
    starts = sizes.withColumn("_start", F.sum("_many").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_many")).drop("_many")
    return own.join(starts, [*keys, "_p"]).withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_p", "_n", "_start")
