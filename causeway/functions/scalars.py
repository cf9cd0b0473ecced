"""Column functions for codes, labels, probabilities, rules, references and progress.

All are built-in expressions: they stay in the JVM, can be pushed down and compiled with what is around
them. A value "is missing" where it is null or the empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event and gate codes, and their names in documents.
TYPE_CODES = {"1": "top", "2": "intermediate", "3": "basic"}
TYPE_NAMES = {
    "top": "top", "top_event": "top", "top event": "top", "顶事件": "top",
    "intermediate": "intermediate", "intermediate_event": "intermediate", "intermediate event": "intermediate", "中间事件": "intermediate",
    "basic": "basic", "basic_event": "basic", "basic event": "basic", "底事件": "basic",
}
GATE_CODES = {"1": "AND", "2": "OR"}
GATE_NAMES = {"and": "AND", "or": "OR", "与": "AND", "或": "OR"}
PROBABILITY_CUTS = (0.01, 0.2, 0.4, 0.6)
INEQUALITIES = (">", ">=", "<", "<=")


def present(x: Column) -> Column:
    """x, or null where it is missing."""
    return F.nullif(x, F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns))


def _lookup(x: Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(table[x], F.lit(default))


def _code(x: Column) -> Column:
    """A number as its shortest decimal text ("2.0" and " 2 " become "2"); other texts give null."""
    number = F.trim(x).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint").cast("string"))


def event_type(x: Column) -> Column:
    """Type code or name of a scanned node (P1); unknown ones are "event"."""
    text = F.lower(F.trim(x))
    named = F.when(text.endswith("_event"), F.regexp_replace(text, "_event$", ""))
    return F.when(named.isin(*TYPE_CODES.values()), named).otherwise(_lookup(F.coalesce(_code(x), F.lit("")), TYPE_CODES, "event"))


def gate_label(x: Column) -> Column:
    """Gate code or name of a scanned node (P2); unknown ones are ""."""
    text = F.upper(F.trim(x))
    return F.when(text.isin("AND", "OR"), text).otherwise(_lookup(F.coalesce(_code(x), F.lit("")), GATE_CODES, ""))


def node_type(x: Column) -> Column:
    """Node type as an edit plan names it (P3); unknown ones are ""."""
    text = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return _lookup(text, TYPE_NAMES | TYPE_CODES, "")


def gate_type(x: Column) -> Column:
    """Gate as an edit plan names it (P4); unknown ones are ""."""
    return _lookup(F.lower(F.trim(F.coalesce(x, F.lit("")))), GATE_NAMES, "")


def gate_in_style(current: Column, wanted: Column) -> Column:
    """A gate label written as the document writes gates: as a code or as a label."""
    code = F.when(wanted == "AND", "1").otherwise("2")
    return F.when(F.trim(current).isin("1", "2"), code).otherwise(wanted)


def type_in_style(current: Column, wanted: Column) -> Column:
    """A node type written as the document writes types."""
    code = _lookup(wanted, {v: k for k, v in TYPE_CODES.items()}, "")
    return F.when(current.endswith("_event"), F.concat(wanted, F.lit("_event"))).when(F.trim(current).isin(*TYPE_CODES), code).otherwise(wanted)


def probability(x: Column) -> Column:
    """The number at the front of a text, thousands commas removed; null where there is none."""
    plain = F.regexp_replace(F.trim(x), ",", "")
    return present(F.regexp_extract(plain, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)).try_cast("double")


def probability_class(p: Column) -> Column:
    """p0 for the unknown and what is no probability or below the first cut, then p1 to p4."""
    out = F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), "p0")
    for i, cut in enumerate(PROBABILITY_CUTS):
        out = out.when(p < cut, f"p{i}")
    return out.otherwise(f"p{len(PROBABILITY_CUTS)}")


def severity_class(x: Column) -> Column:
    """(P10)"""
    text = F.trim(x)
    return F.when(text == "高", "severe").when(text == "中", "moderate").otherwise("mild")


def wrapped_label(x: Column, width: int = 4, most: int = 16) -> Column:
    """A label cut to `most` signs and broken into lines of `width`."""
    short = F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)
    lines = F.transform(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1)), F.lit(width)), lambda i: short.substr(i, F.lit(width)))
    return F.array_join(lines, "\n")


def threshold_text(thresholds: Column, symbol: Column) -> Column:
    """Thresholds as one text; -x and x with an inequality are x."""
    texts = F.filter(F.transform(thresholds, lambda t: F.trim(t)), lambda t: t != "")
    a, b = (F.try_element_at(texts, F.lit(i)).try_cast("double") for i in (1, 2))
    symmetric = (F.size(texts) == 2) & (F.abs(a) == F.abs(b)) & (a != 0) & F.trim(symbol).isin(*INEQUALITIES)
    number = F.regexp_replace(F.abs(a).cast("string"), r"\.0$", "")
    return F.when(texts.isNull(), "").when(F.coalesce(symmetric, F.lit(False)), number).otherwise(F.array_join(texts, "、"))


def rule_text(rule: Column) -> Column:
    """A trigger rule (struct with deviceTypeId, measurePointName, symbol, thresholds, duration) as a sentence."""
    part = lambda c: F.trim(F.coalesce(rule[c], F.lit("")))
    measure, symbol, device, duration = (part(c) for c in ("measurePointName", "symbol", "deviceTypeId", "duration"))
    limits = threshold_text(rule["thresholds"], symbol)
    core = (
        F.when((measure != "") & (limits != "") & (symbol == ""), F.concat(measure, F.lit(" 为 "), limits))
        .when((measure != "") | (limits != ""), F.concat_ws(" ", present(measure), present(symbol), present(limits)))
        .otherwise(F.to_json(rule))
    )
    sentence = F.concat(F.when(device != "", F.concat(F.lit("["), device, F.lit("] "))).otherwise(""), core)
    return F.when(rule.isNull(), "（空）").when((measure == "") & (limits == ""), core).otherwise(F.concat_ws("，", sentence, present(duration)))


def rules_text(rules: Column) -> Column:
    """(P14)"""
    return F.array_join(F.filter(F.transform(rules, rule_text), lambda t: t != ""), "；")


def readable_items(x: Column) -> Column:
    """(P16)"""
    return F.filter(F.transform(F.split(x, "[；;\n\r]+"), lambda t: F.trim(t)), lambda t: t != "")


def chunk_key(file_version_id: Column, chunk_id: Column) -> Column:
    """(P17)"""
    version = F.coalesce(F.trim(file_version_id), F.lit(""))
    return F.when(version != "", F.concat(version, F.lit("::"), F.trim(chunk_id))).otherwise(F.trim(chunk_id))


def object_reference(x: Column) -> Column:
    """(P19)"""
    return present(F.regexp_extract(x, r"\[Ref:\s*(Object_\d+)\]\s*$", 1))


def first_text(columns: list[Column], limit: int) -> Column:
    """(P20, P5, P28)"""
    return F.substring(F.coalesce(*(present(F.trim(c)) for c in columns), F.lit("")), 1, limit)


def distinct_values(values: Column, limit: int | None = None) -> Column:
    """(P21, P46, P79): trimmed, present and distinct, in order; with a limit the first of these."""
    found = F.array_distinct(F.filter(F.transform(values, lambda t: F.trim(t)), lambda v: v != ""))
    return found if limit is None else F.slice(found, 1, limit)


def version_candidates(file_id: Column) -> Column:
    """(P27)"""
    text = F.trim(file_id)
    return F.array_distinct(F.array(text, F.when(text.rlike(r"_v\d+$"), text).otherwise(F.concat(text, F.lit("_v1")))))


# Words that a question drops, and endings that it may lack.
QUESTION_WORDS = ("当前", "画布", "故障树", "知识库", "来源依据", "来源", "依据", "节点", "事件", "是什么", "什么")
QUESTION_ENDINGS = ("失效", "故障", "异常", "损坏", "无响应")
_SIGNS = "[\\s“”\"'`，。？！；：:;,.!?]+"


def query_terms(question: Column, limit: int = 12) -> Column:
    """A question, what is left without its fixed words and endings, and its part before a bracket."""
    compact = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), QUESTION_WORDS, F.trim(question))
    terms = [F.trim(question), compact]
    for ending in QUESTION_ENDINGS:
        terms += [F.regexp_replace(compact, f"{ending}$", ""), F.replace(compact, F.lit(ending), F.lit(""))]
    before, inside = (F.regexp_extract(compact, r"^([^（(]*)[（(]([^）)]*)[）)]", i) for i in (1, 2))
    some = compact.rlike(r"^[^（(]*[（(][^）)]*[）)]")
    terms += [F.when(some, before), F.when(some, F.concat(before, F.lit("（"), inside, F.lit("）"))), F.when(some, F.concat(before, F.lit(" ("), inside, F.lit(")")))]
    clean = [F.regexp_replace(F.regexp_replace(t, f"^{_SIGNS}", ""), f"{_SIGNS}$", "") for t in terms]
    return F.slice(F.array_distinct(F.filter(F.array(*clean), lambda t: t.isNotNull() & (t != ""))), 1, limit)


def job_progress(status: Column, progress: Column) -> Column:
    """Percent of a task: done is 100, failed 0, else 8 to 98."""
    return F.when(status.isin("completed", "success", "done"), 100).when(status.isin("failed", "cancelled"), 0).otherwise(F.greatest(F.lit(8), F.least(F.lit(98), F.round(F.coalesce(progress, F.lit(0))).cast("int"))))


def job_state(status: Column) -> Column:
    """(P33)"""
    text = F.lower(F.trim(status))
    return F.when(text.isin("success", "completed", "done"), "done").when(text.isin("failed", "error", "cancelled"), "failed").otherwise("processing")


def file_category(name: Column) -> Column:
    """Where an uploaded file belongs, by ending and word."""
    text = F.lower(name)
    return F.when(text.endswith(".docx") | text.endswith(".pdf"), "document").when((text.endswith(".xlsx") | text.endswith(".csv")) & text.contains("维修"), "maintenance").when(text.endswith(".xlsx") | text.endswith(".csv"), "work_order").otherwise("document")


def node_kind(labels: Column, entity_type: Column) -> Column:
    """(P41)"""
    has = lambda x: F.array_contains(F.transform(labels, lambda t: F.lower(t)), x)
    return F.when(has("gate"), "gate").when(has("chunk"), "chunk").when(has("entity"), F.concat(F.lit("entity:"), F.coalesce(present(entity_type), F.lit("unknown")))).otherwise(F.coalesce(F.lower(F.try_element_at(labels, F.lit(1))), F.lit("node")))


def same_undirected(s: Column, t: Column, a: Column, b: Column) -> Column:
    """(F16)"""
    return (F.least(s, t) == F.least(a, b)) & (F.greatest(s, t) == F.greatest(a, b))


def overlap_area(a: Column, b: Column) -> Column:
    """Common area of two boxes (structs x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


# The multiplier and the modulus of the generator.
RANDOM_FACTOR, RANDOM_MODULUS = 48271, 2147483647


def seeded_random(seed: Column, n: Column) -> Column:
    """The n-th draw (from 1, up to 2^31) of the generator that starts at seed: x -> 48271 x mod 2^31 - 1, divided by the modulus.

    By squaring: factors for 1, 2, 4, ... draws at once are multiplied as the bits of n say, so any draw of any row is reckoned by itself.
    """
    x, factor = F.pmod(seed.cast("long"), F.lit(RANDOM_MODULUS)) + 1, RANDOM_FACTOR
    for bit in range(31):
        x = x * F.when(F.shiftright(n.cast("long"), bit).bitwiseAND(F.lit(1)) == 1, factor).otherwise(1) % RANDOM_MODULUS
        factor = factor * factor % RANDOM_MODULUS
    return x / F.lit(float(RANDOM_MODULUS))
