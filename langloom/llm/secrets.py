"""Secret scans by a trigram inverted index, with DataFrame operations only.

Each rule's regex is turned into a Boolean query of trigrams that any match must contain. An inverted index
(trigram -> documents) over all texts, folded to lower case, answers the queries: postings are intersected
per alternative and united per rule. Only the candidates are verified with the rule's regex; a rule
without mandatory trigrams scans every text.

The index holds the postings of the trigrams that some rule's query names (no other can be looked up), each as
a sorted list of documents in segments of ``SEGMENT`` ids, so that no posting list meets in one task.

Spans are code points, end exclusive. Null and empty texts have none. Repeated rows each get their spans. Rows
with a null doc_id are found too, as candidates of every rule. Kept columns may have any names (see ``common``). A very
long text is one string to the JVM's regular expressions, and costs its matches beside itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom.llm.common import Workspace, beside, numbered, quoted, table

SEGMENT = 4096
#: Candidates are broadcast up to so many rows (a doc_id and a rule mask each), else both sides are shuffled.
BROADCAST_ROWS = 500_000
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind; a Java and Python regex; the group whose length counts and the least length of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base rules, in the order in which equal starts are listed; the others follow.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def _exact(parsed) -> list[tuple[set[str] | None]]:
    """The sequence as parts: a small set of strings, one of which must be there, or None for anything."""
    parts: list[set[str] | None] = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            parts.append({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            parts.extend(_exact(arg[3]))
        elif op is sre.BRANCH:
            union: set[str] | None = set()
            for way in arg[1]:
                inner = _join(_exact(way))
                union = None if union is None or len(inner) != 1 or inner[0] is None else union | inner[0]
            parts.append(union)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = _join(_exact(body))
            one = inner[0] if len(inner) == 1 else None
            if one is not None and (low, high) == (0, 1):
                parts.append({"", *one})
            elif one is not None and 1 <= low <= 8:
                parts.extend([one] * low)
                if high != low:
                    parts.append(None)
            else:
                parts.extend([None] if low == 0 else [*_exact(body), None])
        else:
            parts.append(None)
    return parts


def _join(parts: list[set[str] | None]) -> list[set[str] | None]:
    """Neighbouring sets multiplied out as long as they stay small."""
    out: list[set[str] | None] = []
    for p in parts:
        if p is not None and out and out[-1] is not None and len(out[-1]) * len(p) <= MOST_STRINGS:
            out[-1] = {a + b for a in out[-1] for b in p}
        else:
            out.append(p)
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs: for each mandatory part, the alternatives, each with the trigrams it needs.

    Folded to lower case (ASCII). Empty if the regex has no mandatory trigram.
    """
    query = []
    for part in _join(_exact(sre_parse.parse(pattern))):
        if part and all(len(s) >= 3 for s in part):
            ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in part}
            query.append(sorted(sorted(w) for w in ways if not any(x < w for x in ways)))
    return query


def build_index(docs: DataFrame, trigrams: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(trigram, segment, docs): the inverted index of ``trigrams`` over every text.

    A row of ``docs`` is known by its doc_id; repeated ids share a posting.
    """
    folded = F.lower(F.col(quoted(text_col)).cast("string"))  # maps more than A-Z, which can only add candidates
    present = F.array_compact(F.array(*[F.when(F.contains("__folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    seen = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("doc_id"), folded.alias("__folded"))
    postings = seen.select("doc_id", F.explode(present).alias("trigram"))
    segment = F.floor(F.col("doc_id") / SEGMENT)
    return postings.groupBy("trigram", segment.alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))


def search(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): for each document that may match, the numbers of those rules as a bit mask.

    Posting lists are intersected segment by segment.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    needed = sorted({t for q in queries.values() for part in q for way in part for t in way})
    if not needed:
        return index.selectExpr("docs[0] AS doc_id", "0L AS rules").limit(0)
    empty = F.array().cast("array<bigint>")
    lists = index.groupBy("segment").pivot("trigram", needed).agg(F.first("docs"))

    def both(ways: list[Column], how) -> Column:
        return reduce(how, ways)

    found = []
    for i, query in queries.items():
        if query:
            parts = [both([both([F.coalesce(F.col(quoted(t)), empty) for t in way], F.array_intersect) for way in part], F.array_union) for part in query]
            found.append(lists.select(F.explode(both(parts, F.array_intersect)).alias("doc_id"), F.lit(1 << i).cast("long").alias("rule")))
    return reduce(DataFrame.unionAll, found).groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,order,kind,end>> of a rule's leftmost non-overlapping matches that are long enough.

    The text is split at the matches; the pieces' lengths give the places.
    """
    lengths = F.transform(F.split(text, F.lit(rule.pattern), -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(matches, F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else sizes
    rows = F.arrays_zip(F.slice(lengths, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), counted.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["part"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step)["out"]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``keep`` columns (all by default; a null text as an empty one) plus ``spans_<kind>`` array<struct<start,end>> for each rule."""
    spark = docs.sparkSession
    work = Workspace(spark, "secrets")
    queries = [trigram_query(r.pattern) for r in rules]
    needed = sorted({t for q in queries for part in q for way in part for t in way})
    keep = docs.columns if keep is None else keep
    names = beside(keep, [f"spans_{r.kind}" for r in rules])
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep) if c != text_col], F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("__text"), F.col(quoted(id_col)).alias("__id"))
    if needed:
        index = work.keep(build_index(docs, needed, text_col, id_col), "index")
        candidates = work.keep(search(index, rules), "candidates")
        few = candidates.count() <= BROADCAST_ROWS
        found = candidates.select(F.col("doc_id").alias("__c"), F.col("rules").alias("__r"))
        rows = rows.join(F.broadcast(found) if few else found.hint("shuffle_hash"), F.col("__id") == F.col("__c"), "left")
    else:
        rows = rows.withColumn("__r", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = [F.col(f"c{i}" if c != text_col else "__text").alias(n) for i, (c, n) in enumerate(zip(keep, names, strict=True))]
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        text = F.col("__text")
        maybe = F.expr(f"__id IS NULL OR (coalesce(__r, 0L) & {1 << i}L) <> 0") if query else F.lit(True)
        out.append(F.when(maybe & F.regexp_like(text, F.lit(rule.pattern)), _spans(text, rule)).otherwise(none).alias(f"spans_{rule.kind}"))
    return rows.select(*out)


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the kinds' spans by start, then in the order of ``kinds``, comma-joined."""

    def tagged(order: int, kind: str) -> Column:
        return F.transform(F.col(f"spans_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*[tagged(i, k) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span of a rule replaced by ``mask``; spans that overlap get one. Null texts stay null."""
    frame, own = numbered(docs, {"text": text_col, "doc_id": id_col})
    found = find_secrets(frame.withColumn("none", F.col("text").isNull()), rules)
    every = F.array_sort(F.concat(*[F.col(f"spans_{r.kind}") for r in rules]))
    text, start = F.col("text"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["at"]
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        grown = F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, F.lit(mask))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

    done = F.aggregate(F.col("every"), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.col("none"), F.lit(None)).when(F.size("every") > 0, done).otherwise(text)
    return found.withColumn("every", every).select(*[clean.alias(c) if c == text_col else o for c, o in zip(docs.columns, own, strict=True)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(list(BASE)).cast("binary"), 256).alias("base_sha256"),
        listed([r.kind for r in RULES]).alias("spans"),
    )
