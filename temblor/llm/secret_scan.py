"""Operator 8: secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
an OR of clauses, each a set of trigrams that a match must contain.  Postings
(trigram, row) are kept for the trigrams that occur in some query; a clause's
postings are intersected, and the rows of any clause of a rule are its
candidates, which the expression then verifies.  A rule without mandatory
trigrams scans all rows.  Trigrams are those of the lower-cased text, so that
they hold for either case.

All steps are DataFrame functions.  Candidates are broadcast only if they are
few (``BROADCAST_ROWS``), else joined by a shuffle.

Spans are code points, the end exclusive, leftmost and non-overlapping for each
kind.  Defined results: null and empty texts have no spans; a text of any
length is scanned whole, its matches are rows and not one array; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import row_keys, stored

BROADCAST_ROWS = 500_000
#: An alternative with more strings than this is not spelled out.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` characters, else the match is dropped (after it was consumed)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, base=True),
    # A run shorter than the least length holds no longer one, so the length can stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which is in every match; None if nothing is mandatory."""

    def trigrams(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def both(a, b):  # AND of two ORs of clauses; None is true
        if a is None or b is None:
            return a if b is None else b
        return least({x | y for x, y in product(a, b)})

    def least(clauses: set[frozenset[str]]) -> list[frozenset[str]]:  # a clause that contains another adds nothing to an OR
        return [x for x in sorted(clauses, key=sorted) if not any(y < x for y in clauses)]

    def of_strings(strings: set[str]):
        clauses = {trigrams(s) for s in strings}
        return None if frozenset() in clauses else least(clauses)

    def analyse(items) -> tuple[set[str] | None, list | None]:
        """(all strings that the items match, or None; clauses besides these)."""
        run, clauses = {""}, None
        for op, arg in items:
            name = str(op)
            strings, inner = None, None
            if name == "LITERAL":
                strings = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                strings, inner = analyse(arg[3])
            elif name == "BRANCH":
                parts = [analyse(x) for x in arg[1]]
                if all(s is not None and c is None for s, c in parts):
                    strings = set().union(*(s for s, _ in parts))
                else:
                    each = [both(of_strings(s) if s is not None else None, c) for s, c in parts]
                    inner = None if any(c is None for c in each) else [x for c in each for x in c]
            elif name == "IN":
                if all(str(o) == "LITERAL" for o, _ in arg):
                    strings = {chr(a).lower() for _, a in arg}
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                s, c = analyse(body)
                if (low, high) == (0, 1) and s is not None and c is None:
                    strings = s | {""}
                elif low == high and s is not None and c is None and len(s) ** low <= MOST_STRINGS:
                    strings = {"".join(x) for x in product(s, repeat=low)}
                elif low:
                    inner = both(of_strings(s) if s is not None else None, c)
            clauses = both(clauses, inner)
            joined = None if strings is None else {a + b for a, b in product(run, strings)}
            if joined is not None and len(joined) <= MOST_STRINGS:
                run = joined
            else:
                clauses = both(clauses, of_strings(run))
                run = strings if strings is not None and joined is not None and len(strings) <= MOST_STRINGS else {""}
        if clauses is None:
            return run, None
        return None, both(clauses, of_strings(run))

    strings, clauses = analyse(_parser.parse(pattern))
    return both(of_strings(strings) if strings is not None else None, clauses)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, k1, k2) for each trigram of the vocabulary in each row."""
    low = docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.lower(F.col("text").cast("string")).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary)))
    return low.select("k1", "k2", F.explode_outer(present).alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """k1, k2 and the bits of the rules for which the row is a candidate."""
    clauses = [(rule, n, t, len(clause)) for rule, qs in queries.items() for n, clause in enumerate(qs) for t in sorted(clause)]
    table = index.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, size int")
    met = index.join(F.broadcast(table), "trigram").groupBy("k1", "k2", "rule", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("k1", "k2").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """k1, k2, kind (its place in ``rules``), start, end of each secret, once for rows of equal keys."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q is not None}
    vocabulary = sorted(set().union(*(c for q in indexed.values() for c in q)))
    found = stored(candidates(postings(docs, vocabulary), indexed), "candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(found, ["k1", "k2"], "left")
    rows = rows.withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    full = F.lit(False)
    for i, r in enumerate(rules):
        hit = F.col("text").rlike(r.pattern)
        full |= hit if i not in indexed else (F.col("rules").bitwiseAND(1 << i) != 0) & hit
    rows = stored(rows.where(full).dropDuplicates(["k1", "k2"]), "verified")
    parts = []
    for i, r in enumerate(rules):
        hits = rows.where(F.col("text").rlike(r.pattern) if i not in indexed else (F.col("rules").bitwiseAND(1 << i) != 0) & F.col("text").rlike(r.pattern))
        pattern = F.lit(r.pattern)
        hits = hits.select("k1", "k2", F.split("text", r.pattern, -1).alias("gaps"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("all"), F.regexp_extract_all("text", pattern, F.lit(r.group)).alias("part"))
        each = F.transform("all", lambda m, j: F.struct(j.alias("place"), F.length(F.element_at("gaps", j + 1)).alias("gap"), F.length(m).alias("size"), F.length(F.element_at("part", j + 1)).alias("part")))
        parts.append(hits.select("k1", "k2", F.lit(i).alias("kind"), F.inline_outer(each)).withColumn("least", F.lit(r.least)))
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("place")
    spans = reduce(DataFrame.unionByName, parts)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return spans.withColumn("end", end).where(F.col("part") >= F.col("least")).select("k1", "k2", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, n_<kind> of the base kinds, base and spans (kind:start:end, joined by commas)."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    base = [i for i, r in enumerate(rules) if r.base]
    label = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    spans = find_spans(docs, rules).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    of_kind = lambda i: F.size(F.filter("s", lambda x: x["kind"] == i))
    spans = spans.select("k1", "k2", *(of_kind(i).alias(f"n_{rules[i].kind}") for i in base), F.array_join(F.transform(F.filter("s", lambda x: x["kind"].isin(base)), label), ",").alias("base"), F.array_join(F.transform("s", label), ",").alias("spans"))
    counts = [F.coalesce(f"n_{rules[i].kind}", F.lit(0)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text"))).join(spans, ["k1", "k2"], "left")
    return rows.select("doc_id", *counts, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, kind, end) by plain matching, for tests."""
    out = []
    for i, r in enumerate(rules):
        out += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m.group(r.group)) >= r.least]
    return sorted(out)
