"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams: an AND of ORs of literals, each an AND of its trigrams
(Cox, 2012). A task indexes its documents a piece at a time: postings from each trigram that any rule asks for to the
documents that hold it, ASCII letters folded. Postings are intersected and united as the query says, and only the
documents left are verified by the expression itself. A rule without mandatory trigrams scans every document.
Nothing is shuffled.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import LOWER, map_batches, pieces, without


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression (in syntax that RE2 shares), and the least length of one of its groups. linear:
    where a backtracking engine would scan a long run anew from each of its places, an expression whose last group
    gives the same matches and that begins in a run once."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    linear: str | None = None

    def matches(self, text: str):
        """(start, end, length of the group) of each match, from the left without overlap."""
        expression, group = re.compile(self.linear or self.pattern, re.ASCII), self.group
        if self.linear:
            return [(*m.span(m.re.groups), m.end(m.re.groups) - m.start(m.re.groups)) for m in expression.finditer(text)]
        return [(m.start(), m.end(), m.end(group) - m.start(group)) for m in expression.finditer(text)]


JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
URL = r"[A-Za-z0-9+.-]+://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@"
#: Base rules first, as listed; the others are the method's own. Public formats of keys and tokens.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # Of a run the first eyJ with enough behind it: whether more follows doesn't hang on where the match begins.
    Rule("jwt", JWT, linear=rf"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ[A-Za-z0-9_-]{{8}}))({JWT})"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", URL, linear=r"(?<![A-Za-z0-9+.-])([A-Za-z0-9+.-]++://[^\x00-\x20:@/]++:[^\x00-\x20:@/]++@)"),
)

#: Strings that a part of an expression may expand to at most; beyond, it counts as unknown.
EXPAND = 64


def literals(pattern: str) -> list[list[str]]:
    """An AND of ORs: of each inner list, every match holds one string (ASCII letters folded, three bytes or more)."""
    query: list[list[str]] = []

    def flush(held: list[str]) -> list[str]:
        if all(len(x) >= 3 for x in held):
            query.append(sorted(set(held)))
        return [""]

    def exact(item) -> list[str] | None:
        op, arg = item
        if op is sre.LITERAL:
            return [chr(arg).lower() if arg < 128 else chr(arg)]
        if op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 8:
            return sorted({chr(x[1]).lower() for x in arg})
        if op is sre.SUBPATTERN:
            return joined(arg[-1])
        if op is sre.BRANCH:
            options = [joined(x) for x in arg[1]]
            return None if None in options else [y for x in options for y in x]
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
            one = joined(arg[2])
            return None if one is None else [y for n in range(arg[0], arg[1] + 1) for y in map("".join, product(one, repeat=n))]
        return None

    def joined(items) -> list[str] | None:
        held = [""]
        for x in items:
            more = exact(x)
            if more is None or len(held) * len(more) > EXPAND:
                return None
            held = [a + b for a in held for b in more]
        return held

    held = [""]
    for item in parser.parse(pattern):
        more = exact(item)
        if more is None:
            held = flush(held)
        elif len(held) * len(more) > EXPAND:
            held = more if flush(held) == [""] else held
        else:
            longer = [a + b for a in held for b in more]
            # An optional part must not weaken what stands before it.
            held = flush(held) if min(map(len, more)) == 0 and all(len(x) >= 3 for x in held) else longer
    flush(held)
    return query


def trigrams(text: str) -> list[int]:
    raw = text.encode()
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


class Index:
    """Postings of one piece: the rows that hold each trigram asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray, asked: np.ndarray):
        self.rows = len(at) - 1
        folded = LOWER[data].astype(np.uint32)
        n = len(folded)
        self.postings: dict[int, np.ndarray] = {}
        if n < 3:
            return
        grams = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
        where = np.flatnonzero(asked[grams])
        row = np.searchsorted(at, where, "right") - 1
        inside = where + 2 < at[row + 1]
        pairs = np.unique(grams[where[inside]].astype(np.uint64) << np.uint64(32) | row[inside].astype(np.uint64))
        gram, row = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True]))) if len(gram) else np.zeros(1, int)
        self.postings = {int(gram[a]): row[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}

    def holding(self, query: list[list[str]]) -> np.ndarray:
        """Rows that the query leaves; all of them for an empty one."""
        left, none = np.arange(self.rows), np.zeros(0, np.int64)
        for options in query:
            union = none
            for text in options:
                own = left
                for g in trigrams(text):
                    own = np.intersect1d(own, self.postings.get(g, none), assume_unique=True)
                union = np.union1d(union, own)
            left = union
        return left


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with spans: array of (kind, start, end), in code points, end exclusive, by start, then rule as listed.

    Leftmost, non-overlapping matches of each rule, those whose group is too short dropped. Null and empty texts have
    none; rows that repeat are each scanned. Other columns pass through, but for one named spans, which is replaced.
    Texts of any length are scanned whole. No documents give no rows.
    """
    docs = without(docs, "spans")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(span))])

    def scan(batches):
        compiled = [(r, literals(r.pattern)) for r in rules]
        asked = np.zeros(1 << 24, bool)
        for _, query in compiled:
            asked[[g for options in query for x in options for g in trigrams(x)]] = True
        for batch in batches:
            for part, data, at in pieces(batch):
                index, texts = Index(data, at, asked), part.column("text")
                found: list[list] = [[] for _ in range(part.num_rows)]
                decoded: dict[int, str] = {}
                for k, (rule, query) in enumerate(compiled):
                    for r in index.holding(query).tolist():
                        if r not in decoded:
                            decoded[r] = texts[r].as_py() or ""
                        found[r] += [(a, k, b) for a, b, n in rule.matches(decoded[r]) if n >= rule.least]
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*part.schema.names, "spans"])

    return map_batches(docs, scan, schema)


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = [r.kind for r in RULES if r.base]

    def of(*kinds: str):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined("spans").alias("spans"))


def rule_sql(k: int, rule: Rule) -> str:
    """Spans of one rule: the text is cut into (what stands before, match) pairs, whose lengths add up to places."""
    p = rule.pattern.replace("'", "''")
    inner = f"(?s:(.*?))({p})"
    group = 2 + rule.group
    return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, s + len(b) AS a, s + len(b) + len(m) AS e FROM (
SELECT r, b, m, g, coalesce(sum(len(b) + len(m)) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (
SELECT r, unnest(regexp_extract_all(t, '{inner}', 1)) AS b, unnest(regexp_extract_all(t, '{inner}', 2)) AS m, unnest(regexp_extract_all(t, '{inner}', {group})) AS g, generate_subscripts(regexp_extract_all(t, '{inner}', 1), 1) AS j FROM d)) WHERE len(g) >= {rule.least}"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(rule_sql(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
