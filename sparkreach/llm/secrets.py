"""Secret scans with multipart credential linking.

Three base kinds are reported wherever they stand: assign, access and hex. Weak parts (an access identifier, a value of
high entropy, an endpoint) are harmless alone. They are linked by an interval join: within a document, each part's
interval is widened by `scope` code points, parts meet on cells of that width, and a part is reported only if a part
of a complementary kind overlaps its scope (identifier and value, endpoint and identifier, endpoint and value) and not
the part itself. The join is a semi join, so no pairs are listed, however dense the parts.

Cases: null and empty texts have no parts; base spans stay whatever is linked; equal doc_ids are kept apart by a row
number taken as the texts are scanned, so repeated rows each have their own spans; texts are scanned whole, at any
length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_ids, sha256, written

KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
SCOPE = 256

# fixed values: the patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is [0-9a-f]+ of 24 characters or more

IDENTIFIER = re.compile(r"\b(?:client|user|account|key|access)[_-]?(?:id|name)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?([A-Za-z0-9_.@-]{3,})", re.I | re.A)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")  # with a digit
DIGIT = re.compile(r"[0-9]")
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}", re.A)
WORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), unsorted."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS) or not low.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """Candidates for linking: (start, kind, end)."""
    out = []
    low = text.lower()
    if "id" in low or "name" in low:
        out += [(m.start(1), 3, m.end(1)) for m in IDENTIFIER.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in VALUE.finditer(text) if DIGIT.search(m.group()) and entropy(m.group()) >= 3.0]
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_assign, n_access, n_hex, base_sha256, base and weak (arrays of start, kind, end), written."""

    def make():
        ids = row_ids()

        def run(doc_ids, texts):
            base = [sorted(base_spans(t or "")) for t in texts]
            weak = [sorted(weak_parts(t or "")) for t in texts]
            as_rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
            counts = [[sum(k == n for _, k, _ in b) for b in base] for n in range(3)]
            return [next(ids) for _ in texts], doc_ids, *counts, [sha256(listed(b)) for b in base], [as_rows(b) for b in base], [as_rows(w) for w in weak]

        return run

    part = "array<struct<start:int,kind:int,end:int>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(map_rows(docs, ["doc_id", "text"], make, f"rid bigint, doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base {part}, weak {part}"), "secrets")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, start, kind, end of the weak parts with a complementary part in their scope.

    Base spans serve as the strong side: an access span is an identifier, assign and hex spans are values.
    """
    parts = scanned.where(F.size("weak") > 0).select("rid", F.explode("weak").alias("p")).select("rid", "p.*")
    strong = scanned.where((F.size("base") > 0)).select("rid", F.explode("base").alias("p")).select("rid", "p.start", F.when(F.col("p.kind") == 1, 3).otherwise(4).alias("kind"), "p.end")
    all_parts = parts.unionByName(strong)
    # a cell holds a bounded stretch of text; the left side looks into the cells that its widened interval touches, the
    # right side is in all that it covers
    left = parts.select("*", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("cell"))
    right = all_parts.select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("kind").alias("k"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("c"))
    near = (F.col("rid") == F.col("r")) & (F.col("cell") == F.col("c")) & (F.col("kind") != F.col("k")) & (F.col("s") < F.col("end") + scope) & (F.col("e") > F.col("start") - scope)
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))  # a text that two patterns match is no complement of itself
    return left.join(right, near & apart, "left_semi").select("rid", "start", "kind", "end").distinct()


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of docs."""
    scanned = scan(docs)
    linked = link(scanned, scope).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")))
    text = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]))
    return scanned.join(linked, "rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"), F.coalesce(F.size("linked"), F.lit(0)).cast("bigint").alias("n_linked"))
