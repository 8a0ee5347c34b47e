"""PII: base patterns and information-theoretic sanitisation.

Emails, IP addresses, card and phone numbers are found by pattern. Other terms of a document may reveal such an entity
as well, so co-occurrence over the corpus estimates how strongly: P(entity | term) is the share of all documents with
the term that have the entity, and its information gain is log2 of that over the entity's own share. A term that stands
in at least `support` documents with one entity, with P of at least `disclose` and `bits` of gain, is generalised
wherever it stands in any document, or removed if P is at least `remove`.

Document frequencies of terms cover all documents: tasks count in bounded tables, Spark sums them. Terms meet entities
by document, those alone that can reach `disclose` (their frequency is at most the entity's over `disclose`), so that
common words make no pairs. Disclosing terms go to the tasks in blocks of `PART`; texts are not shuffled.

Cases: null and empty texts have no entities, and stay as they are; equal doc_ids and repeated rows are kept apart, and
each counts as a document; texts are searched whole, at any length, in linear time; an empty table gives no rows;
further columns, whatever their names, are carried by sanitise and ignored by report.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_ids, sha256, unveiled, veiled, written

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match from within a run of digits fails where the run's start does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
OTHER = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
FLUSH = 300_000
PART = 1 << 18  # disclosing terms that tasks hold at a time


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@domain from each @ outwards: linear, where a scan from the left is quadratic."""
    floor, at = 0, text.find("@")
    while at >= 0:
        if at >= floor:
            before = text[floor:at]
            start = floor + len(before.rstrip(LOCAL))
            m = DOMAIN.match(text, at + 1) if start < at else None
            floor = m.end() if m else at + 1
            if m:
                yield start, m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = OTHER.sub("", m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(OTHER.sub("", m.group())) <= 15]
    return out


def entity(kind: int, found: str) -> str:
    """A digest of the entity, whatever its spelling."""
    plain = found.lower() if kind == 0 else found if kind == 1 else OTHER.sub("", found)
    return xxhash.xxh3_128_hexdigest(f"{kind}:{plain}".encode("utf-8", "surrogatepass"))


def terms(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) outside the entities."""
    ends, starts, last = [], [], -1
    for x, y in sorted((x, y) for _, x, y in base):  # joined where they overlap
        if x < last:
            ends[-1] = last = max(last, y)
        else:
            starts.append(x)
            ends.append(y)
            last = y
    for m in TERM.finditer(text):
        s, t = m.span()
        k = bisect_right(ends, s)  # the first that ends after s
        if k == len(ends) or starts[k] >= t:
            yield m.group().lower(), s, t


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """rid, entities, terms (both distinct) of the documents with entities, written."""

    def make():
        ids = row_ids()

        def run(texts):
            out = []
            for t in texts:
                base = base_spans(t or "")
                if base:
                    out.append((next(ids), list({entity(k, t[a:b]) for k, a, b in base}), list({x for x, _, _ in terms(t, base)})))
            return [list(c) for c in zip(*out, strict=True)] or [[], [], []]

        return run

    return written(map_rows(docs, ["text"], make, "rid bigint, entities array<string>, terms array<string>"), "pii")


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df over all documents: tasks count in tables of FLUSH terms, Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return got

        for b in batches:
            for t in b.column(0):
                held.update(set(map(str.lower, set(TERM.findall(t.as_py() or "")))))
                if len(held) >= FLUSH:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def reveal(docs: DataFrame, support: int, disclose: float, remove: float, bits: float) -> DataFrame:
    """term, kind of the terms that give an entity away, written."""
    scanned = scan(docs)
    ents = scanned.select("rid", F.explode("entities").alias("entity"))
    own = written(ents.groupBy("entity").agg(F.count("*").alias("docs")).where(F.col("docs") >= support), "entities")
    ents = ents.join(own, "entity")
    df = document_frequency(docs).where(F.col("df") >= support)
    found = scanned.select("rid", F.explode("terms").alias("term")).join(df, "term")
    met = found.join(ents, "rid").where(F.col("df") * disclose <= F.col("docs"))
    pairs = met.groupBy("term", "entity").agg(F.count("*").alias("n"), F.first("df").alias("df"), F.first("docs").alias("docs"))
    told = pairs.where(F.col("n") >= support).withColumn("p", F.col("n") / F.col("df")).where(F.col("p") >= disclose)
    told = told.where(F.log2(F.col("p") * docs.count() / F.col("docs")) >= bits)
    return written(told.groupBy("term").agg(F.max(F.when(F.col("p") >= remove, 5).otherwise(4)).alias("kind")), "told")


def marked(docs: DataFrame, carry: list[str], told: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """What finish makes of carry's columns, texts and the places of told terms in each; schema is its. A pass over the texts for each block of terms, no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    part = "array<struct<kind:int,start:int,end:int>>"
    out = docs.select(*carry, F.col("text").alias("_text"), F.array().cast(part).alias("_added"))
    shape = "".join(f"`{c}` {kinds[c]}, " for c in carry) + f"_text string, _added {part}"
    n = max(1, -(-told.count() // PART))
    for i in range(n):
        got = told.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).toArrow()
        held = docs.sparkSession.sparkContext.broadcast(dict(zip(got.column("term").to_pylist(), got.column("kind").to_pylist(), strict=True)))
        last = i == n - 1
        out = map_rows(out, [*carry, "_text", "_added"], adder(held, finish if last else None), schema if last else shape)
        if not last:  # so that a task has one of these at a time
            out = written(out, "marked")
    return out


def adder(held, finish: Callable | None):
    def make():
        told = held.value

        def run(*columns):
            added = []
            for t, a in zip(columns[-2], columns[-1], strict=True):
                if t and told and not told.keys().isdisjoint(map(str.lower, set(TERM.findall(t)))):
                    a = a + [{"kind": told[x], "start": s, "end": e} for x, s, e in terms(t, base_spans(t)) if x in told]
                added.append(a)
            return finish(*columns[:-1], added) if finish else [*columns[:-1], added]

        return run

    return make


SETTINGS = {"support": 3, "disclose": 0.6, "remove": 0.9, "bits": 4.0}


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(doc_ids, texts, added):
        base = [base_spans(t or "") for t in texts]
        counts = [[sum(k == n for k, _, _ in b) for b in base] for n in range(4)]
        spans = [listed(sorted([*b, *((x["kind"], x["start"], x["end"]) for x in a)])) for b, a in zip(base, added, strict=True)]
        return [doc_ids, *counts, [sha256(listed(b)) for b in base], spans, [len(a) for a in added]]

    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_terms bigint"
    return marked(docs, ["doc_id"], reveal(docs, **SETTINGS | settings), finish, schema)


def rewrite(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span's label in its place; of overlapping spans, the first one's."""
    if not spans or text is None:
        return text
    out, last = [], 0
    for a, k, b in sorted((a, k, b) for k, a, b in spans):
        if b <= last:
            continue
        if a >= last:
            out += (text[last:a], LABELS[k])
        last = b
    return "".join((*out, text[last:]))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """docs with entities and disclosing terms replaced in text (and n_chars counted again, if there)."""
    hidden, names = veiled(docs)
    kinds = {f.name: f.dataType.simpleString() for f in hidden.schema}
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def finish(*columns):
        got = list(columns[:-2])
        spans = [base_spans(t or "") + [(x["kind"], x["start"], x["end"]) for x in a] for t, a in zip(columns[-2], columns[-1], strict=True)]
        got[text_at] = [rewrite(t, s) for t, s in zip(got[text_at], spans, strict=True)]
        if chars_at is not None:
            got[chars_at] = [len(t) if s else n for t, s, n in zip(got[text_at], spans, got[chars_at], strict=True)]
        return got

    found = marked(hidden, names, reveal(hidden, **SETTINGS | settings), finish, ", ".join(f"{c} {kinds[c]}" for c in names))
    return unveiled(found, docs)
