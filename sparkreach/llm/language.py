"""Language ID by compression: the language whose zstandard dictionary makes the text smallest.

Per language, a raw-content dictionary of at most `dict_bytes` is filled with whole training texts of smallest hash
(a bounded sample of labelled rows: the bound is the parameter; the last text is cut to fill it). Every text is then
compressed whole with each dictionary. The score is the softmax of the sizes in bits, the best over all; a prediction
whose second-best size is within `margin` (a fraction of the best size) is rejected: accepted is false.

Cases: null texts and texts without letters give `und`, score 0 and are not accepted, as do all if nothing was
learned; ties go to the language with more training rows, then by name; null languages are not learned; repeated rows
are predicted alike; texts are compressed whole, at any length; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, written

LETTER = regex.compile(r"\p{L}")
PART = 256  # dictionaries that a task holds


def languages(train: DataFrame, dict_bytes: int) -> list[tuple[str, float]]:
    """Languages, those with more rows first, and the share of their rows that fills a dictionary four times on average."""
    sizes = usable(train).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").collect()
    return [(r["lang"], min(1.0, 4 * max(16.0, dict_bytes / (r["bytes"] / r["n"])) / r["n"])) for r in sizes]


def usable(train: DataFrame) -> DataFrame:
    return train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))


def learn(train: DataFrame, dict_bytes: int = 128 << 10, shares: list[tuple[str, float]] | None = None) -> dict[str, bytes]:
    """Language to dictionary content, languages with more rows first. train: doc_id, text, lang. shares: of some languages, as from languages.

    Rows are picked by hash and cut by their running size in Spark, so that about dict_bytes a language reach the driver.
    """
    shares = languages(train, dict_bytes) if shares is None else shares
    if not shares:
        return {}
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32))
    limits = train.sparkSession.createDataFrame([(k, int(v * (1 << 32))) for k, v in shares], "lang string, most bigint")
    text = F.substring(F.col("text"), 1, dict_bytes)  # a dictionary takes no more
    rows = usable(train).join(F.broadcast(limits), "lang").where(at < F.col("most")).select("lang", at.alias("at"), text.alias("text"))
    before = Window.partitionBy("lang").orderBy("at", "text").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))).where(F.col("before") < dict_bytes)
    held: dict[str, list] = {lang: [] for lang, _ in shares}
    for r in some.collect():
        held[r["lang"]].append((r["before"], r["text"].encode()[: dict_bytes - r["before"]]))
    return {lang: b"\n".join(t for _, t in sorted(found)) + b"\n" for lang, found in held.items()}


def sizes(docs: DataFrame, content: dict[str, bytes], level: int) -> DataFrame:
    """docs' columns, with the sizes of each text under each dictionary added to `_sizes`; none for texts without letters."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def make():
        def compressor(data: bytes):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)

        engines = [compressor(data) for data in content.values()]

        def run(ids, texts, known):
            out = []
            for t, old in zip(texts, known, strict=True):
                raw = t.encode("utf-8", "surrogatepass") if t and LETTER.search(t) else None
                out.append(old if raw is None else [*old, *(len(c.compress(raw)) for c in engines)])
            return [ids, texts, out]

        return run

    return map_rows(docs, ["doc_id", "text", "_sizes"], make, f"doc_id {kinds['doc_id']}, text string, _sizes array<int>")


def judged(docs: DataFrame, names: list[str], margin: float) -> DataFrame:
    """doc_id, lang_pred, score, accepted from doc_id and _sizes (by name)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(found):
        if not found:
            return "und", 0.0, False
        best = min(found)
        score = 1 / sum(math.exp(-min(700.0, (s - best) * 8 * math.log(2))) for s in found)
        return names[found.index(best)], score, len(found) == 1 or sorted(found)[1] - best > margin * best

    def make():
        def run(ids, found):
            out = [one(x) for x in found]
            return ids, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

        return run

    return map_rows(docs, ["doc_id", "_sizes"], make, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, content: dict[str, bytes], level: int = 3, margin: float = 0.002) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of docs."""
    state = docs.select("doc_id", "text", F.expr("cast(array() as array<int>)").alias("_sizes"))
    return judged(sizes(state, content, level), list(content), margin)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, dict_bytes: int = 128 << 10, level: int = 3, margin: float = 0.002) -> DataFrame:
    """The query: learn from the rows that are not held out, predict all. Tasks hold PART dictionaries at a time, so many languages take several passes."""
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    shares = languages(train, dict_bytes)
    state = docs.select("doc_id", "text", F.expr("cast(array() as array<int>)").alias("_sizes"))
    for i in range(0, len(shares), PART):
        state = sizes(state if i == 0 else written(state, "sizes"), learn(train, dict_bytes, shares[i : i + PART]), level)
    found = judged(state, [k for k, _ in shares], margin)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
