"""Corpus-wide line deduplication (native: DataFrame functions only).

Line keys are hashed to 128 bits. The hashes are range-partitioned and sorted by key, document (largest first) and position; each
partition is streamed: a key's first document keeps its lines, and those that follow lose them once `MIN_DOCS` documents
have passed. The few keys that hold more than a `HOT`-th of all places (there can't be more than `HOT`) are decided from
pre-aggregated counts instead and broadcast, so that no task gets all places of a key that a third of all lines share; both
ways decide alike. What flows back to a document is a run-length bitmap of its lines, never text.

Defined results: a null or empty text is one empty line; lines shorter than `min_length` code points are never
dropped; a text whose lines all go becomes empty; rows that repeat a doc_id are one document, and each row gets
the bitmap of its own text; rows with a null doc_id together count as one document below all others; of equal lines
within a document all stay or all go; an empty table gives an empty one; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexapla.llm.common import cut

#: Characters stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_DOCS = 20, 3
HOT = 1 << 16  # keys of 16 bytes and a document number: 2 MB to broadcast at most
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """Stripped line with A-Z lower-cased; all-ASCII lines take the cheaper built-in."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(docs: DataFrame) -> DataFrame:
    """One column `d` that holds the input row, beside its document number and a fingerprint of its text."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return whole.select("d", F.coalesce(F.col("d.doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("d.text").alias("fp"))


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """(doc, fp, drops: array<struct<first, n>>): for texts that lose lines, the runs of dropped line numbers."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _doc(docs.select("doc_id", "text")).select("doc", "fp", F.posexplode(_lines(F.col("d.text"))).alias("pos", "line"))
    keyed = lines.select("doc", "fp", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_length)
    places = cut(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit(11)).alias("h2"), "doc", "fp", "pos"))
    total = places.count()
    # Fewer than `hot` keys can hold more than total / hot places each, so these are broadcast and their places stay where they are.
    frequent = cut(places.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") * hot > total).select("h1", "h2"))
    held = places.join(F.broadcast(frequent), ["h1", "h2"]).select("h1", "h2", "doc").distinct()
    decided = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    lost = places.join(F.broadcast(decided), ["h1", "h2"]).where("doc <> keeper").select("doc", "fp", "pos")
    # The others are streamed in order: a key's first document keeps its lines; the key counts if it has min_docs of them.
    ranged = places.join(F.broadcast(frequent), ["h1", "h2"], "left_anti").repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    key = Window.partitionBy("h1", "h2")
    nth = ranged.withColumn("nth", F.dense_rank().over(key.orderBy(F.desc("doc"))))
    met = nth.withColumn("n", F.max("nth").over(key.orderBy(F.desc("doc")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lost = lost.unionByName(met.where((F.col("nth") > 1) & (F.col("n") >= min_docs)).select("doc", "fp", "pos"))
    ordered = lost.groupBy("doc", "fp").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # A run begins where the number before isn't dropped too: comparing a sorted list with itself shifted by one.
    firsts = F.filter("at", lambda x, i: (i == 0) | (F.element_at("at", F.greatest(i, F.lit(1))) != x - 1))
    lasts = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.element_at("at", F.least(i + 2, F.size("at"))) != x + 1))
    runs = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))
    return ordered.select("doc", "fp", runs.alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """The lines outside the dropped runs: slices between one run's end and the next one's beginning."""
    n = F.size(drops)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(drops, F.greatest(i, F.lit(1)))["first"] + F.element_at(drops, F.greatest(i, F.lit(1)))["n"])
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.element_at(drops, F.least(i + 1, n))["first"])
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def line_dedup(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """(d: the input row, n_lines, n_dropped, drops, kept: text)."""
    maps = keep_bitmaps(docs, min_length, min_docs, hot)
    joined = _doc(docs).join(maps.hint("shuffle_hash"), ["doc", "fp"], "left")
    lines = _lines(F.col("d.text"))
    kept = F.when(F.col("drops").isNull(), F.coalesce(F.col("d.text"), F.lit(""))).otherwise(F.array_join(_kept(lines, F.col("drops")), "\n"))
    dropped = F.coalesce(F.aggregate("drops", F.lit(0).cast("long"), lambda acc, r: acc + r["n"]), F.lit(0).cast("long"))
    return joined.select("d", F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"), "drops", kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return line_dedup(docs).select("d.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The same columns as `docs`, with the kept lines as text and n_chars (where present) counted anew."""
    out = line_dedup(docs)
    cols = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(cols[c] if cols.get(c) is not None else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
