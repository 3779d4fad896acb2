"""Near-duplicate classes by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with the number of its earlier occurrences.
For each of `SKETCHES` seeds, the `PICKED` labelled shingles with the smallest hashes are kept in text order: two
documents share such a vector when they share its shingles and their order, so shuffled text doesn't collide.
Candidates are aligned: shingles that both hold, within the diagonal band outside which no pair of the wanted
similarity can match, are joined to a longest increasing chain. With L its length and m, n the lengths of both
sequences, similarity is L / (m + n - L), the Jaccard index of shingles aligned in order; `MIN_SIMILARITY` or more
links two documents. Classes are the connected components of links.

Exact copies (equal word sequences) collapse first, with map-side combine, and get their text's class last. A vector shared by up to `ALL_PAIRS`
distinct texts yields all their pairs. A larger group yields a star around the text whose vectors are most common
over the whole corpus (the hub that edited copies of one original have in it). Stars alone would lose links between
texts that both differ from their hub, so the rest follows without a cap: members outside the component that most of
their group is in are held, block by block, against the whole group. There `SIGNATURE` one-byte minima estimate the
Jaccard index, which no aligned similarity exceeds; pairs of two components that reach `LEAST_ESTIMATE` (four standard
deviations below `MIN_SIMILARITY`) are aligned in place, the likeliest first, each in the first large group that it shares.
Only a link that joins two components of its block leaves the task, so its rows grow with members, not with pairs.

Defined results: texts without words (null and empty ones too) are classes of their own; a text of one to four
words is one shingle; rows of one doc_id belong together; rows with a null doc_id have a null class and are kept;
further columns pass through `stage`, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hexapla.llm.common import connected_components, cut, doc_groups, let_go, map_arrow, spread_join, utf8_buffer
from hexapla.llm.words import labelled, mix, shingles, word_hashes

SHINGLE, MIN_SIMILARITY = 5, 0.8
SKETCHES, PICKED = 16, 3
ALL_PAIRS, BLOCK = 12, 64
SIGNATURE, LEAST_ESTIMATE, MEMBERS, BLOCK_BYTES = 256, 0.7, 2048, 1 << 24
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_MINIMA_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_SLICE = 1 << 15


def sequence(words: np.ndarray) -> np.ndarray:
    return labelled(shingles(words, SHINGLE))


def sketch(seq: np.ndarray) -> np.ndarray:
    """The order-preserving vectors of one sequence, each as a 64-bit hash."""
    take = min(PICKED, len(seq))
    place = np.zeros((SKETCHES, 0), np.int64)
    for a in range(0, len(seq), _SLICE):  # long sequences: the smallest of the slices' smallest
        here = np.concatenate([place, np.broadcast_to(np.arange(a, min(a + _SLICE, len(seq))), (SKETCHES, min(a + _SLICE, len(seq)) - a))], axis=1)
        h = mix(seq[here] ^ _SEEDS[:, None])
        if h.shape[1] > take:
            best = np.argpartition(h, take - 1, axis=1)[:, :take]
            here = np.take_along_axis(here, best, axis=1)
        place = here
    place = np.sort(place, axis=1)
    x = np.zeros(SKETCHES, np.uint64)
    for j in range(take):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + seq[place[:, j]])
    return x


def signature(seq: np.ndarray) -> bytes:
    """The low bytes of the smallest hash under each of SIGNATURE seeds."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(seq), 1 << 12):
        np.minimum(least, mix(seq[None, a : a + (1 << 12)] ^ _MINIMA_SEEDS[:, None]).min(axis=1), out=least)
    return least.astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Banded alignment of two labelled sequences; below MIN_SIMILARITY any lower bound may be returned."""
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    if min(m, n) < MIN_SIMILARITY * max(m, n):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    unmatched = (m + n) * (1 - MIN_SIMILARITY) / (1 + MIN_SIMILARITY)
    near = np.abs(i - j) <= unmatched
    i, j = i[near], j[near]
    if len(i) / (m + n - len(i)) < MIN_SIMILARITY:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        chain = len(tails)
    return chain / (m + n - chain)


def _texts_words(column: pa.Array):
    """For each text its word hashes, with scratch memory bounded by groups of texts."""
    raw, offsets = utf8_buffer(column)
    for a, b in doc_groups(offsets):
        words, _, _, at = word_hashes(raw, offsets[a : b + 1])
        for k in range(b - a):
            yield words[at[k] : at[k + 1]]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp: binary, vectors: array<long>); nulls for texts without words. Texts aren't shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, vectors = [], []
        for words in _texts_words(batch.column("text")):
            if len(words):
                fps.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                vectors.append(sketch(sequence(words)).view(np.int64))
            else:
                fps.append(None)
                vectors.append(None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.array(vectors, pa.list_(pa.int64()))], ["doc_id", "fp", "vectors"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return map_arrow(rows, run, "doc_id long, fp binary, vectors array<long>")


def _candidates(bands: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) from `total` bands (k, value, doc), and the members (k, value, n, doc) of large groups."""
    sizes = cut(bands.groupBy("k", "value").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(spread_join(bands, sizes, ["k", "value"], total))
    # A document has at most SKETCHES rows here, so a window over it is small.
    fame = F.sum("n").over(Window.partitionBy("doc"))
    famed = cut(shared.withColumn("fame", fame).where(F.col("n") > ALL_PAIRS))
    hubs = famed.groupBy("k", "value").agg(F.max_by("doc", F.struct("fame", -F.col("doc"))).alias("hub"), F.count("*").alias("n"))
    # Members go to their hub in blocks: fewer rows meet, and no task holds a large group.
    block = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / BLOCK))
    blocks = famed.groupBy("k", "value", block.alias("block")).agg(F.collect_list("doc").alias("docs"))
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread_join(blocks, hubs, ["k", "value"], total).repartition(parts, "k", "value", "block")
    star = met.select("hub", F.explode("docs").alias("doc")).where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    small = shared.where(F.col("n") <= ALL_PAIRS).groupBy("k", "value").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    first = small.select("docs", F.posexplode("docs").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("docs", F.col("i") + 2, F.size("docs"))).alias("b"))
    # Similar pairs share about half of their vectors; one shared vector alone is chance.
    both = pairs.unionByName(star).groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1 AND a <> b").select("a", "b")
    return both, famed.select("k", "value", "n", "doc")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = [similarity(sequence(x), sequence(y)) for x, y in zip(_texts_words(batch.column("ta")), _texts_words(batch.column("tb")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.float64())], ["a", "b", "similarity"])

    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), run, "a long, b long, similarity double").where(F.col("similarity") >= MIN_SIMILARITY)


def links(docs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) links between representatives of exact copies, and (fp, rep, n) of all of their n copies."""
    # The vectors of equal word sequences are equal, so any copy's will do.
    texts = cut(sketched.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("vectors").alias("vectors")))
    pairs, grouped = _candidates(texts.select(F.col("rep").alias("doc"), F.posexplode("vectors").alias("k", "value")), texts.count() * SKETCHES)
    pairs = cut(pairs)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(grouped.select("doc")).distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(involved, "doc", "left_semi")
    whole = cut(whole)
    found = cut(_verified(pairs, whole).select(F.col("a").alias("u"), F.col("b").alias("v")))
    let_go(found.sparkSession)
    if grouped.head(1):
        found = found.unionByName(_across_components(found, grouped, whole))
    return found, texts.select("fp", "rep", "n")


def _links_in_block(group: pa.Table) -> pa.Table:
    """Links that join components, from one block of asking members and one of all members."""
    docs, asks, minor = (group.column(c).to_numpy() for c in ("doc", "asks", "minor"))
    first_k = group.column("k")[0].as_py()
    minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    # Vectors that are in no large group match nothing: their place holds the row's own negative number.
    vectors = np.broadcast_to(-1 - np.arange(len(docs))[:, None], (len(docs), SKETCHES)).copy()
    known = np.zeros((len(docs), SKETCHES), bool)
    for i, large in enumerate(group.column("large").to_pylist()):
        for x in large:
            vectors[i, x["k"]], known[i, x["k"]] = x["value"], True
    seqs = [sequence(words) for words in _texts_words(group.column("text").combine_chunks())]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    parts = group.column("component").to_pylist()
    found_u, found_v = [], []
    for i in np.flatnonzero(asks):
        # Two members of the minority meet twice; the one with the smaller doc_id asks.
        rest = np.flatnonzero(~minor | (docs > docs[i]))
        estimate = (np.count_nonzero(minima[rest] == minima[i], axis=1) / SIGNATURE - 1 / 256) / (1 - 1 / 256)
        near = estimate >= LEAST_ESTIMATE
        rest, estimate = rest[near], estimate[near]
        shared = (vectors[rest] == vectors[i]) & known[rest] & known[i]
        here = shared.argmax(axis=1) == first_k
        rest, estimate = rest[here], estimate[here]
        for j in rest[np.argsort(-estimate, kind="stable")]:
            p, q = root(parts[i]), root(parts[j])
            if p != q and similarity(seqs[i], seqs[j]) >= MIN_SIMILARITY:
                parent[max(p, q)] = min(p, q)
                found_u.append(int(docs[i]))
                found_v.append(int(docs[j]))
    return pa.table({"u": pa.array(found_u, pa.int64()), "v": pa.array(found_v, pa.int64())})


def _across_components(found: DataFrame, grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between different components of `found` among members of large groups."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        minima = [signature(sequence(words)) for words in _texts_words(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), pa.array(minima, pa.binary())], ["doc", "text", "minima"])

    large = grouped.groupBy("doc").agg(F.collect_list(F.struct("k", "value")).alias("large"))  # SKETCHES at most
    component = connected_components(found, tidy=True).withColumnRenamed("node", "doc")
    members = cut(grouped.join(component, "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    held = members.groupBy("k", "value", "component").agg(F.count("*").alias("m"))
    most = held.groupBy("k", "value").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.sum("m").alias("n"), F.max("m").alias("top")).where("top < n").drop("top")
    open_members = cut(spread_join(members.drop("n"), cut(most), ["k", "value"], members.count()))
    wanted = texts.join(open_members.select("doc").distinct(), "doc", "left_semi").select("doc", "text")
    known = cut(map_arrow(wanted, run, "doc long, text string, minima binary").join(large, "doc"))
    let_go(known.sparkSession)
    # Every block of askers meets every block of the group in a task of its own, whatever the group's size and that of its texts.
    bytes_of = known.groupBy("doc").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    needed = lambda number, size: F.greatest(F.ceil(number / MEMBERS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    asking = F.col("component") != F.col("most")
    weighed = open_members.join(bytes_of, "doc").groupBy("k", "value").agg(
        needed(F.count_if(asking), F.sum(F.when(asking, F.col("bytes")).otherwise(0))).alias("ask_blocks"), needed(F.count("*"), F.sum("bytes")).alias("blocks"), F.count("*").alias("n"),
    )
    open_members = spread_join(open_members.drop("n"), cut(weighed), ["k", "value"], open_members.count())
    ask_blocks, blocks = F.col("ask_blocks"), F.col("blocks")
    single = (blocks == 1) & (ask_blocks == 1)
    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    minor = F.col("component") != F.col("most")
    cols = ["k", "value", "doc", "component", minor.alias("minor")]
    askers = open_members.where(minor & ~single).select(*cols, F.lit(True).alias("asks"), mine(ask_blocks).alias("x"), up_to(blocks).alias("y"))
    asked = open_members.select(*cols, (minor & single).alias("asks"), up_to(ask_blocks).alias("x"), mine(blocks).alias("y"))
    met = askers.unionByName(asked).join(known, "doc")
    return cut(met.groupBy("k", "value", "x", "y").applyInArrow(_links_in_block, "u long, v long"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every distinct non-null doc_id: the smallest doc_id of its class."""
    sketched = cut(sketches(docs))
    found, texts = links(docs, sketched)
    worded = sketched.where("fp IS NOT NULL").select("doc_id", "fp")
    # A doc_id with several texts links them; other copies share their text's class and are no nodes.
    several = worded.groupBy("doc_id").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last").select("doc_id")
    held = worded.join(several, "doc_id", "left_semi").distinct().join(texts, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(found.unionByName(held), tidy=True)
    own = cut(texts.join(parts, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("class_id")))
    rows = spread_join(worded, own, ["fp"], worded.count()).select("doc_id", "class_id")
    return rows.unionByName(sketched.where("fp IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))).groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, kept (doc_id = class_id)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(classes(docs), "doc_id", "left").select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each class, in all their columns."""
    gone = classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    left = whole.join(gone, F.col("d.doc_id").cast("long") == F.col("gone_id"), "left_anti")
    return left.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
