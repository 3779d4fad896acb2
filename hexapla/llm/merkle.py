"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, a proof for every row.

Rows are range-partitioned by group and key, so every partition holds runs of consecutive leaves, whose places follow from the
runs' lengths. In each partition a mountain-range stack carries every full run of `base` siblings to the next level; a run that is short
because the group ends there is hashed as it is, without padding. What can't be carried, because siblings lie in another
partition, is sent on as peaks: at most 2 x base x log(n) for each end of a partition. Peaks of `FAN` neighbouring partitions meet in a group and are
carried by the same stack, round by round, until all are roots; the nodes made on the way are kept.

A row's proof needs nodes of its own partition, which are computed again there, and nodes outside, some dozens for each end of a
partition, which are looked up among peaks and merged nodes and sent to the partition that asks. So hashes are shuffled, never texts; a
task holds about `ROWS` leaves, or the peaks of FAN partitions, and a group of any size is spread over many tasks.

Defined results: a null is hashed as `-`, an empty text as `0:`; a null group comes before all others, rows with a null key before
others of their group; rows with the same key follow each other by leaf, so repeated rows have leaves alike, next to
each other, and a proof each; an empty table gives no rows; further columns are ignored, whatever their names; a text of any length is hashed whole, in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hexapla.llm.common import cut, give_back

BASE = 3
#: Leaves of a partition, about; partitions whose peaks meet at a time.
ROWS, FAN = 100_000, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "g string, level int, idx long, hash string, total long, part long, kind string"
_NODES = pa.schema([("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("total", pa.int64()), ("part", pa.int64()), ("kind", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Hash of values, each with its length in bytes before it, or `-` for a null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


class Range:
    """The mountain range over consecutive nodes of one group, pushed from left to right."""

    def __init__(self, base: int):
        self.base = base
        self.waiting: list[list[tuple[int, str]]] = []
        self.made: list[tuple[int, int, str]] = []  # (level, place, hash) of carried nodes
        self.peaks: list[tuple[int, int, str]] = []  # nodes whose siblings are elsewhere

    def push(self, level: int, idx: int, h: str) -> None:
        while True:
            while len(self.waiting) <= level:
                self.waiting.append([])
            run = self.waiting[level]
            run.append((idx, h))
            if (idx + 1) % self.base:
                return
            h = self.carry(level)
            if h is None:
                return
            level, idx = level + 1, idx // self.base

    def carry(self, level: int) -> str | None:
        """The parent of the waiting run, which has come to its end; None if its first siblings are elsewhere."""
        run = self.waiting[level]
        self.waiting[level] = []
        if run[0][0] % self.base:
            self.peaks += [(level, i, h) for i, h in run]
            return None
        h = digest("".join(h for _, h in run))
        self.made.append((level + 1, run[0][0] // self.base, h))
        return h

    def close(self, total: int) -> str | None:
        """At the end of a group of `total` leaves: short runs are carried; the root, if all the group was pushed."""
        level, count = 0, total
        while count > 1:
            if level < len(self.waiting) and self.waiting[level] and self.waiting[level][-1][0] == count - 1:
                h = self.carry(level)
                if h is not None:
                    self.push(level + 1, (count - 1) // self.base, h)
            level, count = level + 1, -(-count // self.base)
        return self.waiting[level].pop()[1] if level < len(self.waiting) and self.waiting[level] else None

    def rest(self) -> list[tuple[int, int, str]]:
        """All peaks."""
        return self.peaks + [(level, i, h) for level, run in enumerate(self.waiting) for i, h in run]


def _nodes(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES) if rows else _NODES.empty_table()


def _levels(total: int, base: int) -> list[int]:
    """Numbers of nodes, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // base))
    return out


def _outside(first: int, last: int, total: int, base: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that proofs of leaves first..last need and that these leaves don't make."""
    width = 1
    for level, count in enumerate(_levels(total, base)[:-1]):
        lo, hi = first // width, last // width
        own_lo, own_hi = -(-first // width), hi if min((hi + 1) * width, total) - 1 <= last else hi - 1
        for i in range(lo - lo % base, min(hi - hi % base + base, count)):
            if i < own_lo or i > own_hi:
                yield level, i
        width *= base


@dataclass
class Forest:
    """`rows`: g, leaf and what else was given, in order, with `at` (partition and place in it) and `part`; `runs`: the consecutive leaves of
    a group in a partition (part, g, before, n, total); `nodes`: peaks and merged nodes; `roots`: g, hash, total."""

    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    base: int


def forest(leaves: DataFrame, keys: list[str], base: int = BASE, rows: int = ROWS) -> Forest:
    """Trees over `leaves` (g: string, leaf: binary, keys and further columns), a tree for each g, in order of `keys`."""
    spark = leaves.sparkSession
    leaves = cut(leaves)
    n = leaves.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000), -(-n // rows))
    # A row's place in its input settles the order of rows alike, so that a key repeated ever so often can be split.
    order = [F.asc_nulls_first(c) for c in ("g", *keys, "leaf", "input")]
    dealt = leaves.withColumn("input", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("input")
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy("g").orderBy("part")  # a group has at most one run in a partition
    runs = dealt.groupBy("part", "g").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = cut(runs.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = runs.groupBy("part").agg(F.min_by(F.struct("before", "total"), "g").alias("first"), F.max_by("total", "g").alias("last"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, g, done = None, None, 0
        out: list[tuple] = []

        def leave(last: bool) -> None:
            nonlocal out
            before, total = start if not done else (0, 0)
            total = total if not done and not last else end if last else idx - before
            root = own.close(total) if idx == total else None
            if root is not None:
                out.append((g, 0, 0, root, total, part, "root"))
            out += [(g, level, i, h, total, part, "peak") for level, i, h in own.rest()]

        for batch in batches:
            for now, h, part_now, first, last_total in zip(*[batch[c].to_pylist() for c in ("g", "leaf", "part", "first", "last")], strict=True):
                if own is None or now != g:
                    if own is not None:
                        leave(False)
                        done += 1
                    else:
                        part, start, end = part_now, (first["before"], first["total"]), last_total
                    own, g, idx = Range(base), now, 0 if done else start[0]
                own.push(0, idx, h.hex())
                own.made.clear()  # computed again for the proofs
                idx += 1
            yield from _nodes(out).to_batches()
            out = []
        if own is not None:
            leave(True)
            yield from _nodes(out).to_batches()

    parts = (runs.agg(F.max("part")).first()[0] or 0) + 1
    found = cut(dealt.select("g", "leaf", "part").join(F.broadcast(ends), "part").mapInArrow(climb, _NODE))  # a row of three numbers for each partition
    roots, nodes = found.where("kind = 'root'"), found.where("kind = 'peak'")
    peaks = nodes
    while parts > 1:
        parts = -(-parts // FAN)
        found = cut(peaks.withColumn("of", F.floor(F.col("part") / FAN)).groupBy("g", "of").applyInArrow(_merger(base), _NODE))
        roots, peaks = roots.unionByName(found.where("kind = 'root'")), found.where("kind = 'peak'")
        nodes = nodes.unionByName(found.where("kind = 'made'"))
    return Forest(dealt, runs, nodes.select("g", "level", "idx", "hash"), roots.select("g", "hash", "total"), base)


def _merger(base: int) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"] * base ** r["level"])
        g, total, part = rows[0]["g"], rows[0]["total"], rows[0]["part"] // FAN
        own = Range(base)
        for r in rows:
            own.push(r["level"], r["idx"], r["hash"])
        end = (rows[-1]["idx"] + 1) * base ** rows[-1]["level"] >= total
        root = own.close(total) if end else None
        out = [(g, level, i, h, total, part, "made") for level, i, h in own.made]
        out += [(g, level, i, h, total, part, "peak") for level, i, h in own.rest()]
        return _nodes(out + ([(g, 0, 0, root, total, part, "root")] if root is not None else []))

    return merge


_PATH = "array<struct<left: string, right: string>>"


def _asked(trees: Forest, above: DataFrame | None) -> DataFrame:
    """What a partition needs for its proofs, a row for each of its runs: where it begins, the group's root, nodes outside, and the
    way `above` (g, path, top) from the group's root on."""
    base = trees.base

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"part": [], "g": [], "level": [], "idx": []}
            for part, g, before, n, total in zip(*[batch[c].to_pylist() for c in ("part", "g", "before", "n", "total")], strict=True):
                for level, i in _outside(before, before + n - 1, total, base):
                    for k, v in zip(out, (part, g, level, i), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int64()), ("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64())]))

    wanted = trees.runs.where("n < total").select("part", "g", "before", "n", "total").mapInArrow(ask, "part long, g string, level int, idx long")
    met = wanted.join(trees.nodes, ["g", "level", "idx"]).groupBy("part", "g").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("nodes"))
    out = trees.runs.join(met, ["part", "g"], "left").join(trees.roots.select("g", F.col("hash").alias("root")), "g")
    way = [F.lit(None).cast(_PATH).alias("path"), F.col("root").alias("top")] if above is None else ["path", "top"]
    out = out if above is None else out.join(above, "g")
    # Names of their own: both sides of a cogroup come from the same rows.
    return out.select(F.col("part").alias("to"), F.col("g").alias("of"), "before", "total", "nodes", "root", *way)


class Proofs:
    """Ways to the root for the consecutive leaves of a run."""

    def __init__(self, leaves: list[str], run: dict, base: int):
        self.base, self.counts, self.first = base, _levels(run["total"], base), run["before"]
        self.outside = {(x["level"], x["idx"]): x["hash"] for x in run["nodes"] or ()}
        self.own = [(self.first, leaves)]  # of each level: place of the first node, nodes
        for count in self.counts[:-1]:
            first, nodes = self.own[-1]
            lo, up = -(-first // base), []
            for i in range(lo, -(-count // base)):
                at, end = i * base - first, min(i * base + base, count) - first
                if end > len(nodes):
                    break
                up.append(digest("".join(nodes[at:end])))
            self.own.append((lo, up))
        end = None
        for x in reversed(run["path"] or ()):
            end = (x["left"], x["right"], end)
        self.above, self.above_text = end, "".join(x["left"] + x["right"] for x in run["path"] or ())
        self.cache: list[tuple] = [(-1,)] * len(self.counts)

    def node(self, level: int, i: int) -> str:
        first, nodes = self.own[level]
        return nodes[i - first] if first <= i < first + len(nodes) else self.outside[level, i]

    def way(self, level: int, i: int) -> tuple[int, str, tuple | None]:
        """(place, siblings' hashes joined, chain of (left, right, next)) from a node up; neighbours share what lies above them."""
        if self.cache[level][0] != i:
            if level == len(self.counts) - 1:
                self.cache[level] = (i, self.above_text, self.above)
            else:
                _, text, chain = self.way(level + 1, i // self.base)
                lo = i - i % self.base
                left = "".join(self.node(level, j) for j in range(lo, i))
                right = "".join(self.node(level, j) for j in range(i + 1, min(lo + self.base, self.counts[level])))
                self.cache[level] = (i, left + right + text, (left, right, chain))
        return self.cache[level]


def fold(h: str, chain: tuple | None) -> str:
    while chain is not None:
        left, right, chain = chain
        h = digest(left + h + right)
    return h


def _groups(rows: pa.Table, runs: pa.Table, base: int) -> Iterator[tuple[dict, Proofs, int, list[str]]]:
    """(run, proofs, place of its first row in `rows`, leaves) for the runs of a partition, rows in order."""
    at, leaves, names = 0, rows["leaf"].to_pylist(), rows["g"].to_pylist()
    for run in sorted(runs.to_pylist(), key=lambda r: r["of"].encode()):
        end = at
        while end < len(names) and names[end] == run["of"]:
            end += 1
        own = [x.hex() for x in leaves[at:end]]
        yield run, Proofs(own, run, base), at, own
        at = end


def _prove(trees: Forest, above: DataFrame, kept: str, schema: str) -> DataFrame:
    """For every row: the columns `kept`, leaf, subroot, root, proof_sha256, folded_root."""
    base = trees.base

    def work(rows: pa.Table, runs: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}
        changed = rows["tampered"].to_pylist()
        for run, proofs, at, own in _groups(rows, runs, base):
            for k, h in enumerate(own):
                _, text, chain = proofs.way(0, run["before"] + k)
                other = changed[at + k]
                for name, v in zip(out, (h, run["root"], run["top"], digest(text), fold(h if other is None else other.hex(), chain)), strict=True):
                    out[name].append(v)
        give_back()
        return pa.table({kept: rows[kept], **{c: pa.array(v, pa.string()) for c, v in out.items()}})

    return trees.rows.groupBy("part").cogroup(_asked(trees, above).groupBy("to")).applyInArrow(work, schema)


def _ways(trees: Forest) -> DataFrame:
    """(g, path, top) for every leaf of a single tree, whose column `name` becomes g."""
    base = trees.base

    def work(rows: pa.Table, runs: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        paths, tops = [], []
        for run, proofs, _, own in _groups(rows, runs, base):
            for k in range(len(own)):
                chain, path = proofs.way(0, run["before"] + k)[2], []
                while chain is not None:
                    left, right, chain = chain
                    path.append({"left": left, "right": right})
                paths.append(path)
                tops.append(run["top"])
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"g": rows["name"], "path": pa.array(paths, kind), "top": pa.array(tops, pa.string())})

    return trees.rows.groupBy("part").cogroup(_asked(trees, None).groupBy("to")).applyInArrow(work, f"g string, path {_PATH}, top string")


def manifest(docs: DataFrame, tampered: Column | None = None, base: int = BASE, rows: int = ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (FIELDS), a subtree for each source.

    `tampered`: the text to be held against the manifest, null where the row is as it was; by default all are."""
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if tampered is None else tampered
    group = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("source")))  # `-` sorts before `:`
    # One hash of each text; a row's texts stay where they are read.
    given = docs.select("doc_id", group.alias("g"), F.unhex(leaf(fields)).alias("leaf"), F.when(other.isNotNull(), F.unhex(leaf([*fields[:-1], other]))).alias("tampered"))
    sources = forest(given, ["doc_id"], base, rows)
    top = forest(sources.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.unhex("hash").alias("leaf")), ["name"], base, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _prove(sources, cut(_ways(top)), "doc_id", schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """Tampering of the query: where 2 divides the CRC-32 of the decimal doc_id, the text loses its line feeds."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit("")))


#: The same in SQL: leaves, levels of nodes, siblings of every ancestor, and the fold along them.
ORACLE_SQL = """WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT *, (list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])) & 1) = 1 AS hit,
  coalesce(':' || source, '-') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents, t),
l AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
a AS (SELECT g, 0 AS level, i, leaf AS h, n FROM o UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY g, level, i // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS level, i, subroot AS h, n FROM s UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY level, i // 3, n),
p AS (SELECT o.g, o.i, a.level, coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (a.i < o.i // (3 ** a.level)::BIGINT), '') AS l, coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (a.i > o.i // (3 ** a.level)::BIGINT), '') AS r
  FROM o JOIN a ON o.g = a.g AND a.n > 1 AND a.i // 3 = o.i // (3 ** (a.level + 1))::BIGINT GROUP BY ALL),
q AS (SELECT s.g, b.level, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < s.i // (3 ** b.level)::BIGINT), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > s.i // (3 ** b.level)::BIGINT), '') AS r
  FROM s JOIN b ON b.n > 1 AND b.i // 3 = s.i // (3 ** (b.level + 1))::BIGINT GROUP BY ALL),
w AS (SELECT g, i, l, r, row_number() OVER (PARTITION BY g, i ORDER BY level) AS step FROM (SELECT * FROM p UNION ALL SELECT o.g, o.i, q.level + 100, q.l, q.r FROM o JOIN q ON o.g = q.g)),
f AS (SELECT g, i, 0 AS step, coalesce(other, leaf) AS h FROM o UNION ALL SELECT f.g, f.i, f.step + 1, sha256(w.l || f.h || w.r) FROM f JOIN w ON w.g = f.g AND w.i = f.i AND w.step = f.step + 1),
e AS (SELECT g, i, arg_max(h, step) AS folded_root FROM f GROUP BY ALL), x AS (SELECT g, i, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM w GROUP BY ALL)
SELECT o.doc_id, o.leaf, s.subroot, b.h AS root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = b.h AS verified
FROM o JOIN s ON o.g = s.g JOIN e ON o.g = e.g AND o.i = e.i LEFT JOIN x ON o.g = x.g AND o.i = x.i JOIN b ON b.n = 1"""
