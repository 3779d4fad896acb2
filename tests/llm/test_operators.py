"""Training-data operators against brute force, reference libraries and held-out labels, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from hexapla.llm import byte_bpe, common, decontaminate, entry, html_text, licences, line_dedup, order_minhash, projection_dedup, quality, token_counts, toxicity, words
from hexapla.llm.common import connected_components, table

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, doc string, fp long, pos int, id long, k int, hit_id long, gone_id long, `my col` string, `a.b` int, n long, class_id long, score double"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "d", "doc", 1, 2, 3, 4, 5, 6, "m", 7, 8, 9, 0.1) for i, t in rows], DOCS)


LONG = "a long line of many words that goes on and on. " * 4000
AWKWARD = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, "x" * 100_000), (None, "text without an id"), (7, "same text twice"), (7, "same text twice"), (8, "中文 текст ñ é 😀 \x00\x1c"), (9, "﻿   \t")]


def rank_docs(spark):
    return docs_of(spark, AWKWARD)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- line dedup ---------------------------------------------------------------------------------------------------
def plain_line_dedup(rows):
    fold = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(line_dedup.STRIPPED).translate(fold)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := x.strip(line_dedup.STRIPPED).translate(fold)) >= 20 and len(held[k]) >= 3 and max(held[k]) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out[i] = (len(lines), sum(gone), kept)
    return out


def test_line_dedup_equals_plain(spark):
    rng = random.Random(1)
    pool = [f"Line number {k} of the common pool É{k}" for k in range(6)] + ["short", "", "  line NUMBER 1 of the common pool é1 ", "\x0bLine number 2 OF the common pool É2\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(100, None), (101, "")]
    want = plain_line_dedup(rows)
    got = line_dedup.digest(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == {i: (a, b, hashlib.sha256(k.encode()).hexdigest()) for i, (a, b, k) in want.items()}
    kept = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(docs_of(spark, rows)).collect()}
    assert kept == {i: (k, len(k)) for i, (_, _, k) in want.items()}
    for hot in (1, 12):  # no key is broadcast, and some are
        assert {r.d.doc_id: r.kept for r in line_dedup.line_dedup(docs_of(spark, rows), hot=hot).collect()} == {i: k for i, (_, _, k) in want.items()}


def test_line_dedup_is_native(spark):
    plan = line_dedup.digest(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    plan += licences.scan(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_dedup_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = c.execute(line_dedup.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    got = entry.op2_line_dedup(spark, SF)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cur.fetchall())


# --- order minhash ------------------------------------------------------------------------------------------------
def plain_classes(rows):
    """All pairs of rows by a full alignment of labelled five-word shingles."""
    seqs = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_]+", (t or "").lower())
        grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        seen = Counter()
        seqs[i] = [(g, seen.update([g]) or seen[g]) for g in grams]
    parent = {i: i for i in seqs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in seqs:
        for b in seqs:
            if a < b and seqs[a] and seqs[b]:
                x, y = seqs[a], seqs[b]
                row = [0] * (len(y) + 1)
                for s in x:
                    row = [0, *row[1:]] if False else _lcs_row(row, s, y)
                same = row[-1]
                if same / (len(x) + len(y) - same) >= 0.8:
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return {i: root(i) for i in seqs}


def _lcs_row(row, s, y):
    out = [0]
    for j, t in enumerate(y):
        out.append(row[j] + 1 if s == t else max(out[j], row[j + 1]))
    return out


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["new", "other", "word"])
    return " ".join(w)


@pytest.mark.parametrize("hot", [1 << 14, 30])
def test_near_copies_equal_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)  # all keys are broadcast, or the most frequent ones
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(8)]
    rows = []
    for b in base:
        rows += [b, b.upper(), *(edited(rng, b, rng.randint(1, 3)) for _ in range(5))]
        halves = b.split()
        rows.append(" ".join(halves[60:] + halves[:60]))
    rows += ["one two three", "One two, three!", "", None, "...", "..."]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in order_minhash.digest(docs_of(spark, rows)).collect()}
    assert got == plain_classes(rows)
    kept = order_minhash.stage(docs_of(spark, rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))


def test_large_group_finds_its_hub(spark):
    """Edited copies of one text are alike through it only; the star around it keeps them together."""
    rng = random.Random(3)
    base = " ".join(f"b{rng.randrange(500)}" for _ in range(150))
    rows = [(i + 1, edited(rng, base, 4)) for i in range(150)] + [(1000, base)]
    far = [i for i, t in rows if order_minhash.similarity(*(order_minhash.sequence(words.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]) for x in (t, base))) < 0.8]
    got = {r.doc_id: r.class_id for r in order_minhash.digest(docs_of(spark, rows)).collect()}
    assert len({got[i] for i, _ in rows if i not in far}) == 1


def test_large_groups_lose_no_class(spark):
    """Texts that differ too much from their group's hub are still joined through others, as all pairs would."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(4000)]
    rows = []
    for family in range(3):
        texts = [" ".join(rng.choice(vocab) for _ in range(80))]
        for _ in range(59):
            w = (texts[0] if family == 0 else rng.choice(texts)).split()
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        rows += texts
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = list(zip(order, rows, strict=True))
    assert {r.doc_id: r.class_id for r in order_minhash.digest(docs_of(spark, rows)).collect()} == plain_classes(rows)


def test_signature_estimates_overlap():
    a = np.arange(1000, dtype=np.uint64)
    x, y = (np.frombuffer(order_minhash.signature(words.mix(v)), np.uint8) for v in (a, a + np.uint64(111)))
    assert abs((x == y).mean() - 889 / 1111) < 0.1


def test_similarity_of_sequences():
    a = np.arange(1, 101, dtype=np.uint64)
    assert order_minhash.similarity(a, a) == 1.0
    assert order_minhash.similarity(a, a[5:]) == 0.95
    assert order_minhash.similarity(a, np.concatenate([a[50:], a[:50]])) < 0.8


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 200)] + [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(25)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(60):
        for u, v in edges:
            want[u] = want[v] = min(want[u], want[v])
    assert got == want


# --- byte-level BPE -----------------------------------------------------------------------------------------------
def test_bpe_equals_tiktoken(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        raw = f.read()
    own, ranks = byte_bpe.Codec(raw, PATTERN), byte_bpe.parse_ranks(raw)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n\t thereing's0129éüñß%$#!　 中文字😀\x1c") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    for t in [*texts, "a" * 20_000, "<|endoftext|>", " " * 5000, LONG]:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and own.decode(ids) == t.encode()
    docs = rank_docs(spark)
    rows = byte_bpe.digest(docs, RANKS, PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows) == Counter((i, len(other.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in AWKWARD)
    ids = lambda t: np.array(other.encode_ordinary(t or ""), "<u4").tobytes()
    assert Counter((r.doc_id, r.ids_sha256) for r in rows) == Counter((i, hashlib.sha256(ids(t)).hexdigest()) for i, t in AWKWARD)
    some = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.ids_sha256 for r in entry.op4_byte_bpe(spark, SF).collect()} == {i: hashlib.sha256(ids(t)).hexdigest() for i, t in some.items()}
    assert all(bytes(r.decoded).decode() == "".join(t or "" for i, t in AWKWARD if i == r.doc_id)[: len(bytes(r.decoded).decode())] for r in byte_bpe.encode(docs, RANKS, PATTERN).collect())


# --- decontamination ----------------------------------------------------------------------------------------------
def test_decontamination_finds_passages_and_paraphrases(spark):
    rng = random.Random(7)
    vocab = [f"v{int(rng.paretovariate(0.4)) % 4000}" for _ in range(20_000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.randint(15, 60))) for k in range(30)]
    rows = [(i, prose(rng.randint(0, 400))) for i in range(300)]
    want = {}
    for k, t in items:
        w = t.split()
        kind = k % 3
        if kind == 1:
            w = [x for x in w if rng.random() > 0.1]
        host = prose(200).split()
        at = rng.randrange(200)
        rows.append((1000 + k, " ".join([*host[:at], *w, *host[at:]]).upper() if kind == 2 else " ".join([*host[:at], *w, *host[at:]])))
        want[1000 + k] = k
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs_of(spark, rows), bench).collect()}
    assert all(got[i] == [] for i in range(300))
    assert sum(got[i] == [k] for i, k in want.items()) >= 29
    left = decontaminate.stage(docs_of(spark, rows), bench)
    assert left.columns == docs_of(spark, rows).columns and left.count() == sum(x == [] for x in got.values())


def test_rows_without_an_id_are_judged_each_by_its_text(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{int(rng.paretovariate(0.4)) % 4000}" for _ in range(n))
    item, clean = prose(40), prose(60)
    rows = [(None, f"{prose(50)} {item} {prose(50)}"), (None, clean), (None, None), (None, clean), (1, item), (1, "clean"), (2, "clean"), *((100 + i, prose(rng.randint(0, 300))) for i in range(200))]
    left = decontaminate.stage(docs_of(spark, rows), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert left.where("doc_id IS NOT NULL").count() == 201 and not left.where("doc_id = 1").count()
    assert sorted(str(r.text) for r in left.where("doc_id IS NULL").collect()) == sorted(["None", clean, clean])


def test_item_blocks_meet_all_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    many = {(r.doc_id, tuple(r.item_ids)) for r in decontaminate.decontaminate(docs, bench).collect()}
    monkeypatch.undo()
    assert many == {(r.doc_id, tuple(r.item_ids)) for r in decontaminate.decontaminate(docs, bench).collect()}


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for s in a:
            row = _lcs_row(row, s, b)
        assert decontaminate.common_subsequence(a, b) == row[-1]


# --- embeddings ---------------------------------------------------------------------------------------------------
def plain_links(rows):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = {i: i for i, _, _ in rows}
    n = Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x, la in ok:
        for b, y, lb in ok:
            if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (n[i], root(i), root(i) == i) for i in parent}


@pytest.mark.parametrize("dim, depth", [(2, 0), (12, 0), (64, 0), (64, 2)])
def test_embedding_links_equal_all_pairs(spark, dim, depth, monkeypatch):
    monkeypatch.setattr(projection_dedup, "BLOCK", 40)
    if depth:  # as for labels of many vectors
        monkeypatch.setattr(projection_dedup, "plan", lambda *_: (depth, 30))
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((12, dim))
    rows = [(k, (centres[k % 12] * rng.uniform(0.5, 3) + rng.standard_normal(dim) * 0.25).tolist(), int(k % 12 % 3)) for k in range(240)]
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * dim, 0), (403, [float("nan")] * dim, 0), (404, [None] * dim, 0), (405, rows[0][1], None), (406, rows[0][1] + [1.0], 0), (407, [float("inf")] * dim, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projection_dedup.near_duplicates(df).collect()}
    assert got == plain_links(rows)


def test_collision_counts_equal_plain_windows():
    rng = np.random.default_rng(5)
    for dim in (3, 40):
        u = rng.standard_normal((60, dim))
        u[30:] = u[:30] + rng.standard_normal((30, dim)) * 0.05
        u /= np.linalg.norm(u, axis=1)[:, None]
        width, least = projection_dedup.calibration(dim, 0.93)
        at = u @ projection_dedup.directions(dim)
        count = (np.abs(at[:, None] - at[None]) <= width + 1e-9).sum(axis=2)
        got = {(int(a), int(b)) for i, j in projection_dedup.collisions(u, u, 0.93) for a, b in zip(i, j, strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(count >= least)), strict=True))


@pytest.mark.parametrize("n", [1000, 4000])
def test_few_pairs_pass_the_count_and_no_link_is_lost(n):
    """On planted neighbours just over the threshold and unrelated vectors, as they are compared within one label."""
    rng = np.random.default_rng(n)
    u = rng.standard_normal((n, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    side = rng.standard_normal((n // 2, 64))
    side -= (side * u[: n // 2]).sum(axis=1)[:, None] * u[: n // 2]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9301, 0.95, n // 2)[:, None]
    u[n // 2 :] = cosine * u[: n // 2] + np.sqrt(1 - cosine**2) * side
    found = sum(len(i) for i, _ in projection_dedup.collisions(u, u, 0.93))
    i, j = projection_dedup._linked(u, u, True, 0.93)
    want = np.argwhere(np.triu(u @ u.T >= 0.93, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(map(tuple, want.tolist())) and len(want) >= n // 2
    assert found / n < 0.01 * n


def test_grids_part_few_linked_pairs():
    """The chance that a pair at the threshold shares no list is what the plan says."""
    rng = np.random.default_rng(3)
    u = rng.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    side = rng.standard_normal((4000, 64))
    side -= (side * u).sum(axis=1)[:, None] * u
    w = 0.93 * u + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1)[:, None]
    n = 1_000_000
    depth, lists = projection_dedup.plan(64, n, 0.93)
    a, b = (projection_dedup.cells(x, n, 0.93) for x in (u, w))
    assert depth >= 4 and (a == b).any(axis=1).all() and a.shape == (4000, lists)
    assert (a[:2000] == a[2000:]).mean() < 0.01  # unrelated vectors seldom meet


def test_embedding_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    cur = c.execute(projection_dedup.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, entry.op7_embedding_near_dup(spark, SF).select(names).collect())) == sorted(cur.fetchall())


def test_embedding_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in projection_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 0, None)], key=str)
    assert projection_dedup.near_duplicates(df.limit(0)).count() == 0


# --- classifiers --------------------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    seen = labels.where("doc_id % 2 = 0")
    got = quality.score(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.accepted == (r.quality == 1) for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_letter_codes_of_many_words_are_made_at_once(monkeypatch):
    """A call a word was half of the scoring's time."""
    some = ["idiot", "", "^großé", "中文𝒳", "ñ", "x" * 25, "ab^c"]
    want = np.zeros((len(some), 25), np.int64)
    for i, w in enumerate(some):
        want[i, : len(w)] = [x - 96 if 97 <= x <= 122 else toxicity.LETTERS - 1 if chr(x) == toxicity.ANCHOR else 27 + x % (toxicity.LETTERS - 28) for x in map(ord, w)]
    calls, read = [], np.frombuffer
    monkeypatch.setattr(toxicity.np, "frombuffer", lambda *a, **k: calls.append(1) or read(*a, **k))
    assert (toxicity._codes(some, 25) == want).all() and len(calls) == 1
    assert toxicity._codes([], 0).shape == (0, 0) and toxicity._codes([""], 3).tolist() == [[0, 0, 0]]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) >= 0.85 and np.mean(false) <= 0.04


def test_sentence_margins_equal_plain_sums():
    rng = random.Random(12)
    for _ in range(50):
        words = ["".join(rng.choice("abc") for _ in range(3)) + rng.choice(["", "", "", "."]) for _ in range(rng.randint(1, 100))]
        value = {w: rng.uniform(-1, 1) for w in words}
        want, now = [], []
        for w in words:
            now.append(value[w])
            if w[-1] in toxicity.STOPS or len(now) == toxicity.LONG:
                want.append(sum(now) / len(now) ** 0.5 + 0.5)
                now = []
        want += [sum(now) / len(now) ** 0.5 + 0.5] if now else []
        parts = np.array([value[w] + (toxicity._END if w[-1] in toxicity.STOPS else 0) for w in words])
        assert toxicity.sentence_margins(parts, 0.5) == pytest.approx(want, abs=1e-6)
    assert [len(s) for s in toxicity.sentences("one two. three\nfour! " + "xx " * 31)] == [2, 2, 30, 1]


def test_sentence_kernel_is_what_the_table_scores():
    """A trained table's margins against the kernel expansion that it stands for, on sentences with gapped insults."""
    rng = random.Random(13)
    plain = [f"w{rng.randrange(300)}a{rng.randrange(9)}z" for _ in range(300)]
    clean = [" ".join(rng.choice(plain) for _ in range(12)) + "." for _ in range(120)]
    toxic = [" ".join([*(rng.choice(plain) for _ in range(6)), rng.choice(["moronic fool", "m-o-r-o-n-i-c fool", "morxonic fo0l", "m o r o n i c fool"]), *(rng.choice(plain) for _ in range(6))]) + "." for _ in range(60)]
    model = toxicity.train([(i, t, int(i >= 120)) for i, t in enumerate(clean + toxic)])
    top = toxicity.Scorer(model).top(["you mor.onic foool there.", "nothing of the sort here.", ""])
    z = np.column_stack([top, np.ones(3)]) @ model.logistic
    assert z[0] > z[1] and (top[2] == model.bias).all()
    words = toxicity.sentences("moronic fool.")[0]
    codes, weights = toxicity._subsequences([toxicity.ANCHOR + w for w in words])
    by_hand = sum(float((model.table[c] * weights).sum()) / n for c, n in zip(codes, toxicity._norms(codes, weights), strict=True)) / 2**0.5
    assert toxicity.sentence_margins(model.parts(words), 0.0)[0] == pytest.approx(by_hand, rel=1e-4)


def test_kernel_equals_enumeration():
    from itertools import combinations

    def plain(a, b):
        def phi(w):
            out = Counter()
            for i, j, k in combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = phi(a), phi(b)
        return sum(v * y[u] for u, v in x.items())

    some = ["idiot", "idxiot", "aaaa", "abcabcabc", "ab", "thereabouts"]
    codes, weights = toxicity._subsequences(some)
    phi = np.zeros((len(some), toxicity.LETTERS**3), np.float32)
    np.add.at(phi, (np.arange(len(some))[:, None], codes), weights)
    phi[:, 0] = 0
    norms = toxicity._norms(codes, weights)
    for i, a in enumerate(some):
        assert norms[i] ** 2 == pytest.approx(plain(a, a), rel=1e-5)
        for j, b in enumerate(some):
            assert float(phi[i] @ phi[j]) == pytest.approx(plain(a, b), rel=1e-4, abs=1e-6)
    assert "idiot" in toxicity.tokens("you I d i o t now") or "iidiot" in "".join(toxicity.tokens("you I d i o t now"))


# --- tokens, pages, licences --------------------------------------------------------------------------------------
@pytest.mark.parametrize("rule", ["start", "most"])
def test_token_attribution_equals_plain(rule):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = token_counts.Encoder(f.read(), PATTERN)
    rng = random.Random(10)
    for _ in range(200):
        text = "".join(rng.choice("ab cé😀\n\n the") for _ in range(rng.randint(0, 60)))
        cuts = sorted({rng.randint(0, len(text)) for _ in range(4)} | {0, len(text)})
        spans = np.array(list(zip(cuts[:-1], cuts[1:], strict=True))[:3] or [(0, 0)])
        starts, ends = enc.spans(text)
        got, outside, _ = token_counts.attribute(starts, ends, text, spans, rule)
        byte_at = [len(text[:k].encode()) for k in range(len(text) + 1)]
        want = [0] * len(spans)
        none = 0
        for s, e in zip(starts, ends, strict=True):
            if rule == "start":
                c = max(k for k in range(len(text)) if byte_at[k] <= s)
                own = next((k for k, (a, b) in enumerate(spans) if a <= c < b), None)
            else:
                share = [max(0, min(e, byte_at[b]) - max(s, byte_at[a])) for a, b in spans]
                own = int(np.argmax(share)) if max(share) else None
            if own is None:
                none += 1
            else:
                want[own] += 1
        assert got.tolist() == want and outside == none


def test_main_text():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=1>m</a></nav><div id=main><h2>Title &amp; more</h2><section><p>Paragraph one is long enough to be text.
    <p>Second paragraph with <a href=x>a link</a> inside it.</section><section><p>Third one<br>here is text with enough length.</p><table><tr><td>a<td>b<tr><td>c</table></section></div>
    <div class="comments"><p>Nice post!</div><aside>side</aside><div class="cookie-notice">We use cookies</div><script>var t="</p>";</script><form>name</form></body>"""
    assert html_text.extract(page) == "Title & more\nParagraph one is long enough to be text.\nSecond paragraph with a link inside it.\nThird one here is text with enough length.\na b\nc"
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("<p>a<p>b") == "a\nb"
    assert html_text.extract("<body><article><h1>T</h1><p>x" + "<div>" * 5000) == "T\nx"


def test_main_text_under_suspect_names():
    text = "<p>" + "Long article text of many words, with a comma. " * 6 + "</p>"
    links = "<ul>" + "<li><a href=x>other story</a></li>" * 6 + "</ul>"
    side = f"<div class=sidebar>{links}</div>"
    talk = "<div class=comments>" + "<div><a href=u>joe</a><p>I like this a lot, thanks.</p></div>" * 5 + "</div>"
    whole = [
        f"<div id=page class='with-sidebar'><article><h1>T</h1>{text * 3}</article>{side}</div>",
        f"<nav><a href=1>m</a></nav><div class='elementor-widget-container'><h2>T</h2>{text * 3}</div>{side}",
        f"<div class=elementor-widget><h2>T</h2>{text}</div><div class=elementor-widget>{text}</div><div class=elementor-widget>{text}</div>",
        f"<form id=aspnet><div><h1>T</h1>{text * 3}</div></form>{side}",
        f"<article><h1>T</h1><div>{text * 3}</div><div>{links}</div></article>{talk}",
        f"<div><h1>T</h1><div>{text * 3}</div></div>{talk}",
    ]
    for page in whole:
        got = html_text.extract(f"<html><body>{page}</body></html>")
        assert got.count("Long article text") == 18 and got.startswith("T\n") and "joe" not in got and "other story" not in got
    assert html_text.extract(f"<body><article><h1>T</h1><p>short<div>{text * 3}</div><p>end</article>").endswith("\nend")


def test_density_sums_equal_recursion():
    """Densities and sums against a plain walk over each node's subtree, on pages of the tables."""
    import math

    def plain(tree, i, ratio, suspect):
        below = [k for k in range(len(tree.tag)) if _ancestor(tree, k, i) and not tree.noise[k]]
        linked = lambda k: any(tree.tag[a] == "a" for a in _up(tree, k))
        size = lambda text: len(text) - text.count(" ")
        w = lambda k: html_text.NAMED if suspect[k] else 1.0
        c = sum(size(x) * w(k) for k, x, _ in tree.pieces if k in below) / w(i)
        lc = sum(size(x) * w(k) for k, x, _ in tree.pieces if k in below and linked(k)) / w(i)
        t = max(1.0, sum(w(k) for k in below if k != i) / w(i))
        lt = sum(w(k) for k in below if k != i and linked(k)) / w(i)
        if c <= 0:
            return 0.0
        if not lc and c <= 1:
            return c * w(i)
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return w(i) * c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0) / max(math.log(base), 0.05)

    pages = ["<body><nav><a href=1>one</a> two</nav><div><h1>T</h1><p>some text <a href=2>and a link</a> more<ul><li>a<li>b c</ul></div><footer><p>small <b>print</b></footer>", "<p>x", "text <b>only</b>", "<div class=ad>buy <a href=1>now</a></div><main><p>word word word</main>"]
    for page in pages:
        tree = html_text._Tree()
        tree.feed(page)
        tree.close()
        d = html_text.Densities(tree)
        ratio = d.links[d.body] / d.chars[d.body]
        want = [plain(tree, i, ratio, d.suspect) for i in range(len(tree.tag))]
        assert d.density == pytest.approx(want, rel=1e-9)
        for i in range(len(tree.tag)):
            own = sum(len(x) - x.count(" ") for k, x, _ in tree.pieces if k == i)
            children = sum(want[k] for k in range(1, len(tree.tag)) if tree.parent[k] == i)
            assert d.sums[i] >= children * (1 - 1e-9) and (own or d.sums[i] == pytest.approx(children))


def _up(tree, k):
    while k > 0:
        yield k
        k = tree.parent[k]


def _ancestor(tree, k, i):
    return k == i or i == 0 or i in _up(tree, k)


def test_density_decides_without_article_tags(spark):
    """The same text when article and main are plain div elements, on every page."""
    rename = lambda h: re.sub(r"<(/?)(article|main)\b", r"<\1div", h or "")
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    for h in pages:
        inner = re.search(r"(?s)<article>(.*?)</article>", h)
        got = html_text.extract(h)
        assert got == html_text.extract(rename(h))
        assert inner is None or got == html_text.extract(f"<body>{inner.group(1)}</body>")


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "   \n "), (4, "u", "no markup &amp; more"), (5, "u", "<p>same<p>text"), (5, "u", "<p>same<p>text"), (6, "u", "<script>only()</script>"), (7, "u", "<p>" + "long " * 200_000), (8, "u", "<nav>x</nav>"), (None, "u", "<p>a"), (9, "u", "<![x[ <p>broken")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars long, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(df).collect()), key=str)
    want = {1: "", 2: "", 3: "", 4: "no markup & more", 5: "same\ntext", 6: "", 7: ("long " * 200_000).strip(), 8: "x", None: "a"}
    assert [g for g in got if g[0] != 9] == sorted(((i, want[i], len(want[i])) for i, _, _ in rows if i != 9), key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_licence_model_on_wordings_left_out():
    """Measured on whole wordings, and names of licences, that the scoring model never saw."""
    held = licences.model(()).held_out
    assert held["notices found"] >= 0.65 and held["of what was found, right"] >= 0.98
    assert held["no licence, taken for one"] <= 0.02 and held["other licences, taken for a family"] == 0 and held["other licences, marked"] >= 0.9


def test_licence_sums_equal_plain_model(spark):
    """The joined and summed table against the model's weights, line by line, on the tables."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    m = licences.model(licences.sample(docs))
    want = {}
    gate = re.compile(licences._any_of(m.gate).replace("\\p{L}\\p{N}", "\\w"))
    for r in docs.select("doc_id", "text").collect():
        for line in r.text.split("\n"):
            for part in {line, *re.split(r"(?<=[.!?;])\s+", line)}:
                w = licences.words(part)
                if not gate.search(part.lower()) or not w:
                    continue
                z = m.intercept + sum((m.weights[g] for g in licences.grams(w) if g in m.weights), np.zeros(len(licences.CLASSES)))
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                family = licences.CLASSES[int(p[:-2].argmax())]
                if p[:-2].max() >= m.least and licences.confirms(w, family):
                    want.setdefault(r.doc_id, set()).add(family)
    got = {r.doc_id: set(r.families) for r in licences.scan(docs).collect() if r.families}
    assert got == want and len(got) >= 20


def test_licences(spark):
    rows = [(0, "foo\nLicensed under the Apache License, Version 2.0."), (1, "Released under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "He renewed his fishing licence at the office."), (5, None), (6, "SPDX-License-Identifier: BSD-3-Clause\nReleased under the MIT License.")]
    got = {r.doc_id: r.families for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {0: ["apache-2.0"], 1: ["mit"], 2: ["gpl-3.0"], 3: ["cc-by-nc"], 4: [], 5: [], 6: ["bsd", "mit"]}


def test_licences_without_stems(spark):
    found = {"Distributed under the GPLv3": "gpl-3.0", "Source code: Apache 2.0": "apache-2.0", "Published under CC BY-SA 4.0": "cc-by-sa", "CC0 1.0": "cc0", "Lizenz: MIT": "mit", "Distributed under MIT": "mit", "Publié sous CC BY 4.0": "cc-by"}
    none = ["Er ging mit dem Hund nach Hause", "Mit freundlichen Grüßen, Anna", "ER KAM MIT DEM HUND UNTER DIE BRÜCKE", "Das Kind spielte mit 2 Freunden und 3 Katzen", "He got a degree from MIT", "The general public has 3 doors", "The Apache lived in the plains"]
    rows = list(enumerate([*found, *none]))
    got = {r.doc_id: r.families for r in licences.scan(docs_of(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == [[f] for f in found.values()] + [[] for _ in none]


def test_licences_named_without_a_grant(spark):
    rows = [
        (0, "Our MIT graduates all hold a driving license."), (1, "The essay compares the Apache License with the MIT License and finds neither better."), (2, "This text is NOT licensed under CC BY 4.0."), (3, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files (the Software), to deal in it"),
        (4, "This program is made available under the terms of the Eclipse Public License 2.0"), (5, "Dieses Werk ist lizenziert unter der GNU General Public License, Version 3."), (6, "Licensed under the Foo Bar License 3.1"), (7, "Prose first. Licensed under CC BY 4.0. More prose that goes on about other things."), (8, "The history of the MIT License began long ago."),
    ]
    got = {r.doc_id: (r.families, r.n_unknown) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {0: ([], 0), 1: ([], 0), 2: ([], 0), 3: (["mit"], 0), 4: ([], 1), 5: (["gpl-3.0"], 0), 6: ([], 1), 7: (["cc-by"], 0), 8: ([], 0)}


def test_wrapped_licences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction, including without limitation the rights"
    rows = [(0, gpl), (1, mit), (2, f"{gpl}\n\n{mit}"), (3, "one\nLicensed under the MIT License\ntwo"), (4, "a GNU General Public License\n\nversion 3"), (5, "Licensed under GPLv3\nLicensed under the Apache License 2.0")]
    got = {r.doc_id: (r.families, r.n_notices) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {0: (["gpl-3.0"], 1), 1: (["mit"], 1), 2: (["gpl-3.0", "mit"], 2), 3: (["mit"], 1), 4: ([], 0), 5: (["apache-2.0", "gpl-3.0"], 2)}


# --- all of them --------------------------------------------------------------------------------------------------
def runs(spark, docs, labels, bench):
    return {
        "quality": quality.score(docs, labels), "lines": line_dedup.digest(docs), "near": order_minhash.digest(docs), "bpe": byte_bpe.digest(docs, RANKS, PATTERN), "toxic": toxicity.score(docs, labels),
        "leaks": decontaminate.decontaminate(docs, bench), "tokens": token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN), "licences": licences.scan(docs),
        "pages": html_text.extract_pages(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"), "text")),
        "stage1": quality.stage(docs, labels), "stage2": line_dedup.stage(docs), "stage6": decontaminate.stage(docs, bench),
    }


def test_awkward_rows_and_clashing_names(spark):
    docs = rank_docs(spark)
    labels = labels_of(spark, [(1, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1), (99, 1, 1)])
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "same text twice")], "item_id long, text string")
    got = {name: out.collect() for name, out in runs(spark, docs, labels, bench).items()}
    for name, rows in got.items():
        assert len(rows) == (len(AWKWARD) if name != "stage6" else len(AWKWARD) - 2), name
    by_id = lambda name: Counter((r.doc_id, *r[1:]) for r in got[name])
    # Two labelled documents aren't enough: every score is 0.5.
    assert by_id("quality") == Counter((i, 0.5, 0.5, 0.5, True) for i, _ in AWKWARD)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert by_id("lines") == Counter((i, (t or "").count("\n") + 1, 0, sha(t)) for i, t in AWKWARD)
    assert by_id("near") == Counter((i, i, True) for i, _ in AWKWARD)
    assert Counter((r.doc_id, r.contaminated, tuple(r.item_ids), r.best_ratio) for r in got["leaks"]) == Counter((i, i == 7, (3,) * (i == 7), 1.0 * (i == 7)) for i, _ in AWKWARD)
    assert all(r.families == [] and r.n_notices == r.n_unknown == 0 and r.probability == 0 for r in got["licences"])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got["toxic"])
    for name in ("stage1", "stage2", "stage6"):
        rows = [r.asDict() for r in got[name]]
        assert Counter((r["doc_id"], r["text"] or "") for r in rows) == Counter((i, t or "") for i, t in AWKWARD if name != "stage6" or i != 7)
        assert all((r["my col"], r["a.b"], r["d"], r["fp"], r["score"]) == ("m", 7, "d", 1, 0.1) for r in rows)
    assert {r.doc_id for r in order_minhash.stage(docs).collect()} == {i for i, _ in AWKWARD}


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    labels = labels_of(spark, [(1, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1), (99, 1, 1)])
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "same text twice")], "item_id long, text string")
    for name, some in (("rows", True), ("none", False)):
        for t, df in (("documents", rank_docs(spark)), ("labels", labels), ("benchmark", bench)):
            (df if some else df.limit(0)).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in AWKWARD if i != 7)  # 7 is a benchmark item
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels, bench = labels_of(spark, []), spark.createDataFrame([], "item_id long, text string")
    for name, out in runs(spark, docs, labels, bench).items():
        assert out.count() == 0, name
    full = table(spark, SF, "documents")
    assert decontaminate.decontaminate(full, bench).where("contaminated").count() == 0
    assert quality.stage(full, labels).count() == full.count()


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert good - {r.doc_id for r in corpus_pipeline.keep_good(spark, table(spark, SF, "documents"), SF).collect()} == set()


def test_latent_space_is_fitted_on_every_document(spark):
    """More documents than a partial sum takes; the vectors are those of all passages, summed in one piece."""
    from hexapla.llm import decontaminate

    n = 25_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha w"), F.col("id") % 50, F.lit(" v"), F.col("id") % 7).alias("text")).repartition(6)
    seen = []
    whole = decontaminate._per_partition
    decontaminate._per_partition = lambda d, *a: seen.append(d.count()) or whole(d, *a)
    try:
        idf = decontaminate.term_weights(docs)
        latent = decontaminate.latent_terms(docs, idf)
    finally:
        decontaminate._per_partition = whole
    assert seen == [n, n] and latent.shape[1] > 1
