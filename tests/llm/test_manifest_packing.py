"""The Merkle manifest against plain recursion, packing against the library's ids and the rules of its windows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hexapla.llm import merkle, packing

DOC = "doc_id long, source string, lang string, n_chars long, text string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, base):
    """(root, for every node its list of (left, right))."""
    ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_groups = [], []
        for at in range(0, len(nodes), base):
            run = nodes[at : at + base]
            for k in range(len(run)):
                for i in groups[at + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h("".join(run)))
            up_groups.append([i for g in groups[at : at + base] for i in g])
        nodes, groups = up, up_groups
    return nodes[0], ways


def plain_manifest(rows, tamper, base):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subtrees, out = [], []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subtrees.append(tree([leaf(*r) for r in by[s]], base))
    root, tops = tree([t[0] for t in subtrees], base)
    for s, (subroot, ways), top in zip(sources, subtrees, tops, strict=True):
        for r, way in zip(by[s], ways, strict=True):
            now = leaf(*r[:4], tamper(r)) if tamper(r) is not None else leaf(*r)
            for left, right in way + top:
                now = h(left + now + right)
            out.append((r[0], leaf(*r), subroot, root, h("".join(a + b for a, b in way + top)), now, now == root))
    return out


def tamper(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None and "\n" in r[4]
    return r[4].replace("\n", "") if hit else None


def some_docs(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "ü", "", None, f"one{i}"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "a\nb", "x" * 50, "\n", "ä\nß"])) for i in range(n)]
    return rows + [(None, "hot", None, None, None), (None, None, None, None, "a\nb"), (7, "hot", "en", 7, "a\nb"), (7, "hot", "en", 7, "a\nb"), (7, "hot", "en", 7, "c")]


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("n", "base", "rows"), [(0, 3, 5), (40, 3, 4), (150, 3, 1), (90, 2, 7), (60, 3, 1000)])
def test_manifest_equals_plain_recursion(spark, n, base, rows):
    docs = some_docs(n, n)
    df = spark.createDataFrame(docs, DOC).repartition(3).withColumns({c: F.lit(1) for c in ("g", "leaf", "at", "part", "root", "input")})
    assert as_rows(merkle.manifest(df, merkle.without_newlines(), base, rows)) == sorted(plain_manifest(docs, tamper, base), key=str)


def test_manifest_of_few_rows_and_none(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], DOC)).first()
    own = leaf(1, None, None, None, None)
    assert (one.leaf, one.subroot, one.root, one.proof_sha256, one.folded_root, one.verified) == (own, own, own, h(""), own, True)


def test_tampering_is_found(spark):
    docs = [(i, "s", "en", 1, f"line {i}\nend") for i in range(30)]
    out = merkle.manifest(spark.createDataFrame(docs, DOC), merkle.without_newlines(), rows=4).collect()
    assert {r.doc_id for r in out if not r.verified} == {i for i in range(30) if zlib.crc32(str(i).encode()) % 2 == 0}
    assert merkle.manifest(spark.createDataFrame(docs, DOC), rows=4).where("verified").count() == 30


def test_mountain_range_carries_whatever_its_parts():
    rng = random.Random(4)
    for _ in range(200):
        n, base = rng.randint(1, 60), rng.choice([2, 3, 5])
        leaves = [h(str(i)) for i in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randint(0, 9)))})
        whole, root = merkle.Range(base), None
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = merkle.Range(base)
            for i in range(a, b):
                part.push(0, i, leaves[i])
            root = part.close(n) if b == n else None
            if root is None:
                for level, i, x in sorted(part.rest(), key=lambda p: p[1] * base ** p[0]):
                    whole.push(level, i, x)
                root = whole.close(n) if b == n else None
        assert root == tree(leaves, base)[0]


# --- packing ------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def held_to_the_rules(pieces, docs, library, length):
    """Whole ids, in pieces of documents and windows without gaps; what isn't full is a power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == {d for d, *_ in docs}
    for doc, *_, text in docs:
        ids, at = library(text), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    short = [s for s in sizes if s != length]
    assert max(sizes, default=0) <= length and all(s & (s - 1) == 0 for s in short) and len(set(short)) == len(short) and sum(short) < length


@pytest.mark.parametrize(("length", "most", "parts"), [(16, 2, 3), (64, 4, 70), (2048, 32, 2), (8, 1, 5)])
def test_windows_are_full_and_ids_whole(spark, library, length, most, parts):
    rng = random.Random(length)
    words = ["the", "Café", "don't", "x" * 30, "straße", "日本語", "…", "42", "<|endoftext|>", "ź", "\x1c", " "]
    texts = [None, "", " \n\t ", "word " * 400, "a" * 5000, *(rng.choice([" ", "\n", "\t", "  "]).join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120))]
    docs = [(i, "s", None, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, DOC).repartition(parts).withColumns({c: F.lit("x") for c in ("ids", "part", "place", "start", "sequence_id")})
    out = packing.pack(df, WORD_BPE, length, most)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held_to_the_rules(out.collect(), docs, library, length)


def test_awkward_tables_are_packed(spark):
    assert packing.pack(spark.createDataFrame([], DOC), WORD_BPE).count() == 0
    out = packing.pack(spark.createDataFrame([(None, None, None, None, None), (3, None, None, None, "a"), (3, None, None, None, "a"), (None, None, None, None, "a")], DOC), WORD_BPE).collect()
    assert {(p.doc_id, p.doc_tokens) for p in out} == {(3, 2), (None, 1), (None, 2)}  # seven ids, in windows of 4, 2 and 1
    assert sum(p.length for p in out) == 7 and len({(p.sequence_id, p.offset) for p in out}) == len(out)


def test_a_document_is_cut_only_to_fill_a_window():
    packer = packing.Packer(10, 2, 0)
    ids = lambda n: b"\0\0\0\0" * n
    for doc, n in enumerate([6, 5, 4, 3, 9]):
        packer.put(doc, 0, ids(n), n)
    # 4 joins 6 exactly; 3 joins 5; 9 fits nowhere, so a new window is opened
    assert [r[:3] for r in packer.rows] == [(0, 0, 6), (2, 0, 4)]
    packer.put(5, 0, ids(8), 8)  # two are open: the fullest (9) is filled up with one token
    assert [r[:3] for r in packer.rows][2:] == [(4, 0, 9), (5, 0, 1)]


def test_words_are_encoded_as_whole_texts_are(library):
    encode, rng = packing.Encoder(WORD_BPE), random.Random(5)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), 0x2000, 0x2028, 0x3000, 0x130, 0x3A3, 0x1F600, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x200B, 0xFEFF)]
    for _ in range(400):
        text = "".join(rng.choices([*letters, *[" ", "\n", "\t", "'s", "the", "É"] * 15], k=rng.randint(0, 60)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text)[:-1].tolist(), ascii(text)
