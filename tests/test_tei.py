"""The pull parser of TEI files against a whole tree, on malformed and on large files."""

import random
import re
import subprocess
import sys
import unicodedata
import xml.etree.ElementTree as ET


from hexapla.sources import readers


def by_tree(xml):
    """The same from a tree in memory."""
    root = ET.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    body = root.find(".//body")
    body = root if body is None else body

    def flat(e):
        now = e.text or ""
        for child in e:
            if child.tag in readers.TEI_SKIPPED:
                now += child.tail or ""
            else:
                yield now
                yield from flat(child)
                now = child.tail or ""
        yield now

    for path in readers.TEI_SECTIONS:
        if found := body.findall(f".//{path}"):
            break
    kept = [s for s in found if (s.get("n") or "").strip()]
    return [(i, s.get("n").strip(), re.sub(r"\s+", " ", unicodedata.normalize("NFC", " ".join(flat(s))).replace("﻿", "").replace("​", "")).strip()) for i, s in enumerate(kept)]


def some_xml(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return rng.choice(["text ", "é&amp;b", "é ", "\n  ", "", "<!-- no -->x", "﻿", "中"])
    tag = rng.choice(["div", "div", "div1", "p", "note", "ref", "body", "seg"])
    attributes = "".join(rng.choice(["", f' {k}="{v}"']) for k, v in [("n", rng.choice(["1", "2", " 3 ", "", "a.b"])), ("type", rng.choice(["textpart", "section"])), ("subtype", "section")])
    return f"<{tag}{attributes}>" + "".join(some_xml(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>" + rng.choice(["", "tail", " tail "])


def test_pull_parser_equals_the_tree():
    rng = random.Random(12)
    for _ in range(600):
        xml = f"<TEI{rng.choice(['', ' xmlns=\"http://www.tei-c.org/ns/1.0\"'])}>" + "".join(some_xml(rng) for _ in range(rng.randint(0, 5))) + "</TEI>"
        assert sorted(readers.tei_sections(xml)) == by_tree(xml), xml
        assert sorted(readers.tei_sections(xml.encode())) == by_tree(xml)


def test_malformed_files_are_rejects(spark):
    good = "<TEI><text><body><div type='textpart' n='1'>one</div></body></text></TEI>"
    rows = [("a", good), ("b", "<TEI><body><div n='1'>lost</div>"), ("c", ""), ("d", "no xml"), ("e", "<TEI><body><div n='1'>&unknown;</div></body></TEI>"), ("f", None), ("g", "<!DOCTYPE TEI SYSTEM 'x.dtd'><TEI><body><div n='1'>&unknown;</div></body></TEI>")]
    files = spark.createDataFrame([(w, "grc", x) for w, x in rows], "work string, side string, xml string").repartition(2)
    assert [(r.work, r.text) for r in readers.read_tei(files).collect()] == [("a", "one")]
    assert {r.work for r in readers.tei_rejects(files).collect()} == set("bcdefg")
    assert all(r.error for r in readers.tei_rejects(files).collect())


def test_files_with_their_own_encoding(spark, tmp_path):
    text = "<?xml version='1.0' encoding='iso-8859-1'?><TEI><body><div n='1'>café</div></body></TEI>"
    (tmp_path / "w1.xml").write_bytes(text.encode("latin-1"))
    (tmp_path / "other.txt").write_text("no")
    assert [(r.work, r.side, r.text) for r in readers.read_tei(readers.tei_files(spark, str(tmp_path), "fra")).collect()] == [("w1", "fra", "café")]


_LARGE = """
import resource, sys
from hexapla.sources.readers import tei_sections
section = b"<div type='textpart' n='%d'><p>" + b"some words of a long section <note>gone</note>" * 2000 + b"</p></div>"
xml = b"<TEI><body>" + b"".join(section % i for i in range(2200)) + b"</body></TEI>"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(t) > 0 for _, _, t in tei_sections(xml))
print(len(xml), n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_a_large_file_takes_little_memory():
    done = subprocess.run([sys.executable, "-c", _LARGE], capture_output=True, text=True, timeout=200, cwd=readers.__file__.rsplit("/hexapla/", 1)[0])
    size, n, grown = map(int, done.stdout.split())
    assert size > 200_000_000 and n == 2200 and grown < 30_000  # kB, beside the file itself
