"""Licence scans by a trained paragraph classifier (native: DataFrame functions only on the data's path).

A paragraph is a sentence of a line, or a line with those that follow it, up to `SPAN` words, a line without words or one of
more than `WRAPPED` characters, for notices wrapped over lines. A multinomial logistic regression on sparse word
unigrams and bigrams gives a probability for each licence family, for licences outside of them (`UNKNOWN`) and for no
licence (`NONE`). It learns from `licence_texts` and, for no licence, from lines of the corpus itself: at most `LINES` of those
`DOCS` documents whose text has the smallest hash, without the lines in which words of licences stand together. Weights that speak for a
licence by less than `LEAST` are cut off, which makes the table sparse.

Probabilities are calibrated on wordings that were left out as a whole: each wording is scored by a model that saw none of
its variants, and these scores set the temperature, the least probability of a family, such that `PRECISION` of what
passes is right with notices of other licences and prose among it, and the least probability of any licence.

A prediction counts when its probability reaches the first and a template of the family confirms it. Either `OVERLAP` of the paragraph's
bigrams are in the family's full text; or a name of the family stands in a form of short notices that isn't negated. Other paragraphs
in such a form, around a word for licence, whose probability of any licence reaches the second are counted as unknown licences.
Full texts are confirmed in whole paragraphs only. A line's own notice answers for the paragraphs that hold it; overlapping ones count once, by the first.

Only lines with a word that the table has something to say for are classified: each weight that speaks for a licence needs such a word,
so no other line can reach any probability. Weights, some thousand numbers, are broadcast and joined to the n-grams of
these lines, whose sums are formed with map-side combine.

Defined results: null and empty texts have no licence; all rows of a doc_id count together, and each gets the
result; rows with a null doc_id count together too; of equal probabilities the first family in order counts; an empty table
gives an empty one; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from hexapla.llm.licence_texts import ALONE, FULL, GRANTS, MENTIONS, NAMES, NOTICES, OTHERS, OTHERS_HELD, PROSE

UNKNOWN, NONE = "unknown", "none"
CLASSES = [*NOTICES, UNKNOWN, NONE]
SPAN, WRAPPED = 40, 400
DOCS, LINES = 300, 1500
LEAST, OVERLAP, FIXED, PRECISION = 0.25, 0.6, 6, 0.98
STEPS, FOLDS, RIDGE, PRIOR = 200, 3, 2e-5, 8
_WORD = r"[\p{L}\p{N}]+"
#: Function words and words of examples, which are no n-gram on their own.
FUNCTION = frozenset("""a an and any are as at be been below but by can do either for from had has have he her his i if in into is it its may me my of on or our shall she so such that the their them there these they this those to
    upon was we were what which who whom will with you your above all following see der die das des dem den ein eine und oder ist zu von im in am auf für sich nach bei los las el la de del en y o un una le les des du et ou on one only or was were has had no not nd example page authors details countries""".split())
#: Words that negate, and those that give a right or name what gives it.
NEGATIONS = "not no never nor neither without nicht kein keine keiner no nunca jamais pas sans".split()
GIVES = "licensed released distributed available published covered permitted granted governed dedicated provided shared under steht unter veröffentlicht lizenziert bajo publicado distribuido sous publié distribué".split()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams(w: list[str]) -> set[str]:
    """Words and bigrams of which a word isn't a function word or a number."""
    plain = [x in FUNCTION or x.isdigit() for x in w]
    return {x for x, p in zip(w, plain, strict=True) if not p} | {f"{a} {b}" for a, b, p, q in zip(w, w[1:], plain, plain[1:], strict=False) if not (p and q)}


def wordings() -> list[tuple[str, str, str]]:
    """(wording, text, class): variants of one wording have its name."""
    out = [(n, n.replace("{}", x), family) for family, notices in NOTICES.items() for n in notices for x in ("example", "2020")[: 1 + ("{}" in n)]]
    for family, names in NAMES.items():
        out += [(f"{form} {family}", form.format(name), family) for form in GRANTS for name in names]
        out += [(name, name, family) for name in names if name in ALONE]
    for family, texts in FULL.items():
        for t in texts:
            w = t.split()
            out += [(t, " ".join(w[a : a + 14]), family) for a in range(0, max(1, len(w) - 6), 7)] + [(t, t, family)]
    out += [(f"{form} {name}", form.format(name), UNKNOWN) for form in GRANTS[:8] for name in OTHERS] + [(name, name, UNKNOWN) for name in OTHERS]
    every = [n for names in NAMES.values() for n in names] + OTHERS
    out += [(form, form.replace("{}", every[(k + 3 * i) % len(every)], 1).replace("{}", every[(k + 7 * i + 1) % len(every)]), NONE) for i, form in enumerate(MENTIONS) for k in range(0, len(every), 3)]
    return out + [(p, p, NONE) for p in PROSE]


def measured() -> list[tuple[str, str]]:
    """(text, class) of what no model learns from: other licences of other names."""
    return [(form.format(name), UNKNOWN) for form in GRANTS[:8] for name in OTHERS_HELD]


_TAILS = ["", "see the file for details", "by the authors of this page", "in all countries", "2019 2024 example"]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (features and intercept, classes): Adam's steps on a smooth convex loss."""
    target = np.eye(len(CLASSES), dtype=np.float32)[y]
    w, mean, square = (np.zeros((x.shape[1], len(CLASSES)), np.float32) for _ in range(3))
    weight = weight / weight.sum()
    for k in range(1, STEPS + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - target) * weight[:, None]) + RIDGE * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (1 - 0.9 * k / STEPS) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


def _probabilities(z: np.ndarray, temperature: float) -> np.ndarray:
    z = z / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class Model:
    """N-gram weights over CLASSES with the temperature divided out, intercepts, and both least probabilities."""

    def __init__(self, lines: tuple[str, ...]):
        rows = [(name, words(f"{text} {tail}") if k % 2 else words(f"{tail} {text}"), c) for name, text, c in wordings() for k, tail in enumerate(_TAILS if len(text) < 200 else _TAILS[:1])]
        vocabulary = sorted(set().union(*(grams(w) for _, w, _ in rows)))
        index = {g: i for i, g in enumerate(vocabulary)}
        lines = frozenset(lines)
        rows += [(line, words(line), NONE) for line in sorted(lines)]
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        for r, (_, w, _) in enumerate(rows):
            x[r, [index[g] for g in grams(w) if g in index]] = 1
        x[:, -1] = 1
        y = np.array([CLASSES.index(c) for *_, c in rows])
        # Classes weigh alike, but for no licence, which is what most paragraphs are.
        weight = (1 / np.bincount(y, minlength=len(CLASSES)))[y].astype(np.float32)
        weight[y == len(CLASSES) - 1] *= PRIOR
        names = {n: i for i, n in enumerate(dict.fromkeys(n for n, *_ in rows))}
        full = {t for texts in FULL.values() for t in texts}
        # Passages of full texts and lines of the corpus are known to every model; wordings are left out as a whole.
        fold = np.array([-1 if n in full or n in lines else names[n] * 7919 % 1009 % FOLDS for n, *_ in rows])
        left_out = np.zeros((len(rows), len(CLASSES)), np.float32)
        other = np.zeros((len(measured()), len(vocabulary) + 1), np.float32)
        for r, (text, _) in enumerate(measured()):
            other[r, [index[g] for g in grams(words(text)) if g in index]] = 1
        other[:, -1] = 1
        beside = np.zeros((len(other), len(CLASSES)), np.float32)
        for k in range(FOLDS):
            w = self._sparse(_fit(x[fold != k], y[fold != k], weight[fold != k]))
            left_out[fold == k] = x[fold == k] @ w
            beside += other @ w / FOLDS
        w = self._sparse(_fit(x, y, weight))
        tried = fold >= 0
        z, truth = np.concatenate([left_out[tried], beside]), np.concatenate([y[tried], np.full(len(other), CLASSES.index(UNKNOWN))])
        temperature = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(_probabilities(z, t)[np.arange(len(z)), truth] + 1e-9).mean())
        p = _probabilities(z, temperature)
        best = p.argmax(axis=1)
        family = best < len(NOTICES)
        texts = [w for (_, w, _), t in zip(rows, tried, strict=True) if t] + [words(t) for t, _ in measured()]
        sure = np.array([family[i] and confirms(w, CLASSES[best[i]]) for i, w in enumerate(texts)])
        noted = np.array([reads_like_notice(w) for w in texts])
        self.least = min((t for t in np.arange(0.3, 0.91, 0.05) if (best == truth)[sure & (p.max(axis=1) >= t)].mean() >= PRECISION), default=0.9)
        free = truth == len(CLASSES) - 1
        self.any = min((t for t in np.arange(0.3, 0.91, 0.05) if (noted & (1 - p[:, -1] >= t))[free].mean() <= 1 - PRECISION), default=0.9)
        passed = sure & (p.max(axis=1) >= self.least)
        marked = ~passed & noted & (1 - p[:, -1] >= self.any)
        beside = np.arange(len(z)) >= len(z) - len(other)
        #: On wordings left out as a whole, and licences of which no model knows the name.
        self.held_out = {
            "notices found": float((passed & (best == truth))[truth < len(NOTICES)].mean()), "of what was found, right": float((best == truth)[passed].mean()), "no licence, taken for one": float((passed | marked)[free].mean()),
            "other licences, marked": float(marked[beside].mean()), "other licences, taken for a family": float(passed[beside].mean()),
        }
        w = w / temperature
        self.weights = {g: w[i] for g, i in index.items() if np.abs(w[i] - w[i, -1]).max() > 0}
        self.intercept = w[-1]
        self.gate = self._gate([w for _, w, c in rows if c == NONE])

    @staticmethod
    def _sparse(w: np.ndarray) -> np.ndarray:
        """Each n-gram's weights against those for no licence; what speaks for a licence by less than LEAST speaks for none."""
        w = w - w[:, -1:]
        w[:-1][(w[:-1] < LEAST) & (w[:-1] > -LEAST)] = 0
        w[:-1][(w[:-1] > 0) & (w[:-1] < LEAST)] = 0
        return w

    def _gate(self, free: list[list[str]]) -> list[str]:
        """Words one of which every n-gram that speaks for a licence has: of a bigram the one that is rarer in other text."""
        seen: dict[str, int] = {}
        for w in free:
            for x in set(w):
                seen[x] = seen.get(x, 0) + 1
        alone = {g for g, w in self.weights.items() if " " not in g and w.max() > 0}
        pairs = [g.split(" ") for g, w in self.weights.items() if " " in g and w.max() > 0]
        return sorted(alone | {min(p, key=lambda x: (x in FUNCTION or x.isdigit(), seen.get(x, 0), -len(x), x)) for p in pairs if not alone & set(p)})


@cache
def model(lines: tuple[str, ...] = ()) -> Model:
    return Model(lines)


def sample(docs: DataFrame) -> tuple[str, ...]:
    """At most LINES lines of DOCS documents that hold no notice: those that a template confirms, or in which two words of licence names stand, aren't taken."""
    chosen = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(DOCS)
    lines = chosen.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.char_length("line").between(8, WRAPPED)).distinct().orderBy(F.xxhash64("line"), "line").limit(LINES)
    known = {w for names in NAMES.values() for n in names for w in words(n)} | {w for n in NOTICES["proprietary"] for w in words(n)} | set(words("licensed licence lizenz copyright permission redistribute spdx warranty"))
    return tuple(sorted(r.line for r in lines.collect() if len(known & set(words(r.line))) < 2 and not _notice(words(r.line))))


def _any_of(known: list[str]) -> str:
    """A pattern of whole words, by first letter."""
    by: dict[str, list[str]] = {}
    for w in known:
        by.setdefault(w[0], []).append(w[1:])
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'{a}(?:{"|".join(sorted(rest, key=len, reverse=True))})' for a, rest in sorted(by.items()))})(?![\p{{L}}\p{{N}}])"


#: Forms of a short notice around {}, a family's names, in joined words.
_SHORT = (
    rf"(^| )({'|'.join(GIVES)}|redistribute|subject|waived|obtain|use)( \S+){{{{0,8}}}} ({{}})( |$)",  # gives a right under it
    r"^(the |spdx |this )?(licen[sc]es?|lizenz|licencia|source code|code|software|project)( identifier)?( is| ist| est| es)? (the |a )?({})( |$)",  # states it
    r"^(the |either )?({})( \S+){{0,3}}$",  # is little more than its name
)
#: The same around a word for licence.
_NOTICED = rf"(^| )({'|'.join(GIVES)})( \S+){{0,8}} (licen[sc]e|lizenz|licencia)( |$)|^(the |spdx )?(licen[sc]e|lizenz|licencia) \S+( \S+){{0,4}}$|^(\S+ ){{1,5}}licen[sc]e( \S+){{0,2}}$"
_NEGATED = rf"(^| )({'|'.join(dict.fromkeys(NEGATIONS))})( \S+){{0,2}} ({'|'.join(GIVES)})( |$)"
#: Names beside those of NAMES, as patterns.
_NAMED = {
    "apache-2.0": ["apache licen[sc]e", "apache 2"], "gpl-3.0": ["general public license (v|version )?3", "gpl( version)? 3", "version 3 of the gnu general public license"], "gpl-2.0": ["general public license (v|version )?2", "gpl( version)? 2", "version 2 of the gnu general public license"],
    "lgpl": ["lesser general public license"], "agpl-3.0": ["affero general public license", "agpl"], "bsd": ["bsd style", "bsd [23]", "bsd licen[sc]e"], "mpl-2.0": ["mozilla public license"], "cc-by-nc": ["cc by nc", "creative commons by nc", "attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "attribution sharealike"], "cc-by": ["cc by(?! (?:nc|sa|nd))", "commons attribution(?! (?:noncommercial|sharealike))"], "cc0": ["cc0", "into the public domain"],
}


def templates() -> list[tuple[str, str, list[str]]]:
    """(family, pattern of its short notices in joined words, bigrams of its full texts)."""
    out = []
    for family in NOTICES:
        names = {" ".join(words(n)) for n in NAMES.get(family, [])} | {" ".join(words(n.split(":")[1])) for n in NOTICES[family] if n.startswith("SPDX")} | set(_NAMED.get(family, []))
        pattern = "|".join(f.format("|".join(sorted(names, key=len, reverse=True))) for f in _SHORT)
        if family == "proprietary":  # its wording is its name
            pattern = "(^| )(all rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés|proprietary and its license)( |$)"
        out.append((family, pattern, sorted({" ".join(g) for t in FULL.get(family, []) for g in zip(words(t), words(t)[1:], strict=False)})))
    return out


@cache
def _known() -> dict[str, tuple[re.Pattern, frozenset[str]]]:
    return {family: (re.compile(pattern), frozenset(full)) for family, pattern, full in templates()}


def confirms(w: list[str], family: str) -> bool:
    """Whether a template of the family confirms the paragraph, as `paragraphs` has it in columns."""
    pattern, full = _known()[family]
    pairs, phrase = {" ".join(g) for g in zip(w, w[1:], strict=False)}, " ".join(w)
    return len(pairs) >= FIXED and len(pairs & full) >= OVERLAP * len(pairs) or bool(pattern.search(phrase)) and not re.search(_NEGATED, phrase)


def _notice(w: list[str]) -> bool:
    return reads_like_notice(w) or any(confirms(w, family) for family in NOTICES)


def reads_like_notice(w: list[str]) -> bool:
    phrase = " ".join(w)
    return bool(re.search(_NOTICED, phrase)) and not re.search(_NEGATED, phrase)


def _split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def _following(lines: Column, i: Column, line: Column) -> Column:
    """struct(text, n, words, ended): the n lines that a notice begun in `line`, number `i`, may go on in."""
    wordless = lambda x: ~x.rlike(r"[\p{L}\p{N}]") | (F.char_length(x) > WRAPPED)
    state = lambda text, n, words, ended: F.struct(text.alias("text"), n.cast("int").alias("n"), words.cast("int").alias("words"), ended.alias("ended"))

    def add(acc: Column, x: Column) -> Column:
        count = acc["words"] + F.size(F.split(F.btrim(x), " "))
        on = state(F.concat_ws("\n", acc["text"], x), acc["n"] + 1, count, count >= SPAN)
        return F.when(acc["ended"], acc).when(wordless(x), state(acc["text"], acc["n"], acc["words"], F.lit(True))).otherwise(on)

    return F.aggregate(F.slice(lines, i + 2, F.lit(SPAN)), state(F.lit(""), F.lit(0), F.lit(0), wordless(line)), add)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, last, family, probability) of every notice: confirmed families, and `UNKNOWN`."""
    spark = docs.sparkSession
    learned = model(sample(docs))
    lists = lambda pairs, kind: F.broadcast(spark.createDataFrame(pairs, kind))  # noqa: E731  some thousand rows at most, the same for any data
    table = lists([(g, [float(v) for v in w]) for g, w in learned.weights.items()], "gram string, w array<double>")
    confirm = lists(templates(), "family string, pattern string, full array<string>")
    some = _any_of(learned.gate)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.lower("text").rlike(some))
    rows = rows.select("doc_id", F.xxhash64("text").alias("fp"), F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    # What follows a line is put together for lines that pass only, and before rows are made, so that none carries the whole text.
    here = F.transform("lines", lambda x, i: F.when(F.lower(x).rlike(some), F.struct(i.alias("pos"), x.alias("line"), _following(F.col("lines"), i, x).alias("more"))))
    rows = rows.select("doc_id", "fp", F.explode(F.filter(here, lambda x: x.isNotNull())).alias("at")).select("doc_id", "fp", "at.*")
    sentences = F.transform(F.split("line", r"(?<=[.!?;])\s+"), lambda s, i: F.struct(F.col("pos").alias("last"), i.alias("nth"), s.alias("text")))
    whole = F.struct((F.col("pos") + F.col("more.n")).alias("last"), F.lit(-1).alias("nth"), F.concat_ws("\n", "line", F.nullif("more.text", F.lit(""))).alias("text"))
    units = rows.select("doc_id", "fp", "pos", F.explode(F.array_distinct(F.concat(sentences, F.array(whole)))).alias("u")).select("doc_id", "fp", "pos", "u.*").where(F.lower("text").rlike(some))
    units = units.select("doc_id", "fp", "pos", "last", "nth", F.explode(F.array(_split_words(F.col("text")))).alias("words")).where(F.size("words") > 0)
    # A text that several rows of one doc_id hold counts once.
    units = units.dropDuplicates(["doc_id", "fp", "pos", "last", "nth"])
    key = ["doc_id", "fp", "pos", "last", "nth"]
    shifted = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), shifted, lambda a, b: F.concat_ws(" ", a, b))
    each = units.select(*key, "words", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    sums = [F.sum(F.coalesce(F.get("w", F.lit(k)), F.lit(0.0))).alias(f"z{k}") for k in range(len(CLASSES))]
    per = each.join(table, "gram").groupBy(*key).agg(F.first("words").alias("words"), *sums)
    z = F.array(*[F.col(f"z{k}") + float(learned.intercept[k]) for k in range(len(CLASSES))])
    scored = per.select(*key, "words", z.alias("z")).withColumn("top", F.array_max(F.slice("z", 1, len(CLASSES) - 2)))
    share = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("z")))
    scored = scored.select(*key, "words", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("z", F.col("top")).cast("int")).alias("family"), (F.exp(F.col("top") - F.array_max("z")) / share).alias("probability"), (1 - F.exp(F.element_at("z", -1) - F.array_max("z")) / share).alias("some"))
    scored = scored.where((F.col("probability") >= float(learned.least)) | (F.col("some") >= float(learned.any)))
    told = scored.join(confirm, "family")
    phrase, bigrams = F.array_join("words", " "), F.array_distinct(pairs)
    fixed = (F.size(bigrams) >= FIXED) & (F.size(F.array_intersect(bigrams, F.col("full"))) >= OVERLAP * F.size(bigrams))
    short = F.expr("array_join(words, ' ') rlike pattern") & ~phrase.rlike(_NEGATED)
    good = (F.col("probability") >= float(learned.least)) & (short | fixed & (F.col("nth") == -1))
    left = (F.col("some") >= float(learned.any)) & phrase.rlike(_NOTICED) & ~phrase.rlike(_NEGATED)
    found = told.select(*key, F.when(good, F.col("family")).when(left, F.lit(UNKNOWN)).alias("family"), F.when(good, F.col("probability")).otherwise(F.col("some")).alias("probability"), (short & (F.col("pos") == F.col("last"))).alias("line")).where("family IS NOT NULL")
    best = found.groupBy("doc_id", "fp", "pos", "last", "family").agg(F.max("probability").alias("probability"), F.bool_or(F.col("line") | (F.col("family") == UNKNOWN) & (F.col("pos") == F.col("last"))).alias("line"))
    # A line's own short notice answers for the runs that hold it.
    text = Window.partitionBy("doc_id", "fp")
    own = F.array_distinct(F.collect_list(F.when(F.col("line"), F.col("pos"))).over(Window.partitionBy("doc_id", "fp", "family")))
    runs = best.withColumn("own", own).where(F.col("line") | ~F.exists("own", lambda p: p.between(F.col("pos"), F.col("last"))))
    # Of overlapping runs the first counts, whatever the family; a known family answers for unknown ones.
    known = ~F.col("line") & (F.col("family") != UNKNOWN)
    seen = F.max(F.when(known, F.col("last"))).over(text.orderBy("pos", F.desc("last"), "family").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("seen", seen).where(F.col("line") | F.col("seen").isNull() | (F.col("pos") > F.col("seen")))
    named = F.collect_list(F.when(F.col("family") != UNKNOWN, F.struct("pos", "last"))).over(text)
    runs = runs.withColumn("named", named).where((F.col("family") != UNKNOWN) | ~F.exists("named", lambda s: (s["pos"] <= F.col("last")) & (s["last"] >= F.col("pos"))))
    return runs.select("doc_id", "pos", "last", "family", "probability")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, families (sorted array), n_notices of them, n_unknown (notices of other licences), probability (the largest of a family)."""
    known = F.col("family") != UNKNOWN
    found = paragraphs(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(known, F.col("family")))).alias("families"), F.count_if(known).alias("n_notices"), F.count_if(~known).alias("n_unknown"), F.max(F.when(known, F.col("probability"))).alias("probability"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    none = F.array().cast("array<string>")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), F.coalesce("families", none).alias("families"), zero("n_notices", "long"), zero("n_unknown", "long"), zero("probability", "double"))
