"""Prompts of the model-backed stages, as templates with named places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ANALYSIS = """Prepare a research question for search in a multilingual corpus. Answer with one JSON object and nothing else. Its keys:
expanded_query: the question in English, enriched with what the traditions call the same things;
medical_concepts: a list of the concepts that it is about;
relevant_traditions: those of {traditions} that it concerns, all of them for a general question;
relevant_languages: those of {languages} that their texts are in;
date_from, date_to: years as integers, negative before the common era, or null where the question sets no bound.
QUESTION
{question}"""

SYNTHESIS = """Write a comparative answer from the passages alone.
Every statement of substance ends with the marker of the passage that it rests on, such as [SOURCE 3].
What the passages don't say isn't said; what they lack for a part of the question, or for a tradition, is named as missing.
Technical terms stay in their own language, as the original has them, with a short gloss.
Likeness is not called identity, and no modern category is read into a text.
QUESTION
{question}
PASSAGES
{context}"""

PROOFREADING = """Check a draft against its sources, statement by statement. A statement is supported only if the passages that it cites say so;
look for content that no cited passage has, that another passage has, modern concepts, terms rendered too freely, and lost reservations.
Content is judged by the translation, terms by the original. Answer with one JSON object and nothing else. Its keys:
claim_checks: a list of objects with claim, cited_sources (integers), supported (boolean) and issue (empty if there is none);
report: the whole in two or three sentences;
needs_more_retrieval: true only if the corpus would have to be searched again because a needed passage is missing.
SOURCES
{context}

DRAFT
{draft}"""

TRANSLATION = """Translate the passage into English, faithfully and literally. {guidance}Add, explain and leave out nothing; what is too damaged
to understand is rendered word by word. Answer with the translation alone.
PASSAGE
{text}"""

#: What a translator has to know of each language, by the beginning of its code.
GUIDANCE = {
    "zh": "It is classical Chinese: medical terms stay in characters, with their reading where they first occur. ",
    "grc": "It is ancient Greek: medical terms are transliterated where they first occur. ",
    "la": "It is medieval Latin from a scanned edition: obvious misreadings are corrected silently, and key terms stay in Latin. ",
}


def filled(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced by its column; null counts as empty."""
    out, rest = [], template
    for name in sorted(parts, key=lambda n: template.index(f"{{{n}}}")):
        before, _, rest = rest.partition(f"{{{name}}}")
        out += [F.lit(before), F.coalesce(parts[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def translation(text: Column, language: Column) -> Column:
    known = F
    for code, words in GUIDANCE.items():
        known = known.when(language.startswith(code), F.lit(words))
    return filled(TRANSLATION, guidance=known.otherwise(""), text=text)
