"""Cleaning generated answers: sentences and paragraphs that repeat earlier ones of the same text go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import PAGE_MARK
from corpusloom.shipping import ready

#: A sentence keeps the bracket that follows its end mark; what a citation alone looks like; a word that counts.
SENTENCE = re.compile(r"([^.!?]+(?:[.!?]+(?:\s*\[[a-zA-Z0-9_:\s,\.-]+\])?|$))")
CITATION = re.compile(r"^\[(?:chk_[a-zA-Z0-9_]+|Source:[^\]]+)\]$")
WORD = re.compile(r"\b[a-z0-9_]{3,}\b")
MARK = re.compile(PAGE_MARK)
#: The characters before the ending of a layout footer. A run of them is read once, whether an ending follows or not.
FOOTER_RUN = re.compile(r"(?i)[a-zA-Z0-9_\s\-]++(\.indd[^\n\r]*)?")
#: Words from which similarity counts and the similarity at which a repeat goes, inside a paragraph, across
#: paragraphs, and of whole paragraphs; a fragment without an end mark has fewer words than the last.
INSIDE, ACROSS, WHOLE, FRAGMENT = (4, 0.70), (4, 0.55), (6, 0.55), 8


def _without_footers(text: str, instead: str = "") -> str:
    return FOOTER_RUN.sub(lambda m: instead if m[1] else m[0], text) if ".indd" in text.lower() else text


def _plain(text: str) -> str:
    return " ".join(_without_footers(MARK.sub(" ", text), " ").split()).lower()


class _Accepted:
    """Texts accepted so far: equal ones and, from some words on, similar ones are known again.

    A text at the similarity lacks so few words of another that it has one of any few more: only texts with one of its
    rarest words are compared.
    """

    def __init__(self, rule: tuple[int, float], exact: bool) -> None:
        self.least, self.limit = rule
        self.exact: set[str] | None = set() if exact else None
        self.holders: dict[str, list[set[str]]] = {}

    def _like(self, bag: set[str]) -> bool:
        rare = sorted(bag, key=lambda w: len(self.holders.get(w, ())))[: int(len(bag) * (1 - self.limit) + 1e-9) + 1]
        for b in (b for w in rare for b in self.holders.get(w, ())):
            both = len(bag & b)
            if both / (len(bag) + len(b) - both) >= self.limit:
                return True
        return False

    def repeats(self, plain: str) -> bool:
        """Whether the text is a repeat; if not, it is accepted."""
        if self.exact is not None and plain in self.exact:
            return True
        bag = set(WORD.findall(plain))
        if len(bag) >= self.least and self._like(bag):
            return True
        if self.exact is not None:
            self.exact.add(plain)
        for w in bag:
            self.holders.setdefault(w, []).append(bag)
        return False


def sentences_with_citations(text: str) -> list[str]:
    """Sentences with the citations that follow them; a citation that stands alone joins the sentence before."""
    out: list[str] = []
    for part in (m.strip() for m in SENTENCE.findall(text)):
        if part and out and CITATION.match(part):
            out[-1] += " " + part
        elif part:
            out.append(part)
    return out


def clean_text(text: str) -> str:
    """One text: a sentence goes if it equals an accepted one of its paragraph or is like it, or like one of any earlier
    paragraph; a paragraph if it equals or is like an accepted one, or is a short fragment without an end mark; a paragraph
    that is a citation alone joins the one before. An unfinished end is cut back to the last end mark or bracket.
    """
    if not text.strip():
        return text
    paragraphs: list[str] = []
    said, whole = _Accepted(ACROSS, False), _Accepted(WHOLE, True)
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", _without_footers(text)))):
        if CITATION.match(para):
            if paragraphs:
                paragraphs[-1] += " " + para
            continue
        here, parts = _Accepted(INSIDE, True), sentences_with_citations(para)
        if len(parts) > 1:
            parts = sentences_with_citations(" ".join(s for s in parts if _plain(s) and not here.repeats(_plain(s))))
        final = " ".join(s for s in parts if not said.repeats(_plain(s)))
        fragment = not re.search(r"[.!?]$", final) and len(final.split()) < FRAGMENT
        if final and not fragment and _plain(final) and not whole.repeats(_plain(final)):
            paragraphs.append(final)
    if paragraphs and not re.search(r"[.!?\]]$", paragraphs[-1]):
        cut = paragraphs[-1][: max(paragraphs[-1].rfind(m) for m in ".!?]") + 1].strip()
        paragraphs[-1:] = [cut] if cut else []
    return "\n\n".join(paragraphs)


def dedupe_answers(rows: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``clean``. Acceptance depends on the order inside one text, so texts are cleaned in Arrow batches."""
    ready(rows.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: clean_text(t or ""))

    return rows.withColumn("clean", clean(F.col(text)))
