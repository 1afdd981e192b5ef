"""Licence scans through a positional index of rare template words.

Of each template the words with the highest inverse document frequency in the corpus form
postings (word, template, position): as many as guarantee that a copy with enough of the
template holds one of them. A file's words are looked up in this index; a posting at
file position i and template position p proposes the start i - p. A proposal counts if enough of
the template stands there, word by word, and its key phrase stands there completely.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: letters of either case, digits and what is not ASCII
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: phrases whose consecutive words give the base label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, template, key phrase that must stand in it)
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification "
            "are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "licensed under the gnu general public license version 3",
     "general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
)
START = 1 << 40              # keeps a template's number and a start in one number
SHIFT = 1 << 20


@dataclass(frozen=True)
class LicenceScan:
    """Adds licence columns to a table of texts.

    Null and empty texts have no words, empty labels and score 0. Texts of any length are
    scanned whole. Ties between equally frequent words go to the smaller word. Repeated rows
    get equal results; columns named like a new one are replaced. Nothing is shuffled but
    the document frequencies of template words, a table no larger than the templates.
    """

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES
    share: float = 0.8           # of a template's words that must stand in place

    @property
    def vocabulary(self) -> list[str]:
        words = {w for _, text, _ in self.templates for w in text.split()}
        return sorted(words | {w for p in self.phrases for w in p.split()})

    def _words(self, docs: DataFrame, text_column: str) -> DataFrame:
        """Words as they stand, and the positions of template words among them."""
        words = F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD), F.lit(0))
        vocabulary = self.vocabulary
        out = docs.withColumn("__words", words).withColumn("n_words", F.size("__words").cast("long"))
        places = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: (
            F.lower(F.get("__words", i)).isin(vocabulary) & ascii_only(F.get("__words", i))))
        return out.withColumn("__at", F.when(F.col("n_words") > 0, places)
                              .otherwise(F.array().cast("array<int>")))

    def frequencies(self, docs: DataFrame, text_column: str = "text") -> list[str]:
        """Template words from the rarest in the corpus to the most frequent."""
        known = self._words(docs.select(text_column), text_column)
        present = F.explode(F.array_distinct(
            F.transform("__at", lambda i: F.lower(F.get("__words", i)))))
        counts = {r["word"]: r["n"] for r in known.select(present.alias("word"))
                  .groupBy("word").agg(F.count("*").alias("n")).collect()}
        return sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w))

    def indexed(self, words: list[str], rank: dict[str, int]) -> list[int]:
        """Positions of a template's rarest words, one more than a counting copy may lack."""
        lacking = len(words) - math.ceil(self.share * len(words) - 1e-9)
        return sorted(range(len(words)), key=lambda p: (rank[words[p]], p))[:lacking + 1]

    def scan(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        base = docs.drop(*[n for n in names if n in docs.columns])
        order = self.frequencies(base, text_column)
        out = self._words(base, text_column)

        def stands(phrase: str):
            def at(i: Column) -> Column:
                found = F.lit(True)
                for k, word in enumerate(phrase.split()):
                    found = found & same(F.get("__words", i + k), F.lit(word))
                return found
            return at

        found = {p: F.filter("__at", stands(p)) for p in self.phrases}
        out = out.withColumn("__found", F.array(*found.values()))
        places = F.flatten("__found")
        labels = F.array_compact(F.array(*[
            F.when(F.size(F.get("__found", F.lit(i))) > 0, F.lit(label))
            for i, label in enumerate(self.phrases.values())]))
        out = out.withColumns({
            "n_base": F.size(places).cast("long"), "first_word": F.array_min(places).cast("long"),
            "last_word": F.array_max(places).cast("long"), "__labels": labels})

        rank = {w: i for i, w in enumerate(order)}
        texts = [t.split() for _, t, _ in self.templates]
        index: dict[str, list[int]] = {}
        needed = []
        for t, (words, (_, _, phrase)) in enumerate(zip(texts, self.templates, strict=True)):
            for p in self.indexed(words, rank):
                index.setdefault(words[p], []).append(t * START + SHIFT - p)
            key = phrase.split()
            start = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            needed.append(list(range(start, start + len(key))))

        of = lambda rows, kind: F.array(*[
            F.array(*[F.lit(x) for x in row]).cast(f"array<{kind}>") for row in rows])
        known = sorted(index)
        slot = lambda i: F.array_position(
            F.array(*[F.lit(w) for w in known]), F.lower(F.get("__words", i))).cast("int") - 1
        rare = F.filter("__at", lambda i: F.lower(F.get("__words", i)).isin(known))
        starts = F.array_distinct(F.flatten(F.transform(rare, lambda i: F.transform(
            F.get(of([index[w] for w in known], "long"), slot(i)), lambda p: p + i))))
        words, keys = of(texts, "string"), of(needed, "int")

        def aligned(code: Column) -> Column:
            t = F.floor(code / START).cast("int")
            start = (code % START - SHIFT).cast("int")
            own = F.get(words, t)
            agrees = lambda j: F.coalesce(
                same(F.get("__words", start + j), F.get(own, j)), F.lit(False))
            here = F.size(F.filter(F.sequence(F.lit(0), F.size(own) - 1), agrees))
            return F.struct(t.alias("t"), (here / F.size(own)).alias("share"),
                            F.forall(F.get(keys, t), agrees).alias("key"))

        names_of = F.array(*[F.lit(label) for label, _, _ in self.templates])
        out = out.withColumn("__aligned", F.transform(starts, aligned))
        verified = F.filter("__aligned", lambda a: a["key"] & (a["share"] >= self.share))
        join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
        added = F.transform(verified, lambda a: F.get(names_of, a["t"]))
        return out.select(
            *base.columns, "n_words", "n_base", "first_word", "last_word",
            join(F.col("__labels")).alias("base_labels"),
            join(F.concat("__labels", added)).alias("labels"),
            F.coalesce(F.round(F.array_max(F.transform("__aligned", lambda a: a["share"])), 6),
                       F.lit(0.0)).alias("score"))


def ascii_only(word: Column) -> Column:
    return F.octet_length(word) == F.length(word)


def same(word: Column, lowered: Column) -> Column:
    """Equal but for the case of A-Z."""
    return (F.octet_length(word) == F.octet_length(lowered)) & (F.lower(word) == lowered)
