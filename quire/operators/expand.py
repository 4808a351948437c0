"""Term expansion: which dictionary terms each query word stands for, ranked and held under a ceiling."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.words import EXACT, MAX_TERMS_PHRASE, OTHER, Branch, WordPlan


@dataclass
class Expansion:
    """The terms of one word: term -> (tier, document frequency), and whether the ceiling cut some off."""

    word: str
    terms: dict[str, tuple[int, int]]
    truncated: bool = False

    @property
    def df(self) -> int:
        """Document frequency of the word: those of its terms together, as spellings share statistics."""
        return sum(df for _, df in self.terms.values())

    def of_tier(self, tier: int) -> list[str]:
        return [t for t, (k, _) in self.terms.items() if k <= tier]


def is_literal(pattern: str) -> bool:
    return not re.search(r"[\\.^$|?*+()\[\]{}]", pattern)


def matches(b: Branch) -> Column:
    """Whether a row of the term table matches a branch."""
    if is_literal(b.pattern):
        hit = F.col("term") == b.pattern
        return hit | (F.col("bare") == b.pattern) if b.quoteless else hit
    whole = f"^(?:{b.pattern})$"
    hit = F.col("term").rlike(whole)
    return hit | ((F.col("bare") != F.col("term")) & F.col("bare").rlike(whole)) if b.quoteless else hit


def _any(branches: list[Branch]) -> Column:
    """Whether a row matches some branch: one set lookup and one joined pattern, before the branches are told apart."""
    words = [b.pattern for b in branches if is_literal(b.pattern)]
    patterns = [b.pattern for b in branches if not is_literal(b.pattern)]
    sides = [F.col("term"), F.col("bare")] if any(b.quoteless for b in branches) else [F.col("term")]
    hit = F.lit(False)
    for c in sides:
        if words:
            hit = hit | c.isin(words)
        if patterns:
            hit = hit | c.rlike(f"^(?:{'|'.join(patterns)})$")
    return hit


def ranked(terms: DataFrame, plan: WordPlan) -> DataFrame:
    """(term, df, len, branch, tier) of the terms a plan matches; ``branch`` is the first branch that does. Terms within the
    edit distance of a fuzzy plan follow its branches by distance, those at distance 0 come first."""
    if plan.fuzzy is not None:
        d = F.least(F.levenshtein("term", F.lit(plan.word)), F.levenshtein("bare", F.lit(plan.word)))
        d = F.when((F.abs(F.col("len") - len(plan.word)) <= plan.fuzzy + 2) & (d <= plan.fuzzy), d)
        hits = [F.when(d == 0, F.lit(0)), *(F.when(matches(b), F.lit(i)) for i, b in enumerate(plan.branches, 1)), d + len(plan.branches)]
        tiers = [EXACT, *(b.tier for b in plan.branches), *[OTHER] * plan.fuzzy]
        near = terms.where(d.isNotNull() | _any(plan.branches)).withColumn("branch", F.coalesce(*hits)).where("branch IS NOT NULL")
        return near.withColumn("tier", F.element_at(F.array(*map(F.lit, tiers)), F.col("branch") + 1))
    if not plan.branches:
        return terms.limit(0).withColumn("branch", F.lit(0)).withColumn("tier", F.lit(0))
    rank = F.coalesce(*(F.when(matches(b), F.lit(i)) for i, b in enumerate(plan.branches)))
    tier = F.element_at(F.array(*(F.lit(b.tier) for b in plan.branches)), F.col("branch") + 1)
    return terms.where(_any(plan.branches)).withColumn("branch", rank).where("branch IS NOT NULL").withColumn("tier", tier)


def expand(terms: DataFrame, plans: list[WordPlan], cap: int = MAX_TERMS_PHRASE) -> list[Expansion]:
    """The terms of every word in one job. Order within a word: branch, length, frequency, term; a word keeps ``cap`` terms.

    What comes to the driver is at most ``cap`` + 1 terms a word. Words that match nothing have no terms.
    """
    if not plans:
        return []
    parts = []
    for i, p in enumerate(plans):
        top = ranked(terms, p).orderBy("branch", "len", F.col("df").desc(), "term").limit(cap + 1)
        parts.append(top.select(F.lit(i).alias("word"), "term", "tier", "df", "branch", "len"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found: list[list] = [[] for _ in plans]
    for r in out.collect():
        found[r.word].append(r)
    result = []
    for p, rows in zip(plans, found, strict=True):
        rows.sort(key=lambda r: (r.branch, r.len, -r.df, r.term))
        result.append(Expansion(p.word, {r.term: (r.tier, r.df) for r in rows[:cap]}, len(rows) > cap))
    return result
