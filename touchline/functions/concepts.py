"""Concepts that the data cannot answer, or answers only through a disclosed stand-in."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA, NOT_IMPLEMENTED, APPROXIMATE = "no_data", "not_implemented", "approximate"


@dataclass(frozen=True)
class Concept:
    name: str
    verdict: str
    phrases: tuple[str, ...]
    questions: tuple[int, ...] = ()
    proxy: tuple[dict, ...] = ()

    @property
    def all_phrases(self) -> tuple[str, ...]:
        return (self.name.replace("_", " "), *self.phrases)


def _spec(column: str, op: str, value) -> dict:
    return {"column": column, "op": op, "value": value}


# The registered concepts in matching order, their phrases and their stand-in filters.
CONCEPTS: tuple[Concept, ...] = (
    Concept("captain", NO_DATA, ("captain", "armband", "skipper"), (5, 78)),
    Concept("offside_call", NO_DATA, ("offside",), (27,)),
    Concept("through_ball", APPROXIMATE, ("through ball", "throughball", "through pass"), (25,),
            (_spec("first_line_break", "eq", True),)),
    Concept("cutback", APPROXIMATE, ("cutback", "cut back", "pull back", "pullback"), (18,),
            (_spec("opp_penalty_area_start", "eq", True), _spec("start_type", "eq", "pass_reception"))),
    Concept("game_management", APPROXIMATE, ("game management", "time wasting", "timewasting", "killing the game"), (48,),
            (_spec("minute_start", "gte", 80), _spec("start_type", "in", ["throw_in_reception", "keep_possession"]))),
    Concept("duel_won", APPROXIMATE, ("duel won", "won the duel", "won a duel", "duel win"), (62,),
            (_spec("pressing_chain_end_type", "eq", "regain"),)),
    Concept("numerical_advantage", APPROXIMATE,
            ("numerical advantage", "numerical superiority", "overload", "outnumber", "numbers up"), (67, 74),
            (_spec("n_opponents_ahead_end", "eq", 0),)),
)


def words(text: Column) -> Column:
    """Lower-case letters and digits with single blanks, padded, so that `contains` means whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def tag_concepts(df: DataFrame, text: str, concepts: Sequence[Concept] = CONCEPTS) -> DataFrame:
    """Adds ``concept`` and ``verdict``: the first registered concept named in the text, or null.

    The phrase list is code, not data, so it compiles into one expression; no join is needed.
    """
    normal = F.col("__words")
    hit = F.lit(None).cast("string")
    for c in reversed(concepts):
        named = F.lit(False)
        for phrase in c.all_phrases:
            named = named | normal.contains(f" {' '.join(phrase.lower().split())} ")
        hit = F.when(named, F.lit(c.name)).otherwise(hit)
    verdict = F.lit(None).cast("string")
    for c in concepts:
        verdict = F.when(F.col("concept") == c.name, F.lit(c.verdict)).otherwise(verdict)
    tagged = df.withColumn("__words", words(F.col(text))).withColumn("concept", hit)
    return tagged.withColumn("verdict", verdict).drop("__words")


def blocked_questions(concepts: Sequence[Concept] = CONCEPTS) -> dict[int, Concept]:
    return {q: c for c in concepts for q in c.questions}


def apply_proxies(specs: list[dict], concepts: Sequence[Concept], event_types: Sequence[str], catalog) -> tuple[list[dict], list[str], list[str]]:
    """(filters with stand-ins, disclosed concepts, concepts not applied).

    A stand-in on a column that is already constrained is skipped: the asker's own condition wins.
    A stand-in the catalog rejects for these event types is neither applied nor disclosed.
    """
    out, disclosed, failed = list(specs), [], []
    for c in concepts:
        taken = {f["column"] for f in out}
        todo = [f for f in c.proxy if f["column"] not in taken]
        problems = [p for f in todo for et in (event_types or [None]) if (p := catalog.problem(f["column"], et, f["op"], f["value"]))]
        if problems:
            failed.append(c.name)
        else:
            out.extend(todo)
            disclosed.append(c.name)
    return out, disclosed, failed
