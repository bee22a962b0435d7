"""Functions of text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower case, cut at white space, without what is no letter or digit, empty ones dropped."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.array_remove(F.split(plain, r"\s+"), "")


def word_count(text: Column) -> Column:
    """Runs of what isn't white space; 0 for a blank text."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


#: The prompt, and the spellings whose first tokens stand for yes and no.
PROMPT = ("Question: Does this image show ", "? Answer:")
SPELLINGS = {"yes": ("yes", " yes", "Yes", " Yes"), "no": ("no", " no", "No", " No")}


def yes_no_ids(encode: Callable[[str], list[int]]) -> tuple[list[int], list[int]]:
    """The distinct first token ids of the spellings of yes and of no, in order; spellings without a token are left out. Raises ValueError if one answer has none."""
    found = []
    for answer, spellings in SPELLINGS.items():
        firsts = list(dict.fromkeys(ids[0] for ids in map(encode, spellings) if ids))
        if not firsts:
            raise ValueError(f"no token for {answer}")
        found.append(firsts)
    return found[0], found[1]


def picked_logits(logits: Column, ids: list[int]) -> Column:
    """The logits (array, by token id) of some ids; ids beyond the array are left out."""
    return F.filter(F.array(*[F.get(logits, F.lit(i)) for i in ids]), lambda x: x.isNotNull())


def yes_no_prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), F.lower(text), F.lit(PROMPT[1]))


def safe_name(*parts: Column) -> Column:
    """Parts joined by a slash, all slashes turned to dashes: a name for a file."""
    return F.replace(F.concat_ws("/", *parts), F.lit("/"), F.lit("-"))


def grouped_number(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def yes_probability(yes: Column, no: Column, floor: float = 1e-8) -> Column:
    """The share of the yes logits (array) among yes and no logits under softmax, 0.5 if there is next to nothing; null if either is null."""
    top = F.array_max(F.concat(yes, no))
    mass = lambda logits: F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    all_ = mass(yes) + mass(no)
    return F.when(yes.isNull() | no.isNull(), F.lit(None).cast("double")).when(F.coalesce(all_, F.lit(0.0)) <= floor, F.lit(0.5)).otherwise(mass(yes) / all_)
