"""Words for scores, screening of engine readings, a rule cascade over code groups, and made-up sentences of the grammar of codes; all in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of a model's probability from each bound on.
WORDS = [(0.9, "high model confidence"), (0.7, "moderate model confidence"), (0.5, "low model confidence")]
UNSURE = "very low model confidence: the model is unsure"


def confidence_words(p: Column) -> Column:
    """Null stays null."""
    found = F.coalesce(*[F.when(p >= bound, words) for bound, words in WORDS], F.lit(UNSURE))
    return F.when(p.isNotNull(), found)


def screen_reading(status: Column, text: Column, score: Column, least: float = 0.9) -> Column:
    """struct(status, text): a candidate of an engine stays one only with text and a score of ``least`` or more; it is never more than a candidate. What is no candidate keeps its status."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    kept = (clean != "") & F.coalesce(score >= least, F.lit(False))
    candidate = status.eqNullSafe(F.lit("candidate"))
    return F.struct(F.when(~candidate | kept, status).otherwise("no_reliable_transcription").alias("status"), F.when(candidate & kept, clean).when(~candidate, text).alias("text"))


def sequence_category(words: Column, groups: Mapping[str, str], symbolic: Column) -> Column:
    """struct(rule, category) of an array of words of codes: the first rule that fits, over the codes that have a group.

    R0 no such code: symbolic mark if ``symbolic``, else no reading; R1 numerals alone; R2 a second word that begins with a marker; R3 a marker at the end; R4 any other.
    """
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    of = lambda c: F.try_element_at(table, c)
    kinds = F.filter(F.transform(F.flatten(F.coalesce(words, F.array().cast("array<array<string>>"))), of), lambda g: g.isNotNull())
    second = of(F.get(F.get(words, F.lit(1)), F.lit(0)))
    steps = [
        ((F.size(kinds) == 0) & F.coalesce(symbolic, F.lit(False)), "R0", "symbolic_mark_like"), (F.size(kinds) == 0, "R0", "no_reading"), (F.forall(kinds, lambda g: g == "numeral_like"), "R1", "numeral_like"),
        (second == "marker", "R2", "name_and_title_like"), (F.element_at(kinds, -1) == "marker", "R3", "ownership_formula_like"), (F.lit(True), "R4", "personal_name_like"),
    ]
    pick = lambda i: F.coalesce(*[F.when(s[0], F.lit(s[i])) for s in steps])
    return F.struct(pick(1).alias("rule"), pick(2).alias("category"))


def draw(seed: Column, *place: Column) -> Column:
    """A number from 0 to 2**32 - 1, fixed by the seed and the place it is drawn for."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in place])), 1, 8), 16, 10).cast("bigint")


def sentence(seed: Column, n: Column, nouns: Sequence[str], verbs: Sequence[str], numerals: Sequence[str], negation: str) -> Column:
    """A valid sentence of exactly n codes, the same for the same seed; null for fewer than 3.

    A clause is noun, other noun, verb and up to three of: a numeral before either noun, the negation at its end. The number of clauses is drawn among those that allow n codes; of all
    their open places those with the lowest draws are filled.
    """
    few, many = F.ceil(n / 6).cast("bigint"), F.floor(n / 3).cast("bigint")
    k = few + draw(seed, F.lit("clauses")) % (many - few + 1)
    places = F.array_sort(F.transform(F.sequence(F.lit(0), (3 * k - 1).cast("int")), lambda p: F.struct(draw(seed, F.lit("place"), p).alias("d"), p.alias("p"))))
    filled = F.transform(F.slice(places, F.lit(1), (n - 3 * k).cast("int")), lambda x: x["p"])
    one = lambda words, number: F.element_at(F.array(*map(F.lit, words)), (number % len(words) + 1).cast("int"))

    def clause(j: Column) -> Column:
        at = lambda i, c: F.when(F.array_contains(filled, j * 3 + i), c)
        first = draw(seed, F.lit("noun"), j) % len(nouns)
        second = first + 1 + draw(seed, F.lit("other"), j) % (len(nouns) - 1)
        number = lambda i: one(numerals, draw(seed, F.lit("numeral"), j * 2 + i))
        return F.array_compact(F.array(at(0, number(0)), one(nouns, first), at(1, number(1)), one(nouns, second), one(verbs, draw(seed, F.lit("verb"), j)), at(2, F.lit(negation))))

    return F.when(n >= 3, F.flatten(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), clause)))
