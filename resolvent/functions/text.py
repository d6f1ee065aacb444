"""Text functions as Column expressions: they stay inside whole-stage code generation, without any UDF.

Vocabularies are parameters.  A ``Vocabulary`` holds the form words, the ordered part words and what else is
stripped from trade names; ``DEFAULT`` is a small general one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vocabulary:
    """Words that say how a product is made (``form``), of which part (``parts``: word -> name, in order), and noise."""

    form: tuple[str, ...] = ("extract", "powder", "oil", "dried", "whole", "cut", "pure", "raw", "standard", "economy", "medium", "promo", "large", "small")
    parts: dict[str, str] = field(default_factory=lambda: {"root": "root", "roots": "root", "leaf": "leaf", "leaves": "leaf", "seed": "seed", "seeds": "seed", "bark": "bark", "flower": "flower", "ring": "ring"})
    noise: tuple[str, ...] = ("kg", "pack")
    #: Words that are never part of a binomial in ``ngram_candidates``, beside form and part words.
    stop: tuple[str, ...] = ("the", "and", "fresh", "wild", "golden")
    #: Phrases that ``clean_common`` strips, and last words that make a name no scientific one.
    phrases: tuple[str, ...] = ("oil extract", "extract", "powder", "oil")
    vernacular: tuple[str, ...] = ("leaf", "root", "seed", "oil")

    @property
    def strip(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.parts, *self.form, *self.noise]))

    @property
    def label_words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.form, *self.parts]))


DEFAULT = Vocabulary()
# The words of botanical catalogues, as their data files use them.
BOTANICAL = Vocabulary(
    form=(
        "extract", "powder", "powdered", "oil", "soluble", "water", "glycerin", "glycol", "infused", "carrier", "essential", "oleoresin", "hydrosol", "paste", "dried", "freeze",
        "cut", "whole", "isolate", "standardized", "standardised", "organic", "natural", "pure", "concentrate", "concentrated", "liquid", "gum", "co2", "virgin", "refined", "fine", "bulk",
        "wholesale", "premium", "ground", "raw", "for", "personal", "care",
    ),
    parts={
        "root": "root", "roots": "root", "leaf": "leaf", "leaves": "leaf", "seed": "seed", "seeds": "seed", "bark": "bark", "flower": "flower", "flowers": "flower", "phool": "flower",
        "phul": "flower", "fruit": "fruit", "fruits": "fruit", "berry": "fruit", "rhizome": "rhizome", "peel": "peel", "pericarp": "peel", "rind": "peel", "aerial": "aerial", "herb": "aerial",
        "wood": "wood", "bud": "bud", "buds": "bud", "stem": "stem", "tuber": "tuber", "husk": "husk", "pod": "pod", "pods": "pod", "shell": "shell", "resin": "resin", "gum": "gum", "nut": "seed",
    },
    noise=("chaal", "chhal", "patta", "patti", "beej", "mool", "chilka", "dana", "sabut", "gutli", "booti", "buti", "big", "small", "kg", "gm"),
    stop=(
        "extracts", "powders", "oils", "granules", "granulated", "dry", "fresh", "sifted", "tincture", "capsules", "capsule", "tablet", "tablets", "softgel", "juice", "flakes", "chips", "oleoresins",
        "fragrance", "aroma", "diffuser", "inspired", "million", "bliss", "ultra", "grade", "black", "white", "red", "green", "blue", "yellow", "golden", "wild", "sweet", "bitter", "food", "gel", "butter",
    ),
    phrases=(
        "Oil Soluble Extract", "Water Soluble Extract", "Propylene Glycol Extract", "Glycerin Extract", "CO2 Extract", "PG Extract", "Infused Oil", "Carrier Oil", "Essential Oil", "Extract Paste",
        "Extract Powder", "Oleoresin", "Hydrosol", "Extract", "Powder", "Paste",
    ),
    vernacular=(
        "petal", "basil", "gourd", "daisy", "mustard", "cornflower", "pea", "apple", "tree", "barberry", "kino", "kudzu", "matcha", "husk", "jivak", "iridis", "patti", "phool", "phul",
        "mirch", "chaal", "dana", "badi", "murga", "irani", "madrasi", "fagonia", "wood", "kahwa",
    ),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def norm(c: Column | str) -> Column:
    """Matching key: lower case, the hybrid sign as x, everything but a-z, 0-9, hyphen and space dropped; null gives ''."""
    x = F.trim(F.replace(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("×"), F.lit("x")))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9\\- ]+", " "), " +", " "))


def squeeze(c: Column | str) -> Column:
    """Runs of any white space, no-break spaces included, become one space; null gives ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "(?U)\\s+", " "), "^ | $", "")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[^A-Za-z]+"), lambda t: t != "")


def _without(c: Column, words) -> Column:
    return F.filter(_tokens(c), lambda t: ~F.array_contains(_words(words), F.lower(t)))


def part_strip(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """A name without parentheses and without part, form and noise words; case is kept."""
    return F.array_join(_without(F.regexp_replace(_col(c), "\\([^)]*\\)", " "), v.strip), " ")


def label_tokens(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """The words of a label that are neither form nor part words."""
    return _without(F.regexp_replace(squeeze(c), "\\([^)]*\\)", " "), v.label_words)


def clean_label(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    return F.array_join(label_tokens(c, v), " ")


def strip_trailing_parens(c: Column | str) -> tuple[Column, Column]:
    """(text without its trailing parenthesised groups, those groups from the last to the first)."""
    tail = F.regexp_extract(_col(c), "((\\s*\\([^()]*\\)\\s*)+)$", 1)
    groups = F.reverse(F.transform(F.regexp_extract_all(tail, F.lit("\\(([^()]*)\\)"), F.lit(1)), lambda g: F.trim(g)))
    return F.regexp_replace(_col(c), "(\\s*\\([^()]*\\)\\s*)+$", ""), groups


def binomial_case(genus: Column, species: Column) -> Column:
    return F.concat(F.upper(F.substring(genus, 1, 1)), F.lower(F.substr(genus, F.lit(2))), F.lit(" "), F.lower(species))


def clean_common(c: Column | str, phrases: tuple[str, ...] = DEFAULT.phrases) -> Column:
    """A trade name without its country tag and form phrases (the longest first)."""
    x = F.trim(F.regexp_replace(_col(c), "^\\s*\\[[A-Za-z]{2,4}\\]\\s*", ""))
    for p in sorted(phrases, key=lambda p: -len(p)):
        x = F.regexp_replace(x, f"(?i)\\b{p}\\b", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\\s*[,\\-–]\\s*$", ""), "\\s{2,}", " "), "^[ ,\\-]+|[ ,\\-]+$", "")


def country_tag(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "^\\s*(\\[[A-Za-z]{2,4}\\])", 1)


def folded_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(F.lower(_col(a)), F.lower(_col(b)))


def canonical_of(c: Column | str) -> Column:
    """A scientific name's binomial, without what follows; '' where it begins with none."""
    return F.regexp_extract(squeeze(c), "^([A-Z][a-zA-Z-]+ ×?[a-z][a-zA-Z-]+)", 1)


#: Tokens of a name that are not part of it.
RANK_MARKERS = ("var.", "subsp.", "ssp.", "f.", "forma", "cv.")


def name_parts(c: Column | str, markers: tuple[str, ...] = RANK_MARKERS) -> Column:
    """Struct of genus, species, infra and rank, guessed from the number of tokens that are no rank markers; a hybrid sign
    separates tokens and is none."""
    t = F.filter(F.split(squeeze(F.replace(_col(c), F.lit("×"), F.lit(" "))), " "), lambda x: (x != "") & ~F.array_contains(_words(markers), x))
    n = F.size(t)
    return F.struct(
        F.get(t, F.lit(0)).alias("genus"), F.get(t, F.lit(1)).alias("species"), F.get(t, F.lit(2)).alias("infra"),
        F.when(n >= 3, "infraspecific").when(n == 2, "species").when(n == 1, "genus").alias("rank"),
    )


def slug(c: Column | str, markers: str = "var|subsp|ssp|f|cv|forma") -> Column:
    """Lower case, the hybrid sign as x-, without rank markers; other characters become single hyphens."""
    x = F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("×"), F.lit("x-")), f"\\b({markers})\\.?\\b", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_scientific(c: Column | str, vernacular: tuple[str, ...] = DEFAULT.vernacular) -> Column:
    """A capital word (which may have further small ones) and a small one, and the last word is no vernacular one."""
    x = squeeze(c)
    return x.rlike("^[A-Z][a-z]+(?:[- ][a-z]+)* [a-z]") & ~F.array_contains(_words(vernacular), F.lower(F.element_at(F.split(x, " "), -1)))


def _binomials(c: Column) -> Column:
    whole = F.regexp_extract_all(c, F.lit("\\b[A-Z][a-z]+\\s+[A-Za-z][a-z]{2,}(?:-[a-z]+)?\\b"), F.lit(0))
    return F.transform(whole, lambda m: binomial_case(F.get(F.split(m, "\\s+"), F.lit(0)), F.get(F.split(m, "\\s+"), F.lit(1))))


def _parentheses(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\(([^)]+)\\)"), F.lit(1))


def _core(c: Column) -> Column:
    x = F.regexp_replace(F.get(F.split(c, "\\|"), F.lit(0)), "\\([^)]*\\)", " ")
    x = F.regexp_replace(x, "(?i)\\b\\d+(\\.\\d+)?\\s*(ml|l|g|kg|gm|mg|oz|lb|%|:1)\\b", " ")
    x = F.regexp_replace(x, "(?i)\\b\\d+\\s*[x×]\\s*\\d+\\b", " ")
    return F.regexp_replace(x, "(?s)[-–—].*$", " ")


def _shortened(t: Column) -> Column:
    """A token array as candidates: all of it, its first two, its first."""
    whole, two, one = F.array_join(t, " "), F.array_join(F.slice(t, 1, 2), " "), F.get(t, F.lit(0))
    return F.when(F.size(t) >= 2, F.array(whole, two, one)).when(F.size(t) == 1, F.array(whole)).otherwise(F.array().cast("array<string>"))


def title_candidates(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """Candidates of a catalogue title: binomials, parentheses, then the core shortened step by step."""
    x = F.trim(_col(c))
    return F.concat(_binomials(x), _parentheses(x), _shortened(_without(_core(x), v.label_words)))


def serving_candidates(latin: Column | str, label: Column | str, v: Vocabulary = DEFAULT, full_label: bool = True) -> Column:
    """Candidates of a query, the most specific first: latin, the full label, its core shortened step by step."""
    given = [F.when(F.coalesce(_col(latin), F.lit("")) != "", F.array(_col(latin))).otherwise(F.array().cast("array<string>"))]
    if full_label:
        given.append(F.when(F.trim(F.coalesce(_col(label), F.lit(""))) != "", F.array(_col(label))).otherwise(F.array().cast("array<string>")))
    return F.concat(*given, _shortened(label_tokens(label, v)))


def _stripped_title(c: Column) -> Column:
    """A title without parentheses, pack sizes, what is behind a bar, and what is behind a dash."""
    x = F.regexp_replace(F.regexp_replace(c, "\\([^)]*\\)", " "), "(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:ml|l|g|kg|gm|mg|oz|%|:1)\\b", " ")
    return F.regexp_replace(F.get(F.split(x, "\\|"), F.lit(0)), "(?s)[-–—].*$", " ")


def ngram_binomials(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """Binomials of a title, in any case, neither word of which is a form, part or stop word."""
    whole = F.regexp_extract_all(_col(c), F.lit("\\b[A-Za-z][a-z]+\\s+[A-Za-z][a-z]{2,}(?:-[a-z]+)?\\b"), F.lit(0))
    pairs = F.filter(F.transform(whole, lambda m: F.split(m, "\\s+")), lambda p: ~F.arrays_overlap(F.transform(p, F.lower), _words((*v.label_words, *v.stop))))
    return F.transform(pairs, lambda p: binomial_case(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def ngram_core(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """A title's words without form and part words; its first word where none is left; '' without words."""
    t = _tokens(_stripped_title(_col(c)))
    return F.coalesce(F.nullif(F.array_join(F.filter(t, lambda w: ~F.array_contains(_words(v.label_words), F.lower(w))), " "), F.lit("")), F.get(t, F.lit(0)), F.lit(""))


def ngram_candidates(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """Binomials, parentheses, then prefixes of the core from the longest to the shortest; the first of equal ones stays."""
    t = _tokens(_stripped_title(_col(c)))
    prefixes = F.when(F.size(t) > 0, F.transform(F.sequence(F.size(t), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(t, F.lit(1), k), " "))).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.transform(F.concat(ngram_binomials(c, v), _parentheses(_col(c)), prefixes), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(every, lambda s, i: F.array_position(F.transform(every, F.lower), F.lower(s)) == i + 1)


def plant_part(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """Name of the first part word, in the vocabulary's order, that the text has as a word."""
    found = F.filter(_words(v.parts), lambda w: F.array_contains(F.split(F.lower(_col(c)), "[^a-z0-9_]+"), w))
    names = F.create_map(*[F.lit(x) for pair in v.parts.items() for x in pair])
    return F.coalesce(F.element_at(names, F.get(found, F.lit(0))), F.lit("unspecified"))


def plant_part_anywhere(texts: list[Column | str], v: Vocabulary = DEFAULT) -> Column:
    """Name of the leftmost part word, inside words too, of the first text that has any (the longest word wins)."""
    pattern = "(" + "|".join(sorted(v.parts, key=len, reverse=True)) + ")"
    names = F.create_map(*[F.lit(x) for pair in v.parts.items() for x in pair])
    hits = [F.element_at(names, F.nullif(F.regexp_extract(F.lower(squeeze(t)), pattern, 1), F.lit(""))) for t in texts]
    return F.coalesce(*hits, F.lit("unspecified"))


def prose_key(c: Column | str) -> Column:
    """Key that compares prose without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(squeeze(c)), "[^a-z0-9 ]+", ""), " +", " "))


def adds_information(reason: Column | str, body: Column | str) -> Column:
    r, b = prose_key(reason), prose_key(body)
    return (r != "") & (r != b) & ~F.contains(b, r)


def first_sentence(c: Column | str) -> Column:
    s = F.trim(F.get(F.split(F.coalesce(_col(c), F.lit("")), "\\.\\s"), F.lit(0)))
    return F.when(s == "", "").when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def rate(part: Column, whole: Column, empty: float) -> Column:
    """part / whole to three digits; ``empty`` where there is no whole."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty)), 3)


def is_binomial(c: Column | str) -> Column:
    """A capital word and, behind a space or a hybrid sign, something more."""
    return F.coalesce(F.trim(_col(c)).rlike("^[A-Z][a-z]+[ ×]"), F.lit(False))


def species_key(c: Column | str) -> Column:
    """Key of a name's genus and epithet, hybrid signs aside."""
    x = norm(F.regexp_replace(F.regexp_replace(_col(c), "^×", ""), "\\s×\\s?", " "))
    return F.array_join(F.slice(F.split(x, " "), 1, 2), " ")


def genus_token(c: Column | str) -> Column:
    """Key of a name's first word."""
    return norm(F.get(F.split(F.trim(_col(c)), "[ ×]"), F.lit(0)))


def epithet_shaped(c: Column | str) -> Column:
    """Whether the second word of a name's key looks like an epithet of three letters or more."""
    return F.coalesce(F.get(F.split(norm(c), " "), F.lit(1)).rlike("^[a-z][a-zà-ÿ-]{2,}$"), F.lit(False))
