"""Column functions for text, numbers, keys and labels. IDs in brackets are those of the inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"

#: Other names of the liquids.
ALIASES = {
    "methylene iodide": "diiodomethane",
    "methylene iodine": "diiodomethane",
    "diiodo methane": "diiodomethane",
    "glycerin": "glycerol",
    "di water": "water",
    "deionized water": "water",
    "distilled water": "water",
}

#: Words that tell a family, in order.
FAMILY_WORDS = (
    ("polymer", ("poly", "pla", "ptfe", "fep", "topas")),
    ("cellulosic", ("paper", "cellulose")),
    ("inorganic", ("tio2", "titan", "oxide", "glass", "silicon")),
    ("biological", ("bio", "bacter", "microb", "fung")),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """[P1] Null becomes empty; white space is trimmed and collapsed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE, " "))


def normalised_token(c: Column | str) -> Column:
    """[P2] Clean text in lower case."""
    return F.lower(clean_text(c))


def bare_token(c: Column | str) -> Column:
    """[P3] Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def stable_id(prefix: str, parts: Sequence[Column | str], length: int = 12) -> Column:
    """[P4] Prefix and the first hex digits of the SHA-256 of the normalised parts, joined by the unit separator."""
    joined = F.concat_ws("\x1f", *[normalised_token(p) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(joined, 256), 1, length)))


def piped_id(prefix: str, parts: Sequence[Column | str], length: int = 12) -> Column:
    """[P4] The other recipe: parts are only trimmed and put in lower case, and joined by a bar. The two never match."""
    joined = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(col(p), F.lit("")))) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(joined, 256), 1, length)))


def first_filled(*cols: Column | str) -> Column:
    """The first column that is not blank; else empty."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cols], F.lit(""))


def canonical_name(c: Column | str, aliases: dict[str, str] = ALIASES) -> Column:
    """[P5] The usual name of a token, for a small alias map; larger ones are joined."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    token = normalised_token(c)
    return F.coalesce(F.element_at(pairs, token), token)


def finite(c: Column | str) -> Column:
    """[P6] A number, or null for anything else, infinities and NaN included."""
    n = col(c).try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def leading_number(c: Column | str) -> Column:
    """[P7] The number at the start of a text."""
    return F.regexp_extract(clean_text(c), r"^([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))", 1).try_cast("double")


def value_with_deviation(c: Column | str) -> Column:
    """[S5a] 'x ± s', 'x (s)' or a bare number as a struct of value and deviation; null if it is none of them."""
    return clean_value(clean_text(c))


def clean_value(t: Column) -> Column:
    """[S5a] value_with_deviation of text that is clean: one pattern has all three forms."""
    number = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
    pattern = rf"^{number}(?: ?± ?{number}| ?\({number}\))?$"
    part = lambda k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    return F.struct(part(1).try_cast("double").alias("value"), F.coalesce(part(2), part(3)).try_cast("double").alias("deviation"))


def family(c: Column | str) -> Column:
    """[P10] The first family that has one of its words in the text."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    out = F
    for name, words in FAMILY_WORDS:
        out = out.when(t.rlike("|".join(words)), name)
    return out.otherwise("other")


def angle_type(c: Column | str) -> Column:
    """[P11] The angle type that a free text names; others pass through."""
    t = normalised_token(c)
    has = t.contains
    return (F.when((t == "") | has("not specified") | has("unspecified"), "reported_unspecified").when(has("advanc"), "advancing").when(has("reced"), "receding")
        .when(has("equilibrium"), "equilibrium").when(has("capillary") | has("washburn"), "capillary_rise_derived").when(has("roughness") & has("correct"), "roughness_corrected_apparent")
        .when(has("apparent"), "apparent").when(has("static"), "static").otherwise(t))


def permissions(split: Column | str, tuning_on_train: bool = False) -> Column:
    """[P12] Struct of training, tuning and evaluation flags of a split; the two rule sets differ in tuning on train."""
    s = col(split)
    yes = lambda c: F.when(c, "yes").otherwise("no")
    held = ~s.isin("train", "validation") if tuning_on_train else s.isin("internal_test", "legacy_external", "prospective_open_external")
    return F.struct(yes(s == "train").alias("training"), yes(s.isin("train", "validation") if tuning_on_train else s == "validation").alias("tuning"), yes(held).alias("evaluation"))


def novelty(material_known: Column, liquid_known: Column) -> Column:
    """[P13] Which of material and liquid the training data have."""
    return F.when(material_known & liquid_known, "known_material_known_liquid").when(material_known, "known_material_new_liquid").when(liquid_known, "new_material_known_liquid").otherwise("new_material_new_liquid")


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """[P14] The label of the bin (lower, upper] that holds a value; null outside all."""
    x = col(c)
    out = F.when(x.isNull() | (x <= edges[0]), None)
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(x <= edge, label)
    return out


def list_of(c: Column | str) -> Column:
    """[P19] Parts of a ';' list, without blanks and 'nan'."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def list_text(items: Column) -> Column:
    """[P20] Sorted distinct items as a ';' list."""
    return F.array_join(F.array_sort(F.array_distinct(items)), ";")


def anchored(base: Column | str, residual: Column | str, low: float = 0.0, high: float = 180.0) -> Column:
    """[P22] base + residual within bounds; null if either is."""
    x = col(base) + col(residual)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def draw(*cols: Column | str) -> Column:
    """A fixed number below 2**32 for a seed and keys, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long")
