"""Labels, numbers, layer names and other strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column headings of ground-truth sheets by field, in lower case (fixed values).
HEADINGS = {
    "label": ("subject", "label", "beteckning", "littera"),
    "length": ("längd", "langd", "length"),
    "count": ("antal_vs", "antal", "count"),
    "layer": ("lager", "layer"),
    "document": ("document", "dokument", "ritning"),
}


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_label(label: Column) -> tuple[Column, Column, Column]:
    """System, type and dimension of SYSTEM-TYPE[-DIMENSION], upper case; nulls where it doesn't fit."""
    pattern = r"^\s*([A-Za-z]+[0-9]*)-([A-Za-z]+[0-9]+)(?:-([0-9]+))?\s*$"
    return tuple(F.upper(_or_null(F.regexp_extract(label, pattern, k))) for k in (1, 2, 3))  # type: ignore[return-value]


def locale_number(text: Column) -> Column:
    """A number with blanks between thousands and a decimal comma; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[\\s\\u00a0]", ""), "[^0-9.\\-]", "")
    return bare.try_cast("double")


def grid_label(text: Column) -> tuple[Column, Column]:
    """Prefix (upper case, may be empty) and value of a grid label such as A200 or 70,5; nulls for anything else."""
    pattern = r"(?U)^([^\W\d_]*)[\s-]?(\d+(?:[.,]\d+)?)$"
    bare = F.trim(text)
    fits = bare.rlike(pattern)
    return F.when(fits, F.upper(F.regexp_extract(bare, pattern, 1))), F.when(fits, F.replace(F.regexp_extract(bare, pattern, 2), F.lit(","), F.lit(".")).try_cast("double"))


def dash_signature(dashes: Column) -> Column:
    """A dash pattern without its scale: ``solid``, ``n<k>:<shares of the period>``, or ``raw:<text>`` where it can't be read."""
    inside = F.regexp_extract(dashes, r"^\s*\[([^\]]*)\]", 1)
    items = F.filter(F.split(F.trim(inside), r"[\s,]+"), lambda s: s != "")
    values = F.transform(items, lambda s: s.try_cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    shares = F.concat_ws("/", F.transform(values, lambda v: F.format_string("%.2f", F.bround(v / total, 2))))
    solid = dashes.isNull() | (F.trim(dashes) == "") | (dashes.rlike(r"^\s*\[") & ((F.size(items) == 0) | (total == 0)))
    readable = dashes.rlike(r"^\s*\[[^\]]*\]") & ~F.exists(values, lambda v: v.isNull())
    return F.when(solid, "solid").when(readable, F.concat(F.lit("n"), F.size(items).cast("string"), F.lit(":"), shares)).otherwise(F.concat(F.lit("raw:"), dashes))


def normal_heading(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9åäö_]", "")


def heading_field(text: Column) -> Column:
    """The field a heading stands for: an exact name first, then one that it holds."""
    h = normal_heading(text)
    exact, part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for field, names in reversed(HEADINGS.items()):
        exact = F.when(h.isin(*names), field).otherwise(exact)
        inside = F.lit(False)
        for n in names:
            inside = inside | h.contains(n)
        part = F.when(inside, field).otherwise(part)
    return F.coalesce(exact, part)


def system_from_layer(layer: Column) -> Column:
    """The last field between hyphens of what follows the last bar; null without one."""
    tail = F.element_at(F.split(layer, r"\|"), -1)
    fields = F.filter(F.split(tail, "-"), lambda f: f != "")
    return F.when(F.size(fields) > 0, F.element_at(fields, -1))


def layer_matches(layer: Column, tokens: list[str]) -> Column:
    """Whether any token lies in the layer's name between bars; an empty or null layer matches nothing."""
    marked = F.concat(F.lit("|"), layer, F.lit("|"))
    hit = F.lit(False)
    for t in tokens:
        hit = hit | marked.contains(t)
    return F.coalesce((layer != "") & hit, F.lit(False))


def layer_matches_any(layer: Column, tokens: Column) -> Column:
    """The same with the tokens in an array column; no token, or none at all, matches nothing."""
    marked = F.concat(F.lit("|"), layer, F.lit("|"))
    return F.coalesce((layer != "") & F.exists(tokens, lambda t: F.contains(marked, t)), F.lit(False))


def rule_applies(valid: Column, tokens: Column, rule_project: Column, project: Column) -> Column:
    """Whether a project's layer rule may be used for a drawing: valid, with tokens, and of the same project."""
    return F.coalesce(valid & (F.size(tokens) > 0) & (rule_project == project), F.lit(False))


def slug(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_.-]", "_")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def companion_stem(path: Column) -> Column:
    """The stem that a drawing shares with its ground-truth files."""
    return F.regexp_replace(file_stem(path), "-(single|bundle)$", "")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
