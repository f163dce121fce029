"""The attribute column of GFF3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import let


def _pairs(text: Column) -> Column:
    """array<struct<k, v>> of the parts with an equals sign, in order."""
    parts = F.filter(F.split(F.btrim(F.btrim(text), F.lit(";")), ";", -1), lambda p: F.instr(p, "=") > 0)
    return F.transform(parts, lambda p: F.struct(F.btrim(F.substring_index(p, "=", 1)).alias("k"), F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))


def _last_wins(pairs: Column) -> Column:
    """A map in which a later pair replaces an earlier one of the same key; empty keys go."""

    def kept(ps: Column) -> Column:
        later = lambda p, i: F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])
        return F.filter(ps, lambda p, i: (p["k"] != "") & ~later(p, i))

    return F.map_from_entries(let(pairs, kept))


def percent_decoded(x: Column) -> Column:
    """%xx decoded; a plus sign stays; a text with a broken escape stays whole."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def strict(text: Column) -> Column:
    """map<string, string> with keys and values percent-decoded."""
    decoded = F.transform(_pairs(text), lambda p: F.struct(percent_decoded(p["k"]).alias("k"), percent_decoded(p["v"]).alias("v")))
    return _last_wins(decoded)


def lenient(text: Column) -> Column:
    """map<string, string> as written."""
    return _last_wins(_pairs(text))


def lenient_id(attributes: Column) -> Column:
    names = [F.nullif(attributes[n], F.lit("")) for n in ("ID", "locus_tag", "gene", "Name")]
    return F.coalesce(*names, F.lit("unknown"))
