"""Schema operators (P1-P5, P7-P9): renames, header catalogues, required sets.

Renames and field selection are plain projections built from the schema.
Header work runs on a header catalogue ``(file, pos, column_name)`` so that
one job profiles the headers of every file in a directory; a file's header
is one small group (its width), never a group that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pystrip
from ..plans import rulesets as RS

# Fixed value: the target fields suggested when no rule set is chosen.
EXPECTED_TARGET_FIELDS = ["code", "username", "firstname", "lastname", "email", "birthdate",
                          "address", "city", "phone", "cellphone", "countrycode",
                          "signuplanguagecode", "currencycode", "zip", "signupdate"]
# Fixed value: the prefix the header normalisation drops.
NAME_PREFIX = "^(customer|user|account|contact)"


# ---------------------------------------------------------------- P1, P2, P9
def rename_exact(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename only columns whose name equals a mapping key exactly."""
    exact = {k: v for k, v in mapping.items() if k in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(exact.get(c, c)) for c in df.columns])


def rename_ci(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Case-insensitive rename, the first matching mapping entry wins.

    When two columns end up with one name, the name keeps the position of its
    first column and the value of its last one (a dict assigned in order).
    """
    def target(c: str) -> str:
        for src, tgt in mapping.items():
            if src is not None and c.lower() == src.lower():
                return tgt
        return c

    order: list[str] = []
    source: dict[str, str] = {}
    for c in df.columns:
        t = target(c)
        if t not in source:
            order.append(t)
        source[t] = c
    return df.select(*[F.col(f"`{source[t]}`").alias(t) for t in order])


def select_required(df: DataFrame, required: list[str], keep: list[str] | None = None) -> DataFrame:
    """Only the columns in the required set (case-folded), in frame order."""
    req = {r.lower() for r in required}
    keep = keep or []
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or c.lower() in req])


# ---------------------------------------------------------------- P3, P7
def clean_header(name: Column) -> Column:
    """Strip, then drop one pair of enclosing ``"``, then one pair of ``'``."""
    c = pystrip(name)
    for q in ['"', "'"]:
        c = F.when(c.startswith(q) & c.endswith(q), F.substring(c, F.lit(2), F.length(c) - F.lit(2))).otherwise(c)
    return c


def normalize_header(name: Column) -> Column:
    """Lower case, no ``_``, ``-`` or whitespace, one leading
    customer/user/account/contact removed."""
    no_seps = F.regexp_replace(F.lower(name), r"(?U)[_\s-]", "")
    return F.regexp_replace(no_seps, NAME_PREFIX, "")


def header_catalog_clean(headers: DataFrame) -> DataFrame:
    """P3 + P7 over a header catalogue: ``file, pos, column_name, cleaned, normalized``."""
    cleaned = clean_header(F.col("column_name"))
    return headers.select("file", "pos", "column_name", cleaned.alias("cleaned"),
                          normalize_header(F.col("column_name")).alias("normalized"))


# ---------------------------------------------------------------- P4
def resolve_required(regulation: str | None = None, requested: list[str] | None = None,
                     session: list[str] | None = None) -> list[str]:
    """Rule set, else the request's list, else the session's, else the default 16."""
    if regulation is not None and regulation in RS.RULESETS:
        return list(RS.RULESETS[regulation].required)
    for candidate in (requested, session):
        if candidate:
            return list(candidate)
    return list(RS.DEFAULT_REQUIRED)


# ---------------------------------------------------------------- P5
def missing_columns(headers: DataFrame, required: list[str],
                    mappings: dict[str, str] | None = None) -> DataFrame:
    """P5: ``file, pos, field`` for each required field a file's header lacks.

    Names compare in lower case after header clean-up; a mapped target counts
    as present when its source column is.  Required fields keep their order
    and spelling.
    """
    mappings = mappings or {}
    names = headers.select("file", F.lower(clean_header(F.col("column_name"))).alias("n"))
    per_file = names.groupBy("file").agg(F.collect_set("n").alias("avail"))   # one header per group
    avail = F.col("avail")
    if mappings:   # in their order, so a mapped target can be the source of the next
        steps = F.array(*[F.struct(F.lit(s.lower()).alias("s"), F.lit(t.lower()).alias("t")) for s, t in mappings.items()])
        avail = F.aggregate(steps, avail, lambda a, m: F.when(F.array_contains(a, m["s"]), F.array_append(a, m["t"])).otherwise(a))
    req = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("field")) for i, r in enumerate(required)])
    return (per_file.select("file", avail.alias("avail"), F.explode(req).alias("r"))
                    .where(~F.array_contains("avail", F.lower(F.col("r.field"))))
                    .select("file", F.col("r.pos").alias("pos"), F.col("r.field").alias("field")))


# ---------------------------------------------------------------- P8
def suggest_mappings(headers: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Suggested ``file, source_column, target`` per file, in two greedy passes.

    Pass 1: each source takes the last target with an equal normalised name.
    Pass 2: each still unmapped source, in header order, walks the targets in
    order, skips targets already used, and takes every target whose
    normalised name contains its own or is contained in it (a later one
    replaces an earlier one).  Pass 2 depends on order, so it folds over the
    file's header array with ``aggregate``; the group is one file's header.
    """
    targets = targets or EXPECTED_TARGET_FIELDS
    tgt = F.array(*[F.struct(F.lit(t).alias("t"), normalize_header(F.lit(t)).alias("nt")) for t in targets])
    src = headers.select("file", "pos", F.col("column_name").alias("s"),
                         normalize_header(F.col("column_name")).alias("ns"))
    # pass 1 (a projection): the last target with an equal normalised name
    equal = F.filter(tgt, lambda x: x["nt"] == F.col("ns"))
    src = src.withColumn("p1", F.when(F.size(equal) > 0, F.element_at(equal, -1)["t"]))
    per_file = (src.groupBy("file")
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "s", "ns", "p1"))).alias("cols")))
    entry = "struct<s:string,t:string>"
    init = F.filter(F.transform("cols", lambda c: F.struct(c["s"].alias("s"), c["p1"].alias("t"))),
                    lambda m: m["t"].isNotNull()).cast(f"array<{entry}>")

    def step(state, c):
        used = F.transform(state, lambda m: m["t"])

        def inner(cur, t):
            contains = F.instr(c["ns"], t["nt"]) > 0
            contained = F.instr(t["nt"], c["ns"]) > 0
            ok = (~F.array_contains(used, t["t"])) & ~F.coalesce(cur == t["t"], F.lit(False)) & (contains | contained)
            return F.when(ok, t["t"]).otherwise(cur)

        pick = F.aggregate(tgt, F.lit(None).cast("string"), inner)
        add = F.when(c["p1"].isNull() & pick.isNotNull(),
                     F.array(F.struct(c["s"].alias("s"), pick.alias("t")))).otherwise(F.array().cast(f"array<{entry}>"))
        return F.concat(state, add)

    final = F.aggregate("cols", init, step)
    return (per_file.select("file", F.explode(final).alias("m"))
                    .select("file", F.col("m.s").alias("source_column"), F.col("m.t").alias("target")))
