"""Entity resolution in three passes and claim consolidation.

Groups are tables (gid, canonical_name, entity_type, aliases, mention_count, sources); gid is the
order of the group's first mention, so the order of groups needs no extra column and
every tie that goes to the first seen is a minimum.  The name map is a table (norm, gid).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import NATIVE_LENGTH, is_digits, is_email, normalize_name, similar, similar_long, sorted_tokens, strip_u
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace
from loomgraph.schema import FUZZY


def entity_id(kind: Column, name: Column) -> Column:
    """Stable id of an entity: type and normalised name."""
    return F.sha2(F.concat_ws("|", kind, normalize_name(name)), 256)


def exact_pass(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions(ord, artifact_id, name, entity_type, aliases) -> (groups, name map).

    Names whose normal form has fewer than 2 characters are dropped. The commonest
    spelling is canonical (then the longest, then the first), the commonest type wins
    (then the first). In the map a group's own name beats aliases; an alias goes to the earliest group that holds it.
    """
    m = mentions.select("ord", "artifact_id", strip_u(F.col("name")).alias("name"), F.coalesce("entity_type", F.lit("topic")).alias("entity_type"), "aliases", normalize_name(F.col("name")).alias("norm")).where("length(norm) >= 2")
    spelled = m.groupBy("norm", "name").agg(F.count("*").alias("c"), F.min("ord").alias("o"))
    canonical = spelled.groupBy("norm").agg(F.max(F.struct("c", F.length("name").alias("l"), (-F.col("o")).alias("o"), "name"))["name"].alias("canonical_name"), F.collect_set("name").alias("spellings"))
    kinds = m.groupBy("norm", "entity_type").agg(F.count("*").alias("c"), F.min("ord").alias("o")).groupBy("norm").agg(F.max(F.struct("c", (-F.col("o")).alias("o"), "entity_type"))["entity_type"].alias("entity_type"))
    rest = m.groupBy("norm").agg(
        F.min("ord").alias("gid"), F.count("*").alias("mention_count"),
        F.collect_set(F.when(F.col("artifact_id").cast("string") != "", F.col("artifact_id"))).alias("sources"),
        F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), strip_u), lambda a: a != "")))).alias("given"),
    )
    groups = rest.join(canonical, "norm").join(kinds, "norm").select(
        "gid", "canonical_name", "entity_type", F.array_sort(F.array_except(F.array_union("spellings", "given"), F.array("canonical_name"))).alias("aliases"), "mention_count", "sources", "norm"
    )
    own = groups.select("norm", "gid", F.lit(0).alias("rank"))
    other = groups.select(F.explode("aliases").alias("a"), "gid").select(normalize_name(F.col("a")).alias("norm"), "gid", F.lit(1).alias("rank")).where("norm <> ''")
    names = own.unionByName(other).groupBy("norm").agg(F.min(F.struct("rank", "gid"))["gid"].alias("gid"))
    return groups.drop("norm"), names


def regroup(groups: DataFrame, names: DataFrame, edges: DataFrame, ws: Workspace, longer_wins: bool) -> tuple[DataFrame, DataFrame]:
    """Merge groups joined by ``edges(a, b)``: most mentions win, then (pass 3) the longer name, then the first.

    Without any edge the map stays as it is. Else it is rebuilt from all names and
    aliases, and of groups that share a name the one whose first member comes last wins.
    """
    if edges.isEmpty():
        return groups, names
    comp = connected_components(edges, ws).toDF("gid", "root")
    tied = groups.join(comp, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    best = F.max(F.struct("mention_count", F.length("canonical_name").alias("l"), (-F.col("gid")).alias("o"), "canonical_name", "entity_type")) if longer_wins else F.max(F.struct("mention_count", (-F.col("gid")).alias("o"), "canonical_name", "entity_type"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = tied.groupBy(F.col("root").alias("gid")).agg(best.alias("best"), flat(F.array_append("aliases", F.col("canonical_name"))).alias("all"), F.sum("mention_count").alias("mention_count"), flat("sources").alias("sources"))
    out = ws.save(merged.select("gid", F.col("best.canonical_name").alias("canonical_name"), F.col("best.entity_type").alias("entity_type"), F.array_sort(F.array_except("all", F.array("best.canonical_name"))).alias("aliases"), "mention_count", "sources"), "groups")
    every = out.select("gid", F.explode(F.array_append("aliases", F.col("canonical_name"))).alias("n")).select("gid", normalize_name(F.col("n")).alias("norm"))
    return out, ws.save(every.groupBy("norm").agg(F.max("gid").alias("gid")), "names")


def alias_edges(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): a group and the owner of one of its aliases, of the same type."""
    held = groups.select("gid", "entity_type", F.explode("aliases").alias("a")).select("gid", "entity_type", normalize_name(F.col("a")).alias("norm")).distinct()
    owner = names.withColumnRenamed("gid", "b").join(groups.select(F.col("gid").alias("b"), F.col("entity_type").alias("t")), "b")
    return held.join(owner, "norm").where("gid <> b AND entity_type = t").select(F.col("gid").alias("a"), "b").distinct()


def alias_pass(groups: DataFrame, names: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    return regroup(groups, names, ws.save(alias_edges(groups, names), "alias-edges"), ws, longer_wins=False)


def similar_pairs(groups: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(a, b) of the same type and first three characters whose names are ``threshold`` alike; guards and a bounded Levenshtein go first.

    Names fall into bands of length, a band so wide that alike names lie in one or in neighbours: a
    block of one type and start is split by it. Pairs with a long name are compared apart.
    """
    n = groups.select("gid", "entity_type", normalize_name(F.col("canonical_name")).alias("n"))
    n = n.where((F.length("n") >= 4) & ~is_email(F.col("n")) & ~is_digits(F.col("n")))
    n = n.select("gid", "entity_type", F.left("n", F.lit(3)).alias("block"), sorted_tokens(F.col("n")).alias("t")).withColumn("l", F.length("t"))
    # |x| - |y| <= (1 - t) (|x| + |y|): in logarithms a fixed step, one band.
    step = math.log((2 - threshold) / threshold) if threshold < 1 else 1e-9
    band = F.floor(F.log(F.greatest("l", F.lit(1)).cast("double")) / step + 1e-9)
    n = n.withColumn("band", band)
    a = n.toDF("a", "entity_type", "block", "x", "lx", "band")
    # Every name meets its own band and the one above.
    b = n.select(F.col("gid").alias("b"), "entity_type", "block", F.col("t").alias("y"), F.col("l").alias("ly"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("own"))
    slack = round((1 - threshold) * 1000)
    near = a.join(b, ["entity_type", "block", "band"]).where("a <> b AND (own > band OR a < b)").where(1000 * F.abs(F.col("lx") - F.col("ly")) <= slack * (F.col("lx") + F.col("ly")))
    long = F.greatest("lx", "ly") > NATIVE_LENGTH
    found = near.where(~long).where(similar(F.col("x"), F.col("y"), threshold)).unionByName(near.where(long).where(similar_long(F.col("x"), F.col("y"), threshold)))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def prefix_pairs(groups: DataFrame, ws: Workspace) -> DataFrame:
    """(a, b) among the next four in name order of a type, one name being the other's start before a blank or dot.

    Places come from a range-partitioned sort: rank inside a range plus the counts of the
    ranges before it, so a type may have any number of names.
    """
    n = groups.select("gid", "entity_type", normalize_name(F.col("canonical_name")).alias("n"))
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ws.save(n.repartitionByRange(parts, "entity_type", "n", "gid").withColumn("part", F.spark_partition_id()), "by-name")
    before = dealt.groupBy("part").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k")).drop("k")
    placed = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("entity_type", "n", "gid"))).join(F.broadcast(before), "part")  # a row per partition
    placed = ws.save(placed.select("gid", "entity_type", "n", (F.col("r") + F.col("before")).alias("place")), "places")
    ahead = placed.select(F.col("gid").alias("a"), F.col("entity_type").alias("t"), F.col("n").alias("x"), F.explode(F.array(*(F.col("place") + k for k in range(1, 5)))).alias("place"))
    near = ahead.join(placed, "place").where("t = entity_type AND length(x) >= 5 AND length(n) >= 5")
    first = F.length("x") <= F.length("n")
    short, long = F.when(first, F.col("x")).otherwise(F.col("n")), F.when(first, F.col("n")).otherwise(F.col("x"))
    starts = F.startswith(long, F.concat(short, F.lit(" "))) | F.startswith(long, F.concat(short, F.lit(".")))
    return near.where(starts).select(F.least("a", "gid").alias("a"), F.greatest("a", "gid").alias("b")).distinct()


def fuzzy_pass(groups: DataFrame, names: DataFrame, ws: Workspace, threshold: float = FUZZY) -> tuple[DataFrame, DataFrame]:
    edges = ws.save(similar_pairs(groups, threshold).unionByName(prefix_pairs(groups, ws)).distinct(), "fuzzy-edges")
    return regroup(groups, names, edges, ws, longer_wins=True)


def resolve(mentions: DataFrame, ws: Workspace, threshold: float = FUZZY) -> tuple[DataFrame, DataFrame]:
    """All three passes: (groups, name map)."""
    g, n = exact_pass(mentions)
    g, n = ws.save(g, "exact-groups"), ws.save(n, "exact-names")
    g, n = alias_pass(g, n, ws)
    return fuzzy_pass(g, n, ws, threshold)


def entities(groups: DataFrame) -> DataFrame:
    """Entity records, most mentions first."""
    out = groups.select("gid", entity_id(F.col("entity_type"), F.col("canonical_name")).alias("id"), "canonical_name", "entity_type", F.array_sort("aliases").alias("aliases"), "mention_count", "sources", F.lit("{}").alias("properties"))
    return out.orderBy(F.desc("mention_count"), "gid")


def _named(rows: DataFrame, ws: Workspace, **names: DataFrame) -> DataFrame:
    """``rows``, stored, with the columns of ``names``, tables by key with one row per key; null where there is none. Popular keys are split."""
    out = rows
    for key, table in names.items():
        found = ws.save(rows.groupBy(key).agg(F.count("*").alias("__rows")).join(table, key, "left"), "found")
        out = lookup_join(out, found, [key], "__rows").drop("__rows")
    return out


def place_claims(raw: DataFrame, names: DataFrame) -> DataFrame:
    """raw claims with s and o, the groups of subject and object, and ``skipped``.

    Skipped: the subject is unknown, null or empty, or a non-empty object is unknown. An empty or null object is the subject.
    """
    ws = Workspace(raw.sparkSession, "claims")
    keyed = ws.save(raw.withColumns({f"{k[0]}n": normalize_name(F.coalesce(k, F.lit(""))) for k in ("subject", "object")}), "keyed")
    placed = _named(keyed, ws, sn=names.toDF("sn", "s"), on=names.toDF("on", "o"))
    skipped = F.col("s").isNull() | (F.col("o").isNull() & (F.col("on") != ""))
    return placed.withColumn("skipped", skipped).withColumn("o", F.coalesce("o", "s")).drop("sn", "on")


def skipped_claims(raw: DataFrame, names: DataFrame) -> DataFrame:
    """One row: claims in all, and those skipped as their subject or a named object is no known entity."""
    return place_claims(raw, names).agg(F.count("*").alias("raw_claims"), F.count_if("skipped").alias("skipped"))


def top_entities(groups: DataFrame, top: int = 15, aliases: int = 3) -> DataFrame:
    """The most mentioned entities with some of their aliases, as a report shows them."""
    return groups.orderBy(F.desc("mention_count"), "gid").limit(top).select("gid", "canonical_name", "entity_type", "mention_count", F.slice(F.array_sort("aliases"), 1, aliases).alias("aliases"))


def consolidate(raw: DataFrame, names: DataFrame, groups: DataFrame) -> DataFrame:
    """raw(ord, artifact_id, date, claim_type, subject, object, detail, excerpt, confidence) -> claims.

    One row per type, subject and object: the first detail, all evidence in input order, the highest confidence.
    """
    kept = place_claims(raw, names).where("NOT skipped")
    c = F.coalesce("confidence", F.lit(0.7))
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("excerpt", F.lit("")).alias("excerpt"), c.alias("confidence"), F.col("artifact_id").cast("string").alias("artifact_id"), F.col("date").cast("string").alias("date")))), lambda e: e.dropFields("ord"))
    g = kept.groupBy("claim_type", "s", "o").agg(F.min_by("detail", "ord").alias("detail"), evidence.alias("evidence"), F.greatest(F.max(c), F.lit(0.0)).alias("confidence"), F.count("*").alias("mention_count"), F.min("ord").alias("ord"))
    who = lambda k, n: groups.select(F.col("gid").alias(k), entity_id(F.col("entity_type"), F.col("canonical_name")).alias(f"{n}_id"), F.col("canonical_name").alias(f"{n}_name"))
    ws = Workspace(raw.sparkSession, "consolidated")
    full = _named(ws.save(g, "claims"), ws, s=who("s", "subject"), o=who("o", "object"))
    return full.select(F.sha2(F.concat_ws("|", "claim_type", "subject_id", "object_id"), 256).alias("id"), "claim_type", "subject_id", "subject_name", "object_id", "object_name", "detail", "evidence", "confidence", "mention_count", "ord").orderBy(F.desc("confidence"), F.desc("mention_count"), "ord").drop("ord")


def reduction_stats(mentions: DataFrame, raw: DataFrame, groups: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: counts before and after, and their ratios as number and text."""
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("k", F.lit(1))
    joined = one(mentions, "raw_entities")
    for df, n in ((groups, "entities"), (raw, "raw_claims"), (claims, "claims")):
        joined = joined.join(one(df, n), "k")
    for a, b, n in (("raw_entities", "entities", "entity"), ("raw_claims", "claims", "claim")):
        r = F.col(a) / F.greatest(F.col(b), F.lit(1))
        joined = joined.withColumn(f"{n}_ratio", F.round(r, 6)).withColumn(f"{n}_ratio_text", F.format_string("%.1fx", r))
    return joined.drop("k")
