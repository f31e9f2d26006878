"""Resolution of mentions to entities: candidates, weighted evidence, vetoes, decisions; and promotion of names to entities.

Everything is a join on exact blocking keys and one expression per candidate. What must be known of all candidates of a
mention (how many aliases, best and runner-up) comes from aggregations, so that no candidates are gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind of evidence adds to a score.
WEIGHTS = {"exact_name": 0.60, "alias": 0.50, "initials_block": 0.15, "metadata": 0.35, "co_mention": 0.15, "authoritative": 0.10, "alias_unique": 0.10}
# By type, the score and the lead over the runner-up from which a mention is linked, the score from which it is ambiguous, and whether the name alone is not enough.
THRESHOLDS = {"PERSON": (0.92, 0.20, 0.55, True), "ORGANIZATION": (0.85, 0.12, 0.50, False), "PROJECT": (0.85, 0.12, 0.50, False)}


def is_specific(name: Column) -> Column:
    """Whether a folded project name is distinctive: three words and twelve letters or more."""
    return (F.size(F.split(name, " ")) >= 3) & (F.length(name) >= 12)


def is_initials_only(name: Column) -> Column:
    """Whether a folded name has no word of more than one letter."""
    return ~name.rlike(r"[a-z0-9]{2,}")


def candidates(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The candidates of mentions, by name, alias, or, of persons, last word and first letter.

    mentions: mention_id, type, name (folded). entities: entity_id, type, name, trust. aliases: entity_id, alias, autolink.
    Result: mention_id, mention_type, mention, entity_id, entity_type, name, trust, source, ambiguous, autolink; a pair
    that is found in several ways has the strongest.
    """
    m = mentions.select("mention_id", F.col("type").alias("mention_type"), F.col("name").alias("mention")).where("mention <> ''")
    e = entities.select("entity_id", F.col("type").alias("entity_type"), "name", "trust").where("name <> ''")
    typed = F.col("mention_type") == F.col("entity_type")
    exact = m.join(e, (F.col("mention") == F.col("name")) & typed).withColumn("way", F.lit(0)).withColumn("autolink", F.lit(True)).withColumn("ambiguous", F.lit(False))
    owners = aliases.groupBy("alias").agg((F.min("entity_id") != F.max("entity_id")).alias("ambiguous"))
    known = aliases.groupBy("entity_id", "alias").agg(F.max("autolink").alias("autolink")).join(owners, "alias").join(e, "entity_id")
    by_alias = m.join(known, (F.col("mention") == F.col("alias")) & typed).withColumn("way", F.lit(1))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    blocked = (m.where("mention_type = 'PERSON'").withColumn("last", last("mention")).withColumn("first", F.substring("mention", 1, 1))
               .join(e.where("entity_type = 'PERSON'").withColumn("last", last("name")).withColumn("first", F.substring("name", 1, 1)), ["last", "first"])
               .withColumn("way", F.lit(2)).withColumn("autolink", F.lit(False)).withColumn("ambiguous", F.lit(False)))
    columns = ["mention_id", "mention_type", "mention", "entity_id", "entity_type", "name", "trust", "way", "ambiguous", "autolink"]
    found = exact.select(*columns).unionByName(by_alias.select(*columns)).unionByName(blocked.select(*columns))
    best = found.groupBy("mention_id", "mention_type", "mention", "entity_id", "entity_type", "name", "trust").agg(F.min(F.struct("way", "ambiguous", "autolink")).alias("b"))
    source = F.element_at(F.array(F.lit("exact_name"), F.lit("alias"), F.lit("blocked")), F.col("b.way") + 1)
    return best.select(*columns[:7], source.alias("source"), F.col("b.ambiguous").alias("ambiguous"), F.col("b.autolink").alias("autolink"))


def score(found: DataFrame, asserted: DataFrame, together: DataFrame) -> DataFrame:
    """Adds ``vetoes`` (array), ``corroborated`` and ``score`` to candidates; a vetoed one scores 0, no score is over 1.

    asserted: mention_id, type, name: the names that the metadata of a mention's document gives. together: the same for
    other mentions in its passage. Both folded.
    """
    alone = found.groupBy("mention_id").agg((F.count(F.when(F.col("source") == "alias", 1)) == 1).alias("one_alias"))
    said = asserted.select("mention_id", F.col("type").alias("entity_type"), "name").distinct().withColumn("asserted", F.lit(True))
    persons = asserted.where("type = 'PERSON'").select("mention_id").distinct().withColumn("names_persons", F.lit(True))
    near = together.select("mention_id", F.col("type").alias("entity_type"), "name").distinct().withColumn("near", F.lit(True))
    d = found.join(alone, "mention_id").join(said, ["mention_id", "entity_type", "name"], "left").join(persons, "mention_id", "left").join(near, ["mention_id", "entity_type", "name"], "left")
    exact, alias = F.col("mention") == F.col("name"), F.col("source") == "alias"
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    person = F.col("mention_type") == "PERSON"
    vetoes = F.array_compact(F.array(
        F.when(F.col("mention_type") != F.col("entity_type"), "type_conflict"),
        F.when(F.col("ambiguous"), "ambiguous_alias").when(alias & ~F.col("autolink"), "alias_not_autolinkable"),
        F.when(person & is_initials_only(F.col("mention")), "initials_only"),
        F.when((F.col("mention_type") == "PROJECT") & (F.col("source") != "blocked") & ~is_specific(F.col("name")), "project_name_not_specific"),
        F.when(person & yes("names_persons") & ~yes("asserted"), "metadata_names_someone_else")))
    part = lambda cond, w: F.when(cond, WEIGHTS[w]).otherwise(0.0)
    total = (F.when(exact, WEIGHTS["exact_name"]).when(alias, WEIGHTS["alias"]).when(F.col("source") == "blocked", WEIGHTS["initials_block"]).otherwise(0.0)
             + part(yes("asserted"), "metadata") + part(yes("near"), "co_mention") + part(F.col("trust") == "authoritative", "authoritative") + part(F.col("one_alias") & alias & F.col("autolink"), "alias_unique"))
    return d.select(*found.columns, vetoes.alias("vetoes"), yes("asserted").alias("corroborated"), F.when(F.size(vetoes) > 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(total, 6))).alias("score"))


def decide(scored: DataFrame, mentions: DataFrame) -> DataFrame:
    """mention_id, decision (auto, ambiguous or unresolved), entity_id of an auto link, best score, margin over the runner-up, candidates.

    Of equal scores the least entity comes first. A mention is linked where score and margin reach its type's bounds and,
    if its type needs that, something but the name speaks for it.
    """
    # a mention's candidates have few different scores, so equal ones are summed up before anything of a mention is gathered
    equal = scored.groupBy("mention_id", "score").agg(F.count("*").alias("equal"), F.min(F.struct("entity_id", "corroborated")).alias("f"))
    top = equal.groupBy("mention_id").agg(F.max(F.struct("score", "equal", "f")).alias("b"), F.sum("equal").alias("candidates"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    d = mentions.select("mention_id", "type").join(top, "mention_id", "left").withColumn("f", F.col("b.f"))
    second = F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0))
    margin = F.when(F.col("candidates") == 1, F.col("b.score")).when(F.col("b.equal") > 1, 0.0).otherwise(F.col("b.score") - second)
    bound = lambda i: F.element_at(F.create_map(*(x for t, v in THRESHOLDS.items() for x in (F.lit(t), F.lit(float(v[i]))))), F.col("type"))
    sure = (F.col("b.score") >= bound(0)) & (F.round(margin, 6) >= bound(1)) & ((bound(3) == 0.0) | F.col("f.corroborated"))
    decision = F.when(sure, "auto").when(F.col("b.score") >= bound(2), "ambiguous").otherwise("unresolved")
    return d.select("mention_id", decision.alias("decision"), F.when(decision == "auto", F.col("f.entity_id")).alias("entity_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.round(F.coalesce(margin, F.lit(0.0)), 6).alias("margin"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def evidence(names: DataFrame) -> DataFrame:
    """What speaks for each name: ``name, documents, first_year, last_year, divisions``; names: name (folded), document_id, year, division."""
    return names.where("name <> ''").groupBy("name").agg(F.countDistinct("document_id").alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("division").alias("divisions"))


def promotion(found: DataFrame, surnames: DataFrame, shared: int, span: int, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``refusal``: why a name is not promoted to an entity, the first reason that holds, or null.

    found: of ``evidence``. surnames: surname, n (names that end in it). A name of two words is refused where its
    surname has ``shared`` names or more, and any whose years span more than ``span``. extra: more reasons by their
    codes, tried before the last two.
    """
    words = F.split("name", " ")
    d = found.withColumn("surname", F.element_at(words, -1)).join(surnames, "surname", "left")
    reasons = {"initials_only": is_initials_only(F.col("name")), "single_word": F.size(words) < 2, **(extra or {}), "shared_surname": (F.size(words) == 2) & (F.coalesce("n", F.lit(0)) >= shared), "career_span": F.col("last_year") - F.col("first_year") > span, "several_divisions": F.col("divisions") > 1}
    return d.select(*found.columns, F.coalesce(*(F.when(c, n) for n, c in reasons.items())).alias("refusal"))
