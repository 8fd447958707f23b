"""Training rows from statements and their extraction records: chat rows, corrupted answers and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You extract entities and relationships from incident statements and answer in JSON."


def chat_rows(statements: DataFrame, gold: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(source_id, messages): system, user and assistant turns; statements without a record are left out."""
    answer = F.to_json(F.struct("entities", "relationships"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return statements.join(gold, "source_id").select("source_id", F.array(turn("system", F.lit(system)), turn("user", F.col("text")), turn("assistant", answer)).alias("messages"))


def incomplete(entities: Column, relationships: Column) -> Column:
    """The first three fifths of the entities, at least one, and the relationships with both ends among them."""
    kept = F.slice(entities, 1, F.greatest(F.lit(1), F.floor(F.size(entities) * 3 / 5).cast("int")))
    ids = F.transform(kept, lambda e: e["id"])
    return F.struct(kept.alias("entities"), F.filter(relationships, lambda r: F.array_contains(ids, r["from_id"]) & F.array_contains(ids, r["to_id"])).alias("relationships"))


def hallucinated(entities: Column, relationships: Column) -> Column:
    """One person too many, the first entity with a wrong label, and a relationship that nobody told."""
    person = F.struct(F.lit("made_up").alias("id"), F.lit("Person").alias("label"), F.create_map(F.lit("name_or_description"), F.lit("Unidentified bystander")).alias("properties"))
    wrong = F.transform(entities, lambda e, i: F.when(i == 0, F.struct(e["id"].alias("id"), F.lit("Observation").alias("label"), e["properties"].alias("properties"))).otherwise(e))
    link = F.struct(F.lit("made_up").alias("from_id"), F.lit("CAUSED_BY").alias("rel_type"), F.coalesce(F.get(entities, F.lit(0))["id"], F.lit("made_up")).alias("to_id"))
    return F.struct(F.concat(wrong, F.array(person)).alias("entities"), F.concat(relationships, F.array(link)).alias("relationships"))


def preference_pairs(statements: DataFrame, gold: DataFrame) -> DataFrame:
    """(source_id, variant, prompt, chosen, rejected): two per source."""
    chosen = F.to_json(F.struct("entities", "relationships"))
    e, r = F.col("entities"), F.col("relationships")
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.to_json(bad).alias("rejected")) for n, bad in (("hallucinated", hallucinated(e, r)), ("incomplete", incomplete(e, r)))])
    return statements.join(gold, "source_id").select("source_id", F.col("text").alias("prompt"), chosen.alias("chosen"), F.explode(variants).alias("v")).select("source_id", "v.variant", "prompt", "chosen", "v.rejected")


def split_of(key: Column, train: int = 80, valid: int = 10) -> Column:
    """train, valid or test by a hash of the key, the same in every run."""
    b = F.pmod(F.xxhash64(key), F.lit(100))
    return F.when(b < train, "train").when(b < train + valid, "valid").otherwise("test")


def extraction_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(precision, recall, f1) over distinct keys; null where there is nothing to divide by."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"), F.count("p").alias("p"), F.count("g").alias("g"))
    pr, rc = F.try_divide("hit", "p"), F.try_divide("hit", "g")
    return n.select(pr.alias("precision"), rc.alias("recall"), F.try_divide(2 * pr * rc, pr + rc).alias("f1"))


def rewritten(statements: DataFrame, styles: list[str], writer) -> DataFrame:
    """(source_id, style, text): each statement in each style by an injected writer, a function from (source_id, style, prompt) to (source_id, style, text)."""
    asked = statements.select("source_id", F.explode(F.array(*map(F.lit, styles))).alias("style"), "text")
    return writer(asked.select("source_id", "style", F.concat(F.lit("Rewrite in the style of "), F.col("style"), F.lit(", keeping every fact:\n"), F.col("text")).alias("prompt")))


# What scenarios are asked for, by template.
SCENARIOS = ("a collision of {n} vehicles told by a passer-by", "a theft of {n} objects told by a shopkeeper", "a fight of {n} persons told by a guard", "a fall told by {n} witnesses")


def scenarios(spark, n: int, writer) -> DataFrame:
    """(scenario_id, template, text): ``n`` made-up statements for each template by an injected writer over (scenario_id, template, prompt)."""
    asked = spark.range(n).select(F.col("id").alias("k"), F.posexplode(F.array(*map(F.lit, SCENARIOS))).alias("template", "p"))
    prompts = asked.select((F.col("k") * len(SCENARIOS) + F.col("template")).alias("scenario_id"), "template", F.concat(F.lit("Write a witness statement about "), F.replace("p", F.lit("{n}"), (F.col("k") % 5 + 1).cast("string"))).alias("prompt"))
    return writer(prompts)


def triple_split(triples: DataFrame, left_out: tuple[str, ...] = ("POSSIBLY_SAME_AS",), key: tuple[str, ...] = ("head", "relation", "tail")) -> DataFrame:
    """(head, relation, tail, part): 80, 10 and 10 of a hundred by hash, links of fusion left out."""
    kept = triples.where(~F.col("relation").isin(*left_out)).distinct()
    return kept.withColumn("part", split_of(F.concat_ws("\u0001", *key)))


def read_gold(spark, path: str) -> DataFrame:
    """(source_id, entities, relationships) of annotation files, one JSON record a line."""
    return spark.read.schema("source_id string, entities array<struct<id:string,label:string,properties:map<string,string>>>, relationships array<struct<from_id:string,rel_type:string,to_id:string>>").json(path)


def triple_keys(records: DataFrame) -> DataFrame:
    """(source_id, head, rel_type, tail) of records by description, for scores against other records."""
    name = lambda p: F.coalesce(*[p[k] for k in ("description", "name_or_description", "name", "value", "summary")])
    ents = records.select("source_id", F.explode("entities").alias("e")).select("source_id", F.col("e.id").alias("id"), name(F.col("e.properties")).alias("d"))
    rels = records.select("source_id", F.explode("relationships").alias("r")).select("source_id", "r.*")
    a, b = ents.select("source_id", F.col("id").alias("from_id"), F.col("d").alias("head")), ents.select("source_id", F.col("id").alias("to_id"), F.col("d").alias("tail"))
    return rels.join(a, ["source_id", "from_id"]).join(b, ["source_id", "to_id"]).select("source_id", "head", "rel_type", "tail").distinct()
