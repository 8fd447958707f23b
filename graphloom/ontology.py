"""Ontologies as data: node and relationship types, completeness rules, shapes, vocabulary filters and prompts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph, has_label
from graphloom.operators.match import with_hop, without_hop


@dataclass(frozen=True)
class NodeType:
    label: str
    merge_key: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    maps_to: str = ""


@dataclass(frozen=True)
class RelType:
    name: str
    start: str
    end: str
    maps_to: str = ""


@dataclass(frozen=True)
class Rule:
    """A gap: nodes of ``label`` that pass ``having`` and lack every one of ``missing`` (relationship types, direction, end label) and all of ``null_props``."""

    rule_id: str
    priority: str
    label: str
    desc: str
    template: str
    missing: tuple[tuple[tuple[str, ...], str, str], ...] = ()
    null_props: tuple[str, ...] = ()
    prop_equals: tuple[tuple[str, str], ...] = ()
    having: tuple[tuple[str, ...], str, str, str, str] | None = None


@dataclass(frozen=True)
class Ontology:
    spec_id: str
    nodes: dict[str, NodeType]
    rels: dict[str, RelType]
    rules: tuple[Rule, ...]
    event_types: tuple[str, ...] = ()
    person_roles: tuple[str, ...] = ()
    system_nodes: tuple[str, ...] = ()
    system_rels: tuple[str, ...] = ()
    time_precisions: tuple[str, ...] = field(default=("exact", "approximate", "relative", "vague"))

    def constraint_lines(self) -> list[str]:
        """Uniqueness of each label's merge key."""
        return [f"{n.label}({n.merge_key}) is unique" for n in self.nodes.values()]

    def summary(self) -> str:
        return f"{self.spec_id}: {len(self.nodes)} node types, {len(self.rels)} relationship types, {len(self.rules)} rules"

    def prompt(self) -> str:
        """Instructions for an extractor that answers in JSON, without the types that the system keeps itself."""
        kinds = [f"- {n.label}: required {', '.join(n.required)}" + (f"; optional {', '.join(n.optional)}" if n.optional else "") for n in self.nodes.values() if n.label not in self.system_nodes]
        links = [f"- ({r.start})-[{r.name}]->({r.end})" for r in self.rels.values() if r.name not in self.system_rels]
        return "\n".join(["Entity types:", *kinds, "Relationship types:", *links, 'Answer as JSON: {"entities": [{"id", "label", "properties"}], "relationships": [{"from_id", "rel_type", "to_id"}]}'])


def _ontology(spec_id: str, nodes: str, rels: str, rules: tuple[Rule, ...], **more: object) -> Ontology:
    """Node lines: label key: required | optional | mapping; relationship lines: name start end mapping."""
    n, r = {}, {}
    for line in nodes.strip().splitlines():
        head, rest = line.split(":", 1)
        label, key = head.split()
        req, opt, to = ([*map(str.strip, rest.split("|"))] + ["", ""])[:3]
        n[label] = NodeType(label, key, tuple(req.split()), tuple(opt.split()), to)
    for line in rels.strip().splitlines():
        name, start, end, to = line.split()
        r[name] = RelType(name, start, end, to)
    return Ontology(spec_id, n, r, rules, **more)


_SUSPECT = "Suspect '{entity_desc}' has no physical description"
# The three event ontologies.
SCHEMA_ORG = _ontology("schema-org-event-v1", """
Event description: description type | severity duration | schema:Event + prov:Entity
Person name_or_description: name_or_description role | name age_estimate gender | schema:Person + prov:Agent
Vehicle description: description | colour make model registration type | schema:Vehicle + prov:Entity
Location description: description | type address latitude longitude | schema:Place
Time value: value | precision date day_of_week | schema:DateTime
Object description: description | type colour size | prov:Entity
PhysicalDescription summary: summary | height build hair_colour hair_style clothing distinguishing_features | evt:PhysicalDescription
Observation description: description observation_type | confidence conditions | sosa:Observation + prov:Activity
""", """
PARTICIPATED_IN Person Event schema:participant
WITNESSED Person Event sosa:madeBySensor
OCCURRED_AT Event Location schema:location
OCCURRED_AT_TIME Event Time schema:startDate
USED Person Object prov:used
DROVE Person Vehicle evt:drove
DESCRIBED_AS Person PhysicalDescription evt:describedAs
CAUSED Event Event evt:caused
PRECEDED Event Event evt:preceded
LOCATED_NEAR Location Location schema:geo
OWNED_BY Vehicle Person schema:ownedBy
OBSERVED Observation Event sosa:hasFeatureOfInterest
MADE_BY Observation Person sosa:madeBySensor
DERIVED_FROM Event Observation prov:wasDerivedFrom
""", (
    Rule("event_needs_time", "critical", "Event", "description", "Event '{entity_desc}' has no timestamp", ((("OCCURRED_AT_TIME",), "out", "Time"),)),
    Rule("event_needs_location", "critical", "Event", "description", "Event '{entity_desc}' has no location", ((("OCCURRED_AT",), "out", "Location"),)),
    Rule("event_needs_participant", "critical", "Event", "description", "Event '{entity_desc}' has no participants or witnesses", ((("PARTICIPATED_IN", "WITNESSED"), "in", "Person"),)),
    Rule("suspect_needs_description", "high", "Person", "name_or_description", _SUSPECT, ((("DESCRIBED_AS",), "out", "PhysicalDescription"),), prop_equals=(("role", "suspect"),)),
    Rule("vehicle_needs_identifiers", "high", "Vehicle", "description", "Vehicle '{entity_desc}' has no identifying details", null_props=("colour", "make", "registration")),
), event_types=("incident", "observation", "action", "arrival", "departure", "communication", "environmental"),
    person_roles=("witness", "suspect", "victim", "bystander", "first_responder", "reporting_officer"), system_nodes=("Observation",), system_rels=("OBSERVED", "MADE_BY", "DERIVED_FROM"))

SEM = _ontology("sem-event-v1", """
Event description: description event_type | severity | sem:Event
Actor name_or_description: name_or_description | name actor_type age_estimate gender | sem:Actor
Place description: description | type address latitude longitude | sem:Place
Time value: value | precision earliest latest date | sem:Time
Role role_type: role_type | description | sem:RoleType
Object description: description | type colour size registration | sem:Object
PhysicalDescription summary: summary | height build hair_colour clothing distinguishing_features | evt:PhysicalDescription
""", """
HAS_ACTOR Event Actor sem:hasActor
HAS_ROLE Actor Role sem:roleType
HAS_PLACE Event Place sem:hasPlace
HAS_TIME Event Time sem:hasTimeStamp
HAS_SUB_EVENT Event Event sem:hasSubEvent
PRECEDED Event Event sem:preceded
CAUSED Event Event sem:caused
INVOLVED_OBJECT Event Object sem:hasObject
USED_BY Object Actor sem:usedBy
DESCRIBED_AS Actor PhysicalDescription evt:describedAs
""", (
    Rule("event_needs_time", "critical", "Event", "description", "Event '{entity_desc}' has no temporal anchor", ((("HAS_TIME",), "out", "Time"),)),
    Rule("event_needs_place", "critical", "Event", "description", "Event '{entity_desc}' has no spatial anchor", ((("HAS_PLACE",), "out", "Place"),)),
    Rule("event_needs_actor", "critical", "Event", "description", "Event '{entity_desc}' has no associated actor", ((("HAS_ACTOR",), "out", "Actor"),)),
    Rule("actor_needs_role", "high", "Actor", "name_or_description", "Actor '{entity_desc}' has no assigned role", ((("HAS_ROLE",), "out", "Role"),)),
    Rule("suspect_needs_description", "high", "Actor", "name_or_description", _SUSPECT, ((("DESCRIBED_AS",), "out", "PhysicalDescription"),), having=(("HAS_ROLE",), "out", "Role", "role_type", "suspect")),
), event_types=("incident", "observation", "action", "arrival", "departure", "communication", "environmental"))

BFO_CCO = _ontology("bfo-cco-event-v1", """
Process description: description process_type | severity duration | bfo:Process
Act description: description act_type | | cco:Act
Agent name_or_description: name_or_description | name age_estimate gender | cco:Agent
AgentRole role_type: role_type | description | bfo:Role
MaterialEntity description: description | type colour make model registration | bfo:MaterialEntity
Site description: description | type address latitude longitude | bfo:Site
TemporalInterval value: value | precision start end date | bfo:TemporalInterval
InformationContentEntity description: description ice_type | content | cco:InformationContentEntity
DescriptiveICE summary: summary | height build hair_colour clothing distinguishing_features | cco:DescriptiveInformationContentEntity
""", """
AGENT_IN Agent Process cco:agent_in
HAS_AGENT Process Agent cco:has_agent
BEARS_ROLE Agent AgentRole bfo:bearer_of
REALIZED_IN AgentRole Process bfo:realized_in
OCCURS_AT Process Site bfo:occurs_in
OCCUPIES_TEMPORAL Process TemporalInterval bfo:occupies_temporal_region
HAS_PARTICIPANT Process MaterialEntity bfo:has_participant
OPERATED_BY MaterialEntity Agent cco:operated_by
HAS_PART Process Process bfo:has_part
PRECEDES Process Process bfo:precedes
CAUSED_BY Process Process cco:caused_by
DESCRIBED_BY Agent DescriptiveICE cco:described_by
IS_ABOUT InformationContentEntity Process cco:is_about
CREATED_BY InformationContentEntity Agent cco:created_by
""", (
    Rule("process_needs_temporal", "critical", "Process", "description", "Process '{entity_desc}' has no temporal region", ((("OCCUPIES_TEMPORAL",), "out", "TemporalInterval"),)),
    Rule("process_needs_site", "critical", "Process", "description", "Process '{entity_desc}' has no spatial anchor", ((("OCCURS_AT",), "out", "Site"),)),
    Rule("process_needs_agent", "critical", "Process", "description", "Process '{entity_desc}' has no associated agent", ((("HAS_AGENT",), "out", "Agent"), (("AGENT_IN",), "in", "Agent"))),
    Rule("agent_needs_role", "high", "Agent", "name_or_description", "Agent '{entity_desc}' bears no formal role", ((("BEARS_ROLE",), "out", "AgentRole"),)),
    Rule("suspect_needs_description", "high", "Agent", "name_or_description", _SUSPECT, ((("DESCRIBED_BY",), "out", "DescriptiveICE"),), having=(("BEARS_ROLE",), "out", "AgentRole", "role_type", "suspect")),
), event_types=("incident", "observation", "intentional_act", "arrival", "departure", "communication", "environmental_process"))

ONTOLOGIES = {o.spec_id: o for o in (SCHEMA_ORG, SEM, BFO_CCO)}
# The order of gap priorities.
PRIORITIES = ("critical", "high", "medium", "low")
SAFE_PROPERTY = r"^[a-z_][a-z0-9_]*$"


def gaps(graph: Graph, ontology: Ontology) -> DataFrame:
    """(rule_id, priority, label, entity_desc, gap_description) of every rule hit, one row a node."""
    out = None
    for rule in ontology.rules:
        found = graph.labelled(rule.label)
        for k, v in rule.prop_equals:
            found = found.where(F.col("props")[k] == v)
        if rule.having:
            types, direction, label, key, value = rule.having
            found = with_hop(graph, found, types, direction, graph.labelled(label).where(F.col("props")[key] == value))
        for k in rule.null_props:
            found = found.where(F.col("props")[k].isNull())
        for types, direction, label in rule.missing:
            found = without_hop(graph, found, types, direction, graph.labelled(label))
        before, after = rule.template.split("{entity_desc}")
        desc = F.col("props")[rule.desc]
        rows = found.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.priority).alias("priority"), F.get("labels", F.lit(0)).alias("label"), desc.alias("entity_desc"), F.concat(F.lit(before), F.coalesce(desc, F.lit("None")), F.lit(after)).alias("gap_description"))
        out = rows if out is None else out.unionByName(rows)
    return out


def priority_rank(column: str = "priority", other: int = 99):
    """0 for critical ... 3 for low, ``other`` for anything else."""
    rank = F.lit(other)
    for i, p in reversed(list(enumerate(PRIORITIES))):
        rank = F.when(F.col(column) == p, i).otherwise(rank)
    return rank


def in_vocabulary(graph: Graph, ontology: Ontology) -> Graph:
    """Without nodes and relationships outside the ontology and properties with unsafe names."""
    keep = F.map_filter("props", lambda k, v: k.rlike(SAFE_PROPERTY) & v.isNotNull())
    nodes = graph.nodes.where(F.col("label").isin(*ontology.nodes)).withColumn("props", keep)
    ends = nodes.select("id")
    edges = graph.typed(*ontology.rels).join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
    return Graph(nodes, edges)


def outside_vocabulary(graph: Graph, ontology: Ontology) -> DataFrame:
    """(item_kind, name, n) of labels and relationship types that loading would drop."""
    labels = graph.nodes.where(~F.col("label").isin(*ontology.nodes)).groupBy(F.lit("label").alias("item_kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    types = graph.edges.where(~F.col("type").isin(*ontology.rels)).groupBy(F.lit("relationship").alias("item_kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return labels.unionByName(types)


@dataclass(frozen=True)
class Shape:
    """A constraint on nodes of some labels; kind is min_count, in, datatype, relation or class."""

    name: str
    labels: tuple[str, ...]
    path: str
    kind: str
    allowed: tuple[str, ...] = ()
    end: str = ""
    severity: str = "Violation"


def shapes_of(ontology: Ontology) -> list[Shape]:
    """min_count 1 for each required property."""
    return [Shape(f"{n.label}Shape", (n.label,), p, "min_count") for n in ontology.nodes.values() for p in n.required]


# The shapes of the event graph; driver and passenger are roles here.
EVENT_SHAPES = (
    Shape("EventShape", ("Event",), "description", "min_count"), Shape("EventShape", ("Event",), "type", "min_count"), Shape("EventShape", ("Event",), "type", "in", SCHEMA_ORG.event_types),
    Shape("EventShape", ("Event",), "OCCURRED_AT", "relation", end="Location"), Shape("EventShape", ("Event",), "OCCURRED_AT", "class", end="Location"),
    Shape("EventShape", ("Event",), "OCCURRED_AT_TIME", "relation", end="Time"), Shape("EventShape", ("Event",), "OCCURRED_AT_TIME", "class", end="Time"),
    Shape("PersonShape", ("Person",), "name_or_description", "min_count"), Shape("PersonShape", ("Person",), "role", "min_count"), Shape("PersonShape", ("Person",), "role", "in", (*SCHEMA_ORG.person_roles, "driver", "passenger")),
    Shape("VehicleShape", ("Vehicle",), "description", "min_count"), Shape("LocationShape", ("Location",), "description", "min_count"), Shape("TimeShape", ("Time",), "value", "min_count"),
    Shape("ObservationShape", ("Observation",), "description", "min_count"), Shape("ObservationShape", ("Observation",), "observation_type", "min_count"), Shape("ObservationShape", ("Observation",), "MADE_BY", "relation", end="Person"),
    Shape("PhysicalDescriptionShape", ("PhysicalDescription",), "summary", "min_count"),
    Shape("ProvenanceShape", ("Event", "Person", "Vehicle", "Location", "Time", "Object", "PhysicalDescription"), "source", "min_count", severity="Warning"),
    Shape("ProvenanceShape", ("Event", "Person", "Vehicle", "Location", "Time", "Object", "PhysicalDescription"), "confidence", "min_count", severity="Info"),
)
#: Properties that are columns of the node table.
COLUMN_PROPS = {"source": "source", "confidence": "confidence_raw", "source_type": "source_type", "extracted_at": "extracted_at", "ontology_id": "ontology_id"}


def violations(graph: Graph, shapes: tuple[Shape, ...] | list[Shape]) -> DataFrame:
    """(shape, path, kind, severity, id): one row for each node and broken constraint. Labels and paths match by local name."""
    direct = [s for s in shapes if s.kind in ("min_count", "in", "datatype")]
    checks = []
    for s in direct:
        value = F.col(COLUMN_PROPS[s.path]) if s.path in COLUMN_PROPS else F.col("props")[s.path]
        if s.kind == "datatype":  # every property is a string; other types must be readable from it
            broken = F.lit(False) if s.allowed == ("string",) else value.isNotNull() & value.try_cast(s.allowed[0]).isNull()
        else:
            broken = value.isNull() if s.kind == "min_count" else value.isNotNull() & ~value.isin(*s.allowed)
        checks.append(F.when(has_label(*s.labels) & broken, F.struct(F.lit(s.name).alias("shape"), F.lit(s.path).alias("path"), F.lit(s.kind).alias("kind"), F.lit(s.severity).alias("severity"))))
    # one scan for all constraints on properties
    out = graph.nodes.select("id", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("c.*", "id") if checks else None
    for s in (s for s in shapes if s.kind not in ("min_count", "in", "datatype")):
        start, end = graph.labelled(*s.labels), graph.labelled(s.end)
        if s.kind == "relation":
            ids = without_hop(graph, start, (s.path,), "out").select("id")
        else:
            ids = graph.typed(s.path).join(start.select(F.col("id").alias("src")), "src", "left_semi").join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(end.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"))
        rows = ids.select(F.lit(s.name).alias("shape"), F.lit(s.path).alias("path"), F.lit(s.kind).alias("kind"), F.lit(s.severity).alias("severity"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def spec_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Node and relationship types of all ontologies as tables."""
    nodes = [(o.spec_id, n.label, list(n.required), list(n.optional), n.maps_to, n.merge_key) for o in ONTOLOGIES.values() for n in o.nodes.values()]
    rels = [(o.spec_id, r.name, r.start, r.end, r.maps_to) for o in ONTOLOGIES.values() for r in o.rels.values()]
    return (spark.createDataFrame(nodes, "spec_id string, label string, required array<string>, optional array<string>, mapping string, merge_key string"),
            spark.createDataFrame(rels, "spec_id string, rel_type string, from_label string, to_label string, mapping string"))


def shapes_turtle(ontology: Ontology, base: str = "http://example.org/kg/") -> str:
    """The shapes of the required properties as SHACL text."""
    out = [f"@prefix kg: <{base}> .", "@prefix sh: <http://www.w3.org/ns/shacl#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", ""]
    for n in ontology.nodes.values():
        props = [f"  sh:property [ sh:path kg:{p} ; sh:minCount 1 ; sh:datatype xsd:string ]" for p in n.required]
        out.append(" ;\n".join([f"kg:{n.label}Shape a sh:NodeShape ;\n  sh:targetClass kg:{n.label}", *props]) + " .")
    return "\n".join(out)


def conformance(graph: Graph, shapes: tuple[Shape, ...] | list[Shape]) -> DataFrame:
    """(score): 1 less the violations per RDF triple of the graph, not below 0; 1 for an empty graph."""
    from graphloom.sources.files import rdf_triples

    n = violations(graph, shapes).agg(F.count("*").alias("broken")).join(rdf_triples(graph).agg(F.count("*").alias("triples")))
    return n.select(F.when(F.col("triples") == 0, 1.0).otherwise(1 - F.least(F.col("broken") / F.col("triples"), F.lit(1.0))).alias("score"))


# What corresponds between the ontologies, from the first to the second and third.
ALIGNED = (("Person", "Actor", "Agent"), ("Event", "Event", "Process"), ("Location", "Place", "Site"), ("Time", "Time", "TemporalInterval"), ("Vehicle", "Object", "MaterialEntity"), ("Object", "Object", "MaterialEntity"), ("PhysicalDescription", "PhysicalDescription", "DescriptiveICE"), ("Observation", "Observation", "InformationContentEntity"))


def aligned(graph: Graph, to: str) -> Graph:
    """The graph with the labels of the first ontology put into those of ``to`` ("sem" or "bfo"); other labels stay."""
    table = {row[0]: row[1 if to == "sem" else 2] for row in ALIGNED}
    new = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    labels = F.transform("labels", lambda x: F.coalesce(F.try_element_at(new, x), x))
    return Graph(graph.nodes.withColumn("labels", labels).withColumn("label", F.get(labels, F.lit(0))), graph.edges)


def property_completeness(graph: Graph, ontology: Ontology) -> DataFrame:
    """(label, property, nodes, filled, share): how many nodes of each label have each property that the ontology knows; one scan."""
    wanted = graph.nodes.sparkSession.createDataFrame([(n.label, p) for n in ontology.nodes.values() for p in (*n.required, *n.optional)], "label string, property string")
    totals = graph.nodes.groupBy("label").agg(F.count("*").alias("nodes"))
    filled = graph.nodes.select("label", F.explode(F.map_filter("props", lambda k, v: v.isNotNull() & (v != ""))).alias("property", "v")).groupBy("label", "property").agg(F.count("*").alias("filled"))
    out = wanted.join(totals, "label").join(filled, ["label", "property"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return out.withColumn("share", F.col("filled") / F.col("nodes"))


def stale(nodes: DataFrame, at: str, instant: str = "utc_micros", days: int = 30) -> DataFrame:
    """(id, days): nodes whose instant (microseconds) lies more than ``days`` before ``at``."""
    age = (F.unix_micros(F.to_timestamp(F.lit(at))) - F.col(instant)) / 86_400_000_000
    return nodes.where(age > days).select("id", F.floor(age).alias("days"))
