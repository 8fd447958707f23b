"""Graph quality: structural probes, extended probes, embedding geometry and the report."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import mean, stdev

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph, desc_probe, has_label
from graphloom.operators.match import equal_classes, isolated, on_cycles, with_hop

SKIPPED = -1.0
# Weights of the report's dimensions; the first six always count.
BASE_WEIGHTS = {"schema": 0.15, "structural": 0.15, "consistency": 0.15, "constraint": 0.20, "coherence": 0.15, "faithfulness": 0.20}
MORE_WEIGHTS = {"semantic_completeness": 0.10, "investigative_readiness": 0.10, "link_prediction": 0.08, "triple_plausibility": 0.08, "entity_clustering": 0.04}
#: Below which score a dimension is recommended for work.
NEEDED = {"schema": 0.8, "structural": 0.8, "constraint": 0.8, "consistency": 0.8, "coherence": 0.6, "faithfulness": 0.6, "semantic_completeness": 0.7, "investigative_readiness": 0.7, "link_prediction": 0.7, "triple_plausibility": 0.7, "entity_clustering": 0.7}


@dataclass
class Result:
    dimension: str
    score: float
    violations: list[str] = field(default_factory=list)


def population(graph: Graph, expected: tuple[str, ...]) -> DataFrame:
    """(label, n): how many nodes each expected label has; one scan for all labels."""
    spark = graph.nodes.sparkSession
    counts = graph.nodes.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in expected], "label string").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def schema_score(graph: Graph, expected: tuple[str, ...]) -> DataFrame:
    return population(graph, expected).agg(F.coalesce(F.avg((F.col("n") > 0).cast("double")), F.lit(1.0)).alias("score"))


def structural_score(graph: Graph) -> DataFrame:
    """Share of nodes with a relationship; 0 for an empty graph."""
    lone = isolated(graph).agg(F.count("*").alias("isolated"))
    total = graph.nodes.agg(F.count("*").alias("total"))
    return total.join(lone).select("total", "isolated", F.when(F.col("total") == 0, 0.0).otherwise((F.col("total") - F.col("isolated")) / F.col("total")).alias("score"))


def duplicates(graph: Graph) -> DataFrame:
    """(id, first_id, key): nodes of equal labels and description, by class."""
    return equal_classes(graph.nodes, desc_probe())


def consistency_score(graph: Graph, order_types: tuple[str, ...] = ("PRECEDED", "PRECEDES")) -> float:
    """Of two checks, the share that passes: no cycle in an order (each type for itself), no two nodes of equal labels and description."""
    cyclic = any(not on_cycles(graph, (t,)).isEmpty() for t in order_types)
    return ((not cyclic) + duplicates(graph).isEmpty()) / 2


def grounding_score(graph: Graph, cap: int | None = 20) -> DataFrame:
    """1 less the share of nodes without source, Observations aside; at most ``cap`` of them count (None for all)."""
    rows = graph.nodes.where(~has_label("Observation"))
    orphans = F.count_if(F.col("source").isNull())
    counted = F.least(orphans, F.lit(cap)) if cap is not None else orphans
    return rows.agg(F.count("*").alias("total"), counted.alias("orphans")).select("total", "orphans", F.when(F.col("total") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("orphans") / F.col("total"))).alias("score"))


def population_checks(graph: Graph) -> DataFrame:
    """(check, passed): an event, two persons, a place, a time, participants for all events, a source for all nodes."""
    events = graph.labelled("Event")
    joined = with_hop(graph, events, ("PARTICIPATED_IN", "WITNESSED", "HAS_ACTOR", "HAS_AGENT", "AGENT_IN", "INVOLVED_IN"), "both")
    counts = graph.nodes.agg(
        F.count_if(has_label("Event", "Process")).alias("events"), F.count_if(has_label("Person", "Actor", "Agent")).alias("persons"), F.count_if(has_label("Location", "Place", "SpatialRegion", "Site")).alias("places"),
        F.count_if(has_label("Time", "TemporalInterval")).alias("times"), F.count_if(F.col("source").isNull() & ~has_label("Observation", "GraphVersion")).alias("unsourced"))
    rest = events.agg(F.count("*").alias("all_events")).join(joined.agg(F.count("*").alias("joined")))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("passed")) for n, ok in (
        ("events", F.col("events") >= 1), ("persons", F.col("persons") >= 2), ("places", F.col("places") >= 1), ("times", F.col("times") >= 1), ("participants", F.col("all_events") == F.col("joined")), ("sources", F.col("unsourced") == 0))])
    return counts.join(rest).select(F.explode(checks).alias("c")).select("c.*")


def cross_source_score(graph: Graph) -> DataFrame:
    """1 for at most one source, else 0.7 with corroborations for and contradictions against it, between 0 and 1."""
    sources = graph.nodes.agg(F.count_distinct("source").alias("sources"))
    links = graph.edges.agg(F.count_if(F.col("type") == "CORROBORATED_BY").alias("corroborations"), F.count_if(F.col("type") == "CONTRADICTS").alias("contradictions"))
    score = 0.7 + F.least(F.lit(0.3), 0.05 * F.col("corroborations")) - F.least(F.lit(0.5), 0.1 * F.col("contradictions"))
    return sources.join(links).select("sources", F.when(F.col("sources") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"))


def temporal_score(issues: int) -> float:
    return max(0.0, 1 - 0.1 * issues)


def overall(results: list[Result], normalise_active: bool = False) -> float:
    """Weighted mean; base dimensions that were skipped count as 0 unless only active ones are asked for. A later result of a dimension replaces an earlier one."""
    scores = {r.dimension: r.score for r in results if r.score >= 0}
    weights = {k: w for k, w in BASE_WEIGHTS.items() if not normalise_active or k in scores} | {k: w for k, w in MORE_WEIGHTS.items() if k in scores}
    total = sum(weights.values())
    return sum(w * scores.get(k, 0.0) for k, w in weights.items()) / total if total else 0.0


def recommendations(results: list[Result]) -> list[str]:
    """The dimensions that need work: base ones even where skipped, further ones where active; overall below 0.4."""
    scores = {r.dimension: r.score for r in results if r.score >= 0}
    out = [f"improve {k}: {scores.get(k, 0.0):.2f} is below {need}" for k, need in NEEDED.items() if (k in BASE_WEIGHTS or k in scores) and scores.get(k, 0.0) < need]
    return out + ["overall quality is low: check the statement and ingest it again"] * (overall(results) < 0.4)


def calibrate(probe: Callable[[], Result], runs: int = 3) -> tuple[Result, dict[str, float]]:
    """The upper-median result of repeated runs and their spread; returns at once when the probe skips."""
    first = probe()
    if first.score < 0:
        return first, {}
    results = sorted([first, *(probe() for _ in range(runs - 1))], key=lambda r: r.score)
    scores = [r.score for r in results]
    return results[len(results) // 2], {"mean": mean(scores), "stdev": stdev(scores) if len(scores) > 1 else 0.0, "min": scores[0], "max": scores[-1]}


def calibration(runs: DataFrame, dimension: str = "dimension", score: str = "score") -> DataFrame:
    """(dimension, runs, mean, stdev, low, high, median): repeated runs of probes as rows; the median is the upper one. Runs of one probe are few by nature."""
    w = Window.partitionBy(dimension).orderBy(score)
    rows = runs.where(F.col(score) >= 0).withColumn("_n", F.row_number().over(w) - 1).withColumn("_k", F.count("*").over(Window.partitionBy(dimension)))
    middle = F.max(F.when(F.col("_n") == F.floor(F.col("_k") / 2), F.col(score)))
    return rows.groupBy(dimension).agg(F.count("*").alias("runs"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("stdev"), F.min(score).alias("low"), F.max(score).alias("high"), middle.alias("median"))


def label_centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): mean vector of each label."""
    dims = vectors.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def centroid_outliers(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, label, distance) of vectors farther from their label's mean than the mean distance and two population deviations."""
    measured = vectors.join(label_centroids(vectors, label, vector), label).withColumn("distance", F.sqrt(squared_distance(F.col(vector), F.col("centroid")))).select(key, label, "distance")
    stats = measured.groupBy(label).agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"), F.count("*").alias("n"))
    return measured.join(stats, label).where("n >= 2 and s >= 1e-8 and distance > m + 2 * s").select(key, label, "distance")


def near_pairs(vectors: DataFrame, limit: float, key: str = "vec_id", label: str = "label", vector: str = "embedding", dims: int = 3) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: all pairs of one label closer than ``limit``.

    Exact, by a grid over some dimensions: of two points closer than the limit each coordinate differs by
    less than a cell of that width, so the pair meets in a cell of one and a neighbouring cell of the other.
    """
    cells = [F.floor(F.get(vector, F.lit(d)).cast("double") / limit).alias(f"c{d}") for d in range(dims)]
    at = vectors.select(key, label, vector, *cells)
    shifts = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    b = at.select(F.col(key).alias("id_b"), label, F.col(vector).alias("vb"), *[F.col(f"c{d}") for d in range(dims)])
    for d in range(dims):
        b = b.withColumn("_s", F.explode(shifts)).withColumn(f"c{d}", F.col(f"c{d}") + F.col("_s")).drop("_s")
    a = at.select(F.col(key).alias("id_a"), label, F.col(vector).alias("va"), *[F.col(f"c{d}") for d in range(dims)])
    pairs = a.join(b, [label, *[f"c{d}" for d in range(dims)]]).where("id_a < id_b").withColumn("distance", F.sqrt(squared_distance(F.col("va"), F.col("vb"))))
    return pairs.where(F.col("distance") < limit).select("id_a", "id_b", "distance")


def _number(answer: str, pattern: str, default: float) -> float:
    found = re.search(pattern, answer or "", re.I)
    return float(found.group(1)) if found else default


def coherence(triples: str, judge: Callable[[str], str]) -> Result:
    """An injected judge's score out of ten for the story the triples tell; 0.5 where it cannot be read."""
    answer = judge(f"Rate from 0 to 10 how well these facts form one story. Answer as JSON with score and issues.\n{triples}")
    return Result("coherence", max(0.0, min(1.0, _number(answer, r'"score"\s*:\s*([\d.]+)', 5.0) / 10)), _listed(answer, "issues"))


def faithfulness(triples: str, source: str, judge: Callable[[str], str], shown: int = 3000) -> Result:
    """An injected judge's score for how far the source bears the triples out, with what it calls made up or missing."""
    answer = judge(f"Source:\n{source[:shown]}\nFacts:\n{triples}\nAnswer as JSON with score (0 to 10), hallucinated and missing.")
    return Result("faithfulness", max(0.0, min(1.0, _number(answer, r'"score"\s*:\s*([\d.]+)', 5.0) / 10)), [f"error: {x}" for x in _listed(answer, "hallucinated")] + [f"warning: {x}" for x in _listed(answer, "missing")])


def narrative(triples: str, judge: Callable[[str], str]) -> Result:
    """An injected judge's line ``SCORE: n`` out of five, 3 where there is none; 0 without triples."""
    if not triples or triples == "(empty graph)":
        return Result("narrative", 0.0)
    return Result("narrative", min(5.0, _number(judge(triples), r"SCORE:\s*(\d)", 3.0)) / 5)


def _listed(answer: str, key: str) -> list[str]:
    found = re.search(r"\{.*\}", answer or "", re.S)
    try:
        return [str(x) for x in json.loads(found.group()).get(key) or []] if found else []
    except ValueError:
        return []


def first_that_answers(*probes: Callable[[], Result]) -> Result:
    """The first probe that is not skipped; one that fails scores 0.5."""
    last = Result("none", SKIPPED)
    for probe in probes:
        try:
            last = probe()
        except Exception as error:  # noqa: BLE001
            return Result("failed", 0.5, [f"error: {error}"])
        if last.score >= 0:
            return last
    return last


def borne_out(triples: DataFrame, source: str) -> DataFrame:
    """(id, triple, share): the share of each triple's words that the source has; 1 - share says how far it may be made up."""
    words = F.array_distinct(F.filter(F.split(F.lower("triple"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    known = F.array_distinct(F.split(F.lower(F.lit(source)), r"[^\p{L}\p{N}]+"))
    return triples.select("id", "triple", F.coalesce(F.try_divide(F.size(F.array_intersect(words, known)), F.size(words)), F.lit(1.0)).alias("share"))


class Rotations:
    """Embeddings that turn heads into tails: entities are points of the complex plane per dimension, relations rotations.

    Trained in numpy by self-adversarial-free margin loss over a bounded sample of triples (``most``, a documented bound: the model is
    one for a prompt-sized graph); scored over all triples by ``scores``.
    """

    def __init__(self, triples: list[tuple[str, str, str]], dims: int = 50, epochs: int = 100, rate: float = 0.05, margin: float = 6.0, seed: int = 42) -> None:
        import numpy as np

        self.np, self.margin = np, margin
        rnd = np.random.RandomState(seed)
        self.entities = {e: i for i, e in enumerate(sorted({x for h, _, t in triples for x in (h, t)}))}
        self.relations = {r: i for i, r in enumerate(sorted({r for _, r, _ in triples}))}
        n = len(self.entities)
        self.e = rnd.uniform(-1, 1, (n, dims)) + 1j * rnd.uniform(-1, 1, (n, dims))
        self.r = rnd.uniform(-np.pi, np.pi, (len(self.relations), dims))
        rows = np.array([(self.entities[h], self.relations[r], self.entities[t]) for h, r, t in triples], int).reshape(-1, 3)
        batch = min(64, len(rows)) or 1
        for _ in range(epochs):
            rnd.shuffle(rows)
            for k in range(0, len(rows), batch):
                h, r, t = rows[k:k + batch].T
                wrong = rnd.randint(0, n, len(h))
                self._step(h, r, t, 1.0, rate)
                self._step(h, r, wrong, -1.0, rate)

    def _step(self, h, r, t, sign: float, rate: float) -> None:
        np = self.np
        turn = np.exp(1j * self.r[r])
        gap = self.e[h] * turn - self.e[t]
        size = np.abs(gap) + 1e-9
        slack = self.margin - size.sum(1)
        weight = (sign / (1 + np.exp(np.clip(sign * slack, -30, 30))))[:, None] * rate
        unit = gap / size
        np.add.at(self.e, h, -weight * unit * np.conj(turn))
        np.add.at(self.e, t, weight * unit)
        np.add.at(self.r, r, -weight * np.real(np.conj(unit) * 1j * self.e[h] * turn))

    def score(self, h: str, r: str) -> "object":
        """Scores of all entities as the tail of (h, r, ?)."""
        np = self.np
        return self.margin - np.abs(self.e[self.entities[h]] * np.exp(1j * self.r[self.relations[r]]) - self.e).sum(1)


def trained(triples: DataFrame, most: int = 5000, **settings: float) -> tuple[Rotations | None, list[tuple[str, str, str]]]:
    """A model of a graph of at most ``most`` distinct (head, relation, tail), with the triples in order; larger graphs are sampled by hash to that bound."""
    distinct = triples.select("head", "relation", "tail").where("head is not null and relation is not null and tail is not null").distinct()
    rows = [tuple(r) for r in distinct.orderBy(F.xxhash64("head", "relation", "tail"), "head", "relation", "tail").limit(most).collect()]
    rows.sort()
    return (Rotations(rows, **settings) if rows else None), rows


def link_prediction(triples: DataFrame, sampled: int = 20, seed: int = 42, **settings: float) -> Result:
    """1 less the share of sampled (head, relation) for which the model's five best tails hold one that the graph does not know; 1 below ten triples."""
    model, rows = trained(triples, **settings)
    if len(rows) < 10 or model is None:
        return Result("link_prediction", 1.0)
    import numpy as np

    names, known = list(model.entities), set(rows)
    chosen = np.random.RandomState(seed).permutation(len(rows))[:sampled]
    novel = []
    for k in chosen:
        h, r, _ = rows[k]
        best = np.argsort(-model.score(h, r), kind="stable")[:5]
        fresh = next((names[i] for i in best if (h, r, names[i]) not in known and names[i] != h), None)
        if fresh is not None and len(novel) < 10:
            novel.append(f"({h}, {r}, {fresh})")
    return Result("link_prediction", max(0.0, 1 - len(novel) / len(chosen)), novel)


def plausible(triples: DataFrame, least: float = 0.3, **settings: float) -> Result:
    """The share of the model's triples whose sigmoid score is at least ``least``."""
    model, rows = trained(triples, **settings)
    if model is None:
        return Result("triple_plausibility", 1.0)
    import numpy as np

    low = [(h, r, t) for h, r, t in rows if 1 / (1 + np.exp(-model.score(h, r)[model.entities[t]])) < least]
    return Result("triple_plausibility", 1 - len(low) / len(rows), [str(x) for x in low[:10]])


def novel(predicted: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("head", "relation", "tail")) -> DataFrame:
    """Predicted rows that the graph does not have."""
    return predicted.join(known.select(*keys).distinct(), list(keys), "left_anti")


def entity_clustering(vectors: DataFrame, limit: float = 0.1, key: str = "vec_id", label: str = "label", vector: str = "embedding", least: int = 15) -> DataFrame:
    """(vectors, outliers, near, score): 1 less 0.15 for each outlier, between 0 and 1; 1 below ``least`` vectors. Near pairs are told beside it."""
    n = vectors.agg(F.count("*").alias("vectors"))
    out = centroid_outliers(vectors, key, label, vector).agg(F.count("*").alias("outliers"))
    near = near_pairs(vectors, limit, key, label, vector).agg(F.count("*").alias("near"))
    return n.join(out).join(near).select("vectors", "outliers", "near", F.when(F.col("vectors") < least, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.15 * F.col("outliers"))).alias("score"))


def triple_plausibility(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """(score): the share of given triple scores (a column ``score``) whose sigmoid is at least ``least``."""
    p = 1 / (1 + F.exp(-F.col("score")))
    return scores.agg(F.coalesce(F.avg((p >= least).cast("double")), F.lit(1.0)).alias("score"))


def composite(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, score): the unweighted mean of (dimension, score) rows that were not skipped."""
    return scores.where(F.col("score") >= 0).groupBy(*by).agg(F.avg("score").alias("score"))


def severities(violations: DataFrame) -> DataFrame:
    """(errors, warnings, infos) of rows with a severity, whatever its case; shapes say Violation for an error."""
    s = F.lower("severity")
    return violations.agg(F.count_if(s.isin("error", "violation")).alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "info").alias("infos"))


def temporal_result(issues: list[str]) -> Result:
    """A tenth less for each issue; what has no timestamp is a warning, all else an error."""
    return Result("temporal", temporal_score(len(issues)), [("warning: " if "without timestamp" in x else "error: ") + x for x in issues])


def strict(score: float, missing_domains: int = 0, components: int = 1) -> float:
    """The documented stricter variant: 0.05 less for each relationship outside its domain, 0.1 for each component beyond the first."""
    return max(0.0, score - 0.05 * missing_domains - 0.1 * max(0, components - 1))


def consistency_checks(graph: Graph, order_types: tuple[str, ...] = ("PRECEDED", "PRECEDES"), role: str = "role") -> DataFrame:
    """(check, passed) of the stricter variant: no cycle, no duplicate, time grows along an order, one role for a person of one source."""
    spark = graph.nodes.sparkSession
    person = graph.labelled("Person").select("source", desc_probe().alias("d"), F.col("props")[role].alias("r")).where("d is not null and r is not null")
    torn = person.groupBy("source", "d").agg(F.count_distinct("r").alias("n")).where("n > 1")
    at = lambda k: graph.nodes.select(F.col("id").alias(k), F.col("props")["timestamp"].try_cast("timestamp").alias(f"t_{k}"))
    back = graph.typed(*order_types).join(at("src"), "src").join(at("dst"), "dst").where("t_src > t_dst")
    rows = [("cycles", all(on_cycles(graph, (t,)).isEmpty() for t in order_types)), ("duplicates", duplicates(graph).isEmpty()), ("order of time", back.isEmpty()), ("one role", torn.isEmpty())]
    return spark.createDataFrame(rows, "check string, passed boolean")


#: Graded probes: least score that passes, and below which a failure is an error.
GRADED = {"coherence": (0.6, 0.0), "faithfulness": (0.8, 0.5), "semantic_completeness": (0.7, 0.4), "investigative_readiness": (0.5, 0.0)}


def graded(dimension: str, judge: Callable[[str], tuple[float, str]] | None, prompt: str) -> Result:
    """An injected judge's (score, reason) of a graded dimension: nothing to say above its threshold, else an error or a warning; skipped without a judge."""
    if judge is None:
        return Result(dimension, SKIPPED, ["no judge"])
    score, reason = judge(prompt)
    passes, error = GRADED[dimension]
    score = max(0.0, min(1.0, score))
    return Result(dimension, score, [] if score >= passes else [("error: " if score < error else "warning: ") + reason])


def extended_report(results: list[Result]) -> dict:
    """composite (the mean of what ran), and first ten recommendations: Critical below 0.5, Improve below 0.7, then what each error says."""
    ran = [r for r in results if r.score >= 0]
    advice = [f"{'Critical' if r.score < 0.5 else 'Improve'}: {r.dimension} is {r.score:.2f}" for r in ran if r.score < 0.7]
    advice += [f"Fix: {v.removeprefix('error: ')}" for r in ran for v in r.violations if v.startswith("error: ")]
    return {"composite": round(mean(r.score for r in ran), 4) if ran else 0.0, "dimensions": {r.dimension: round(r.score, 4) for r in ran}, "recommendations": advice[:10]}


def report_json(results: list[Result]) -> str:
    """The report as JSON, scores to four places."""
    body = {"overall": round(overall(results), 4), "dimensions": [{"dimension": r.dimension, "score": round(r.score, 4), "skipped": r.score < 0, "violations": r.violations} for r in results], "recommendations": recommendations(results)}
    return json.dumps(body, ensure_ascii=False)


def report(results: list[Result]) -> str:
    """The scores, violations and recommendations as text."""
    lines = [f"overall {overall(results):.4f}"] + [f"{r.dimension} " + ("skipped" if r.score < 0 else f"{r.score:.4f}") for r in results]
    return "\n".join(lines + [f"- {v}" for r in results for v in r.violations[:10]] + [f"* {x}" for x in recommendations(results)[:10]])
