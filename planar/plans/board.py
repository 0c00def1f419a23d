"""The whole analysis of boards: elements to components, as one chain of relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from planar.operators import classify, graph, recognize, semantic
from planar.sources.templates import TEMPLATES


@dataclass
class Analysis:
    classified: DataFrame
    judged: DataFrame
    pads: DataFrame
    vias: DataFrame
    holes: DataFrame
    semantics: DataFrame
    low_level_footprints: DataFrame
    footprints: DataFrame
    components: DataFrame


def analyze(elements: DataFrame, layers: DataFrame, templates: list[dict] = TEMPLATES) -> Analysis:
    """Relations of every stage; those that several stages read are written once. Footprints use all pads, also those that count as vias."""
    limits = classify.size_limits(elements)
    prims = classify.classified(elements)
    judged = classify.candidates(prims, limits)
    pads = graph.written(classify.distinct_pads(judged.where("reason = 'None'")), "pads")
    vias, holes = classify.vias(pads), classify.holes(elements, pads, limits)
    rest = pads.join(vias.select("doc_id", "element_ord"), ["doc_id", "element_ord"], "left_anti")
    solved = graph.written(recognize.metrics(recognize.clustered(pads)), "clusters")
    footprints = recognize.footprints(solved, templates)
    return Analysis(prims, judged, pads, vias, holes, semantic.semantics(elements, layers, pads, vias, holes, prims), recognize.low_level_footprints(rest, limits), footprints, recognize.components(footprints, elements.where("kind = 'Text'")))
